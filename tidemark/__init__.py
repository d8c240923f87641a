"""tidemark: a PySpark-native SQL analytics engine."""
