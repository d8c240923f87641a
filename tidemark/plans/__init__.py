"""Plans: helpers that run SQL over the Parquet tables, and rewrites of constructs that Spark's syntax lacks."""
