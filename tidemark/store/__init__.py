"""Versioned Parquet tables: definitions, data changes, constraints, snapshots and transactions."""

from tidemark.store.engine import Column, ConstraintError, Engine, ForeignKey, TableDef

__all__ = ["Column", "ConstraintError", "Engine", "ForeignKey", "TableDef"]
