"""MySQL SELECT text as Spark SQL: a tokenizer and the rewrites below; whatever they don't list is passed through."""

from tidemark.dialect.rewrite import translate

__all__ = ["translate"]
