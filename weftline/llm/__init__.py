"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries`` and
``oracle_sql`` are what ``__spark_entry__.py`` registers when it is present.
"""

from weftline.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
