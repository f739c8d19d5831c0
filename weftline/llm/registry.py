"""The queries of the subpackage, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that offer QUERIES and, where SQL can express them, ORACLES.
MODULES = ("q_mixing", "q_language", "q_toxicity", "q_simhash", "q_bpe", "q_chat", "q_suffix", "q_search", "q_quality", "q_vectors")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"weftline.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"weftline.llm.{m}"), "ORACLES", {}).items()}
