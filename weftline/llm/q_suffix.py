"""op7: bytes left in the whole of documents once repeated 200-byte strings are gone."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.shared import table
from weftline.llm.suffix import digests


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), length=200)


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
