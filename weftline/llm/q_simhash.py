"""op4: SimHash components of the whole of documents."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.shared import table
from weftline.llm.simhash import simhash_components


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=4, radius=4)


QUERIES = {"op4_simhash": op4_simhash}
