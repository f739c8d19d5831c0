"""op9: quality of the whole of documents."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.quality import quality
from weftline.llm.shared import table


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}
