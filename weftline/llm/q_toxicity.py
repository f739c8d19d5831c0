"""op3: toxicity of the whole of documents."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.shared import table
from weftline.llm.toxicity import toxicity


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
