"""op2: the language of every text of documents."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.language import languages
from weftline.llm.shared import table


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"op2_language_id": op2_language_id}
