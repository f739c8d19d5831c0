"""op5: byte-level BPE over the whole of documents."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm.bpe import bpe
from weftline.llm.shared import table


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
