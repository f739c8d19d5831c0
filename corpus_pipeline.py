"""A training corpus from raw documents, in five stages.

Each stage is (name, function); the function takes (spark, docs, sf_dir), where docs is
what the stage before it wrote (first: documents), and returns a DataFrame. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.bpe import bpe
from weftline.llm.mixing import KEYS, interleaved, places, with_places
from weftline.llm.quality import good
from weftline.llm.shared import shared_folder, table
from weftline.llm.simhash import distinct_documents
from weftline.llm.suffix import cleaned
from weftline.sources.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labels, doesn't reject."""
    return good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return distinct_documents(docs, width=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that stand elsewhere too; n_chars follows the text."""
    return cleaned(docs, length=200).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' blocks interleave; their places are noted for what follows."""
    return interleaved(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, with the mix_slot and mix_position that the mixing gave it.

    Files don't keep the order of rows, so the place in the mixing is a column. Documents that no mixing has placed are mixed here.
    """
    keys, found = places(docs)
    out = bpe(docs.select("doc_id", "text", *keys), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=KEYS)
    return with_places(out, found)


STAGES = [("quality", quality), ("near copies", near_copies), ("repeats", repeats), ("mixing", mixing), ("tokens", tokens)]

#: Classifiers, fingerprints, suffix arrays and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns; each stage's rows are written as Parquet and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/weftline-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
