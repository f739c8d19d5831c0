"""op6: the maximal conversations of the whole of conversations, rendered."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.chat import chat
from weftline.llm.shared import table


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat(table(spark, sf_dir, "conversations"))


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLES = {
    "op6_chat_format": """
WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
c AS (SELECT conv_id, count(*) AS n, list(row(role, text) ORDER BY place) AS turns FROM t GROUP BY conv_id),
kept AS (SELECT a.conv_id, a.n FROM c a WHERE NOT EXISTS (
  SELECT 1 FROM c b WHERE a.conv_id IS DISTINCT FROM b.conv_id AND (b.n > a.n OR b.n = a.n AND b.conv_id < a.conv_id) AND b.turns[1:a.n] = a.turns))
SELECT t.conv_id, ((place - 1) // 256)::BIGINT AS segment, kept.n::BIGINT AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY t.conv_id, segment, kept.n
"""
}
