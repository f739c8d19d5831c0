"""op1: the mixing schedule of the whole of documents."""

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.mixing import LONGEST, mixed
from weftline.llm.shared import table

QUANTUM, BLOCK = 1000, 16


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows are mixed: their digests decide the order. Texts aren't carried along."""
    return mixed(table(spark, sf_dir, "documents"), quantum=QUANTUM, block=BLOCK, carry=["doc_id", "source"])


QUERIES = {"op1_pfair_mixing": op1_pfair_mixing}
ORACLES = {
    "op1_pfair_mixing": f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src, md5(concat_ws('|', doc_id, source, text, lang, n_chars)) AS h FROM documents),
d AS (SELECT doc_id, source, src, row_number() OVER (PARTITION BY src ORDER BY h, doc_id) - 1 AS k FROM r),
c AS (SELECT src, greatest(1, floor(sqrt(count(*))))::BIGINT AS r FROM r GROUP BY src),
w AS (SELECT src, CASE WHEN n = 1 THEN 1 ELSE greatest(1, (2 * parts * r + t) // (2 * t)) END::BIGINT AS w
  FROM c, (SELECT count(*) AS n, sum(r)::BIGINT AS t, greatest({QUANTUM}, least({LONGEST}, sum(r)::BIGINT // min(r))) AS parts FROM c)),
s AS (SELECT list(src ORDER BY src) AS names, list(w ORDER BY src) AS ws, sum(w)::BIGINT AS q FROM w),
-- before slot t, source j has had ks[j] blocks; of those released the one due first goes
e AS (
  SELECT 0::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS ks, 0 AS i, false AS had FROM s
  UNION ALL
  SELECT CASE WHEN had THEN t + 1 ELSE t END,
    CASE WHEN had THEN list_transform(ks, lambda v, j: v + (j = i)::BIGINT) ELSE ks END,
    CASE WHEN had THEN 0 ELSE list_sort(list_filter(list_transform(ws, lambda x, j: CASE WHEN ks[j] * q // x <= t THEN [((ks[j] + 1) * q + x - 1) // x, j] END), lambda y: y IS NOT NULL))[1][2]::INT END,
    NOT had
  FROM e, s WHERE t < q),
slots AS (SELECT names[i] AS src, ks[i] AS nth, t FROM e, s WHERE had),
b AS (SELECT d.*, k // {BLOCK} AS b, w, q FROM d JOIN w USING (src), s)
SELECT doc_id, source, b AS mix_block, b * q // w AS mix_release, ((b + 1) * q + w - 1) // w AS mix_due, b // w * q + t AS mix_slot,
  row_number() OVER (ORDER BY b // w * q + t, k) AS mix_position
FROM b JOIN slots ON slots.src = b.src AND slots.nth = b % w
"""
}
