"""The thin contract queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, bpe, mixing, neardup, pii, pivots, quality, suffixes, toxicity, warc
from .common import table
from .nets import fold

TOXIC_FOLDS, TOXIC_HELD, QUALITY_FOLDS, QUALITY_HELD = 3, 1, 5, 0


def _held(folds: int, held: int):
    return F.coalesce(fold(folds) == held, F.lit(False))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~_held(TOXIC_FOLDS, TOXIC_HELD))
    return toxicity.score(docs, net).withColumn("held_out", _held(TOXIC_FOLDS, TOXIC_HELD)).select("doc_id", "held_out", "score", "predicted", "lang_threshold", "lang_predicted")


def op2_neardup(spark, sf_dir):
    return neardup.dedup(table(spark, sf_dir, "documents"), threshold=0.85)


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~_held(QUALITY_FOLDS, QUALITY_HELD))
    return quality.score(docs.select("doc_id", "text"), net).select("doc_id", _held(QUALITY_FOLDS, QUALITY_HELD).alias("held_out"), "score", "predicted")


def op4_suffixes(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op5_pivots(spark, sf_dir):
    return pivots.search(table(spark, sf_dir, "embeddings"))


def op6_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op9_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def queries():
    return {f.__name__: f for f in (op1_toxicity, op2_neardup, op3_quality, op4_suffixes, op5_pivots, op6_pii, op7_warc, op8_bpe, op9_ann, op10_mixing)}


#: Links by all pairs that share a shingle, and what each document reaches.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets), sh AS (SELECT doc_id, unnest(s) AS s FROM sets),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id AS v, doc_id AS m FROM n UNION SELECT b, m FROM r JOIN both_ways ON v = a)
SELECT n.doc_id, n.n AS n_shingles, min(m) AS component_id, min(m) = n.doc_id AS kept FROM n JOIN r ON r.v = n.doc_id GROUP BY n.doc_id, n.n
"""

#: What the archives hold follows from the pages alone.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, html, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) >> (15 - 5 * j)) & 31 AS INTEGER) + 1, 1) FOR j IN range(4)], '') FOR i IN range(8)], '') AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM m
"""

#: Rows of op5 are the exact ranks, so SQL over all pairs of a query and a vector gives them.
OP5_SQL = """
WITH u AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

#: Water-filling in closed form: sources by cap over weight, of which the first few are clamped; then the seeded order by digest.
OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
o AS (
  SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS held,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, sum(CAST(source_size AS DOUBLE)) OVER () AS total FROM w
), l AS (SELECT (total - held) / rest AS level FROM o WHERE (total - held) / rest <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM w, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
x AS (SELECT *, greatest(round(target) - whole * source_size, 0) AS extra FROM e),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, p.source, x.source_size, x.target, CAST(x.whole * p.size + least(greatest(x.extra - p.before, 0), p.size) AS BIGINT) AS taken
FROM p JOIN x ON p.source IS NOT DISTINCT FROM x.source
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_neardup": OP2_SQL, "op5_pivots": OP5_SQL, "op7_warc": OP7_SQL, "op10_mixing": OP10_SQL}
