"""Retrieval of documents for the benchmark's items, and packing what is found."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import count_tokens, tokens
from ..operators import packing, retrieval, selection
from .registry import query, read

BM25 = """w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS m FROM w),
a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark), p AS (SELECT id, len(t) AS l, unnest(t) AS term FROM w),
tf AS (SELECT id, term, count(*) AS tf, any_value(l) AS l FROM p WHERE term IN (SELECT term FROM a) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / m))), 6) AS score FROM tf JOIN a USING (term) JOIN df USING (term), st GROUP BY 1, 2),
bm AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM sc WHERE score > 0)"""
LEX = """, ov AS (SELECT b.item_id AS query_id, d.id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')), list_distinct(d.t))) / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+'))), 1), 6) AS cosine FROM benchmark b, w d),
ds AS (SELECT query_id, id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) - 1 AS rank FROM ov WHERE cosine > 0),
fu AS (SELECT query_id, id, sum(1.0 / (60 + rank + 1)) AS rrf FROM (SELECT query_id, id, rank FROM bm WHERE rank < 30 UNION ALL SELECT query_id, id, rank FROM ds WHERE rank < 30) GROUP BY 1, 2)"""


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _asked(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {BM25} SELECT query_id, id, score, rank::INTEGER AS rank FROM bm WHERE rank < 30")
def bm25_topk(spark, sf_dir):
    return retrieval.bm25(_docs(spark, sf_dir), _asked(spark, sf_dir), 30)


@query(f"WITH {BM25}, al AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS r FROM bm WHERE id % 7 = 0) SELECT query_id, id, score, r::INTEGER AS rank FROM al WHERE r < 30")
def bm25_allowed(spark, sf_dir):
    """Statistics of all documents, scores of an allowed set."""
    docs = _docs(spark, sf_dir)
    return retrieval.bm25(docs, _asked(spark, sf_dir), 30, docs.where("id % 7 = 0").select("id"))


def _channels(spark, sf_dir):
    """Two channels of 30 a query: BM25, and the share of the query's words for a cosine."""
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    return retrieval.bm25(docs, asked, 30), retrieval.overlap(docs, asked, 30).withColumnRenamed("score", "cosine")


def _cosines(spark, sf_dir, found):
    """query_id, id, cosine of what was found, however it ranks by that."""
    texts = found.select("query_id", "id").join(_docs(spark, sf_dir), "id").join(_asked(spark, sf_dir).withColumnRenamed("text", "q"), "query_id")
    words, own = F.array_distinct(tokens(F.col("q"))), F.array_distinct(tokens(F.col("text")))
    return texts.select("query_id", "id", F.round(F.size(F.array_intersect(words, own)) / F.greatest(F.size(words), F.lit(1)), 6).alias("cosine"))


@query(f"WITH {BM25}{LEX} SELECT query_id, id, round(rrf, 9) AS rrf FROM fu")
def rrf_fusion(spark, sf_dir):
    a, b = _channels(spark, sf_dir)
    return retrieval.fuse(a, b).select("query_id", "id", F.round("rrf", 9).alias("rrf"))


@query(f"WITH {BM25}{LEX} SELECT query_id, fu.id, round(0.7 * coalesce(cosine, 0) + 0.3 * rrf / max(rrf) OVER (PARTITION BY query_id), 6) AS rel FROM fu LEFT JOIN ov USING (query_id, id)")
def relevance_blend(spark, sf_dir):
    fused = retrieval.fuse(*_channels(spark, sf_dir))
    return retrieval.blend(fused, _cosines(spark, sf_dir, fused)).select("query_id", "id", F.round("rel", 6).alias("rel"))


@query(f"""WITH {BM25}{LEX}, rl AS (SELECT query_id, fu.id, round(0.7 * coalesce(cosine, 0) + 0.3 * rrf / max(rrf) OVER (PARTITION BY query_id), 6) AS rel FROM fu LEFT JOIN ov USING (query_id, id)),
o AS (SELECT query_id, rel, lead(rel) OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS nx, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS r FROM rl),
c AS (SELECT query_id, CASE WHEN nx IS NULL THEN 1 ELSE (rel - nx) / greatest(rel, 1e-6) END AS c FROM o WHERE r = 1)
SELECT query_id, round(c, 6) AS confidence, floor(2000 * least(0.5, greatest(0.2, 1 - c)))::INTEGER AS hop2 FROM c""")
def hop_budget(spark, sf_dir):
    rel = relevance_blend(spark, sf_dir)
    return retrieval.hop_share(rel, 2000).select("query_id", F.round("confidence", 6).alias("confidence"), "hop2")


_COST = "greatest(1, (length(text) + 3) // 4)"


@query(f"""WITH RECURSIVE i AS (SELECT source, doc_id, {_COST} AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT source, 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS id, -1 AS position FROM (SELECT DISTINCT source FROM documents)
  UNION ALL SELECT i.source, i.r, CASE WHEN used + cost <= 4000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 4000 THEN doc_id END, CASE WHEN used + cost <= 4000 THEN position + 1 ELSE position END FROM p JOIN i ON i.source = p.source AND i.r = p.r + 1)
SELECT source, position::INTEGER AS position, id FROM p WHERE id IS NOT NULL""")
def pack_topk_skipfit(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), count_tokens(F.col("text")).alias("cost"))
    return packing.skip_fit(d, "source", 4000, F.col("id"))


@query(f"SELECT source, doc_id AS id, used FROM (SELECT source, doc_id, sum({_COST}) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 4000")
def pack_prefix(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("id"), count_tokens(F.col("text")).alias("cost"))
    return packing.prefix(d, "source", 4000, "id").select("source", "id", "used")


@query(f"SELECT source AS memory, doc_id AS seq, newer FROM (SELECT source, doc_id, sum({_COST}) OVER (PARTITION BY source ORDER BY doc_id DESC)::BIGINT AS newer FROM documents WHERE {_COST} <= 4000) WHERE newer <= 4000")
def fifo_survivors(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("memory"), F.col("doc_id").alias("seq"), count_tokens(F.col("text")).alias("cost"))
    return selection.fifo_survivors(d, 4000).select("memory", "seq", "newer")


@query(f"""WITH c AS (SELECT source, doc_id, {_COST} AS cost, doc_id % 3 = 0 AS cons FROM documents), o AS (SELECT source, doc_id, coalesce(sum(cost) OVER (PARTITION BY source ORDER BY cons DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c)
SELECT source AS memory, doc_id AS id FROM o WHERE b < 3000""")
def evict_order(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("memory"), F.col("doc_id").alias("id"), count_tokens(F.col("text")).alias("cost"), (F.col("doc_id") % 3 == 0).alias("consolidated"))
    return selection.evict_order(d, 3000, "id").select("memory", "id")


@query(f"SELECT source AS memory, CAST(doc_id // 5 AS VARCHAR) AS unit, greatest(sum({_COST}), 1)::BIGINT AS cost, count(*) AS members, bool_and(doc_id % 3 = 0) AS consolidated FROM documents GROUP BY 1, 2")
def evict_units(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("memory"), F.floor(F.col("doc_id") / 5).cast("string").alias("chain"), F.col("doc_id").cast("string").alias("id"), count_tokens(F.col("text")).alias("cost"), (F.col("doc_id") % 3 == 0).alias("consolidated"))
    return selection.units(d).withColumn("cost", F.col("cost").cast("long"))


@query("SELECT round(0.0003 * pow(2, i), 9) AS threshold FROM range(0, 11) t(i)")
def sieve_thresholds(spark, sf_dir):
    return spark.range(1).select(F.explode(selection.thresholds(0.0003, 0.5, 2.0)).alias("t")).select(F.round("t", 9).alias("threshold"))


def candidates(spark, sf_dir):
    """query_id, q, id, text: every item with the documents that fusion over all documents finds for it."""
    found = rrf_fusion(spark, sf_dir).select("query_id", "id")
    return found.join(_asked(spark, sf_dir).withColumnRenamed("text", "q"), "query_id").join(_docs(spark, sf_dir), "id")


@query(f"""WITH {BM25}{LEX}, l AS (SELECT query_id, fu.id, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS q, string_split(d.text, chr(10)) AS ls FROM fu JOIN documents d ON d.doc_id = fu.id JOIN benchmark b ON b.item_id = fu.query_id),
x AS (SELECT query_id, id, q, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l), s AS (SELECT query_id, id, line, i, len(list_intersect(list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')), list_distinct(q))) AS n FROM x)
SELECT query_id AS item_id, id AS doc_id, arg_max(line, (n, -i)) AS line FROM s GROUP BY 1, 2""")
def best_line(spark, sf_dir):
    """Of the documents that rank fusion finds for each test item."""
    c = candidates(spark, sf_dir)
    return c.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), packing.best_line(F.col("text"), tokens(F.col("q"))).alias("line"))
