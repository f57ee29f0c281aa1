"""Facts: each customer's order priority as a chain of validity intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.temporal import intersects, valid_at
from ..operators import chains
from .registry import query, read

AS_OF = "1995-06-17"
FACTS = """f AS (SELECT o_custkey AS entity, 'priority' AS attribute, o_orderpriority AS value, o_orderdate AS valid_from, o_orderkey AS seq FROM orders),
c AS (SELECT *, lag(lower(value)) OVER (PARTITION BY entity ORDER BY valid_from, seq) AS b FROM f),
v AS (SELECT entity, attribute, value, valid_from, seq, lead(valid_from) OVER w AS valid_to, lead(seq) OVER w AS superseded_by, CAST(row_number() OVER w AS INTEGER) AS version
      FROM c WHERE b IS NULL OR b <> lower(value) WINDOW w AS (PARTITION BY entity ORDER BY valid_from, seq))"""


def facts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("entity"), F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("value"), F.col("o_orderdate").alias("valid_from"), F.col("o_orderkey").alias("seq"))


@query(f"WITH {FACTS} SELECT entity, value, valid_from, valid_to, seq, superseded_by, version FROM v")
def scd2_chain(spark, sf_dir):
    return chains.build(facts(spark, sf_dir)).select("entity", "value", "valid_from", "valid_to", "seq", "superseded_by", "version")


@query(f"""WITH {FACTS}, e AS (SELECT entity, arg_max(value, (valid_from, seq)) FILTER (valid_from <= TIMESTAMP '{AS_OF}') AS e, arg_min(value, (valid_from, seq)) AS f,
    bool_or(valid_from <= TIMESTAMP '{AS_OF}') AS found FROM v GROUP BY entity) SELECT entity, CASE WHEN found THEN e ELSE f END AS value, found FROM e""")
def asof_lookup(spark, sf_dir):
    return chains.as_of(chains.build(facts(spark, sf_dir)), F.lit(AS_OF).cast("timestamp_ntz")).select("entity", "value", "found")


@query(f"WITH {FACTS} SELECT entity, value, seq FROM v WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR TIMESTAMP '{AS_OF}' < valid_to)")
def valid_at_time(spark, sf_dir):
    return chains.build(facts(spark, sf_dir)).where(valid_at(F.lit(AS_OF).cast("timestamp_ntz"), F.col("valid_from"), F.col("valid_to"))).select("entity", "value", "seq")


@query(f"WITH {FACTS} SELECT entity, value, seq FROM v WHERE TIMESTAMP '1995-12-31 23:59:59' >= valid_from AND (valid_to IS NULL OR TIMESTAMP '1995-01-01' < valid_to)")
def interval_overlap(spark, sf_dir):
    start, end = (F.lit(x).cast("timestamp_ntz") for x in ("1995-01-01", "1995-12-31 23:59:59"))
    return chains.build(facts(spark, sf_dir)).where(intersects(start, end, F.col("valid_from"), F.col("valid_to"))).select("entity", "value", "seq")


@query(f"""WITH {FACTS} SELECT entity, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE (count(*) - 1) / greatest((epoch(max(valid_from)) - epoch(min(valid_from))) / 86400.0, 1.0) END, 9) AS volatility FROM f GROUP BY entity""")
def chain_volatility(spark, sf_dir):
    return chains.volatility(facts(spark, sf_dir)).select("entity", "n", F.round("volatility", 9).alias("volatility"))


@query(f"""WITH {FACTS} SELECT entity, arg_min(value, version) AS head, arg_max(value, version) AS tail, max(value) FILTER (version = n - 1) AS previous, CAST(max(n) AS INTEGER) AS length
    FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM v) GROUP BY entity""")
def chain_head_tail(spark, sf_dir):
    return chains.ends(chains.build(facts(spark, sf_dir))).select("entity", "head", "tail", "previous", "length")


@query(f"WITH {FACTS} SELECT entity, seq, max(valid_from) OVER (PARTITION BY entity ORDER BY seq) AS valid_from FROM f")
def late_fact_clamp(spark, sf_dir):
    return chains.clamp(facts(spark, sf_dir)).select("entity", "seq", "valid_from")


@query(f"WITH {FACTS} SELECT entity, lower(value) AS value, min(valid_from) AS valid_from, count(*) AS mentions, array_to_string(list(CAST(seq AS VARCHAR) ORDER BY valid_from, seq), ',') AS sources FROM f GROUP BY 1, 2")
def merge_sources(spark, sf_dir):
    sourced = facts(spark, sf_dir).withColumn("sources", F.array(F.col("seq").cast("string")))
    return chains.merged(sourced).select("entity", "value", "valid_from", "mentions", F.array_join("sources", ",").alias("sources"))


MODES = ("whole_chain", "before_latest", "interval", "now", "none")


@query(f"""WITH {FACTS}, q AS (SELECT DISTINCT entity, ['whole_chain', 'before_latest', 'interval', 'now', 'none'][entity % 5 + 1] AS mode FROM f),
j AS (SELECT v.*, mode, count(*) OVER k AS n, row_number() OVER o AS i, valid_from <= TIMESTAMP '1995-12-31 23:59:59' AND (valid_to IS NULL OR TIMESTAMP '1995-01-01' < valid_to) AS hit,
    (epoch(max(valid_from) OVER k) - epoch(min(valid_from) OVER k)) / 86400.0 AS span, first_value(value) OVER o AS head, last_value(value) OVER (PARTITION BY v.entity ORDER BY valid_from, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail
    FROM v JOIN q USING (entity) WINDOW k AS (PARTITION BY v.entity), o AS (PARTITION BY v.entity ORDER BY valid_from, seq)),
x AS (SELECT *, bool_or(hit) OVER (PARTITION BY entity) AS any_hit, sum((valid_from <= TIMESTAMP '1995-12-31 23:59:59')::INT) OVER (PARTITION BY entity) AS early,
    (n - 1) / greatest(span, 1.0) < 1.0 / 30 AND lower(head) <> lower(tail) AS suspect FROM j)
SELECT entity, mode, seq, value FROM x WHERE CASE WHEN n = 1 THEN true WHEN mode = 'whole_chain' THEN true WHEN mode = 'before_latest' THEN i >= n - 1
    WHEN mode = 'interval' THEN CASE WHEN any_hit THEN hit ELSE i = greatest(early, 1) END ELSE i = n OR (suspect AND i = 1) END""")
def temporal_nodes(spark, sf_dir):
    """Every customer asks one question, whose mode is dealt by key; speakers aren't the user."""
    versions = chains.build(facts(spark, sf_dir)).select("*", F.lit("clerk").alias("speaker"), F.lit("stated").alias("kind"))
    asked = versions.select("entity", "attribute").distinct().select(F.col("entity").alias("question_id"), "entity", "attribute", F.get(F.array(*map(F.lit, MODES)), (F.col("entity") % 5).cast("int")).alias("mode"), F.lit("1995-01-01").cast("timestamp_ntz").alias("start"), F.lit("1995-12-31 23:59:59").cast("timestamp_ntz").alias("end"))
    return chains.select_nodes(versions, asked).join(asked.select("question_id", "mode"), "question_id").select("entity", "mode", "seq", "value")


@query(f"""WITH {FACTS}, h AS (SELECT entity, seq, 1.0 / (1 + seq % 7) AS rel FROM v WHERE version = 1), t AS (SELECT entity, arg_max(seq, version) AS seq FROM v GROUP BY entity),
u AS (SELECT entity, seq, rel FROM h UNION ALL SELECT t.entity, t.seq, CASE WHEN t.seq = h.seq THEN h.rel ELSE h.rel * 0.9 END FROM t JOIN h USING (entity))
SELECT entity AS question_id, seq, round(max(rel), 9) AS rel FROM u GROUP BY 1, 2""")
def resolve_chains(spark, sf_dir):
    """A question without a cue hits each chain's head; the tail joins it with 0.9 of its relevance."""
    versions = chains.build(facts(spark, sf_dir)).select("*", F.lit("user").alias("speaker"), F.lit("stated").alias("kind"))
    none = F.lit(None).cast("timestamp_ntz")
    asked = versions.select("entity", "attribute").distinct().select(F.col("entity").alias("question_id"), "entity", "attribute", F.lit("none").alias("mode"), none.alias("start"), none.alias("end"))
    hits = versions.where("version = 1").select(F.col("entity").alias("question_id"), "seq", (1.0 / (1 + F.col("seq") % 7)).alias("rel"), F.lit("none").alias("mode"))
    return chains.resolve(hits, versions, chains.select_nodes(versions, asked)).select("question_id", "seq", F.round("rel", 9).alias("rel"))
