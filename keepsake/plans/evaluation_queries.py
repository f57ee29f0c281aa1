"""Evaluation analytics on records made of labels and documents: quality is right, toxic is abstained, language the stratum."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from .registry import query, read

RECORDS = """r AS (SELECT l.doc_id, CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE l.quality = 1 END AS correct, l.toxic = 1 AS abstained, lang AS stratum, l.doc_id % 5 = 0 AS is_abstention, l.doc_id % 4 AS n_evidence,
    least(l.doc_id % 4, l.doc_id % 3) AS n_written, least(l.doc_id % 4, l.doc_id % 2) AS n_survived, least(l.doc_id % 4, l.doc_id % 2) AS n_injected, least(l.doc_id % 4, l.doc_id % 2, l.doc_id % 3) AS n_survived_strict, l.doc_id % 6 // 5 AS invalid_citations, n_chars % 2000 AS injected_tokens, n_chars // 8 AS store_tokens, n_chars // 4 AS history_tokens FROM labels l JOIN documents USING (doc_id))"""


def records(spark, sf_dir):
    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    k = F.col("doc_id")
    return j.select(
        "doc_id", F.when(k % 9 != 0, F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("abstained"), F.col("lang").alias("stratum"), (k % 5 == 0).alias("is_abstention"), (k % 4).alias("n_evidence"),
        F.least(k % 4, k % 3).alias("n_written"), F.least(k % 4, k % 2).alias("n_survived"), F.least(k % 4, k % 2).alias("n_injected"), F.least(k % 4, k % 2, k % 3).alias("n_survived_strict"), F.floor(k % 6 / 5).alias("invalid_citations"), (F.col("n_chars") % 2000).alias("injected_tokens"), F.floor(F.col("n_chars") / 8).alias("store_tokens"), F.floor(F.col("n_chars") / 4).alias("history_tokens"),
    )


@query(f"""WITH {RECORDS} SELECT stratum, count(*) AS n, count(correct) AS n_judged, round(avg(correct::INT), 6) AS accuracy, round(avg(n_written / nullif(n_evidence, 0)) FILTER (NOT is_abstention), 6) AS write_rate, round(avg(n_survived / nullif(n_evidence, 0)) FILTER (NOT is_abstention), 6) AS survival_rate, round(avg(n_survived_strict / nullif(n_evidence, 0)) FILTER (NOT is_abstention), 6) AS survival_rate_strict, round(avg((invalid_citations > 0)::INT), 6) AS invalid_citation_rate,
round(avg(n_injected / nullif(n_evidence, 0)) FILTER (NOT is_abstention), 6) AS injection_rate, round(avg(abstained::INT) FILTER (is_abstention), 6) AS correct_abstention, round(avg(abstained::INT) FILTER (NOT is_abstention), 6) AS false_abstention,
round(avg(injected_tokens), 6) AS tokens_per_query, round(avg(store_tokens / nullif(history_tokens, 0)), 6) AS store_fraction FROM r GROUP BY GROUPING SETS ((), (stratum))""")
def metric_rates(spark, sf_dir):
    return evaluation.metrics(records(spark, sf_dir))


@query("""WITH i AS (SELECT doc_id AS id, lang AS stratum FROM documents), s AS (SELECT stratum, count(*) AS size FROM i GROUP BY 1), q AS (SELECT stratum, 100.0::DOUBLE * size / sum(size) OVER () AS q FROM s), p AS (SELECT stratum, floor(q) AS base, q - floor(q) AS rest FROM q),
k AS (SELECT stratum, base + (row_number() OVER (ORDER BY rest DESC, stratum) <= 100 - sum(base) OVER ())::INT AS quota FROM p) SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('0:' || id), id) <= quota AS dev FROM i JOIN k USING (stratum)""")
def stratified_split(spark, sf_dir):
    return evaluation.stratified_split(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum")), 100)


_HEX = "list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda p: (strpos('0123456789abcdef', substr(md5('0:' || rep || ':' || i), p, 1)) - 1)::BIGINT)), lambda a, d: a * 16 + d)"


@query(f"""WITH v AS (SELECT lang AS grp, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, quality::DOUBLE AS v FROM labels JOIN documents USING (doc_id)), n AS (SELECT grp, count(*) AS n, avg(v) AS mean FROM v GROUP BY grp),
d AS (SELECT v.grp, rep, {_HEX} % n AS i FROM v JOIN n USING (grp), range(0, 1000) t(rep)), m AS (SELECT d.grp, rep, round(avg(v), 9) AS m FROM d JOIN v ON v.grp = d.grp AND v.i = d.i GROUP BY 1, 2),
o AS (SELECT grp, m, row_number() OVER (PARTITION BY grp ORDER BY m, rep) - 1 AS k FROM m) SELECT grp, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(max(m) FILTER (k = 25), 6) AS lo, round(max(m) FILTER (k = 975), 6) AS hi FROM o JOIN n USING (grp) GROUP BY grp""")
def bootstrap_ci(spark, sf_dir):
    return evaluation.bootstrap(_quality_by_lang(spark, sf_dir))


def _quality_by_lang(spark, sf_dir):
    from pyspark.sql import Window as W

    j = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.select(F.col("lang").alias("grp"), (F.row_number().over(W.partitionBy("lang").orderBy("doc_id")) - 1).cast("long").alias("i"), F.col("quality").cast("double").alias("v"))


@query("""WITH e AS (SELECT doc_id % 50 AS question_id, doc_id AS id FROM documents) SELECT question_id, count(*) AS n_evidence, count(*) FILTER (id % 2 = 0) AS n_written, count(*) FILTER (id % 3 = 0) AS n_survived, count(*) FILTER (id % 6 = 0) AS n_injected FROM e GROUP BY 1""")
def evidence_sets(spark, sf_dir):
    e = read(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("question_id"), F.col("doc_id").alias("id"))
    return evaluation.evidence_counts(e, e.where("id % 2 = 0"), e.where("id % 3 = 0"), e.where("id % 6 = 0"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1000000000 WHEN 1 THEN greatest(floor(0.25 * n_chars), 1)::BIGINT ELSE 500 END AS budget FROM documents")
def budget_resolve(spark, sf_dir):
    b = F.when(F.col("doc_id") % 3 == 1, 0.25).when(F.col("doc_id") % 3 == 2, 500.0)
    return read(spark, sf_dir, "documents").select("doc_id", evaluation.resolve_budget(b, F.col("n_chars")).alias("budget"))


@query("SELECT d.doc_id, lang FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id")
def resume_pending(spark, sf_dir):
    """What a resumed run still has to do: items without a record."""
    from ..sources.caches import missing

    return missing(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


_NAMES = """w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM benchmark),
f AS (SELECT 'item_' || item_id AS entity, unnest(w) AS attribute FROM w UNION SELECT 'item_' || item_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w),
n AS (SELECT 'attribute' AS kind, entity, attribute AS name FROM f UNION SELECT 'entity', NULL, entity FROM f)"""


@query(f"""WITH {_NAMES} SELECT x.kind, x.entity, x.name AS a, y.name AS b FROM n x JOIN n y ON x.kind = y.kind AND x.entity IS NOT DISTINCT FROM y.entity AND x.name < y.name
AND (starts_with(x.name, y.name || '_') OR ends_with(x.name, '_' || y.name) OR starts_with(y.name, x.name || '_') OR ends_with(y.name, '_' || x.name))""")
def key_drift(spark, sf_dir):
    """Names of which one begins or ends the other at a '_'; key_drift_names has close spellings too."""
    return evaluation.key_drift(_names(spark, sf_dir), None)


@query()
def key_drift_names(spark, sf_dir):
    """Close names, whole. The sequence ratio has no SQL."""
    return evaluation.key_drift(_names(spark, sf_dir))


def _names(spark, sf_dir):
    """Each test item as an entity, its words and pairs of neighbours as attributes."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    w = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("entity"), words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))), lambda i: F.concat_ws("_", F.get("w", i - 1), F.get("w", i)))
    both = F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))
    return w.select("entity", F.explode(F.array_distinct(both)).alias("attribute"))


@query("SELECT doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 EXCEPT ALL SELECT doc_id FROM labels WHERE toxic = 1)")
def evicted_diff(spark, sf_dir):
    l = read(spark, sf_dir, "labels")
    return l.where("quality = 1").select("doc_id").exceptAll(l.where("toxic = 1").select("doc_id"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)) AS either, (SELECT count(*) FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1)) AS both")
def id_set_algebra(spark, sf_dir):
    l = read(spark, sf_dir, "labels")
    flags = l.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    return flags.agg(F.sum(F.greatest("q", "t")).cast("long").alias("either"), F.sum(F.least("q", "t")).cast("long").alias("both"))


@query("SELECT doc_id, (doc_id % 7 = 0) OR (doc_id % 10 < 4 AND len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), ['that', 'with', 'from', 'this'])) = 0) AS abstain FROM documents")
def abstain(spark, sf_dir):
    from ..functions.text import strings

    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))
    rule = evaluation.should_abstain(F.when(F.col("doc_id") % 7 == 0, 0).otherwise(1), (F.col("doc_id") % 10) / 10.0, 0.4, strings(["that", "with", "from", "this"]), words)
    return read(spark, sf_dir, "documents").select("doc_id", rule.alias("abstain"))
