"""Vectors: coverage, search, clusters, packing and selection on embeddings; groups are labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..operators import consolidation, coverage, packing, retrieval, selection
from ..operators.kernels import Config
from .registry import query, read

SIMS = """t AS (SELECT label AS grp, vec_id AS h, embedding AS hv, 1.0 + label / 10.0 AS w FROM embeddings), s AS (SELECT grp, h AS s, hv AS sv FROM t WHERE h % 7 = 0),
x AS (SELECT grp, h, w, s, greatest(list_dot_product(hv::DOUBLE[], sv::DOUBLE[]), 0) AS sim FROM t JOIN s USING (grp)),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, h ORDER BY round(sim, 9) DESC, s) AS r FROM x),
b AS (SELECT grp, h, any_value(w) AS w, max(s) FILTER (r = 1) AS provider, max(sim) FILTER (r = 1) AS best, coalesce(max(sim) FILTER (r = 2), 0) AS second FROM r WHERE r <= 2 GROUP BY grp, h)"""


def targets(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("grp"), F.col("vec_id").alias("h"), F.col("embedding").alias("hv"), (1.0 + F.col("label") / 10.0).alias("w"))


def vectors(t):
    return t.select("grp", F.col("h").alias("s"), F.col("hv").alias("sv"))


def selected(t):
    """The store of the example: every seventh vector."""
    return vectors(t).where("s % 7 = 0")


def _sims(spark, sf_dir):
    t = targets(spark, sf_dir)
    return coverage.similarities(t, selected(t))


@query(f"WITH {SIMS} SELECT grp, round(sum(w * best), 6) AS value FROM b GROUP BY grp")
def coverage_value(spark, sf_dir):
    return coverage.value(_sims(spark, sf_dir)).select("grp", F.round("value", 6).alias("value"))


@query(f"WITH {SIMS} SELECT grp, h, provider, round(best, 6) AS best, round(second, 6) AS second FROM b")
def coverage_top2(spark, sf_dir):
    return coverage.top_two(_sims(spark, sf_dir)).select("grp", "h", "provider", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"))


@query(f"WITH {SIMS} SELECT grp, provider AS s, round(sum(w * (best - second)), 6) AS loss FROM b GROUP BY 1, 2")
def coverage_loss(spark, sf_dir):
    return coverage.losses(coverage.top_two(_sims(spark, sf_dir))).select("grp", "s", F.round("loss", 6).alias("loss"))


@query(f"""WITH {SIMS}, c AS (SELECT grp, h AS s, hv AS sv FROM t WHERE h % 7 <> 0)
SELECT c.grp, c.s, round(sum(t.w * greatest(greatest(list_dot_product(hv::DOUBLE[], sv::DOUBLE[]), 0) - coalesce(best, 0), 0)), 5) AS gain FROM c JOIN t ON c.grp = t.grp LEFT JOIN b ON b.grp = t.grp AND b.h = t.h GROUP BY 1, 2""")
def coverage_gain(spark, sf_dir):
    t = targets(spark, sf_dir)
    best = coverage.top_two(_sims(spark, sf_dir))
    return coverage.gains(vectors(t).where("s % 7 <> 0"), best, t).select("grp", "s", F.round("gain", 5).alias("gain"))


@query(f"""WITH {SIMS}, g AS (SELECT grp, h, any_value(w) AS w, max(sim) AS best, coalesce(max(sim) FILTER (s % 2 = 1), 0) AS rest FROM x GROUP BY 1, 2) SELECT grp, round(sum(w * (best - rest)), 6) AS loss FROM g GROUP BY grp""")
def coverage_set_loss(spark, sf_dir):
    t = targets(spark, sf_dir)
    return coverage.loss_of_set(t, selected(t), selected(t).where("s % 2 = 0")).select("grp", F.round("loss", 6).alias("loss"))


@query(f"""WITH {SIMS}, k AS (SELECT grp, h, max(sim) AS best FROM x WHERE s % 2 = 1 GROUP BY 1, 2), c AS (SELECT grp, h AS s, hv AS sv FROM t WHERE h % 7 <> 0)
SELECT c.grp, c.s, round(sum(t.w * greatest(greatest(list_dot_product(hv::DOUBLE[], sv::DOUBLE[]), 0) - coalesce(best, 0), 0)), 5) AS gain FROM c JOIN t ON c.grp = t.grp LEFT JOIN k ON k.grp = t.grp AND k.h = t.h GROUP BY 1, 2""")
def coverage_gain_without(spark, sf_dir):
    t = targets(spark, sf_dir)
    gone = selected(t).where("s % 2 = 0").select("grp", "s")
    return coverage.gain_without(vectors(t).where("s % 7 <> 0"), selected(t), t, gone).select("grp", "s", F.round("gain", 5).alias("gain"))


@query(f"""WITH {SIMS}, y AS (SELECT t.grp, c.h AS s, sum(t.w * greatest(list_dot_product(t.hv::DOUBLE[], c.hv::DOUBLE[]), 0)) AS single FROM t JOIN t c USING (grp) GROUP BY 1, 2)
SELECT grp, round(max(single / greatest(1 + s % 60, 20)), 6) AS ratio FROM y GROUP BY grp""")
def singleton_ratio(spark, sf_dir):
    t = targets(spark, sf_dir)
    costs = t.select("grp", F.col("h").alias("s"), (1 + F.col("h") % 60).alias("cost"))
    return coverage.max_singleton_ratio(vectors(t), t, costs).select("grp", F.round("ratio", 6).alias("ratio"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS id, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings)
SELECT query_id, id, score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 30""")
def dense_topk(spark, sf_dir):
    """Queries: all vectors whose id fifty divides, against all vectors."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.dense_topk(e, e.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vec"), 30)


@query("""WITH e AS (SELECT label AS grp, vec_id AS id, embedding AS v FROM embeddings) SELECT a.grp, a.id AS a, b.id AS b, round(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 6) AS sim
FROM e a JOIN e b ON a.grp = b.grp AND a.id < b.id WHERE round(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 6) >= 0.25""")
def near_dup_pairs(spark, sf_dir):
    return consolidation.near_pairs(_entries(spark, sf_dir), 0.25).select("grp", "a", "b", F.round("sim", 6).alias("sim"))


def _entries(spark, sf_dir):
    return targets(spark, sf_dir).select("grp", F.col("h").alias("id"), F.col("hv").alias("vec"))


def _clusters(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return consolidation.clusters(e, consolidation.links(e, 0.25))


CLUSTERS = """e AS (SELECT label AS grp, vec_id AS id, embedding AS v FROM embeddings), p AS (SELECT a.grp, a.id AS a, b.id AS b FROM e a JOIN e b ON a.grp = b.grp AND a.id <> b.id WHERE round(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 6) >= 0.25),
reach AS (SELECT grp, id, id AS via FROM e UNION SELECT reach.grp, reach.id, p.b FROM reach JOIN p ON reach.grp = p.grp AND reach.via = p.a), c AS (SELECT grp, id, min(via) AS cluster FROM reach GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {CLUSTERS} SELECT grp, id, cluster FROM c")
def threshold_clusters(spark, sf_dir):
    """At 0.25, since these vectors are nearly random."""
    return _clusters(spark, sf_dir)


@query(f"""WITH RECURSIVE {CLUSTERS}, m AS (SELECT c.*, v FROM c JOIN e USING (grp, id)), s AS (SELECT x.grp, x.cluster, x.id AS medoid, count(*) AS size, round(sum(list_dot_product(x.v::DOUBLE[], y.v::DOUBLE[])), 6) AS total FROM m x JOIN m y ON x.grp = y.grp AND x.cluster = y.cluster GROUP BY ALL HAVING count(*) >= 3)
SELECT grp, cluster, medoid, size, total FROM (SELECT *, row_number() OVER (PARTITION BY grp, cluster ORDER BY total DESC, medoid) AS r FROM s) WHERE r = 1""")
def cluster_medoid(spark, sf_dir):
    return consolidation.medoids(_entries(spark, sf_dir), _clusters(spark, sf_dir))


@query(f"WITH {SIMS}, l AS (SELECT grp AS cluster, provider, sum(w * (best - second)) AS loss, any_value(w) AS w FROM b GROUP BY 1, 2) SELECT cluster, round(avg(loss / w), 6) AS mean FROM l GROUP BY cluster HAVING round(avg(loss / w), 6) < 2")
def redundancy_trigger(spark, sf_dir):
    tops = coverage.top_two(_sims(spark, sf_dir))
    each = coverage.losses(tops).select(F.col("grp").alias("cluster"), "loss", (1.0 + F.col("grp") / 10.0).alias("w"))
    return consolidation.redundant(each, 2.0).select("cluster", F.round("mean", 6).alias("mean"))


@query("""WITH e AS (SELECT label, vec_id AS id, embedding AS v FROM embeddings), s AS (SELECT a.id, max(round(greatest(list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[]), 0), 6)) AS best FROM e a JOIN e b ON a.label = b.label AND b.id % 7 = 0 AND a.id <> b.id GROUP BY a.id)
SELECT e.id, coalesce(best, 0) AS max_sim, 1 - coalesce(best, 0) >= 0.85 AS novel FROM e LEFT JOIN s USING (id)""")
def novelty(spark, sf_dir):
    """Each vector's similarity to the nearest other one in its label's store, which is every seventh vector."""
    t = targets(spark, sf_dir)
    sims = coverage.similarities(t, selected(t)).where("h <> s")
    best = sims.groupBy("h").agg(F.max(F.round("sim", 6)).alias("best"))
    each = t.join(best, "h", "left").select(F.col("h").alias("id"), F.coalesce("best", F.lit(0.0)).alias("max_sim"))
    return each.select("id", "max_sim", (1 - F.col("max_sim") >= 0.85).alias("novel"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def normalise(spark, sf_dir):
    from ..functions.vectors import normalised

    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.get(normalised(F.col("embedding")), F.lit(0)), 6).alias("first"))


def _candidates(spark, sf_dir):
    t = targets(spark, sf_dir)
    return t.select(F.col("grp").alias("query_id"), F.col("h").alias("id"), F.col("hv").alias("vec"), (0.2 + (F.col("h") % 17) / 20.0).alias("rel"), (5 + F.col("h") % 23).alias("cost"))


@query()
def pack_mmr(spark, sf_dir):
    return packing.by_query(_candidates(spark, sf_dir), 200, "mmr")


@query()
def pack_greedy(spark, sf_dir):
    return packing.by_query(_candidates(spark, sf_dir), 200, "greedy")


def _stream(spark, sf_dir):
    t = targets(spark, sf_dir)
    return t.select(F.col("grp").alias("memory"), F.col("h").alias("id"), F.col("h").cast("double").alias("at"), F.col("hv").alias("vec"), (5 + F.col("h") % 23).alias("cost"), "w").withColumnRenamed("w", "weight")


@query()
def sieve_select(spark, sf_dir):
    return selection.replay(_stream(spark, sf_dir), Config(200))


@query()
def swap_select(spark, sf_dir):
    return selection.replay(_stream(spark, sf_dir), Config(200, write="all"))


@query("SELECT vec_id, label, embedding[1]::DOUBLE AS first FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) > 0) AND vec_id % 7 = 0")
def allowed_filter(spark, sf_dir):
    """Retrieval restricted to the store: a semi join before anything is ranked."""
    e = read(spark, sf_dir, "embeddings")
    return e.join(e.where("vec_id % 7 = 0").select("vec_id"), "vec_id", "left_semi").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("first"))
