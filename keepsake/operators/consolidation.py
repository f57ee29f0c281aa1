"""Consolidation: clusters of similar entries, their medoids, and when to compress them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import entities
from ..functions.vectors import dot
from ..session import cut
from .coverage import by_blocks, strips


def _near(x: pd.DataFrame, y: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and in y of pairs a < b from the threshold on, and their similarities, a strip at a time."""
    a, b = x["a"].to_numpy()[:, None], y["b"].to_numpy()[None]
    for own, sims in strips(x["av"], y["bv"]):
        rows, cols = np.nonzero((np.round(sims, 6) >= threshold) & (a[own] < b))
        yield rows + own.start, cols, sims[rows, cols]


def near_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """entries: grp, id, vec. Pairs a < b of a group (a window of sessions) from the threshold on, block by block."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        rows, cols, sims = (np.concatenate(k) for k in zip(*_near(x, y, threshold), strict=True))
        return pd.DataFrame({"grp": x["grp"].to_numpy()[rows], "a": x["a"].to_numpy()[rows], "b": y["b"].to_numpy()[cols], "sim": sims})

    return _by_twos(entries, run, ", sim double")


def _by_twos(entries: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], more: str = "") -> DataFrame:
    a, b = (entries.select("grp", F.col("id").alias(x), F.col("vec").alias(x + "v")) for x in "ab")
    grp, own = (entries.schema[c].dataType.simpleString() for c in ("grp", "id"))
    return by_blocks(a, b, "a", "b", run, f"grp {grp}, a {own}, b {own}{more}")


def links(entries: DataFrame, threshold: float) -> DataFrame:
    """(grp, a, b), a < b: pairs that connect what near_pairs connects and no more, though not all are near themselves.
    A pair of blocks leaves each entry's link to the least it reaches there, in place of all its pairs."""

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ids, own = np.unique(np.concatenate([x["a"].to_numpy(), y["b"].to_numpy()]), return_inverse=True)
        least, to = np.arange(len(ids)), own[len(x) :]
        for rows, cols, _ in _near(x, y, threshold):
            least = joined(least, own[rows], to[cols])
        at = np.flatnonzero(least < np.arange(len(ids)))
        return pd.DataFrame({"grp": x["grp"].to_numpy()[np.zeros(len(at), int)], "a": ids[least[at]], "b": ids[at]})

    return _by_twos(entries, run)


def joined(least: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least place that each one reaches, once u and v are linked too."""
    while True:
        a, b = least[u], least[v]
        apart = a != b
        if not apart.any():
            return least
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least != (to := least[least])).any():
            least = to


def clusters(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(grp, id, cluster): single-link components, named by their least id. Large and small stars alternate until
    no edge changes; edges are written between rounds, to the shared folder."""
    keep = lambda d: cut(d, "edges")
    state = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("grp", "u", "v").cast("decimal(38,0)"))).first())
    edges = keep(pairs.where("a <> b").select("grp", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select("grp", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("grp", "u").agg(F.min("v").alias("m")).select("grp", "u", F.least("u", "m").alias("m"))
        large = both.join(least, ["grp", "u"]).where("v > u").select("grp", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("grp", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["grp", "u"]).where("v <> m").select("grp", F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("grp", "u", F.col("m").alias("v"))).distinct()
        edges = keep(small)
        after = state(edges)
        if after == before:
            break
        before = after
    labels = edges.select("grp", F.col("u").alias("id"), F.col("v").alias("label"))
    return entries.join(labels, ["grp", "id"], "left").select("grp", "id", F.coalesce("label", "id").alias("cluster"))


def medoids(entries: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """The member of each cluster of at least so many with the largest sum of similarities; ties by id.

    A member's sum is its product with the sum of the cluster's vectors, so no pairs are made.
    """
    m = entries.join(labels, ["grp", "id"])
    each = m.select("grp", "cluster", F.posexplode("vec").alias("at", "x")).groupBy("grp", "cluster", "at").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("size"))
    sums = each.where(F.col("size") >= least).groupBy("grp", "cluster", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("sum"))
    found = m.join(sums, ["grp", "cluster"]).select("grp", "cluster", "id", "size", F.round(dot(F.col("vec"), F.col("sum")), 6).alias("total"))
    best = found.groupBy("grp", "cluster").agg(F.max_by(F.struct("id", "size", "total"), F.struct("total", -F.col("id"))).alias("m"))
    return best.select("grp", "cluster", F.col("m.id").alias("medoid"), "m.size", "m.total")


def modal_entity(members: DataFrame) -> DataFrame:
    """members: cluster, entity. The commonest entity but user; ties by name."""
    counts = members.where("entity <> 'user'").groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("n"), "entity")).alias("r")).where("r = 1").drop("r")


def redundant(losses: DataFrame, below: float = 0.35) -> DataFrame:
    """losses: cluster, loss, w. Clusters whose mean loss / w is below the trigger."""
    return losses.groupBy("cluster").agg(F.avg(F.col("loss") / F.col("w")).alias("mean")).where(F.col("mean") < below)


def recent(sessions: DataFrame, k: int = 10) -> DataFrame:
    """The last k sessions of each memory."""
    return sessions.select("*", F.dense_rank().over(W.partitionBy("memory").orderBy(F.desc("session"))).alias("age")).where(F.col("age") <= k)


def supported(summaries: DataFrame, rate: float = 0.8) -> DataFrame:
    """summaries: summary, fact, support (whether members entail it). Accepted ones keep only their supported facts."""
    share = F.avg(F.col("support").cast("double")).over(W.partitionBy("summary"))
    return summaries.select("*", share.alias("rate")).where((F.col("rate") >= rate) & F.col("support"))


def summaries(members: DataFrame, vectors: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """members: grp, id, text, speaker, ts; vectors: grp, id, vec; labels: grp, id, cluster. A fact for each cluster of at
    least so many: what its medoid says under the topic of its commonest entity, from its first day, with its sources."""
    medoid = medoids(vectors, labels, least).select("grp", "cluster", F.col("medoid").alias("id"))
    own = members.join(labels, ["grp", "id"])
    names = own.select(F.struct("grp", "cluster").alias("cluster"), F.explode(F.array_distinct(entities(F.col("text")))).alias("entity"))
    topic = modal_entity(names.withColumn("entity", F.lower("entity"))).select("cluster.grp", "cluster.cluster", F.regexp_replace("entity", " ", "_").alias("topic"))
    whole = own.groupBy("grp", "cluster").agg(F.min("ts").alias("valid_from"), F.array_sort(F.collect_set("id")).alias("sources"), F.max((F.col("speaker") == "user").cast("int")).alias("by_user"))
    said = medoid.join(members.select("grp", "id", F.col("text").alias("value")), ["grp", "id"]).drop("id")
    found = said.join(whole, ["grp", "cluster"]).join(topic, ["grp", "cluster"], "left")
    entity = F.when(F.col("by_user") == 1, "user").otherwise("assistant")
    return found.select("grp", "cluster", entity.alias("entity"), F.concat(F.lit("recurring_"), F.coalesce("topic", F.lit("general"))).alias("attribute"), "value", "valid_from", "sources", F.lit("inferred").alias("kind"))
