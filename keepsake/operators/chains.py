"""Facts as chains of validity intervals (slowly changing dimensions), and lookups in time.

A chain is a key's facts in order of (valid_from, arrival). A repeated value merges into the version that
stands; a new one closes it. One shuffle by key serves all windows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import intersects

KEY = ("entity", "attribute")


def _by_key(*order: str) -> W:
    return W.partitionBy(*KEY).orderBy(*order)


def build(facts: DataFrame, multi_valued: tuple[str, ...] = ()) -> DataFrame:
    """facts: entity, attribute, value, valid_from, seq. The versions, with id order, valid_to and superseded_by.

    A fact that comes late counts from the start of the version before it in arrival order if clamp() was
    applied. Multi-valued attributes merge equal values and never close one another.
    """
    w = _by_key("valid_from", "seq")
    before = F.lag(F.lower("value")).over(w)
    kept = facts.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.lower("value"))).drop("_b")
    single = ~F.col("attribute").isin(*multi_valued) if multi_valued else F.lit(True)
    return kept.select("*", F.when(single, F.lead("valid_from").over(w)).alias("valid_to"), F.when(single, F.lead("seq").over(w)).alias("superseded_by"), F.row_number().over(w).alias("version"))


def clamp(facts: DataFrame) -> DataFrame:
    """Facts that arrive out of order start no earlier than those that came before them."""
    w = _by_key("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    return facts.withColumn("valid_from", F.max("valid_from").over(w))


def merged(facts: DataFrame) -> DataFrame:
    """One row per key and value: first start, ordered distinct union of sources, number of mentions."""
    ordered = F.array_sort(F.collect_list(F.struct("valid_from", "seq", "sources")))
    return facts.groupBy(*KEY, F.lower("value").alias("value")).agg(F.min("valid_from").alias("valid_from"), F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["sources"]))).alias("sources"), F.count(F.lit(1)).alias("mentions"))


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """The latest version of each key that began by then; keys that began later have their first."""
    early = F.max_by(F.struct("value", "valid_from"), F.when(F.col("valid_from") <= at, F.struct("valid_from", "seq")))
    first = F.min_by(F.struct("value", "valid_from"), F.struct("valid_from", "seq"))
    return versions.groupBy(*KEY).agg(early.alias("e"), first.alias("f"), F.max(F.col("valid_from") <= at).alias("found")).select(*KEY, F.when(F.col("found"), F.col("e")).otherwise(F.col("f")).alias("v"), "found").select(*KEY, "v.value", "v.valid_from", "found")


def volatility(facts: DataFrame) -> DataFrame:
    """Changes per day of each key: (n - 1) / max(span in days, 1), 0 for one fact."""
    span = (F.unix_timestamp(F.max("valid_from").cast("timestamp")) - F.unix_timestamp(F.min("valid_from").cast("timestamp"))) / 86400.0
    n = F.count(F.lit(1))
    return facts.groupBy(*KEY).agg(F.when(n < 2, 0.0).otherwise((n - 1) / F.greatest(span, F.lit(1.0))).alias("volatility"), n.alias("n"))


def ends(versions: DataFrame) -> DataFrame:
    """Head, tail and the version before the tail, by key."""
    values = F.array_sort(F.collect_list(F.struct("valid_from", "seq", "value")))
    return versions.groupBy(*KEY).agg(values.alias("v")).select(*KEY, F.get("v", F.lit(0))["value"].alias("head"), F.element_at("v", -1)["value"].alias("tail"), F.get("v", F.size("v") - 2)["value"].alias("previous"), F.size("v").alias("length"))


def select_nodes(versions: DataFrame, constraints: DataFrame) -> DataFrame:
    """constraints: question_id, entity, attribute, mode, start, end. The versions each question is about.

    whole_chain: all; before_latest: the last two; interval: those that meet it, else the latest that began
    by its end, else the first; now and none: the tail, with the head if the tail is suspect (changes rarer
    than monthly and not said by the user, or inferred, and unlike the head).
    """
    n, first = W.partitionBy("question_id", *KEY), W.partitionBy("question_id", *KEY).orderBy("valid_from", "seq")
    j = versions.join(constraints, list(KEY))
    hit = intersects(F.col("start"), F.col("end"), F.col("valid_from"), F.col("valid_to"))
    span = (F.unix_timestamp(F.max("valid_from").over(n).cast("timestamp")) - F.unix_timestamp(F.min("valid_from").over(n).cast("timestamp"))) / 86400.0
    j = j.select("*", F.row_number().over(first).alias("_i"), F.count(F.lit(1)).over(n).alias("_n"), F.max(hit.cast("int")).over(n).alias("_any"), hit.alias("_hit"),
                 F.sum((F.col("valid_from") <= F.col("end")).cast("int")).over(n).alias("_early"), span.alias("_span"),
                 F.first("value").over(n.orderBy("valid_from", "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_head"))
    is_tail = F.col("_i") == F.col("_n")
    tail = W.partitionBy("question_id", *KEY)
    rare = (F.col("_n") - 1) / F.greatest(F.col("_span"), F.lit(1.0)) < 1 / 30
    suspect = F.max(F.when(is_tail, ((rare & (F.col("speaker") != "user")) | (F.col("kind") == "inferred")) & (F.lower("value") != F.lower("_head")))).over(tail)
    j = j.withColumn("_suspect", suspect)
    keep = (
        F.when(F.col("_n") == 1, True)
        .when(F.col("mode") == "whole_chain", True)
        .when(F.col("mode") == "before_latest", F.col("_i") >= F.col("_n") - 1)
        .when(F.col("mode") == "interval", F.when(F.col("_any") == 1, F.col("_hit")).otherwise(F.col("_i") == F.greatest(F.col("_early"), F.lit(1))))
        .otherwise(is_tail | (F.col("_suspect") & (F.col("_i") == 1)))
    )
    return j.where(keep).select("question_id", *KEY, "value", "valid_from", "valid_to", "seq", (F.col("_suspect") & F.col("mode").isin("now", "none")).alias("suspect"))


def resolve(candidates: DataFrame, versions: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidates: question_id, seq (a fact hit), rel, mode. Each hit becomes its chain's selected nodes.

    A node that isn't the hit has 0.9 of its relevance; without a temporal cue the hit itself stays too; the
    largest relevance of a node wins.
    """
    hits = candidates.join(versions.select(*KEY, F.col("seq")), "seq")
    chosen = hits.withColumnRenamed("seq", "hit").join(nodes.select("question_id", *KEY, "seq"), ["question_id", *KEY])
    moved = chosen.select("question_id", "seq", F.when(F.col("seq") == F.col("hit"), F.col("rel")).otherwise(F.col("rel") * 0.9).alias("rel"))
    stay = hits.where("mode = 'none'").select("question_id", "seq", "rel")
    return moved.unionByName(stay).groupBy("question_id", "seq").agg(F.max("rel").alias("rel"))
