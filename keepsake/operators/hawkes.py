"""Point-process intensity of keys over mention events (key, day)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Jump and decay of an event, floor of the base rate, least span in days.
ALPHA, BETA, FLOOR, SPAN = 0.5, 0.1, 0.01, 30.0


def mentions(events: DataFrame, key: str = "key", session: str = "session") -> DataFrame:
    """One event per key and session."""
    return events.dropDuplicates([key, session])


def base_rate(events: DataFrame, floor: float = FLOOR, least_span: float = SPAN) -> DataFrame:
    """max(floor, events / max(span, least)) of each key; the span is that of all events."""
    span = events.agg((F.max("day") - F.min("day")).alias("span"))
    counts = events.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(span)).select("key", "n", F.greatest(F.lit(floor), F.col("n") / F.greatest(F.col("span"), F.lit(least_span))).alias("mu"))


def excitation(events: DataFrame, at: float, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """alpha * sum(exp(-beta * (at - day))) over the events of each key up to then: one aggregate, no self join."""
    past = events.where(F.col("day") <= at)
    return past.groupBy("key").agg((alpha * F.sum(F.exp(-beta * (at - F.col("day"))))).alias("excitation"))


def intensity(events: DataFrame, at: float, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    return base_rate(events).join(excitation(events, at, alpha, beta), "key", "left").select("key", "mu", (F.col("mu") + F.coalesce("excitation", F.lit(0.0))).alias("intensity"))


def at_events(events: DataFrame, beta: float = BETA, block: float = 30.0) -> DataFrame:
    """The decayed sum of a key's earlier and equal events at each of its events.

    Days are dealt to blocks. Within one a running sum of exp(beta * day) is safe from overflow and a window of
    one key and block is all that a task needs together; a key's blocks, a row each, are folded in order.
    """
    placed = events.select("key", "day").withColumn("b", F.floor(F.col("day") / block))
    placed = placed.withColumn("x", F.exp(beta * (F.col("day") - F.col("b") * block)))
    inner = F.sum("x").over(W.partitionBy("key", "b").orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow))
    sums = placed.groupBy("key", "b").agg((F.sum("x") * float(np.exp(-beta * block))).alias("s"))  # as of the block's end
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0).cast("long").alias("b"), F.array().cast("array<struct<b:bigint,carry:double>>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        carry = s["a"] * F.exp(-beta * block * (n["b"] - s["b"]))  # as of the start of block n
        own = F.struct(n["b"].alias("b"), carry.alias("carry"))
        return F.struct((carry * float(np.exp(-beta * block)) + n["s"]).alias("a"), (n["b"] + 1).alias("b"), F.concat(s["out"], F.array(own)).alias("out"))

    folded = sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias("l"))
    carried = folded.select("key", F.inline(F.aggregate("l", start, step)["out"]))
    each = placed.select("key", "b", "day", inner.alias("inner")).distinct().join(carried, ["key", "b"])
    decayed = (F.col("inner") + F.col("carry")) * F.exp(-beta * (F.col("day") - F.col("b") * block))
    return each.groupBy("key", "day").agg(F.max(decayed).alias("decayed"))


def entry_weights(entries: DataFrame, intensities: DataFrame, floor: float = FLOOR) -> DataFrame:
    """entries: id, keys; intensities: key, intensity. Each entry's weight: the largest of its keys, the floor for one
    without events or keys."""
    each = entries.select("id", F.explode_outer("keys").alias("key")).join(intensities.select("key", "intensity"), "key", "left")
    return each.groupBy("id").agg(F.max(F.coalesce("intensity", F.lit(floor))).alias("weight"))


def log_likelihood(events: DataFrame, alpha: Column | float, beta: Column | float, mu: str = "mu", horizon: str = "horizon") -> Column:
    """Of a sorted array of days in column `days`: sum log(mu + alpha A_i) - mu T - alpha/beta sum(1 - e^(-beta (T - t)))."""
    start = F.struct(F.lit(0.0).alias("a"), F.col("days")[0].alias("last"), F.lit(0.0).alias("ll"))

    def step(s: Column, d: Column) -> Column:
        a = s["a"] * F.exp(-beta * (d - s["last"]))
        return F.struct((a + 1.0).alias("a"), d.alias("last"), (s["ll"] + F.ln(F.col(mu) + alpha * a)).alias("ll"))

    compensator = F.aggregate("days", F.lit(0.0), lambda s, d: s + 1.0 - F.exp(-beta * (F.col(horizon) - d)))
    return F.aggregate("days", start, step)["ll"] - F.col(mu) * F.col(horizon) - alpha / beta * compensator


GRID = ((0.1, 0.2, 0.4, 0.6, 0.8, 1.0), (0.02, 0.05, 0.1, 0.2, 0.5, 1.0))


def fit(events: DataFrame, grid=GRID) -> DataFrame:
    """The (alpha, beta) of the grid with the largest total log likelihood; ties go to the first in grid order."""
    horizon = events.agg(F.max("day").alias("horizon"), F.min("day").alias("origin"))
    keyed = events.groupBy("key").agg(F.array_sort(F.collect_list("day")).alias("d")).join(base_rate(events), "key").join(F.broadcast(horizon))
    keyed = keyed.select("key", "mu", F.transform("d", lambda d: d - F.col("origin")).alias("days"), (F.col("horizon") - F.col("origin")).alias("horizon"))
    cells = [F.struct(F.lit(i * len(grid[1]) + j).alias("cell"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"), log_likelihood(keyed, F.lit(a), F.lit(b)).alias("ll")) for i, a in enumerate(grid[0]) for j, b in enumerate(grid[1])]
    sums = keyed.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.cell", "c.alpha", "c.beta").agg(F.round(F.sum("c.ll"), 6).alias("ll"))
    return sums.orderBy(F.desc("ll"), "cell").limit(1).select("alpha", "beta", "ll")
