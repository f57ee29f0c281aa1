"""Selection under a storage budget, by memory: the kernel's replay in batch, and forms that SQL can say."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import Config, Entry, Selector


def replay(entries: DataFrame, config: Config, extra: tuple[str, ...] = ()) -> DataFrame:
    """entries: memory, id, at, vec, cost and any of weight, unit, raw, value, consolidated, rank. The active sieve.

    One memory is one task: selection is sequential in a memory, whose size the budget bounds, and memories
    are the parallel axis.
    """
    names = [c for c in ("weight", "unit", "raw", "value", "consolidated", "rank") if c in entries.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"], kind="stable")
        selector = Selector(config, len(pdf["vec"].iloc[0]))
        for r in pdf.itertuples(index=False):
            selector.offer(Entry(str(r.id), np.asarray(r.vec, np.float32), int(r.cost), at=float(r.at), **{n: getattr(r, n) for n in names}))
        best = selector.active()
        kept = list(best.held.values())
        return pd.DataFrame({"memory": [pdf["memory"].iloc[0]] * len(kept), "id": [h.id for h in kept], "cost": [h.cost for h in kept], "threshold": [best.threshold] * len(kept), "value": [best.cover.value()] * len(kept)})

    kind = entries.schema["memory"].dataType.simpleString()
    return entries.select("memory", "id", "at", "vec", "cost", *names).groupBy("memory").applyInPandas(run, f"memory {kind}, id string, cost long, threshold double, value double")


def fifo_survivors(entries: DataFrame, budget: int) -> DataFrame:
    """What first-in-first-out eviction leaves of (memory, seq, cost): the longest suffix that fits.

    Entries above the budget never enter. The sum runs from the newest entry back.
    """
    w = W.partitionBy("memory").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return entries.where(F.col("cost") <= budget).select("*", F.sum("cost").over(w).alias("newer")).where(F.col("newer") <= budget)


def evict_order(entries: DataFrame, needed: int, *order) -> DataFrame:
    """The first entries of each memory, consolidated ones first and then by order, whose costs reach what is needed."""
    w = W.partitionBy("memory").orderBy(F.desc("consolidated"), *order)
    before = F.coalesce(F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return entries.select("*", before.alias("before")).where(F.col("before") < needed).drop("before")


def utility(age_days, accesses, spec, source):
    """The weighted sum of recency, frequency, specificity and source that ranks entries."""
    frequency = F.least(F.lit(1.0), F.ln(1.0 + accesses) / F.ln(F.lit(51.0)))
    return 0.4 * F.exp(-age_days / 30.0) + 0.3 * frequency + 0.2 * spec + 0.1 * source


def units(entries: DataFrame) -> DataFrame:
    """Chains live or go as one: cost, members and whether all are consolidated."""
    return entries.groupBy("memory", F.coalesce("chain", "id").alias("unit")).agg(F.greatest(F.sum("cost"), F.lit(1)).alias("cost"), F.count(F.lit(1)).alias("members"), F.bool_and("consolidated").alias("consolidated"))


def thresholds(low: float, high: float, step: float):
    """The grid of sieve thresholds as an array."""
    n = F.floor(F.ln(F.lit((high + 1e-9) / low)) / F.ln(F.lit(step))).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: low * F.pow(F.lit(step), i))
