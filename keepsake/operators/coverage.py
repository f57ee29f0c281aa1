"""Facility-location coverage: sum over targets of w * the best similarity to a selected vector, clipped at 0.

Everything is within a group (a memory, a label). A group's targets and vectors are dealt to blocks of CHUNK,
every block of the one side meets every block of the other as a product of matrices, and what leaves a pair of
blocks is two rows a target or one a candidate. A group of any size is so spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors of a block, and those of its rows whose similarities are held at once.
CHUNK, STRIP = 4096, 256


def by_blocks(left: DataFrame, right: DataFrame, left_id: str, right_id: str, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, chunk: int = CHUNK) -> DataFrame:
    """run on each pair of blocks of a group; both sides have a column grp. Groups that a side lacks are left out."""
    count = lambda d, name: d.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(name))
    blocks = count(left, "_nl").join(count(right, "_nr"), "grp")

    def dealt(side: DataFrame, key: str, own: str, n: str, other: str, m: str) -> DataFrame:
        placed = side.join(blocks, "grp").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)).cast("int"))
        met = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_nl", "_nr")
        return met.select(*[F.col(c).alias(c) for c in met.columns])  # columns of its own, where both sides are one table

    l, r = dealt(left, left_id, "_l", "_nl", "_r", "_nr"), dealt(right, right_id, "_r", "_nr", "_l", "_nl")
    keys = ("grp", "_l", "_r")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a, b)[names] if len(a) and len(b) else pd.DataFrame({n: [] for n in names})

    return l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(pair, schema)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def strips(left: pd.Series, right: pd.Series) -> Iterator[tuple[slice, np.ndarray]]:
    """Similarities of a pair of blocks, STRIP rows of the left one at a time."""
    a, b = matrix(left), matrix(right).T
    for at in range(0, len(a), STRIP):
        yield slice(at, at + STRIP), a[at : at + STRIP] @ b


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def similarities(targets: DataFrame, selected: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """targets: grp, h, hv, w; selected: grp, s, sv. (grp, h, w, s, sim), sim >= 0: of each target the two best of each
    block of selected vectors, ties, to nine places, to the smaller id. All that asks for a best one needs no more."""

    def run(t: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("s")
        out, ids = [], x["s"].to_numpy()
        for own, sims in strips(t["hv"], x["sv"]):
            np.maximum(sims, 0, out=sims)
            ranks, part, at = np.round(sims, 9), t.iloc[own], np.arange(len(sims))
            for _ in range(min(2, len(x))):
                top = ranks.argmax(axis=1)
                out.append(pd.DataFrame({"grp": part["grp"].to_numpy(), "h": part["h"].to_numpy(), "w": part["w"].to_numpy(), "s": ids[top], "sim": sims[at, top]}))
                ranks[at, top] = -1
        return pd.concat(out)

    schema = f"grp {_kind(targets, 'grp')}, h {_kind(targets, 'h')}, w double, s {_kind(selected, 's')}, sim double"
    return by_blocks(targets.select("grp", "h", "hv", F.col("w").cast("double")), selected.select("grp", "s", "sv"), "h", "s", run, schema, chunk)


def top_two(sims: DataFrame) -> DataFrame:
    """Best and second-best provider of each target; ties, to nine places, go to the smaller id."""
    rank = F.row_number().over(W.partitionBy("grp", "h").orderBy(F.desc(F.round("sim", 9)), "s"))
    ranked = sims.select("*", rank.alias("r")).where("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    return ranked.groupBy("grp", "h").agg(F.first("w").alias("w"), pick(1, "s").alias("provider"), pick(1, "sim").alias("best"), F.coalesce(pick(2, "sim"), F.lit(0.0)).alias("second"))


def value(sims: DataFrame) -> DataFrame:
    best = sims.groupBy("grp", "h").agg(F.first("w").alias("w"), F.max("sim").alias("best"))
    return best.groupBy("grp").agg(F.sum(F.col("w") * F.col("best")).alias("value"))


def gains(candidates: DataFrame, best: DataFrame | None, targets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """candidates: grp, s, sv. What each would add to the value; best: grp, h, best, none for an empty store."""

    def run(t: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        part, w, best = np.zeros(len(x)), t["w"].to_numpy(), t["best"].to_numpy()[:, None]
        for own, sims in strips(t["hv"], x["sv"]):
            np.maximum(sims, 0, out=sims)
            sims -= best[own]
            part += w[own] @ np.maximum(sims, 0, out=sims)
        return pd.DataFrame({"grp": x["grp"].to_numpy(), "s": x["s"].to_numpy(), "part": part})

    known = targets.select("grp", "h", "hv", F.col("w").cast("double"))
    known = known.withColumn("best", F.lit(0.0)) if best is None else known.join(best.select("grp", "h", "best"), ["grp", "h"], "left").fillna(0.0, ["best"])
    parts = by_blocks(known, candidates.select("grp", "s", "sv"), "h", "s", run, f"grp {_kind(targets, 'grp')}, s {_kind(candidates, 's')}, part double", chunk)
    return parts.groupBy("grp", "s").agg(F.sum("part").alias("gain"))


def losses(tops: DataFrame) -> DataFrame:
    """What the value would lose without each selected one."""
    return tops.groupBy("grp", F.col("provider").alias("s")).agg(F.sum(F.col("w") * (F.col("best") - F.col("second"))).alias("loss"))


def _best_without(targets: DataFrame, selected: DataFrame, gone: DataFrame) -> DataFrame:
    """The best similarity of each target to what a set (grp, s) leaves."""
    rest = selected.join(gone.select("grp", "s"), ["grp", "s"], "left_anti")
    return similarities(targets, rest).groupBy("grp", "h").agg(F.max("sim").alias("best"))


def loss_of_set(targets: DataFrame, selected: DataFrame, gone: DataFrame) -> DataFrame:
    """What the value of each group would lose without a set (grp, s)."""
    best = similarities(targets, selected).groupBy("grp", "h").agg(F.first("w").alias("w"), F.max("sim").alias("all"))
    both = best.join(_best_without(targets, selected, gone), ["grp", "h"], "left")
    return both.groupBy("grp").agg(F.sum(F.col("w") * (F.col("all") - F.coalesce("best", F.lit(0.0)))).alias("loss"))


def gain_without(candidates: DataFrame, selected: DataFrame, targets: DataFrame, gone: DataFrame) -> DataFrame:
    """What each candidate would add once a set is gone."""
    return gains(candidates, _best_without(targets, selected, gone), targets)


def singletons(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    return gains(candidates, None, targets).withColumnRenamed("gain", "single")


def max_singleton_ratio(candidates: DataFrame, targets: DataFrame, costs: DataFrame, floor: int = 20) -> DataFrame:
    """costs: grp, s, cost. The largest singleton value per token, with a least cost."""
    each = singletons(candidates, targets).join(costs, ["grp", "s"])
    return each.groupBy("grp").agg(F.max(F.col("single") / F.greatest("cost", F.lit(floor))).alias("ratio"))
