"""Packing entries into a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import pack_greedy, pack_hops, pack_mmr


def skip_fit(items: DataFrame, group: str, budget: int, order: Column, cost: str = "cost") -> DataFrame:
    """Of each group in order, what fits; what doesn't is skipped. items: group, id, cost.

    A fold over one array a group: for candidates of a query, which retrieval bounds.
    """
    kind = items.schema["id"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["cost"] <= budget
        return F.when(fits, F.struct((s["used"] + x["cost"]).alias("used"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s)

    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("id"), F.col(cost).cast("long").alias("cost"))))
    folded = items.groupBy(group).agg(F.aggregate(rows, start, step).alias("p"))
    return folded.select(group, F.posexplode("p.ids").alias("position", "id"))


def prefix(items: DataFrame, group: str, budget: int, *order) -> DataFrame:
    """What comes before the first that doesn't fit."""
    w = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return items.select("*", F.sum("cost").over(w).alias("used")).where(F.col("used") <= budget)


def by_query(candidates: DataFrame, budget: int, how: str = "greedy") -> DataFrame:
    """candidates: query_id, id, rel, cost, vec. greedy or mmr, which need a query's candidates together."""
    pack = {"greedy": pack_greedy, "mmr": pack_mmr}[how]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rel", "id"], ascending=[False, True])
        ids = [str(i) for i in pdf["id"]]
        vecs = {i: np.asarray(v, np.float32) for i, v in zip(ids, pdf["vec"], strict=True)}
        cost = {i: max(int(c), 1) for i, c in zip(ids, pdf["cost"], strict=True)}
        out = pack(ids, dict(zip(ids, map(float, pdf["rel"]), strict=True)), cost, vecs, budget)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(out), "position": range(len(out)), "id": out, "cost": [cost[i] for i in out]})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return candidates.select("query_id", "id", "rel", "cost", "vec").groupBy("query_id").applyInPandas(run, f"query_id {kind}, position int, id string, cost long")


def by_hops(candidates: DataFrame, budget: int, how: str = "greedy") -> DataFrame:
    """candidates: query_id, id, rel, cost, vec, hop (1 or 2), hop2 (the second hop's budget). The second hop gets what it
    is promised and all that the first leaves."""
    pack = {"greedy": pack_greedy, "mmr": pack_mmr}[how]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rel", "id"], ascending=[False, True])
        ids = pdf["id"].astype(str)
        vecs = {i: np.asarray(v, np.float32) for i, v in zip(ids, pdf["vec"], strict=True)}
        cost = {i: max(int(c), 1) for i, c in zip(ids, pdf["cost"], strict=True)}
        rel = dict(zip(ids, map(float, pdf["rel"]), strict=True))
        first, second = (ids[pdf["hop"] == h].tolist() for h in (1, 2))
        out = pack_hops(first, second, budget, int(pdf["hop2"].iloc[0]), cost, lambda own, most: pack(own, rel, cost, vecs, most))
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(out), "position": range(len(out)), "id": out, "cost": [cost[i] for i in out]})

    kind = candidates.schema["query_id"].dataType.simpleString()
    return candidates.select("query_id", "id", "rel", "cost", "vec", "hop", "hop2").groupBy("query_id").applyInPandas(run, f"query_id {kind}, position int, id string, cost long")


def chunks(turns: DataFrame, words: int = 150) -> DataFrame:
    """turns: session_id, turn, text. Runs of at most so many words, in order."""
    cut = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    held = turns.select("session_id", "turn", cut.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int"))
    return held.select("session_id", "turn", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i * words + 1, F.lit(words)), " "))).alias("chunk", "text"))


def best_line(context: Column, question_terms: Column) -> Column:
    """The line that shares the most words with a question; the first of equals."""
    lines = F.split(context, "\n")
    scored = F.transform(lines, lambda x, i: F.struct(F.size(F.array_intersect(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), question_terms)).alias("n"), (-i).alias("i"), x.alias("line")))
    return F.array_max(scored)["line"]
