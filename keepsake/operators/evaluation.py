"""Evaluation: rates with conditions, strata, bootstrap intervals, splits and identity of runs."""

from __future__ import annotations

import difflib
import hashlib
import json
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.col(num) / F.col(den))


def metrics(records: DataFrame) -> DataFrame:
    """One row for all records and one for each stratum, in one pass over grouping sets.

    Unjudged records count in n but not in accuracy; strict survival leaves out what only a summary keeps; evidence rates are means over answerable questions with
    evidence; abstention rates are right over abstention questions and false over the others.
    """
    can = ~F.col("is_abstention")
    mean = lambda c: F.round(F.avg(c), 6)
    return records.groupingSets([[], [F.col("stratum")]], F.col("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.count("correct").alias("n_judged"), mean(F.col("correct").cast("double")).alias("accuracy"),
        mean(F.when(can, rate("n_written", "n_evidence"))).alias("write_rate"), mean(F.when(can, rate("n_survived", "n_evidence"))).alias("survival_rate"),
        mean(F.when(can, rate("n_survived_strict", "n_evidence"))).alias("survival_rate_strict"), mean((F.col("invalid_citations") > 0).cast("double")).alias("invalid_citation_rate"),
        mean(F.when(can, rate("n_injected", "n_evidence"))).alias("injection_rate"), mean(F.when(~can, F.col("abstained").cast("double"))).alias("correct_abstention"),
        mean(F.when(can, F.col("abstained").cast("double"))).alias("false_abstention"), mean(F.col("injected_tokens")).alias("tokens_per_query"), mean(rate("store_tokens", "history_tokens")).alias("store_fraction"),
    )


#: Positions of a packed row of values, values that a task looks up at once, replicates of a task, draws hashed at once.
PACKED, HELD, REPLICATES, DRAWN = 1 << 16, 1 << 22, 20, 1 << 13
_TURNS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _first_words(words: np.ndarray) -> np.ndarray:
    """The first eight hex digits of MD5 as a number, of messages of one block, a column each of sixteen 32-bit words."""
    start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in start)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        k = i // 16
        if k == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += np.uint32(_SINES[i])
        f += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[k] % 16]
        turn = _TURNS[k][i % 4]
        np.left_shift(f, np.uint32(turn), out=t), np.right_shift(f, np.uint32(32 - turn), out=f), np.bitwise_or(f, t, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(start[0])).byteswap()


def _drawn(seed: int, rep: int, first: int, last: int, n: int) -> np.ndarray:
    """What positions first to last (excluded) draw in a replicate, from 0, by a hash that SQL engines share."""
    out, head = [], f"{seed}:{rep}:".encode()
    while first < last:
        digits = len(str(first))
        end = min(last, 10**digits)
        i, size = np.arange(first, end), len(head) + digits
        text = np.zeros((64, len(i)), np.uint8)
        text[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
        for at in range(size - 1, len(head) - 1, -1):
            i, rest = np.divmod(i, 10)
            text[at] = 48 + rest
        text[size] = 128
        words = sum(text[k::4].astype(np.uint32) << np.uint32(8 * k) for k in range(4))
        words[14] = 8 * size
        out.append(_first_words(words).astype(np.int64) % n)
        first = end
    return np.concatenate(out)


def bootstrap(values: DataFrame, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """values: grp, i (from 0), v. Mean and the 2.5 and 97.5 % replicate means by sorted position.

    Values travel packed, HELD of a group to every task of some replicates, which draws all positions and sums those it holds.
    """
    n = values.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    kind = values.schema["grp"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["p"].iloc[0]) * PACKED
        at, known = pdf["i"].to_numpy() - first, pdf["v"].notna().to_numpy()
        v, has = np.zeros(PACKED), np.zeros(PACKED, np.int64)
        np.add.at(v, at[known], pdf["v"].to_numpy(float)[known])
        np.add.at(has, at[known], 1)
        return pd.DataFrame({"grp": pdf["grp"].iloc[:1], "p": pdf["p"].iloc[:1], "v": [v.tobytes()], "has": [has.astype(np.int32).tobytes()]})

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        low, total, rep = int(pdf["p"].min()) * PACKED, int(pdf["n"].iloc[0]), int(pdf["rep"].iloc[0])
        size = (int(pdf["p"].max()) + 1) * PACKED - low
        v, has = np.zeros(size), np.zeros(size, np.int32)
        for r in pdf.itertuples(index=False):
            at = r.p * PACKED - low
            v[at : at + PACKED], has[at : at + PACKED] = np.frombuffer(r.v), np.frombuffer(r.has, np.int32)
        reps, sums, counts = range(rep, min(rep + REPLICATES, replicates)), [], []
        for k in reps:
            s, c = 0.0, 0
            for first in range(0, total, DRAWN):
                at = _drawn(seed, k, first, min(first + DRAWN, total), total) - low
                at = at[(at >= 0) & (at < size)]
                s, c = s + float(v[at].sum()), c + int(has[at].sum())
            sums.append(s)
            counts.append(c)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(reps), "rep": list(reps), "s": sums, "c": counts})

    placed = values.where("grp is not null").select("grp", "i", F.col("v").cast("double").alias("v"), F.floor(F.col("i") / PACKED).cast("int").alias("p"))
    packed = placed.groupBy("grp", "p").applyInPandas(pack, f"grp {kind}, p int, v binary, has binary").join(n.select("grp", "n"), "grp")
    dealt = packed.withColumn("h", F.floor(F.col("p") / (HELD // PACKED))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(REPLICATES))))
    parts = dealt.repartition(2 * -(-replicates // REPLICATES), "grp", "h", "rep").groupBy("grp", "h", "rep").applyInPandas(draw, f"grp {kind}, rep int, s double, c long")
    means = parts.groupBy("grp", "rep").agg(F.round(F.sum("s") / F.sum("c"), 9).alias("m"))
    at = F.row_number().over(W.partitionBy("grp").orderBy("m", "rep")) - 1
    low, high = int(0.025 * replicates), min(int(0.975 * replicates), replicates - 1)
    ends = means.select("grp", "m", at.alias("at")).groupBy("grp").agg(F.max(F.when(F.col("at") == low, F.col("m"))).alias("lo"), F.max(F.when(F.col("at") == high, F.col("m"))).alias("hi"))
    return n.join(ends, "grp").select("grp", "n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def stratified_split(items: DataFrame, n_dev: int, seed: int = 0) -> DataFrame:
    """items: id, stratum. A column dev: quotas by largest remainder, members by hash within a stratum."""
    sizes = items.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(W.partitionBy())
    quota = n_dev * F.col("size") / total
    parts = sizes.select("stratum", "size", F.floor(quota).alias("base"), (quota - F.floor(quota)).alias("rest"))
    left = n_dev - F.sum("base").over(W.partitionBy())
    parts = parts.select("stratum", (F.col("base") + (F.row_number().over(W.orderBy(F.desc("rest"), "stratum")) <= left).cast("int")).alias("quota"))
    place = F.row_number().over(W.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "id")), "id"))
    return items.withColumn("_p", place).join(F.broadcast(parts), "stratum").select("id", "stratum", (F.col("_p") <= F.col("quota")).alias("dev"))


def close_names(names: DataFrame, threshold: float | None = 0.8) -> DataFrame:
    """names: grp, name. (grp, a, b), the pairs a < b of a group of which one begins or ends the other at a '_' or
    whose sequence ratio reaches the threshold; None asks for affixes alone. Lengths alone rule out most ratios, and only the rest reach Python."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() >= threshold for x, y in zip(a, b, strict=True)], dtype=bool)

    names = names.where("name is not null").distinct()
    a, b = names.withColumnRenamed("name", "a"), names.withColumnRenamed("name", "b")
    x, y = F.col("a"), F.col("b")
    affix = F.lit(False)
    for long, short in ((x, y), (y, x)):
        affix = affix | long.startswith(F.concat(short, F.lit("_"))) | long.endswith(F.concat(F.lit("_"), short))
    if threshold is None:
        return a.join(b, "grp").where("a < b").where(affix).select("grp", "a", "b")
    low, high = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    pairs = a.join(b, "grp").where("a < b").select("grp", "a", "b", affix.alias("affix"), (2.0 * low / (low + high) >= threshold - 1e-9).alias("near"))
    glued = pairs.where("affix").select("grp", "a", "b")
    return glued.union(pairs.where("near AND NOT affix").where(alike("a", "b")).select("grp", "a", "b"))


def key_drift(facts: DataFrame, threshold: float | None = 0.8) -> DataFrame:
    """facts: entity, attribute. (kind, entity, a, b): close attribute names of an entity, and close entity names, whose entity is null."""
    attributes = close_names(facts.select(F.col("entity").alias("grp"), F.col("attribute").alias("name")), threshold)
    entities = close_names(facts.select(F.lit(0).alias("grp"), F.col("entity").alias("name")), threshold)
    return attributes.select(F.lit("attribute").alias("kind"), F.col("grp").alias("entity"), "a", "b").union(entities.select(F.lit("entity"), F.lit(None).cast("string"), "a", "b"))


def evidence_counts(evidence: DataFrame, written: DataFrame, stored: DataFrame, injected: DataFrame) -> DataFrame:
    """question_id, id tables. Of each question's evidence, how much was written, survives and was injected."""
    j = evidence
    for name, other in (("written", written), ("stored", stored), ("injected", injected)):
        j = j.join(other.select("question_id", "id").distinct().withColumn(name, F.lit(1)), ["question_id", "id"], "left")
    return j.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.count("written").alias("n_written"), F.count("stored").alias("n_survived"), F.count("injected").alias("n_injected"))


def resolve_budget(budget: Column, history: Column) -> Column:
    """Null is no limit; up to 1 a share of the history, at least one token; else tokens."""
    return F.when(budget.isNull(), F.lit(1_000_000_000)).when(budget <= 1, F.greatest(F.floor(budget * history), F.lit(1))).otherwise(budget.cast("long")).cast("long")


def should_abstain(packed: Column, top_rel: Column, tau: float, question_terms: Column, packed_terms: Column) -> Column:
    return (packed == 0) | ((top_rel < tau) & ~F.arrays_overlap(question_terms, packed_terms))


#: Settings that don't change a result, and those that only matter when reading.
INFRA, READ = ("device", "cache_dir", "max_workers", "api_key", "base_url"), ("read", "answer", "judge", "budget.read_tokens", "budget.raw_tokens")


def _flat(tree: dict, path: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tree.items():
        out.update(_flat(v, f"{path}{k}.") if isinstance(v, dict) else {path + k: v})
    return out


def identity(config: dict, ingest: bool = False) -> str:
    """A hash of what changes results; with ingest, of what changes a stored memory."""
    kept = {k: v for k, v in _flat(config).items() if k.split(".")[-1] not in INFRA and not (ingest and any(k == r or k.startswith(r + ".") for r in READ))}
    return hashlib.sha1(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:12]


def inherited(path: str, read=None, seen: tuple[str, ...] = ()) -> dict:
    """The settings of a file over those of the one it names under ``extends``, relative to its own folder; ValueError
    if files name each other in a circle. read: from a path to a dict, JSON by default."""
    path = os.path.abspath(path)
    if path in seen:
        raise ValueError(f"settings extend each other: {' -> '.join((*seen, path))}")
    if read is None:
        with open(path) as f:
            own = json.load(f)
    else:
        own = read(path)
    own = dict(own)
    parent = own.pop("extends", None)
    return overlay(inherited(os.path.join(os.path.dirname(path), parent), read, (*seen, path)), own) if parent else own


def override(said: str) -> dict:
    """``write.policy=sieve`` as a tree; values are JSON where they can be, else text."""
    key, eq, value = said.partition("=")
    if not eq:
        raise ValueError(f"not of the form key=value: {said!r}")
    try:
        out = json.loads(value.strip())
    except ValueError:
        out = value.strip()
    for part in reversed(key.strip().split(".")):
        out = {part: out}
    return out


def overlay(base: dict, over: dict) -> dict:
    """base with over's values, dicts merged in depth."""
    return base | {k: overlay(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def summary(metrics_row: dict) -> str:
    return "\n".join(f"{k:<20} {v:.4f}" if isinstance(v, float) else f"{k:<20} {v}" for k, v in metrics_row.items())
