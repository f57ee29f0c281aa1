"""What a question gets to read besides packed entries: excerpts, whole sources, rendered sessions and baselines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import count_tokens
from . import packing, retrieval
from .answering import contexts


def excerpts(scored: DataFrame, group: str, budget: int) -> DataFrame:
    """scored: group, id, session_id, turn, score, cost. Verbatim turns by score as far as they fit, what doesn't is
    skipped; then in order of time. (group, id, session_id, turn, position)."""
    chosen = packing.skip_fit(scored.where("score > 0"), group, budget, F.struct(-F.col("score"), "session_id", "turn")).select(group, "id")
    kept = scored.join(chosen, [group, "id"], "left_semi")
    return kept.select(group, "id", "session_id", "turn", (F.row_number().over(W.partitionBy(group).orderBy("session_id", "turn")) - 1).alias("position"))


def injected(packed: DataFrame, added: DataFrame, group: str) -> DataFrame:
    """(group, id): what a question reads, from packing or as an excerpt, once each."""
    return packed.select(group, "id").union(added.select(group, "id")).distinct()


def without_raw(allowed: DataFrame, raw: DataFrame) -> DataFrame:
    """allowed, raw: id. Allowed entries that aren't verbatim turns."""
    return allowed.select("id").distinct().join(raw.select("id"), "id", "left_anti")


def oracle(turns: DataFrame, evidence: DataFrame) -> DataFrame:
    """turns: session_id, turn, …; evidence: question_id, session_id. The turns of each question's evidence sessions."""
    return turns.join(evidence.select("question_id", "session_id").distinct(), "session_id")


def cut_middle(text: Column, most: int, least: int = 20) -> Column:
    """A text that costs more than `most` tokens keeps words at both ends, in proportion, `least` at the fewest."""
    words = F.filter(F.split(F.btrim(text), "\\s+"), lambda w: w != "")
    cost = count_tokens(text)
    half = F.floor(F.greatest(F.lit(least), F.floor(F.size(words) * most / cost)) / 2).cast("int")
    ends = F.concat_ws(" ", F.array_join(F.slice(words, F.lit(1), half), " "), F.lit("[...]"), F.array_join(F.slice(words, F.greatest(F.size(words) - half + 1, F.lit(1)), half), " "))
    return F.when(cost > most, ends).otherwise(text)


def rendered(turns: DataFrame, most: int | None = None) -> DataFrame:
    """turns: session_id, turn, role, text. One text a session, a numbered line a turn; long turns lose their middle."""
    said = F.btrim("text")
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), said if most is None else cut_middle(said, most))
    lines = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


def fact_keys(raw: DataFrame, facts: DataFrame) -> DataFrame:
    """raw: id, session_id, turn, text; facts: session_id, turn, seq, text. What a verbatim turn is searched by: its
    text and the facts that were taken from it, in order."""
    said = facts.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("f"))
    own = F.concat_ws(" ", "text", F.array_join(F.transform(F.coalesce("f", F.array().cast("array<struct<seq:bigint,text:string>>")), lambda x: x["text"]), " "))
    return raw.join(said, ["session_id", "turn"], "left").select("id", "session_id", "turn", F.when(F.col("f").isNull(), F.col("text")).otherwise(own).alias("text"))


def chosen(questions: DataFrame, kinds: tuple[str, ...] = (), ids: tuple = (), most: int | None = None, kind: str = "question_type", key: str = "question_id") -> DataFrame:
    """Questions of some kinds and ids, of these the first `most` by id; an empty choice leaves all."""
    out = questions.where(F.col(kind).isin(*kinds)) if kinds else questions
    out = out.where(F.col(key).isin(*ids)) if ids else out
    return out if most is None else out.orderBy(key).limit(most)


def naive_rag(turns: DataFrame, questions: DataFrame, budget: int = 2000, k: int = 30, words: int = 150) -> DataFrame:
    """turns: session_id, ts, turn, role, text; questions: query_id, text. Chunks, fused search, what fits, in their order:
    (query_id, id, position, line)."""
    cut = packing.chunks(turns.select("session_id", "turn", "text"), words).join(turns.select("session_id", "turn", "ts", "role"), ["session_id", "turn"])
    line = F.concat(F.lit("["), F.col("session_id").cast("string"), F.lit("#"), F.col("turn").cast("string"), F.lit("] ("), F.date_format("ts", "yyyy-MM-dd"), F.lit("; "), F.col("role"), F.lit(") "), F.col("text"))
    lines = cut.select(F.xxhash64("session_id", "turn", "chunk").alias("id"), "ts", "session_id", "turn", "chunk", line.alias("text"))
    fused = retrieval.fuse(retrieval.bm25(lines.select("id", "text"), questions, k), retrieval.overlap(lines.select("id", "text"), questions, k))
    costs = lines.select("id", count_tokens(F.col("text")).alias("cost"))
    packed = packing.skip_fit(fused.join(costs, "id"), "query_id", budget, F.struct(-F.round("rrf", 9), "id")).select("query_id", "id")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("ts", "session_id", "turn", "chunk")) - 1
    return packed.join(lines, "id").select("query_id", "id", order.alias("position"), F.col("text").alias("line"))


def full(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Everything of a question's history: question_id, context."""
    line = F.concat_ws(": ", "role", "text")
    return contexts(turns.join(questions.select("question_id", "memory"), "memory").select("question_id", "ts", "session_id", "turn", line.alias("line")))


BASELINES: dict[str, Callable[..., DataFrame]] = {"full_context": full, "naive_rag": naive_rag, "oracle": oracle}


def baseline(name: str) -> Callable[..., DataFrame]:
    """The baseline of a name; ValueError with the names there are."""
    if name not in BASELINES:
        raise ValueError(f"no baseline {name!r}; there are {', '.join(sorted(BASELINES))}")
    return BASELINES[name]
