"""Contexts, answers and judgements as columns; a model is any callable from texts to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import citations

ABSTAIN = "I don't know."


def _day(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")


def format_entry(e: Callable[[str], Column] = F.col) -> Column:
    """A line of an entry: id, validity or date, kind, speaker and text."""
    until = F.when(e("valid_to").isNotNull(), F.concat(F.lit(" to "), _day(e("valid_to")))).otherwise("")
    fact = F.concat(F.lit("["), e("id"), F.lit("] (valid from "), _day(e("ts")), until, F.lit("; fact/"), e("kind"), F.lit("; by "), e("speaker"), F.lit(") "), e("text"))
    episode = F.concat(F.lit("["), e("id"), F.lit("] ("), _day(e("ts")), F.lit("; episode/"), e("speaker"), F.lit(") "), e("text"))
    return F.when(e("etype") == "fact", fact).otherwise(episode)


def format_turn(verbatim: bool = False) -> Column:
    tail = ", verbatim) " if verbatim else ") "
    return F.concat(F.lit("["), F.col("id"), F.lit("] ("), _day(F.col("ts")), F.lit("; "), F.col("speaker"), F.lit(tail), F.col("text"))


def contexts(lines: DataFrame) -> DataFrame:
    """lines: question_id, ts, session_id, turn, line. One text per question, in order of time."""
    rows = F.array_sort(F.collect_list(F.struct("ts", "session_id", "turn", "line")))
    return lines.groupBy("question_id").agg(rows.alias("r")).select("question_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("context"))


def extractive(packed: DataFrame) -> DataFrame:
    """packed: question_id, id, etype, value, text, rel. The best entry, facts before episodes, with its citation."""
    order = F.row_number().over(W.partitionBy("question_id").orderBy(F.desc(F.col("etype") == "fact"), F.desc("rel"), "id"))
    said = F.concat(F.when(F.col("etype") == "fact", F.col("value")).otherwise(F.col("text")), F.lit(" ["), F.col("id"), F.lit("]"))
    return packed.withColumn("_r", order).where("_r = 1").select("question_id", said.alias("answer"))


def cited(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """Citations of each answer that were injected, and those that weren't."""
    own = packed.groupBy("question_id").agg(F.collect_set("id").alias("ids"))
    c = citations(F.col("answer"))
    none = F.array().cast("array<string>")
    return answers.join(own, "question_id", "left").select("question_id", "answer", F.array_intersect(c, F.coalesce("ids", none)).alias("valid"), F.array_except(c, F.coalesce("ids", none)).alias("invalid"))


#: What a judge is told for each kind of question, before question, gold answer and response.
JUDGE = {
    "abstention": "The question can't be answered. Say yes if the response recognises that, else no.",
    "temporal-reasoning": "Say yes if the response contains the correct answer, else no. Counts of days, weeks or months may be off by one.",
    "knowledge-update": "Say yes if the response contains the updated answer, even beside outdated facts, else no.",
    "single-session-preference": "The answer is a rubric. Say yes if the response uses what the user told about themselves, else no.",
    "other": "Say yes if the response contains or equals the correct answer, else no; a part of it is not enough.",
}


def judge_prompt() -> Column:
    """Over question_type, is_abstention, question, gold, answer."""
    rule = F.lit(JUDGE["other"])
    for kind in ("temporal-reasoning", "knowledge-update", "single-session-preference"):
        rule = F.when(F.col("question_type") == kind, JUDGE[kind]).otherwise(rule)
    rule = F.when(F.col("is_abstention"), JUDGE["abstention"]).otherwise(rule)
    return F.concat(rule, F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAnswer: "), F.col("gold"), F.lit("\nResponse: "), F.col("answer"), F.lit("\n\nyes or no?"))


def by_model(prompts: DataFrame, model: Callable[[list[str]], list[str]], prompt: str = "prompt", out: str = "reply", tries: int = 3) -> DataFrame:
    """A column of replies; a call that raises or is empty is tried again, and null after the last try."""

    def ask(text: str) -> str | None:
        for _ in range(tries):
            try:
                if reply := model([text])[0]:
                    return reply
            except Exception:  # noqa: BLE001, S112  a model's errors are its own
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [ask(t) for t in pdf[prompt]]})

    return prompts.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, {out} string")


def judge_health(verdicts: DataFrame) -> DataFrame:
    """verdicts: verdict (null: none)."""
    return verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict")).alias("yes"), F.count_if(~F.col("verdict")).alias("no"), F.count_if(F.col("verdict").isNull()).alias("unjudged"))
