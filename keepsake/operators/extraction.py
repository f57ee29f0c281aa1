"""Turns to episodes and facts by rules, and the interface of a model in their place."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_value, count_tokens, entities, make_id, sentences, strings, truncated
from ..schemas import ATTRIBUTES, EXTRACTION

FIRST_PERSON = "(?i)\\b(i|i'm|i've|i'd|i'll|my|me|we|our|mine)\\b"
# Fact patterns as (pattern, attribute, kind, group of the value, group of the attribute or 0).
FACTS = (
    (r"\bI(?: just| recently)? moved to ([A-Z][\w .'-]+?)(?=[,.!?;]| this| last| for| with| and| because|$)", "location", "stated", 1, 0),
    (r"\bI(?:'m| am)? (?:currently )?liv(?:e|ing) in ([A-Z][\w .'-]+?)(?=[,.!?;]| now| with| and| for|$)", "location", "stated", 1, 0),
    (r"\bI (?:work|am working|started working) (?:at|for) ([A-Z][\w .&'-]+?)(?=[,.!?;]| as| in| now| and|$)", "employer", "stated", 1, 0),
    (r"\bI(?:'m| am) (?:a|an) ([a-z][\w -]{2,30}?)(?= at| in| for| by| and|[,.!?;]|$)", "occupation", "inferred", 1, 0),
    (r"\bI(?:'m| am) allergic to ([\w ,'-]+?)(?=[.!?;]| and| so| which|$)", "allergy", "stated", 1, 0),
    (r"\b[Mm]y name is ([A-Z][\w'-]+)", "name", "stated", 1, 0),
    (r"\b[Mm]y (?:favou?rite) ([a-z][\w ]{2,25}?) (?:is|are) ([\w ,'&-]+?)(?=[.!?;]| and| but| because|$)", "favorite_", "preference", 2, 1),
    (r"\bI (?:really )?(?:love|like|enjoy|prefer) ([\w ,'-]{3,40}?)(?=[.!?;]| and| but| because| so| when|$)", "likes", "preference", 1, 0),
    (r"\bI (?:really )?(?:hate|dislike|can't stand|cannot stand) ([\w ,'-]{3,40}?)(?=[.!?;]| and| but| because| so|$)", "dislikes", "preference", 1, 0),
    (r"\b[Mm]y ([a-z][\w' ]{2,20}?) is (?:called |named )?([A-Z][\w'-]+)", "", "stated", 2, 1),
    (r"\b[Mm]y birthday is (?:on )?([\w ]+?\d[\w ,]*?)(?=[.!?;]|$)", "birthday", "stated", 1, 0),
)


def normal_role(role: Column) -> Column:
    return F.when(role.isin("assistant", "system"), "assistant").otherwise("user")


def raw_turns(turns: DataFrame) -> DataFrame:
    """turns: session_id, turn, role, text. Non-blank turns as verbatim episodes."""
    kept = turns.where(F.regexp_replace("text", "\\s+", "") != "")
    return kept.select(make_id("raw", F.col("session_id"), F.col("turn")).alias("id"), "*", F.array().cast("array<string>").alias("entities"), count_tokens(F.col("text")).alias("tokens"), F.lit(True).alias("raw"))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def assistant_episodes(turns: DataFrame, most: int | None = 60) -> DataFrame:
    """The first sentence of each assistant turn, if it has five words."""
    first = turns.where(normal_role(F.col("role")) == "assistant").select("session_id", "turn", F.get(sentences(F.col("text")), F.lit(0)).alias("s")).where(_words(F.col("s")) >= 5)
    said = F.concat(F.lit("assistant suggested: "), F.col("s"))
    return first.select("session_id", "turn", F.lit("assistant").alias("speaker"), (said if most is None else truncated(said, most)).alias("text"))


def user_sentences(turns: DataFrame) -> DataFrame:
    """Sentences of the user that speak in the first person and have four words, with their place."""
    each = turns.where(normal_role(F.col("role")) == "user").select("session_id", "turn", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    return each.where((_words(F.col("sentence")) >= 4) & F.col("sentence").rlike(FIRST_PERSON))


def episodes(turns: DataFrame, most: int = 60) -> DataFrame:
    user = user_sentences(turns).select("session_id", "turn", F.lit("user").alias("speaker"), truncated(F.col("sentence"), most).alias("text"))
    both = user.unionByName(assistant_episodes(turns, most))
    found = entities(F.col("text"))
    named = F.when((F.col("speaker") == "user") & ~F.exists(found, lambda e: F.lower(e) == "user"), F.concat(strings(["user"]), found)).otherwise(found)
    return both.select(make_id("ep", F.col("session_id"), F.col("turn"), F.col("text")).alias("id"), "*", named.alias("entities"), count_tokens(F.col("text")).alias("tokens"))


def facts(turns: DataFrame) -> DataFrame:
    """What the patterns find; of a session's equal (attribute, value) pairs the first."""
    found = []
    for i, (pattern, attribute, kind, value, named) in enumerate(FACTS):
        own = F.regexp_extract("sentence", pattern, value)
        name = F.lit(attribute)
        if named:
            snake = F.btrim(F.regexp_replace(F.lower(clean_value(F.regexp_extract("sentence", pattern, named))), "[^a-z0-9]+", "_"), F.lit("_"))
            name = F.concat(F.lit(attribute), snake)
        found.append(F.struct(F.lit(i).alias("rule"), name.alias("attribute"), F.lit(kind).alias("kind"), clean_value(own).alias("value")))
    each = user_sentences(turns).select("session_id", "turn", "place", F.explode(F.array(*found)).alias("f")).select("session_id", "turn", "place", "f.*").where((F.length("value") > 0) & (F.length("value") <= 60))
    first = F.min_by(F.struct("turn", "place", "value", "kind"), F.struct("turn", "place", "rule"))
    kept = each.groupBy("session_id", "attribute", F.lower("value").alias("low")).agg(first.alias("f"))
    return kept.select(make_id("f", F.col("session_id"), F.lit("user"), F.col("attribute"), F.col("f.value")).alias("id"), "session_id", F.lit("user").alias("entity"), "attribute", "f.value", "f.kind", "f.turn")


def salvage(text: str | None) -> str | None:
    """A JSON object that was cut off, up to its last whole item, closed; null if nothing can be kept."""
    text = (text or "")[(text or "").find("{") :] if "{" in (text or "") else ""
    stack, quoted, escaped, ends = [], False, False, []
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
    for end, close in reversed(ends):
        try:
            json.loads(text[:end] + close)
            return text[:end] + close
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def salvaged(replies: pd.Series) -> pd.Series:
    return replies.map(salvage)


def parse(replies: Column) -> Column:
    """A model's reply as an extraction; cut-off replies as far as they go."""
    whole = F.get_json_object(replies, "$").isNotNull()
    return F.from_json(F.when(whole, replies).otherwise(salvaged(replies)), EXTRACTION)


def degenerate(replies: DataFrame, key: str = "session_id", raw: str = "raw") -> DataFrame:
    """Replies whose JSON doesn't close, or that say one value five times."""
    values = F.regexp_extract_all(raw, F.lit('"value"\\s*:\\s*"([^"]*)"'), F.lit(1))
    most = F.array_max(F.transform(F.array_distinct(values), lambda v: F.size(F.filter(values, lambda w: w == v))))
    return replies.select(key, (~F.rtrim(raw).endswith("}") | (F.coalesce(most, F.lit(0)) >= 5)).alias("degenerate"))


def normalised_attribute(attribute: Column, custom: Column) -> Column:
    """Of the closed list as it is; ``other`` gives its custom name."""
    return F.when(attribute.isin(*[a for a in ATTRIBUTES if a != "other"]), attribute).otherwise(F.coalesce(F.nullif(custom, F.lit("")), attribute))


def extracted(sessions: DataFrame, model: Callable[[list[str]], list[str]], again: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """sessions: session_id, text, n_turns. (session_id, raw, out, ok): a model's replies and what they say.

    Degenerate replies are asked for once more, of `again`, and the second stands if it isn't degenerate. Turn
    numbers outside a session are moved to its ends. Where nothing can be read, out is null and ok false: facts and
    episodes of the rules take its place.
    """
    first = by_model(sessions.select("session_id", "text", "n_turns"), model)
    if again is not None:
        bad = first.join(degenerate(first).where("degenerate").select("session_id"), "session_id", "left_semi").drop("raw")
        second = by_model(bad, again)
        good = second.join(degenerate(second).where("NOT degenerate").select("session_id"), "session_id", "left_semi")
        first = first.join(good.select("session_id", F.col("raw").alias("_raw")), "session_id", "left").withColumn("raw", F.coalesce("_raw", "raw")).drop("_raw")
    last = F.greatest(F.col("n_turns") - 1, F.lit(0))
    clamped = lambda items: F.transform(items, lambda x: x.withField("turn_idx", F.greatest(F.lit(0), F.least(x["turn_idx"], last))))
    out = first.withColumn("out", parse(F.col("raw")))
    out = out.withColumn("out", F.when(F.col("out.episodes").isNotNull() & F.col("out.facts").isNotNull(), F.struct(clamped(F.col("out.episodes")).alias("episodes"), clamped(F.col("out.facts")).alias("facts"))))
    return out.select("session_id", "raw", "out", (F.col("out").isNotNull() & F.get_json_object("raw", "$").isNotNull()).alias("ok"))


def by_model(sessions: DataFrame, model: Callable[[list[str]], list[str]], text: str = "text", batch: int = 64) -> DataFrame:
    """sessions with a column raw: a model's replies, whatever the model; it is called with lists of texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = [r for i in range(0, len(pdf), batch) for r in model(list(pdf[text].iloc[i : i + batch]))]
            yield pdf.assign(raw=replies)

    return sessions.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in sessions.schema)}, raw string")
