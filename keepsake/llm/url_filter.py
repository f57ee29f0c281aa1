"""URL filter (2): host and path rules first, a weighted vocabulary for the urls that no rule fits.

An Aho-Corasick automaton reads each lower-cased url once and reports the terms it holds. A hit counts
where no ASCII letter or digit touches it. One strict hit blocks the url; soft hits block it when the
weights of the distinct ones reach a threshold, so one soft term alone never does. Rules are native
column expressions over a fixed list.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; the
vocabulary still reads what text there is; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ascii_lower, table

#: (host, path, verdict); a rule fits the host, its subdomains, and urls whose path starts with the path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRICT = ("casino", "porn", "spam", "viagra", "warez", "xxx")
SOFT = {"adult": 0.6, "bet": 0.5, "bonus": 0.5, "cheap": 0.5, "crack": 0.6, "dating": 0.5, "deals": 0.4, "escort": 0.8, "farm": 0.5, "free": 0.4, "loan": 0.5, "pills": 0.7, "poker": 0.7, "promo": 0.4, "torrent": 0.6, "win": 0.4}
#: Distinct soft weights that block. Every weight is less.
SOFT_LIMIT = 0.9

FOUND = T.StructType([T.StructField("strict_hits", T.IntegerType()), T.StructField("soft_hits", T.IntegerType()), T.StructField("soft_weight", T.DoubleType())])


@dataclass(frozen=True)
class Vocabulary:
    strict: tuple[str, ...] = STRICT
    soft: tuple[tuple[str, float], ...] = field(default=tuple(SOFT.items()))


@cache
def _automaton(words: Vocabulary) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in words.strict:
        out.add_word(term, (term, None))
    for term, weight in words.soft:
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def _touches(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()


def scan(url: str | None, words: Vocabulary) -> tuple[int, int, float]:
    """Strict hits, distinct soft terms and their weight."""
    strict, soft, low = 0, {}, (url or "").lower()
    for end, (term, weight) in _automaton(words).iter(low) if words.strict or words.soft else ():
        if _touches(low, end - len(term)) or _touches(low, end + 1):
            continue
        if weight is None:
            strict += 1
        else:
            soft[term] = weight
    return strict, len(soft), round(sum(soft.values()), 6)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, words: Vocabulary = Vocabulary(), limit: float = SOFT_LIMIT) -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight."""

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            yield pd.DataFrame([scan(u, words) for u in urls], columns=FOUND.names)

    out = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), found(F.col(url)).alias("f"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    by_words = F.when((F.col("f.strict_hits") > 0) | (F.col("f.soft_weight") >= limit), "block").otherwise("allow")
    return out.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, by_words).alias("verdict"), "f.strict_hits", "f.soft_hits", "f.soft_weight")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _has(term: str) -> str:
    return f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"


def _hits(term: str) -> str:
    """Hits of a term, touching ones too: all places less those with a letter or digit at a side."""
    n = f"(length(u) - length(replace(u, '{term}', ''))) // {len(term)}"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE (SELECT count(*) FROM range(1, length(u) - {len(term)} + 2) t(i) WHERE substr(u, i, {len(term)}) = '{term}' AND NOT regexp_matches(substr(' ' || u, i, 1), '[a-z0-9]') AND NOT regexp_matches(substr(u || ' ', i + {len(term)}, 1), '[a-z0-9]')) END)"


SQL = f"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT *, CAST({" + ".join(map(_hits, STRICT))} AS INTEGER) AS strict_hits,
    CAST({" + ".join(f"{_has(t)}::INTEGER" for t in SOFT)} AS INTEGER) AS soft_hits,
    round(CAST({" + ".join(f"{_has(t)}::INTEGER * {w}" for t, w in SOFT.items())} AS DOUBLE), 6) AS soft_weight,
    CASE {" ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))} END AS rule FROM p)
SELECT page_id, host, path, rule,
    CASE {" ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in RULES)}
         WHEN strict_hits > 0 OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
    strict_hits, soft_hits, soft_weight
FROM h
"""
