"""Scalar text functions over documents and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as T
from ..functions import text as X
from ..schemas import ENTAILMENT_STOP_WORDS, QUESTION_WORDS
from .registry import query, read
from .retrieval_queries import BM25, LEX, candidates

_STOP, _ASK = (", ".join(f"'{w}'" for w in ws) for ws in (ENTAILMENT_STOP_WORDS, QUESTION_WORDS))


@query("SELECT doc_id, 'raw_' || substr(sha1(concat_ws('|', source, CAST(doc_id AS VARCHAR), text)), 1, 10) AS id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END::INTEGER AS tokens FROM documents")
def make_ids(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", X.make_id("raw", F.col("source"), F.col("doc_id"), F.col("text")).alias("id"), X.count_tokens(F.col("text")).alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::INTEGER AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))::INTEGER AS n_distinct FROM documents")
def tokenise_counts(spark, sf_dir):
    t = X.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("n_distinct"))


_WORDS = "list_filter(regexp_split_to_array(trim(text, ' \n\t'), '\\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, len(w) AS n, list_sum(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '^\\p{{Lu}}.') THEN 1 ELSE 0 END)) AS signal FROM w)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0.2 ELSE 0.2 + 0.8 * least(1.0, 2.0 * signal / n) END, 6) AS specificity FROM s""")
def specificity(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(X.specificity(F.col("text")), 6).alias("specificity"))


def _content(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP})))"


@query(f"""WITH {BM25}{LEX}, c AS (SELECT query_id, fu.id, {_content('d.text')} AS p, {_content('b.text')} AS h FROM fu JOIN documents d ON d.doc_id = fu.id JOIN benchmark b ON b.item_id = fu.query_id)
SELECT query_id AS item_id, id AS doc_id, round(CASE WHEN len(h) = 0 THEN 1 ELSE len(list_intersect(h, p)) / len(h) END, 6) AS support FROM c""")
def lexical_entail(spark, sf_dir):
    """Do the documents that rank fusion finds for each test item entail it?"""
    c = candidates(spark, sf_dir)
    return c.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round(X.entailment(F.col("text"), F.col("q")), 6).alias("support"))


@query(f"""WITH r AS (SELECT item_id, text, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t NOT IN ({_ASK})), ' ') AS k FROM benchmark) SELECT item_id, CASE WHEN k <> '' AND k <> lower(text) THEN 'user ' || k END AS rewritten FROM r""")
def question_rewrite(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.rewritten(F.col("text")).alias("rewritten"))


_ENTITY = "trim(regexp_replace(trim(regexp_replace(lower(trim(n)), '[^a-z0-9]+', '_', 'g'), '_'), '^(my|the|a|an|our|his|her|their)_', ''), '_')"


@query(f"""WITH d AS (SELECT doc_id, text AS n FROM documents) SELECT doc_id, coalesce(nullif({_ENTITY}, ''), 'user') AS entity,
trim(regexp_replace(regexp_replace(lower(trim(n)), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS attribute, trim(trim(trim(n), '.,;:!?"''')) AS value,
coalesce(nullif(substr(array_to_string(regexp_extract_all(lower(n), '[a-z0-9]+')[1:3], '_'), 1, 40), ''), 'other') AS named FROM d""")
def canonical_names(spark, sf_dir):
    """Of whole documents, as names."""
    n = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.canonical_entity(n).alias("entity"), X.canonical_attribute(n).alias("attribute"), X.clean_value(n).alias("value"), X.attribute_from_value(n).alias("named"))


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Yes, ' WHEN 1 THEN 'no; not yes ' WHEN 2 THEN 'maybe ' ELSE '' END || '[ep_' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 10) || '] [f_zz] [raw_' || substr(sha1(CAST(doc_id % 10 AS VARCHAR)), 1, 6) || '] ' || coalesce(text, '') AS a FROM documents)
SELECT doc_id, array_to_string(regexp_extract_all(a, '\\[((?:ep|f|fs|raw)_[0-9a-f]{6,})\\]', 1), ',') AS cited, CASE nullif(regexp_extract(lower(a), '\\b(yes|no)\\b', 1), '') WHEN 'yes' THEN true WHEN 'no' THEN false END AS verdict FROM a""")
def citations_and_verdicts(spark, sf_dir):
    """Of answers made of a verdict, three citations and a whole document."""
    k = F.col("doc_id") % 4
    said = F.when(k == 0, "Yes, ").when(k == 1, "no; not yes ").when(k == 2, "maybe ").otherwise("")
    a = F.concat(said, F.lit("[ep_"), F.substring(F.sha1(F.col("doc_id").cast("string")), 1, 10), F.lit("] [f_zz] [raw_"), F.substring(F.sha1((F.col("doc_id") % 10).cast("string")), 1, 6), F.lit("] "), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.cited(a), ",").alias("cited"), X.verdict(a).alias("verdict"))


_CUES = ("What is it now?", "Where did I live in March?", "how many times did it change", "What did I do two weeks ago?", "who came last month", "what was it previously", "tell me the name", "what happened on 2023-05-20", "what of 3 days ago", "what of a year ago", "since Sep 2021", "in may we met", "past week", "last year")
_NOW = "TIMESTAMP '2023-06-10 12:00:00'"
_NUMBER = "CASE said " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.NUMBERS.items()) + " ELSE try_cast(said AS INTEGER) END"
_MONTHS = ", ".join(f"'{m}'" for m in T.MONTHS)


def _month(day: str) -> tuple[str, str]:
    return f"date_trunc('month', {day})::TIMESTAMP", f"date_trunc('month', {day})::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 SECOND"


def _year(year: str) -> tuple[str, str]:
    return f"make_timestamp({year}, 1, 1, 0, 0, 0)", f"make_timestamp({year} + 1, 1, 1, 0, 0, 0) - INTERVAL 1 SECOND"


#: When a question has which mode, and its interval.
_CASES = (
    (f"regexp_matches(q, '{T.CHANGE}')", "whole_chain", None),
    ("day IS NOT NULL", "interval", ("day::TIMESTAMP", "day::TIMESTAMP + INTERVAL 1 DAY - INTERVAL 1 SECOND")),
    ("unit = 'day'", "interval", (f"{_NOW} - to_days(n + 1)", f"{_NOW} - to_days(n - 1)")),
    ("unit = 'week'", "interval", (f"{_NOW} - to_days(7 * n + 3)", f"{_NOW} - to_days(7 * n - 3)")),
    ("unit = 'month'", "interval", _month(f"({_NOW} - to_months(n))")),
    ("unit = 'year'", "interval", _year(f"(year({_NOW}) - n)")),
    ("past = 'week'", "interval", (f"{_NOW} - INTERVAL 14 DAYS", _NOW)),
    ("past = 'month'", "interval", _month(f"({_NOW} - INTERVAL 1 MONTH)")),
    ("past = 'year'", "interval", _year(f"(year({_NOW}) - 1)")),
    ("month <> '' AND (length(month) > 3 OR regexp_matches(month, '^[A-Z][a-z]*$'))", "interval", _month(f"make_date(coalesce(said_year, CASE WHEN k <= month({_NOW}) THEN year({_NOW}) ELSE year({_NOW}) - 1 END)::INTEGER, k, 1)")),
    (f"regexp_matches(q, '{T.NOW}')", "now", (_NOW, _NOW)),
    (f"regexp_matches(q, '{T.BEFORE}')", "before_latest", None),
)


def _ends(i: int) -> str:
    return " ".join(f"WHEN {when} THEN {ends[i] if ends else 'NULL'}" for when, _, ends in _CASES)


_ASKED = ", ".join(f"'{c}'" for c in _CUES)
_MODES = " ".join(f"WHEN {when} THEN '{mode}'" for when, mode, _ in _CASES)


@query(f"""WITH q AS (SELECT item_id, trim(list_value({_ASKED})[item_id % {len(_CUES)} + 1] || ' ' || coalesce(text, ''), ' ') AS q FROM benchmark),
p AS (SELECT *, lower(regexp_extract(q, '{T.AGO}', 1)) AS said, lower(regexp_extract(q, '{T.AGO}', 2)) AS unit, lower(regexp_extract(q, '{T.LAST_UNIT}', 2)) AS past, regexp_extract(q, '{T.MONTH}', 1) AS month,
  try_cast(regexp_extract(q, '{T.MONTH}', 2) AS INTEGER) AS said_year, try_cast(concat_ws('-', regexp_extract(q, '{T.DATE}', 1), regexp_extract(q, '{T.DATE}', 2), regexp_extract(q, '{T.DATE}', 3)) AS DATE) AS day FROM q),
x AS (SELECT *, coalesce({_NUMBER}, 0)::INTEGER AS n, greatest(coalesce(list_position([{_MONTHS}], lower(left(month, 3))), 1), 1)::INTEGER AS k FROM p)
SELECT item_id, CASE {_MODES} ELSE 'none' END AS mode, (CASE {_ends(0)} END)::TIMESTAMP AS start, (CASE {_ends(1)} END)::TIMESTAMP AS "end" FROM x""")
def temporal_cues(spark, sf_dir):
    """What questions ask about, on the tenth of June 2023: a cue dealt by id, before the whole text of a test item."""
    cue = F.get(X.strings(_CUES), (F.col("item_id") % len(_CUES)).cast("int"))
    q = F.concat(cue, F.lit(" "), F.coalesce("text", F.lit("")))
    parsed = read(spark, sf_dir, "benchmark").select("item_id", T.parse_temporal(q, F.lit("2023-06-10 12:00:00").cast("timestamp_ntz")).alias("t"))
    return parsed.select("item_id", "t.mode", "t.start", "t.end")


_STAMPS = ("%Y/%m/%d (%a) %H:%M", "%Y/%m/%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d", "around %Y")
_WRITTEN = " ".join(f"WHEN {i} THEN strftime(ts, '{f}')" for i, f in enumerate(_STAMPS))


@query(f"""WITH e AS (SELECT event_id, CASE event_id % {len(_STAMPS)} {_WRITTEN} END AS said FROM events), b AS (SELECT event_id, regexp_replace(trim(said), '\\s*\\([A-Za-z]{{3}}\\)', '') AS t FROM e)
SELECT event_id, try_strptime(t, ['%Y/%m/%d %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y/%m/%d']) AS at FROM b""")
def session_dates(spark, sf_dir):
    """Times of events, written in every format that a session's date comes in, and in one that it doesn't, read back."""
    stamps = ("yyyy/MM/dd (EEE) HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "'around' yyyy")
    k, said = F.col("event_id") % len(stamps), F.lit(None).cast("string")
    for i, pattern in enumerate(stamps):
        said = F.when(k == i, F.date_format("ts", pattern)).otherwise(said)
    return read(spark, sf_dir, "events").select("event_id", T.parse_session_date(said).alias("at"))


@query()
def hash_embedding(spark, sf_dir):
    """Each document's vector: its length, first bucket, and a digest of all of it."""
    from ..functions.vectors import dot
    from ..functions.vectors import hash_embedding as embed

    d = read(spark, sf_dir, "documents").select("doc_id", embed()("text").alias("v"))
    return d.select("doc_id", F.round(dot(F.col("v"), F.col("v")), 4).alias("norm"), F.round(F.get("v", F.lit(0)).cast("double"), 5).alias("first"), F.sha2(F.array_join(F.transform("v", lambda x: F.format_number(x.cast("double"), 5)), ","), 256).alias("digest"))


@query()
def truncate_text(spark, sf_dir):
    heads = read(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text"), 60).alias("head"))
    return heads.select("doc_id", "head", X.count_tokens(F.col("head")).alias("tokens"))
