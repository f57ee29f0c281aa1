"""What is read beside packed entries: excerpts, unions, rendered sessions, baselines, weights of entries, small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import hawkes, packing, reading, retrieval
from ..schemas import NOT_ENTITIES
from .conversation_queries import turns
from .event_queries import events
from .registry import ORACLES, query, read

_TOK = "greatest(1, (length(text) + 3) // 4)"
_SCORED = f"""sc AS ({ORACLES['neighbour_turns']}), i AS (SELECT s.session_id, conv_id * 1000 + c.turn AS id, c.turn, {_TOK}::BIGINT AS cost, row_number() OVER (PARTITION BY s.session_id ORDER BY score DESC, c.turn) AS r FROM sc s JOIN conversations c ON c.conv_id = s.session_id AND c.turn = s.turn WHERE score > 0 AND text <> ''),
p AS (SELECT session_id, 0::BIGINT AS r, 0::BIGINT AS used, NULL::BIGINT AS id, NULL::BIGINT AS turn FROM (SELECT DISTINCT session_id FROM i)
  UNION ALL SELECT i.session_id, i.r, CASE WHEN used + cost <= 60 THEN used + cost ELSE used END, CASE WHEN used + cost <= 60 THEN i.id END, i.turn FROM p JOIN i ON i.session_id = p.session_id AND i.r = p.r + 1),
x AS (SELECT session_id, id, turn FROM p WHERE id IS NOT NULL)"""


def _scored(spark, sf_dir):
    t = turns(spark, sf_dir).where("text <> ''")
    hits = turns(spark, sf_dir).where("turn % 3 = 0").select("session_id", "turn", (1.0 / (1 + F.col("turn"))).alias("rel"))
    scores = retrieval.neighbour_scores(hits, t.select("session_id", "turn")).withColumn("score", F.round("score", 6))
    own = t.select("session_id", "turn", (F.col("session_id") * 1000 + F.col("turn")).alias("id"), X.count_tokens(F.col("text")).alias("cost"))
    return scores.join(own, ["session_id", "turn"])


def _excerpts(spark, sf_dir):
    return reading.excerpts(_scored(spark, sf_dir).withColumn("asked", F.col("session_id")), "asked", 60)


@query(f"WITH RECURSIVE {_SCORED} SELECT session_id, id, turn, (row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1)::INTEGER AS position FROM x")
def excerpt_pack(spark, sf_dir):
    """Verbatim turns around the hits of neighbour_turns, as far as they fit, in order of time."""
    return _excerpts(spark, sf_dir).select("session_id", "id", F.col("turn"), "position")


@query(f"""WITH RECURSIVE {_SCORED}, k AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS id, sum({_TOK}) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations WHERE text <> '')
SELECT session_id, id FROM x UNION SELECT session_id, id FROM k WHERE used <= 40""")
def set_union(spark, sf_dir):
    """What is injected: a conversation's first turns within a budget, and the excerpts."""
    t = turns(spark, sf_dir).where("text <> ''").select("session_id", "turn", (F.col("session_id") * 1000 + F.col("turn")).alias("id"), X.count_tokens(F.col("text")).alias("cost"))
    first = packing.prefix(t, "session_id", 40, "turn").select(F.col("session_id").alias("asked"), "id")
    return reading.injected(first, _excerpts(spark, sf_dir), "asked").select(F.col("asked").alias("session_id"), "id")


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE length(text) > 40 EXCEPT SELECT conv_id * 1000 + turn FROM conversations WHERE role = 'user'")
def allowed_without_raw(spark, sf_dir):
    """Long turns are allowed, the user's are verbatim ones."""
    t = turns(spark, sf_dir).withColumn("id", F.col("session_id") * 1000 + F.col("turn"))
    return reading.without_raw(t.where(F.length("text") > 40), t.where("role = 'user'"))


@query("SELECT e.question_id, c.conv_id AS session_id, c.turn, c.text FROM (SELECT DISTINCT conv_id % 10 AS question_id, conv_id FROM conversations WHERE role = 'assistant' AND length(text) > 60) e JOIN conversations c ON c.conv_id = e.conv_id")
def oracle_turns(spark, sf_dir):
    """Conversations with a long reply are the evidence of the question that their number names."""
    t = turns(spark, sf_dir)
    evidence = t.where((F.col("role") == "assistant") & (F.length("text") > 60)).select((F.col("session_id") % 10).alias("question_id"), "session_id")
    return reading.oracle(t, evidence).select("question_id", "session_id", "turn", "text")


@query("""WITH t AS (SELECT conv_id, turn, role, trim(text, ' ') AS x FROM conversations), w AS (SELECT *, CASE WHEN length(x) = 0 THEN 0 ELSE greatest(1, (length(x) + 3) // 4) END AS cost, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM t),
h AS (SELECT *, CASE WHEN cost > 12 THEN (greatest(20, floor(len(w) * 12 / cost)) // 2)::INTEGER END AS half FROM w),
l AS (SELECT conv_id, turn, '[' || turn || '] ' || role || ': ' || CASE WHEN cost > 12 THEN array_to_string(w[1:half], ' ') || ' [...] ' || array_to_string(w[greatest(len(w) - half + 1, 1):], ' ') ELSE x END AS line FROM h)
SELECT conv_id AS session_id, string_agg(line, chr(10) ORDER BY turn) AS context FROM l GROUP BY conv_id""")
def rendered_sessions(spark, sf_dir):
    return reading.rendered(turns(spark, sf_dir), 12)


@query("""WITH f AS (SELECT conv_id, turn, string_agg('user names: ' || w, ' ' ORDER BY k) AS f FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{5,}'), 1) AS k FROM conversations) GROUP BY 1, 2)
SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id AS session_id, c.turn, CASE WHEN f IS NULL THEN text ELSE text || ' ' || f END AS text FROM conversations c LEFT JOIN f ON f.conv_id = c.conv_id AND f.turn = c.turn""")
def raw_fact_text(spark, sf_dir):
    """Each turn with facts made of its capitalised words."""
    t = turns(spark, sf_dir)
    said = t.select("session_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0))).alias("seq", "w"))
    facts = said.select("session_id", "turn", F.col("seq").cast("long").alias("seq"), F.concat(F.lit("user names: "), "w").alias("text"))
    return reading.fact_keys(t.withColumn("id", F.col("session_id") * 1000 + F.col("turn")), facts)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr') ORDER BY doc_id LIMIT 50")
def question_selection(spark, sf_dir):
    """The first fifty of two kinds, which is what is asked for."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return reading.chosen(d, ("en", "fr"), most=50, kind="lang", key="doc_id")


@query(f"WITH k AS ({ORACLES['hawkes_intensity']}) SELECT e.event_id, round(greatest(coalesce(a.intensity, 0.01), coalesce(b.intensity, 0.01)), 6) AS weight FROM events e LEFT JOIN k a ON a.key = e.user_id LEFT JOIN k b ON b.key = e.user_id + 1")
def entry_weights(spark, sf_dir):
    """An entry's weight is the largest intensity of its keys, here of a user and the next one."""
    e = events(spark, sf_dir)
    at = e.agg(F.max("day")).first()[0]
    known = hawkes.intensity(e.select("key", "day"), at if at is not None else 0.0).withColumn("intensity", F.round("intensity", 6))
    entries = e.select(F.col("event_id").alias("id"), F.array(F.col("key"), F.col("key") + 1).alias("keys"))
    return hawkes.entry_weights(entries, known).select(F.col("id").alias("event_id"), F.round("weight", 6).alias("weight"))


@query()
def naive_rag(spark, sf_dir):
    """Chunks of conversations for every test item."""
    t = turns(spark, sf_dir).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return reading.naive_rag(t, asked).select("query_id", "position", "line")


@query("SELECT doc_id, coalesce(contains(lower(text), lower(trim(source))) AND trim(source) <> '', false) AS matches FROM documents")
def exact_matches(spark, sf_dir):
    """Does a document hold the name of its source?"""
    return read(spark, sf_dir, "documents").select("doc_id", X.exact_match(F.col("text"), F.col("source")).alias("matches"))


@query("SELECT event_id, nullif(regexp_extract('Sure: ```' || props || '``` done', '(?s)(\\{.*\\})', 1), '') AS bare FROM events")
def bare_json(spark, sf_dir):
    reply = F.concat(F.lit("Sure: ```"), F.col("props"), F.lit("``` done"))
    return read(spark, sf_dir, "events").select("event_id", X.bare_json(reply).alias("bare"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '^.*/', ''), '-[0-9]{4}-?[0-9]{2}-?[0-9]{2}$', '') AS name FROM pages")
def model_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.model_name(F.col("url")).alias("name"))


_STOP = ", ".join(f"'{w}'" for w in NOT_ENTITIES)


@query("""WITH t AS (SELECT conv_id AS session_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN list_filter(['user/' || lower(role), CASE WHEN regexp_matches(text, '^\\p{Lu}') THEN lower(text) END], lambda k: k IS NOT NULL)
 WHEN role = 'user' THEN ['user'] ELSE [lower(role)] END AS k FROM conversations) SELECT session_id, turn, array_to_string(k, '|') AS keys FROM t""")
def entry_keys(spark, sf_dir):
    """Every second turn as a fact of the user, the others as episodes about who speaks."""
    kind = F.when(F.col("turn") % 2 == 0, "fact").otherwise("episode")
    keys = X.hawkes_keys(kind, F.lit("User"), F.col("role"), F.col("text"), F.array("role"))
    return turns(spark, sf_dir).select("session_id", "turn", F.array_join(keys, "|").alias("keys"))


@query("""WITH w AS (SELECT conv_id AS session_id, turn, role, text, list_filter(regexp_split_to_array(trim(text, ' '), '\\s+'), lambda w: w <> '') AS w FROM conversations),
s AS (SELECT *, len(w) AS n, list_sum(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(x, '^\\p{Lu}.') THEN 1 ELSE 0 END)) AS signal FROM w)
SELECT session_id, turn, round(CASE WHEN n = 0 THEN 0.2 ELSE 0.2 + 0.8 * least(1.0, 2.0 * signal / n) END * CASE WHEN role = 'user' THEN 1.0 ELSE 0.6 END / greatest(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, (length(text) + 3) // 4) END, 20), 9) AS value FROM s""")
def raw_values(spark, sf_dir):
    """The value density of each turn."""
    t = turns(spark, sf_dir)
    return t.select("session_id", "turn", F.round(X.raw_value(F.col("text"), F.col("role"), X.count_tokens(F.col("text"))), 9).alias("value"))
