"""Conversations: turns, episodes, entities, chunks and distinct work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import consolidation, packing, retrieval
from ..operators.extraction import assistant_episodes as episodes
from ..operators.extraction import normal_role, raw_turns as turns_of
from ..schemas import NOT_ENTITIES
from .registry import query, read

_STOP = ", ".join(f"'{w}'" for w in NOT_ENTITIES)
_TOK = "greatest(1, (length(text) + 3) // 4)::INTEGER"


def turns(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn"), "role", "text")


@query(f"SELECT 'raw_' || substr(sha1(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), 1, 10) AS id, conv_id AS session_id, turn, text, {_TOK} AS tokens FROM conversations WHERE trim(text, ' \n\t') <> ''")
def raw_turns(spark, sf_dir):
    return turns_of(turns(spark, sf_dir)).select("id", "session_id", "turn", "text", "tokens")


@query("SELECT conv_id, turn, CASE role WHEN 'system' THEN 'assistant' WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role FROM conversations")
def role_normalise(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", normal_role(F.col("role")).alias("role"))


_FIRST = """regexp_extract(trim(text, ' \n\t') || ' ', '(?s)^(.*?[.!?])\\s+[A-Z"''(]', 1)"""


@query(f"""WITH a AS (SELECT conv_id AS session_id, turn, CASE WHEN {_FIRST} = '' THEN trim(text, ' \n\t') ELSE {_FIRST} END AS f FROM conversations WHERE role <> 'user')
SELECT session_id, turn, 'assistant suggested: ' || f AS text FROM a WHERE len(list_filter(regexp_split_to_array(f, '\\s+'), lambda w: w <> '')) >= 5""")
def assistant_episodes(spark, sf_dir):
    """First sentences, uncut."""
    return episodes(turns(spark, sf_dir), None).select("session_id", "turn", "text")


#: Letters that some regex engines don't count as parts of words; an underscore stands in for them.
_LATIN = "[À-ÖØ-öø-ÿĀ-ſ]"


@query(f"""WITH l AS (SELECT conv_id AS session_id, turn, list_filter(regexp_extract_all(regexp_replace(text, '{_LATIN}', '_', 'g'), '\\b([A-Z][a-zA-Z0-9]+(?:\\s+[A-Z][a-zA-Z0-9]+)*)\\b', 1), lambda e: e NOT IN ({_STOP}) AND length(e) >= 2) AS l FROM conversations)
SELECT session_id, turn, array_to_string(list_filter(l, lambda e, i: list_position(l, e) = i)[1:8], '|') AS entities FROM l""")
def entity_extract(spark, sf_dir):
    plain = F.regexp_replace("text", _LATIN, "_")
    return turns(spark, sf_dir).select("session_id", "turn", F.array_join(X.entities(plain), "|").alias("entities"))


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS id, conv_id AS s, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}'))) AS entity FROM conversations),
c AS (SELECT s AS query_id, id, 1.0 / (1 + id % 1000) AS rel, row_number() OVER (PARTITION BY s ORDER BY 1.0 / (1 + id % 1000) DESC, id) AS r FROM (SELECT DISTINCT s, id FROM w)),
n AS (SELECT query_id, entity, count(*) AS n FROM c JOIN w USING (id) WHERE r <= 10 GROUP BY 1, 2), t AS (SELECT query_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, entity) AS r FROM n) WHERE r <= 5)
SELECT DISTINCT query_id, w.id FROM t JOIN w USING (entity) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = t.query_id AND c.id = w.id)""")
def two_hop(spark, sf_dir):
    """From a conversation's first turns to turns elsewhere that share their commonest long words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))
    w = turns(spark, sf_dir).select((F.col("session_id") * 1000 + F.col("turn")).alias("id"), "session_id", F.explode(words).alias("entity"))
    candidates = w.select(F.col("session_id").alias("query_id"), "id").distinct().withColumn("rel", 1.0 / (1 + F.col("id") % 1000))
    return retrieval.second_hop(candidates, w.select("id", "entity"))


@query("""WITH h AS (SELECT conv_id AS s, turn, 1.0 / (1 + turn) AS rel FROM conversations WHERE turn % 3 = 0), p AS (SELECT s, turn + d AS turn, rel * w AS part FROM h, (VALUES (0, 1.0), (-1, 0.5), (1, 0.5)) o(d, w))
SELECT s AS session_id, p.turn, round(sum(part), 6) AS score FROM p JOIN conversations c ON c.conv_id = p.s AND c.turn = p.turn GROUP BY 1, 2""")
def neighbour_turns(spark, sf_dir):
    t = turns(spark, sf_dir)
    hits = t.where("turn % 3 = 0").select("session_id", "turn", (1.0 / (1 + F.col("turn"))).alias("rel"))
    return retrieval.neighbour_scores(hits, t.select("session_id", "turn")).select("session_id", "turn", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT conv_id % 10 AS q, conv_id AS s, turn, round(1.0 / (1 + (conv_id * 7 + turn) % 13), 6) AS sc FROM conversations), m AS (SELECT *, row_number() OVER (PARTITION BY q, s ORDER BY sc DESC, turn) AS o, row_number() OVER (PARTITION BY q ORDER BY sc DESC, s, turn) AS a FROM t),
f AS (SELECT *, CASE WHEN o = 1 AND sum((o = 1)::INT) OVER (PARTITION BY q ORDER BY a) <= 3 THEN 1 ELSE 0 END AS f FROM m) SELECT q AS query_id, s AS session_id, turn, row_number() OVER (PARTITION BY q ORDER BY f DESC, a)::INTEGER AS position FROM f""")
def raw_diversity(spark, sf_dir):
    scored = turns(spark, sf_dir).select((F.col("session_id") % 10).alias("query_id"), "session_id", "turn", F.round(1.0 / (1 + (F.col("session_id") * 7 + F.col("turn")) % 13), 6).alias("score"))
    return retrieval.diversified(scored, 3).select("query_id", "session_id", "turn", "position")


@query("SELECT count(*) AS sessions, count(DISTINCT h) AS distinct_sessions FROM (SELECT conv_id, substr(sha1(string_agg(role || chr(0) || text || chr(1), '' ORDER BY turn)), 1, 16) AS h FROM conversations GROUP BY conv_id)")
def content_hash_distinct(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    s = turns(spark, sf_dir).groupBy("session_id").agg(X.content_hash(ordered).alias("h"))
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.countDistinct("h").alias("distinct_sessions"))


@query(f"SELECT conv_id % 10 AS history, sum({_TOK})::BIGINT AS tokens, count(DISTINCT conv_id) AS sessions FROM conversations GROUP BY 1")
def session_tokens(spark, sf_dir):
    return turns(spark, sf_dir).groupBy((F.col("session_id") % 10).alias("history")).agg(F.sum(X.count_tokens(F.col("text"))).cast("long").alias("tokens"), F.countDistinct("session_id").alias("sessions"))


@query("""WITH w AS (SELECT conv_id AS session_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM conversations), i AS (SELECT session_id, turn, w, unnest(range(0, len(w), 150)) AS k FROM w)
SELECT session_id, turn, (k // 150)::INTEGER AS chunk, array_to_string(w[k + 1:k + 150], ' ') AS text FROM i""")
def chunk_turns(spark, sf_dir):
    return packing.chunks(turns(spark, sf_dir))


@query("WITH s AS (SELECT DISTINCT conv_id % 10 AS memory, conv_id AS session FROM conversations) SELECT memory, session, age::INTEGER AS age FROM (SELECT *, dense_rank() OVER (PARTITION BY memory ORDER BY session DESC) AS age FROM s) WHERE age <= 10")
def recent_sessions(spark, sf_dir):
    s = turns(spark, sf_dir).select((F.col("session_id") % 10).alias("memory"), F.col("session_id").alias("session")).distinct()
    return consolidation.recent(s)


@query("SELECT conv_id AS session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def full_context(spark, sf_dir):
    """The baseline that reads everything."""
    t = turns(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")))).alias("l"))
    return t.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("context"))


@query("WITH m AS (SELECT conv_id % 10 AS cluster, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{7,}'))) AS entity FROM conversations), n AS (SELECT cluster, entity, count(*) AS n FROM m GROUP BY 1, 2) SELECT cluster, entity, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, entity) AS r FROM n) WHERE r = 1")
def modal_entity(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{7,}"), F.lit(0)))
    return consolidation.modal_entity(turns(spark, sf_dir).select((F.col("session_id") % 10).alias("cluster"), F.explode(words).alias("entity")))


@query("SELECT conv_id, turn, sha256(role || '|' || text) AS key FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations d WHERE d.turn = 0 AND sha256(d.role || '|' || d.text) = sha256(c.role || '|' || c.text))")
def cache_misses(spark, sf_dir):
    """Turns whose key isn't in a cache that holds all first turns."""
    from ..sources.caches import missing

    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.concat_ws("|", "role", "text"), 256).alias("key"))
    return missing(c, c.where("turn = 0").select("key"))


def _placed(spark, sf_dir):
    return turns(spark, sf_dir).select((F.col("session_id") * 1000 + F.col("turn")).alias("id"), "session_id", "turn", "text")


@query("WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn FROM conversations) SELECT f.id AS fact, e.session_id, e.turn FROM t f JOIN t e ON e.id IN (f.id, f.id - 1)")
def source_join(spark, sf_dir):
    """Every turn cites itself and the one before it."""
    t = _placed(spark, sf_dir)
    return retrieval.source_locations(t.select("id", F.array(F.col("id"), F.col("id") - 1).alias("sources")), t.select("id", "session_id", "turn"))


@query("SELECT conv_id % 10 AS question_id, conv_id * 1000 + turn AS id FROM conversations WHERE conv_id % 2 = 0 OR turn IN (0, 2)")
def evidence_predicate(spark, sf_dir):
    """Sessions of odd number count only with their first and third turns."""
    t = _placed(spark, sf_dir)
    sessions = t.select("session_id").distinct().select((F.col("session_id") % 10).alias("question_id"), "session_id", F.when(F.col("session_id") % 2 == 1, F.array(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("turns"))
    return retrieval.evidence(t.select("id", "session_id", "turn"), sessions)


@query("SELECT conv_id AS session_id, turn, min(conv_id * 1000 + turn) OVER (PARTITION BY text) AS id FROM conversations")
def alias_resolution(spark, sf_dir):
    """Equal turns are known by the first one's id."""
    t = _placed(spark, sf_dir)
    first = t.groupBy("text").agg(F.min("id").alias("stored"))
    aliases = t.join(first, "text").where("id <> stored").select("id", "stored")
    return retrieval.resolved(t.select("id", "session_id", "turn"), aliases).select("session_id", "turn", "id")
