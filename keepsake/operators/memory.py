"""The life of a memory: ingest turns, keep entries under a budget, answer questions; keyed by memory throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import parse_temporal
from ..functions.text import count_tokens, entities, format_fact, make_id, tokens
from ..functions.vectors import dot, hash_embedding
from ..session import cut
from . import answering, chains, extraction, packing, selection
from .kernels import Config
from .evaluation import should_abstain
from .reading import excerpts
from .retrieval import B, K1, RRF_K, hop_share, neighbour_scores, ranked, top_entities

DIM = 256


def entries(turns: DataFrame, dim: int = DIM) -> DataFrame:
    """turns: memory, session_id, ts, turn, role, text. Episodes and fact versions as one table with vectors."""
    keyed = turns.select("*", F.concat_ws("\1", "memory", "session_id").alias("_s"))
    ids = keyed.select("_s", "memory", F.col("session_id").alias("sid"), "ts").distinct()
    sessions = keyed.select(F.col("_s").alias("session_id"), "turn", "role", "text")
    episodes = extraction.episodes(sessions).join(ids, F.col("session_id") == F.col("_s"))
    none = F.lit(None)
    e = episodes.select("memory", F.concat_ws("_", "id", "memory").alias("id"), F.lit("episode").alias("etype"), "ts", none.cast("timestamp_ntz").alias("valid_to"), F.col("sid").alias("session_id"), F.col("turn").cast("int").alias("turn"), "speaker", none.cast("string").alias("kind"), none.cast("string").alias("entity"), none.cast("string").alias("attribute"), none.cast("string").alias("value"), "text", none.cast("string").alias("unit"))
    facts = extraction.facts(sessions).join(ids, F.col("session_id") == F.col("_s"))
    chained = chains.build(facts.select(F.concat_ws("\1", "memory", "entity").alias("entity"), "attribute", "value", F.col("ts").alias("valid_from"), F.col("id").alias("seq"), "memory", "kind", "turn", F.col("sid").alias("session_id")))
    f = chained.select("memory", F.concat_ws("_", "seq", "memory").alias("id"), F.lit("fact").alias("etype"), F.col("valid_from").alias("ts"), "valid_to", "session_id", F.col("turn").cast("int").alias("turn"), F.lit("user").alias("speaker"), "kind", F.lit("user").alias("entity"), "attribute", "value", format_fact(F.lit("user"), F.col("attribute"), F.col("value")).alias("text"), F.concat_ws("/", F.lit("user"), "attribute").alias("unit"))
    return e.unionByName(f).select("*", count_tokens(F.col("text")).alias("cost"), hash_embedding(dim)("text").alias("vec"))


def keep(found: DataFrame, budget: int, policy: Config | None = None) -> DataFrame:
    """The entries of each memory's active sieve."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    stream = found.select("memory", "id", at.alias("at"), "vec", "cost", F.coalesce("unit", F.lit("")).alias("unit"))
    kept = selection.replay(stream, policy or Config(budget, write="all", duplicate=0.999))
    return found.join(kept.select("memory", "id"), ["memory", "id"], "left_semi")


def retrieve(kept: DataFrame, questions: DataFrame, k: int = 30, dim: int = DIM) -> DataFrame:
    """question_id, id, rel: BM25 and vectors of the question's own memory, fused."""
    asked = questions.select("question_id", "memory", "question", hash_embedding(dim)("question").alias("qv"))
    words = kept.select("memory", "id", tokens(F.col("text")).alias("t"))
    stats = words.groupBy("memory").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("t")).alias("mean"))
    tf = words.select("memory", "id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("memory", "id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))
    df = tf.groupBy("memory", "term").agg(F.count(F.lit(1)).alias("df"))
    terms = asked.select("question_id", "memory", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))
    j = tf.join(df, ["memory", "term"]).join(terms, ["memory", "term"]).join(stats, "memory")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    lexical = ranked(j.groupBy("question_id", "id").agg(F.round(F.sum(part), 6).alias("s")), "question_id", F.desc("s"), k)
    cosines = kept.join(asked, "memory").select("question_id", "id", dot(F.col("vec"), F.col("qv")).alias("cosine"))
    dense = ranked(cosines.withColumn("s", F.round("cosine", 6)), "question_id", F.desc("s"), k)
    fused = lexical.select("question_id", "id", "rank").unionByName(dense.select("question_id", "id", "rank")).groupBy("question_id", "id").agg(F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("rrf"))
    top = F.max("rrf").over(W.partitionBy("question_id"))
    return fused.join(cosines, ["question_id", "id"]).select("question_id", "id", (0.7 * F.greatest("cosine", F.lit(0.0)) + 0.3 * F.col("rrf") / top).alias("rel"))


def resolve(found: DataFrame, kept: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, id, rel after facts gave way to the versions a question's time is about."""
    parsed = questions.select("question_id", "memory", parse_temporal(F.col("question"), F.col("now")).alias("t")).select("question_id", "memory", "t.mode", "t.start", "t.end")
    facts = kept.where("etype = 'fact'").select(F.col("memory").cast("string").alias("entity"), "attribute", "value", F.col("ts").alias("valid_from"), "valid_to", F.col("id").alias("seq"), "speaker", "kind")
    hits = found.join(facts.select(F.col("seq").alias("id"), "entity", "attribute"), "id")
    asked = hits.select("question_id", "entity", "attribute").distinct().join(parsed.drop("memory"), "question_id")
    nodes = chains.select_nodes(facts, asked)
    moved = chains.resolve(hits.select("question_id", F.col("id").alias("seq"), "rel").join(parsed.select("question_id", "mode"), "question_id"), facts, nodes)
    episodes = found.join(kept.where("etype = 'episode'").select("id"), "id", "left_semi")
    return episodes.select("question_id", "id", "rel").unionByName(moved.select("question_id", F.col("seq").alias("id"), "rel"))


def hops(rel: DataFrame, kept: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """question_id, id, rel, hop, hop2: what was found, and entries of the same memory that share the commonest entities of
    its best ones, by their similarity to the question, facts as of the time that it is about; hop2 is the second hop's
    budget."""
    named = kept.select("memory", "id", F.explode(F.array_distinct(F.transform(entities(F.col("text")), F.lower))).alias("entity"))
    first = rel.select(F.col("question_id").alias("query_id"), "id", "rel")
    memories = questions.select(F.col("question_id").alias("query_id"), "memory")
    asked = top_entities(first, named.select("id", "entity")).join(memories, "query_id").select("query_id", "memory", "entity")
    reached = asked.join(named, ["memory", "entity"]).select("query_id", "id").distinct().join(first, ["query_id", "id"], "left_anti")
    vectors = questions.select(F.col("question_id").alias("query_id"), hash_embedding(DIM)("question").alias("qv"))
    near = reached.join(kept.select("id", "vec"), "id").join(vectors, "query_id")
    scored = near.select(F.col("query_id").alias("question_id"), "id", (0.7 * F.greatest(dot(F.col("vec"), F.col("qv")), F.lit(0.0))).alias("rel")).where("rel > 0")
    resolved = resolve(cut(scored, "second"), kept, questions).groupBy(F.col("question_id").alias("query_id"), "id").agg(F.max("rel").alias("rel"))
    second = resolved.join(first, ["query_id", "id"], "left_anti")
    both = first.withColumn("hop", F.lit(1)).unionByName(second.withColumn("hop", F.lit(2)))
    share = hop_share(first, budget).select("query_id", "hop2")
    return both.join(share, "query_id").withColumnRenamed("query_id", "question_id")


def ask(kept: DataFrame, questions: DataFrame, budget: int = 2000, second: bool = True) -> DataFrame:
    """questions: question_id, memory, question, now (timestamp_ntz). What is packed for each, by greedy coverage, of what
    search finds and, with second, of what is one entity away."""
    rel = cut(resolve(cut(retrieve(kept, questions), "found"), kept, questions), "resolved")
    if second:
        found = hops(rel, kept, questions, budget)
        packed = packing.by_hops(found.join(kept, "id").select(F.col("question_id").alias("query_id"), "id", "rel", "cost", "vec", "hop", "hop2"), budget)
    else:
        found = rel
        packed = packing.by_query(rel.join(kept, "id").select(F.col("question_id").alias("query_id"), "id", "rel", "cost", "vec"), budget)
    scores = found.select("question_id", "id", "rel")
    return packed.select(F.col("query_id").alias("question_id"), "id").join(scores, ["question_id", "id"]).join(kept.drop("vec"), "id")


def verbatim(packed: DataFrame, turns: DataFrame, budget: int) -> DataFrame:
    """turns: memory, session_id, turn, role, ts, text. Excerpts around what is packed: question_id, id, session_id, turn,
    position, text."""
    hits = packed.select("question_id", "memory", "session_id", "turn", "rel").where("turn >= 0")
    own = F.struct("question_id", "memory", "session_id")
    placed = turns.select("memory", "session_id", "turn", "text", count_tokens(F.col("text")).alias("cost"), make_id("raw", F.col("memory"), F.col("session_id"), F.col("turn")).alias("id"))
    asked = hits.select("question_id", "memory", "session_id").distinct().join(placed, ["memory", "session_id"])
    scores = neighbour_scores(hits.select(own.alias("session_id"), "turn", "rel"), asked.select(own.alias("session_id"), "turn"))
    scored = scores.select("session_id.*", "turn", "score").join(placed, ["memory", "session_id", "turn"])
    chosen = excerpts(scored, "question_id", budget)
    return chosen.join(scored.select("question_id", "id", "text"), ["question_id", "id"])


def answers(packed: DataFrame, questions: DataFrame, tau: float = 0.0) -> DataFrame:
    """An extractive answer for every question, with an abstention where nothing is packed, or where the best entry's
    relevance is below tau and no packed entry has a word of the question."""
    found = answering.extractive(packed)
    own = packed.groupBy("question_id").agg(F.max("rel").alias("top"), F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text"))))).alias("terms"))
    both = questions.select("question_id", tokens(F.col("question")).alias("asked")).join(found, "question_id", "left").join(own, "question_id", "left")
    none = should_abstain(F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0.0)), tau, F.col("asked"), F.coalesce("terms", F.array().cast("array<string>")))
    return both.select("question_id", F.when(none, F.lit(answering.ABSTAIN)).otherwise(F.col("answer")).alias("answer"))
