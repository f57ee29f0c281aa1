"""Retrieval: BM25, dense search in blocks, rank fusion, relevance and second hops."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, RRF_K = 1.5, 0.75, 60


#: Rows of queries (of a vector or of a term) that a task holds, as bytes for vectors; queries beyond them are dealt to blocks.
HELD_TERMS, HELD_BYTES = 200_000, 64 << 20
#: Entries of the corpus that are scored together, in a block of a search by blocks, and the largest matrix of weights.
CHUNK, BLOCK, MOST = 256, 50_000, 1 << 22


def against(corpus: DataFrame, queries: DataFrame, blocks: int, prepare, kinds: str, k: int | None) -> DataFrame:
    """(query_id, id, score): every query against every entry, the k best of a query and task.

    prepare(frame of queries) gives a function that yields (names, scores by query and entry) of a frame of the
    corpus. One block of queries, whose size the caller has checked, goes to all tasks, and the corpus is read
    where it lies. Of several, each meets each block of the corpus: pairs of blocks are dealt by a shuffle.
    """

    def best_of(frames: Iterator[pd.DataFrame], scores) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in frames:
            for low in range(0, len(pdf), CHUNK):
                part = pdf.iloc[low : low + CHUNK]
                found = pd.concat([_best(s, names, part["id"].to_numpy(), k) for names, s in scores(part)])
                if k is None:
                    yield found
                else:
                    best = found if best is None else pd.concat([best, found])
                    if len(best) > 4 * k * best["query_id"].nunique():
                        best = _top(best, k)
        if best is not None:
            yield _top(best, k)

    if blocks == 1:
        held = corpus.sparkSession.sparkContext.broadcast(queries.toPandas())
        return corpus.mapInPandas(lambda frames: best_of(frames, prepare(held.value)), kinds)

    def pair(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = list(best_of(iter([own]), prepare(asked))) if len(own) and len(asked) else []
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []})

    parts = max(1, -(-corpus.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = corpus.withColumn("_c", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("_q", every(blocks))
    asked = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_c", every(parts))
    return own.groupBy("_c", "_q").cogroup(asked.groupBy("_c", "_q")).applyInPandas(pair, kinds)


def _best(scores: np.ndarray, names: np.ndarray, ids: np.ndarray, k: int | None) -> pd.DataFrame:
    """Scores by query and id as rows: those that aren't minus infinity, of each query the k best and what ties with them."""
    fits = scores > -np.inf
    if k is not None and k < scores.shape[1]:
        fits &= scores >= np.partition(scores, -k, axis=1)[:, -k, None]
    rows, cols = np.nonzero(fits)
    return pd.DataFrame({"query_id": names[rows], "id": ids[cols], "score": scores[rows, cols]})


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)


def _kinds(corpus: DataFrame, queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {corpus.schema['id'].dataType.simpleString()}, score double"


def lexical(docs: DataFrame, queries: DataFrame, weights, k: int | None, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): scores that are sums over the terms that a query and a document share.

    weights(words, asked) gives (query_id, term, weight, mean) from (id, t) and (query_id, term); a document's part
    for a term is the weight times its saturated count, or the weight alone where mean is null. A block of documents
    times a block of weights is a product of matrices, so no row for a shared word leaves a task.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()
    words = docs.select("id", tokens(F.col("text")).alias("t"))
    weighed = weights(words, asked).select("query_id", "term", "weight", "mean")
    scored = words if allowed is None else words.join(allowed, "id", "left_semi")
    blocks = max(1, -(-asked.count() // HELD_TERMS))

    def prepare(rows: pd.DataFrame):
        held, own, terms = [], [], set()
        for name, q in rows.groupby("query_id"):  # groups of queries whose matrix of weights is small
            terms_with = terms | set(q["term"])
            if own and len(terms_with) * (len(own) + 1) > MOST:
                held.append(_matrix(own))
                own, terms_with = [], set(q["term"])
            own.append((name, q))
            terms = terms_with
        if own:
            held.append(_matrix(own))
        mean = rows["mean"].iloc[0] if len(rows) else None

        def scores(pdf: pd.DataFrame):
            texts = [Counter(t.split(" ")) for t in pdf["t"]]
            for names, terms, matrix in held:
                parts = np.zeros((len(texts), len(terms)))
                for i, count in enumerate(texts):
                    found = {terms[w]: n for w, n in count.items() if w in terms}
                    if found:
                        tf = np.fromiter(found.values(), float, len(found))
                        parts[i, list(found)] = 1 if pd.isna(mean) else tf * (K1 + 1) / (tf + K1 * (1 - B + B * count.total() / mean))
                s = np.round(parts @ matrix, 6).T
                yield names, np.where(s > 0, s, -np.inf)

        return scores

    text = scored.select("id", F.array_join("t", " ").alias("t"))
    return against(text, weighed, blocks, prepare, _kinds(docs, queries), k)


def _matrix(own: list[tuple[object, pd.DataFrame]]) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """(names of queries, places of terms, weights by term and query)."""
    terms = {t: i for i, t in enumerate(dict.fromkeys(t for _, q in own for t in q["term"]))}
    out = np.zeros((len(terms), len(own)))
    for j, (_, q) in enumerate(own):
        out[[terms[t] for t in q["term"]], j] = q["weight"].to_numpy()
    return np.array([name for name, _ in own]), terms, out


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """queries: query_id, text. (query_id, id, score), the k best of each query with a rank, ties by id.

    Statistics cover all of docs, in one pass that keeps a sum for each asked term; allowed, a table of ids, says
    which documents are scored. idf is ln(1 + (n - df + 0.5) / (df + 0.5)).
    """

    def weights(words: DataFrame, asked: DataFrame) -> DataFrame:
        every = words.select(F.size("t").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
        terms = asked.select("term").union(docs.sparkSession.range(1).select(F.lit(""))).distinct()
        counted = every.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("total"))
        counted = counted.select("*", F.max(F.when(F.col("term") == "", F.col("df"))).over(W.partitionBy()).alias("n"), F.max(F.when(F.col("term") == "", F.col("total"))).over(W.partitionBy()).alias("all"))
        idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return asked.join(counted.where("term <> ''").select("term", idf.alias("weight"), (F.col("all") / F.col("n")).alias("mean")), "term")

    out = lexical(docs, queries, weights, k, allowed)
    return out if k is None else ranked(out, "query_id", F.desc("score"), k)


def overlap(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """The share of each query's distinct words that a document has, like bm25()."""

    def weights(words: DataFrame, asked: DataFrame) -> DataFrame:
        sizes = asked.groupBy("query_id").agg((1 / F.count(F.lit(1))).alias("weight"))
        return asked.join(sizes, "query_id").select("query_id", "term", "weight", F.lit(None).cast("double").alias("mean"))

    out = lexical(docs, queries, weights, k)
    return out if k is None else ranked(out, "query_id", F.desc("score"), k)


def ranked(scores: DataFrame, group: str, order: Column, k: int, name: str = "rank") -> DataFrame:
    """The k best rows of each group with a rank from 0; ties by id."""
    return scores.select("*", (F.row_number().over(W.partitionBy(group).orderBy(order, "id")) - 1).alias(name)).where(F.col(name) < k)


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, held: int = HELD_BYTES) -> DataFrame:
    """corpus: id, vec; queries: query_id, vec. (query_id, id, score, rank), the k most similar of each query, exactly."""
    size = queries.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]

    def prepare(rows: pd.DataFrame):
        names, asked = rows["query_id"].to_numpy(), np.array(rows["vec"].tolist(), np.float64)

        def scores(pdf: pd.DataFrame):
            if len(names):
                yield names, np.round(asked @ np.array(pdf["vec"].tolist(), np.float64).T, 6)
            else:
                yield names, np.zeros((0, len(pdf)))

        return scores

    out = against(corpus.select("id", "vec"), queries.select("query_id", "vec"), max(1, -(-8 * size // held)), prepare, _kinds(corpus, queries), k)
    return ranked(out, "query_id", F.desc("score"), k)


def fuse(*channels: DataFrame, k: int = RRF_K) -> DataFrame:
    """channels: query_id, id, rank from 0. The sum of 1 / (k + rank + 1)."""
    both = channels[0].select("query_id", "id", "rank")
    for c in channels[1:]:
        both = both.unionByName(c.select("query_id", "id", "rank"))
    return both.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank") + 1)).alias("rrf"))


def blend(fused: DataFrame, cosines: DataFrame) -> DataFrame:
    """0.7 * max(cosine, 0) + 0.3 * rrf / the query's largest rrf."""
    top = F.max("rrf").over(W.partitionBy("query_id"))
    return fused.join(cosines, ["query_id", "id"], "left").select("query_id", "id", (0.7 * F.greatest(F.coalesce("cosine", F.lit(0.0)), F.lit(0.0)) + 0.3 * F.col("rrf") / top).alias("rel"))


def top_entities(candidates: DataFrame, entities: DataFrame, first: int = 10, n: int = 5) -> DataFrame:
    """The n commonest entities but user of each query's first candidates; ties by name."""
    top = ranked(candidates, "query_id", F.desc("rel"), first)
    counts = top.join(entities, "id").where("entity <> 'user'").groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("*", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n"), "entity")).alias("r")).where(F.col("r") <= n).drop("r")


def second_hop(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Entries that share one of the top entities and aren't candidates yet."""
    reached = top_entities(candidates, entities).select("query_id", "entity").join(entities, "entity").select("query_id", "id").distinct()
    return reached.join(candidates, ["query_id", "id"], "left_anti")


def hop_share(candidates: DataFrame, budget: int) -> DataFrame:
    """The second hop's budget: 1 - the gap of the two best, between a fifth and a half."""
    r = candidates.select("query_id", "rel", F.lead("rel").over(W.partitionBy("query_id").orderBy(F.desc("rel"), "id")).alias("next"), F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rel"), "id")).alias("r")).where("r = 1")
    confidence = F.when(F.col("next").isNull(), 1.0).otherwise((F.col("rel") - F.col("next")) / F.greatest("rel", F.lit(1e-6)))
    return r.select("query_id", confidence.alias("confidence"), F.floor(budget * F.least(F.lit(0.5), F.greatest(F.lit(0.2), 1 - confidence))).cast("int").alias("hop2"))


def neighbour_scores(hits: DataFrame, turns: DataFrame) -> DataFrame:
    """hits: session_id, turn, rel. Turns score the relevance of hits on them, and half of that of hits beside them."""
    around = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in ((0, 1.0), (-1, 0.5), (1, 0.5))])
    spread = hits.select("session_id", "turn", "rel", F.explode(around).alias("o")).select("session_id", (F.col("turn") + F.col("o.d")).alias("turn"), (F.col("rel") * F.col("o.w")).alias("part"))
    return spread.join(turns, ["session_id", "turn"]).groupBy("session_id", "turn").agg(F.sum("part").alias("score"))


def diversified(scored: DataFrame, n: int) -> DataFrame:
    """An order in which the best turns of the n best sessions come first."""
    own = F.row_number().over(W.partitionBy("query_id", "session_id").orderBy(F.desc("score"), "turn"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "session_id", "turn")
    marked = scored.select("*", own.alias("_own"), F.row_number().over(w).alias("_all"))
    heads = F.sum((F.col("_own") == 1).cast("int")).over(W.partitionBy("query_id").orderBy("_all"))
    first = ((F.col("_own") == 1) & (heads <= n)).cast("int")
    marked = marked.withColumn("_first", first)
    return marked.select(*scored.columns, F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_first"), "_all")).alias("position"))


def source_locations(facts: DataFrame, episodes: DataFrame) -> DataFrame:
    """facts: id, sources; episodes: id, session_id, turn. Where each fact was said."""
    cited = facts.select(F.col("id").alias("fact"), F.explode("sources").alias("id"))
    return cited.join(episodes, "id").select("fact", "session_id", "turn")


def evidence(candidates: DataFrame, sessions: DataFrame) -> DataFrame:
    """candidates: id, session_id, turn; sessions: question_id, session_id, turns (null: all). Each question's evidence."""
    right = F.col("turns").isNull() | (F.col("turn") < 0) | F.array_contains("turns", F.col("turn"))
    return candidates.join(sessions, "session_id").where(right).select("question_id", "id")


def resolved(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """aliases: id, stored. Candidates under the ids of the entries they were merged into."""
    return candidates.join(aliases, "id", "left").withColumn("id", F.coalesce("stored", "id")).drop("stored")
