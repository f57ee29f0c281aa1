"""The whole job where a registered query with SQL covers a part of it."""

import hashlib

from pyspark.sql import functions as F

from keepsake.operators import coverage, evaluation, retrieval
from keepsake.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


def test_key_drift(spark):
    rows = [("user", "location"), ("user", "current_location"), ("user", "allergy"), ("user", "colour"), ("user", "color"), ("user", "loc"), ("rachel", "employer"), ("rachel_colleague", "employer")]
    got = {tuple(r) for r in evaluation.key_drift(spark.createDataFrame(rows, "entity string, attribute string")).collect()}
    assert got == {("attribute", "user", "current_location", "location"), ("attribute", "user", "color", "colour"), ("entity", None, "rachel", "rachel_colleague")}


def test_candidates_have_all_items(spark):
    items = {r.item_id for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id").collect()}
    for name in ("lexical_entail", "best_line"):
        got = catalogue.queries()[name](spark, FOLDER).select("item_id", "doc_id").collect()
        assert {r.item_id for r in got} == items


def test_canonical_names_are_whole(spark):
    got = catalogue.queries()["canonical_names"](spark, FOLDER)
    assert got.where(F.length("value") > 60).count() > 0 and got.where(F.length("attribute") > 60).count() > 0


def test_hash_embedding_is_whole(spark):
    got = catalogue.queries()["hash_embedding"](spark, FOLDER)
    assert "digest" in got.columns and got.select("digest").distinct().count() > 1


def test_blocks_change_nothing(spark, monkeypatch):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    corpus, asked = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(retrieval.dense_topk(corpus, asked, 7)) == rows(retrieval.dense_topk(corpus, asked, 7, held=1000))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    one, every = rows(retrieval.bm25(docs, items, 9)), rows(retrieval.bm25(docs, items))
    monkeypatch.setattr(retrieval, "HELD_TERMS", 100)
    monkeypatch.setattr(retrieval, "MOST", 400)
    assert rows(retrieval.bm25(docs, items, 9)) == one and rows(retrieval.bm25(docs, items)) == every
    t = e.select(F.col("label").alias("grp"), F.col("vec_id").alias("h"), F.col("embedding").alias("hv"), F.lit(1.5).alias("w"))
    s = t.select("grp", F.col("h").alias("s"), F.col("hv").alias("sv"))
    tops = lambda chunk: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(coverage.top_two(coverage.similarities(t, s, chunk)))]
    assert tops(4096) == tops(5)
    gain = lambda chunk: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows(coverage.gains(s, None, t, chunk))]
    assert gain(4096) == gain(5)


def test_bootstrap_by_blocks(spark, monkeypatch):
    """Blocks of values and draws change nothing, and values may be missing."""
    rows = [("a", i, float(i * i % 7)) for i in range(41)] + [("b", i, None if i == 3 else i / 8) for i in range(12)]
    values = spark.createDataFrame(rows, "grp string, i long, v double")
    want = []
    for grp in "ab":
        own = [v for g, _, v in rows if g == grp]
        drawn = [[own[int(hashlib.md5(f"0:{rep}:{i}".encode()).hexdigest()[:8], 16) % len(own)] for i in range(len(own))] for rep in range(200)]
        means = sorted(round(sum(k) / len(k), 9) for d in drawn for k in [[v for v in d if v is not None]])
        known = [v for v in own if v is not None]
        want.append((grp, len(own), round(sum(known) / len(known), 6), round(means[5], 6), round(means[195], 6)))
    for held in ((1 << 16, 1 << 22, 1 << 13), (4, 8, 5)):
        for name, size in zip(("PACKED", "HELD", "DRAWN"), held, strict=True):
            monkeypatch.setattr(evaluation, name, size)
        found = evaluation.bootstrap(values, 200)
        assert sorted(map(tuple, found.collect())) == want
