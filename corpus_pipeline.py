"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

Each stage works on what the one before it kept, written as Parquet to the shared folder and read again.
All but the last return the columns of documents, whole rows of them; the last returns the packed pieces.
Where rows share an id, a stage's decision holds for the id and, in exact dedup, its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.llm import decontaminate, exact_dedup, ngram_join, packing, quality
from keepsake.llm.shared import fresh_path, stored, table, unused
from keepsake.llm.tokens import public_path


#: Most (id, digest) pairs of rows to drop that are broadcast; about 80 bytes each.
BROADCAST = 500_000


def _without(docs: DataFrame, dropped: DataFrame, on: tuple[str, ...], keys: tuple[Column, ...]) -> DataFrame:
    """The rows of docs whose keys, null ones too, aren't among dropped, which has the columns `on`."""
    dropped = stored(dropped, "dropped")
    few = F.broadcast if dropped.count() <= BROADCAST else (lambda df: df)
    same = F.lit(True)
    for name, key in zip(on, keys, strict=True):
        same = same & key.eqNullSafe(dropped[name])
    return docs.join(few(dropped), same, "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier, trained on the labelled rows among docs, doesn't reject. Where these don't
    have labels of both classes there is nothing to judge by, and all rows stay."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest id. Only rows whose id and text both repeat are dealt by them."""
    each = stored(exact_dedup.decide(docs), "decided")
    lost = each.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest")
    again = each.where(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") > 1)).select("id", "digest")
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    pairs, keys = ("id", "digest"), (docs["doc_id"], digest)
    if again.isEmpty():
        return _without(docs, lost, pairs, keys)
    repeated = docs.join(again, docs["doc_id"].eqNullSafe(again["id"]) & (digest == again["digest"]), "left_semi")
    text, name = F.coalesce("text", F.lit("")), unused(docs, "text")
    one = repeated.withColumn(name, text).dropDuplicates(["doc_id", name]).select(*docs.columns)
    return _without(docs, lost.union(again), pairs, keys).unionByName(one)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the rows with the smallest id; texts without words stay."""
    found = ngram_join.join(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("id")).distinct()
    return _without(docs, found, ("id",), (docs["doc_id"],))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no test item."""
    found = decontaminate.contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("id")).distinct()
    return _without(docs, found, ("id",), (docs["doc_id"],))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    return packing.digest(packing.pack(docs, public_path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: No SQL: a trained classifier and a tokenizer. tests/llm hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
