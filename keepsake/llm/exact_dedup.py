"""Exact dedup (6): lookups in a minimal perfect hash over the distinct digests of a history.

The history is a set of distinct SHA-256 digests with the id of the row that won each. It is cut into
shards by digest, as many as its size needs; each shard is one row: the hash function, the full digests by
slot and the winners by slot. Rows to judge are first counted by (id, digest) and then by digest, with
map-side sums, so a group of copies of any size is one row before it meets a shard. A lookup takes the
slot's full digest and compares all its 32 bytes. Equal means a repeat of the history, and the slot's
winner is the group's; unequal means a text that isn't there, and those form groups of their own. The
answer goes back to the rows by a sort-merge join, whose hot digests adaptive execution splits.

A corpus without a history is its own: the rows with its larger ids, one half, are the history, which so
holds the largest id of every text it has; the other half's rows are repeats of it or group among
themselves.

Defined results: a null text counts as empty; a null id never beats an id, and a group of null ids only
has a null keep_id; of rows repeated in full one is kept and the others are dropped; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mph
from .shared import partitions, stored, table

INDEX = "shard int, hash binary, digests binary, winners binary"
#: Digests in a shard on average: 48 bytes a slot.
SLOTS = 500_000


def digest_keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The full digests as rows of four words; the first two are the key."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint64).reshape(-1, 4)


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, n): the rows of each id and text. n exceeds 1 where rows repeat."""
    return docs.select(F.col(key).cast("long").alias("id"), _digest(text).alias("digest")).groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history: distinct digest binary, winner long. One row per shard."""

    def build(t: pa.Table) -> pa.Table:
        full, winner = digest_keys(t["digest"]), t["winner"]
        data = mph.build(full[:, :2])
        slot = mph.Lookup(data)(full[:, :2])
        by_slot, packed = np.empty_like(full), np.zeros((len(full), 2), np.int64)  # packed: winner, whether there is one
        by_slot[slot] = full
        packed[slot, 0] = winner.fill_null(0).to_numpy()  # without nulls Arrow keeps them integers
        packed[slot, 1] = winner.is_valid().to_numpy()
        return pa.table({"shard": pa.array([t["shard"][0].as_py()], pa.int32()), "hash": [data], "digests": [by_slot.tobytes()], "winners": [packed.tobytes()]})

    return history.select(_shard(shards), "digest", F.col("winner").cast("long")).groupBy("shard").applyInArrow(build, INDEX)


def lookup(groups: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """groups: distinct digest, other columns. Adds member boolean and winner long (null for nonmembers)."""
    schema = f"{groups.select(_shard(shards), '*').schema.simpleString()[7:-1].replace(':', ' ')}, member boolean, winner bigint"

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        member, winner, has = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
        if n and right.num_rows:
            row, keys = right.slice(0, 1).to_pylist()[0], digest_keys(left["digest"])
            slot = mph.Lookup(row["hash"])(keys[:, :2])
            full = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
            packed = np.frombuffer(row["winners"], np.int64).reshape(-1, 2)
            at = np.maximum(slot, 0)
            member = (slot >= 0) & (full[at] == keys).all(axis=1)
            has = member & (packed[at, 1] == 1)
            winner[has] = packed[at[has], 0]
        return left.append_column("member", pa.array(member)).append_column("winner", pa.array(winner, mask=~has))

    return groups.select(_shard(shards), "*").groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(find, schema).drop("shard")


def history_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The distinct digests of a corpus with their winners, the largest ids."""
    return _winners(digests(docs, key, text))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("id").alias("winner"))


def decide(docs: DataFrame, history: DataFrame | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """One row per distinct id and text: id, digest, n, keep_id, group_size, member.

    history: digest, winner of rows seen before, whose winner counts as one of the group; by default the half
    of the corpus with the larger ids. own is the largest id of a group's rows outside the history.
    """
    rows = digests(docs, key, text)
    if history is None:
        n, middle = docs.agg(F.count(key), F.percentile_approx(F.col(key).cast("long"), 0.5)).first()
        later = F.coalesce(F.col("id") >= F.lit(middle).cast("long"), F.lit(False))
        known = _winners(rows.where(later))
        groups = rows.groupBy("digest").agg(F.max(F.when(~later, F.col("id"))).alias("own"), F.sum("n").alias("group_size"))
        keep = F.when(F.col("member"), F.col("winner")).otherwise(F.col("own"))
    else:
        known = stored(history.select("digest", "winner"), "history")
        n = known.count()
        groups = rows.groupBy("digest").agg(F.max("id").alias("own"), F.sum("n").alias("group_size"))
        keep = F.when(F.col("member"), F.greatest("own", "winner")).otherwise(F.col("own"))
    shards = shards or max(partitions(docs.sparkSession), -(-n // SLOTS))
    found = lookup(groups, build_index(known, shards), shards).select("digest", "group_size", "member", keep.alias("keep_id"))
    return rows.join(found, "digest").select("id", "digest", "n", "keep_id", "group_size", "member")


def dedup(docs: DataFrame, history: DataFrame | None = None, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, in_history."""
    each = decide(docs, history, key, text, shards).select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return each.select(
        F.col("id").alias(key), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("member").alias("in_history"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("in_history")


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
