"""Token-id files (7): raw ids in shards, with a minimal perfect hash from document keys to places.

Documents are dealt to shards by ranges of their key and sorted by it, so shard after shard the ids stand
in ascending key order. Rows that repeat a key are told apart by a hash of their text and by where they were
read, so a key of any number of rows, null too, is spread over as many shards as its rows need. A task encodes its documents and streams the ids to ``NNNNNN.bin`` (little-endian,
16 bits each if the vocabulary fits, else 32) while ``NNNNNN.idx`` gets, by slot of a minimal perfect hash of
the shard's keys, a 64-bit fingerprint, the place of the key's first id, its number of ids and of rows;
then the keys and lengths in file order. Both are written under a name of the attempt and renamed, so a task
that runs again replaces its files with equal ones. The manifest, one Parquet row per shard, names the files.

Defined results: a null text counts as empty and has the end id alone; a null key sorts first and has its
own slot; rows that repeat a key stand together, ordered by a hash of the text, and the slot of each shard that
has some spans them; a text with a special token's string has that token's id, as the library gives it; an empty
table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mph
from .shared import fresh_path, table
from .tokens import ByteWords, encoder, public_path

#: Bytes of a generation of a worker's table of words. An executor has a worker a core beside its heap.
TABLE = 56 << 20
#: Rows whose texts are in a worker as Python strings at once.
ROWS = 256
#: Ids in memory at most, beside one document's, before they go to the file or come from it.
BLOCK = 1 << 21
#: The key that stands for null in an index; a real key of this value has the flag 0 in its second word.
NO_KEY = np.int64(-(2**63))
SLOT = np.dtype([("print", "<u8"), ("first", "<i8"), ("ids", "<i8"), ("rows", "<i8")])
ROW = np.dtype([("key", "<i8"), ("null", "<i8"), ("ids", "<i8")])


def _open(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


def _keys(rows: np.ndarray) -> np.ndarray:
    return np.stack([rows["key"].view(np.uint64), rows["null"].astype(np.uint64)], axis=1)


def _prints(keys: np.ndarray) -> np.ndarray:
    return mph.mix(keys[:, 0] + mph.mix(keys[:, 1] + np.uint64(7)))


def index_bytes(rows: np.ndarray) -> bytes:
    """rows: of type ROW, in file order, equal keys together."""
    ends = np.cumsum(rows["ids"])
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["null"][1:] != rows["null"][:-1])
    at = np.flatnonzero(new)
    keys = _keys(rows[at])
    data = mph.build(keys)
    slots, to = np.zeros(len(at), SLOT), mph.Lookup(data)(keys)
    first = (ends - rows["ids"])[at]
    slots["print"][to], slots["first"][to] = _prints(keys), first
    slots["ids"][to], slots["rows"][to] = np.diff(np.append(first, ends[-1])), np.diff(np.append(at, len(rows)))
    return np.array([len(data), len(slots), len(rows)], "<i8").tobytes() + data + slots.tobytes() + rows.tobytes()


class Shard:
    """A shard's files: keyed access by get, all rows by rows."""

    def __init__(self, url: str, shard: int, width: int):
        self.files, folder = _open(url)
        self.path, self.width = f"{folder}/{shard:06d}", width
        with self.files.open_input_file(f"{self.path}.idx") as f:
            data = f.read()
        n, slots, rows = np.frombuffer(data, "<i8", 3)
        self.lookup = mph.Lookup(data[24 : 24 + n])
        self.slots = np.frombuffer(data, SLOT, slots, 24 + n)
        self.table = np.frombuffer(data, ROW, rows, 24 + n + slots * SLOT.itemsize)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys of shape (n, 2); -1 where the fingerprint says no."""
        slot = self.lookup(keys)
        return np.where((slot >= 0) & (self.slots["print"][np.maximum(slot, 0)] == _prints(keys)), slot, -1)

    def ids(self, first: int, n: int) -> np.ndarray:
        with self.files.open_input_file(f"{self.path}.bin") as f:
            return np.frombuffer(f.read_at(n * self.width, first * self.width), f"<u{self.width}")

    def get(self, key: int | None) -> np.ndarray | None:
        """All ids under a key, in constant time; None if the shard lacks it."""
        row = np.array([(NO_KEY, 1, 0)] if key is None else [(key, 0, 0)], ROW)
        slot = int(self.places(_keys(row))[0])
        return None if slot < 0 else self.ids(int(self.slots["first"][slot]), int(self.slots["ids"][slot]))

    def rows(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, place of its first id, ids) of each row, read through the index in blocks."""
        slot = self.places(_keys(self.table))
        if (slot < 0).any():
            raise ValueError(f"{self.path}: a key isn't where the index says")
        first = np.cumsum(self.table["ids"]) - self.table["ids"]
        if (first < self.slots["first"][slot]).any() or (first + self.table["ids"] > (self.slots["first"] + self.slots["ids"])[slot]).any():
            raise ValueError(f"{self.path}: an index entry doesn't span its row")
        i, n = 0, len(self.table)
        while i < n:
            j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK)))
            base, block = first[i], self.ids(int(first[i]), int(first[j - 1] + self.table["ids"][j - 1] - first[i]))
            for k in range(i, j):
                key, null, m = self.table[k]
                yield None if null else int(key), int(first[k]), block[first[k] - base : first[k] - base + m]
            i = j


def write(docs: DataFrame, url: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Writes the shards and the manifest (shard int, docs long, ids long, width int)."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ByteWords, tokenizer, TABLE)
        width = 2 if encode.tokenizer.get_vocab_size() <= 65536 and end_id < 65536 else 4
        task = TaskContext.get()
        files, folder = _open(url)
        files.create_dir(folder, recursive=True)
        final, mine = f"{folder}/{task.partitionId():06d}", f"{folder}/.{task.partitionId():06d}-{task.taskAttemptId()}"
        rows, held, size, out = [], [], 0, None
        end = np.array([end_id], f"<u{width}").tobytes()
        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode(t), "<u4").astype(f"<u{width}").tobytes() + end
                rows.append((NO_KEY, 1, len(ids) // width) if k is None else (k, 0, len(ids) // width))
                held.append(ids)
                size += len(ids)
                if size >= BLOCK * width:
                    out = out or files.open_output_stream(f"{mine}.bin")
                    out.write(b"".join(held))
                    held, size = [], 0
        if not rows:
            return
        out = out or files.open_output_stream(f"{mine}.bin")
        out.write(b"".join(held))
        out.close()
        made = np.array(rows, ROW)
        with files.open_output_stream(f"{mine}.idx") as f:
            f.write(index_bytes(made))
        for x in ("bin", "idx"):
            files.move(f"{mine}.{x}", f"{final}.{x}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "docs": [len(made)], "ids": [int(made["ids"].sum())], "width": pa.array([width], pa.int32())})

    order = ("_key", "_print", "_row")
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_print"), F.monotonically_increasing_id().alias("_row"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_key", "_text")
    dealt.mapInArrow(shard, "shard int, docs long, ids long, width int").write.parquet(f"{url}/manifest")


def read(spark: SparkSession, url: str, key: str = "doc_id") -> DataFrame:
    """One row per document from the files: key, start (ids of all before it), n_tokens, ids (raw, 32 bits)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, width, before in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                held, size = [], 0
                for k, first, ids in Shard(url, number, width).rows():
                    held.append((k, before + first, len(ids), ids.astype("<u4").tobytes()))
                    size += len(ids)
                    if size >= BLOCK:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)

    def batch(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[key, "start", "n_tokens", "ids"])

    manifest = spark.read.schema("shard int, docs long, ids long, width int").parquet(f"{url}/manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "width", before.alias("before")).repartition(max(1, manifest.count()), "shard")
    return shards.mapInArrow(rows, f"`{key}` long, start long, n_tokens long, ids binary")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    url = fresh_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), url, public_path("byte_bpe_50k.json"))
    return read(spark, url).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
