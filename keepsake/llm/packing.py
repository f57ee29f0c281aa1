"""Best-fit packing (9): documents' token ids into sequences, online and in bounded space.

Each task packs the documents it reads, in the order it reads them, so texts don't shuffle. It keeps a
fixed number of open bins, lists of them by free space and a bitset of the free spaces that have any: the
lowest bit at or above a piece's length is the bin it fits best. When a new bin would be one too many, the
fullest bin closes first, which is the lowest bit of all. Only documents longer than a sequence are cut.

The bins that are still open when a task ends are packed once more: what each holds is a unit, and the units
of all tasks, dealt by TAILS, go through the same packer, longest first. So the number of sequences hardly
depends on the number of tasks. A sequence that takes a unit in keeps its number; numbers hold the partition
above 2^32 and count within it below.

Defined results: a null text counts as empty, an empty text is the end id alone; a null id is kept;
repeated rows are packed each; of bins with equal free space the one that reached it last is taken; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, table
from .tokens import LowerWords, encoder, public_path

LENGTH, OPEN = 2048, 1024
#: Units that a task packs once more; most moves (two numbers and an offset each) that are broadcast.
TAILS, BROADCAST = 1 << 18, 1 << 20
#: Bytes of a generation of a worker's table of words.
TABLE = 48 << 20


class Packer:
    """Places pieces one by one."""

    def __init__(self, length: int = LENGTH, most: int = OPEN):
        self.length, self.most = length, most
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]  # numbers of open bins, by free space
        self.free = 0  # a bit for each free space that an open bin has
        self.open = self.made = 0

    def _take(self, bit: int) -> int:
        """An open bin of this free space, taken out."""
        number = self.bins[bit].pop()
        if not self.bins[bit]:
            self.free ^= 1 << bit
        self.open -= 1
        return number

    def place(self, n: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of n tokens, 1 <= n <= length."""
        if fits := self.free >> n << n:
            room = (fits & -fits).bit_length() - 1
            number = self._take(room)
        else:
            if self.open == self.most and n < self.length:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            number, room = self.made, self.length
            self.made += 1
        left = room - n
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.length - room

    def tails(self) -> list[tuple[int, int]]:
        """(sequence, tokens in it) of the open bins."""
        return [(number, self.length - room) for room, numbers in enumerate(self.bins) for number in numbers]


SCHEMA = "piece int, start long, length long, ids binary, sequence_id long, offset long"
ROWS = 1024


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, most: int = OPEN, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian, 32 bits), sequence_id, offset."""
    kind = docs.schema[key].dataType.simpleString()
    placed = stored(_placed(docs, tokenizer, length, most, end_id, key, text, kind), "packed", "zstd")
    moves = stored(_moves(placed.where("piece < 0").select("sequence_id", "length"), length), "moves")
    few = F.broadcast if moves.count() <= BROADCAST else (lambda df: df)
    out = placed.where("piece >= 0").join(few(moves), "sequence_id", "left")
    at = {"sequence_id": F.coalesce("to", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}
    return out.select(key, *[at.get(c, F.col(c)).alias(c) for c in (x.split()[0] for x in SCHEMA.split(", "))])


def _moves(tails: DataFrame, length: int) -> DataFrame:
    """(sequence_id, to, shift): open bins that go behind what another one holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = sorted((-n, s) for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        packer, host, rows = Packer(length, len(units) + 1), [], []
        for n, sequence in units:
            number, offset = packer.place(-n)
            if offset:
                rows.append((sequence, host[number], offset))
            else:
                host.append(sequence)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], names=["sequence_id", "to", "shift"])

    return tails.repartition(max(1, -(-tails.count() // TAILS)), "sequence_id").mapInArrow(run, "sequence_id long, to long, shift long")


def _placed(docs: DataFrame, tokenizer: str, length: int, most: int, end_id: int, key: str, text: str, kind: str) -> DataFrame:
    """The pieces as tasks place them, and a row with piece -1 for each bin left open, with what it holds as length."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(LowerWords, tokenizer, TABLE), Packer(length, most)
        base, end = TaskContext.get().partitionId() << 32, np.array([end_id], "<u4").tobytes()
        for b in it:
            rows, size = [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t) + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    cut = ids[at : at + 4 * length]
                    number, offset = packer.place(len(cut) // 4)
                    rows.append((k, piece, at // 4, len(cut) // 4, cut, base + number, offset))
                    size += len(cut)
                    if len(rows) >= ROWS * 4 or size > 1 << 24:
                        yield batch(rows, b.schema.field(0).type)
                        rows, size = [], 0
            if rows:
                yield batch(rows, b.schema.field(0).type)
        if tails := packer.tails():
            yield batch([(None, -1, None, n, None, base + number, None) for number, n in tails], b.schema.field(0).type)

    def batch(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[key, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {kind}, {SCHEMA}")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json")))
