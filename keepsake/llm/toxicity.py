"""Toxicity (8): how much shorter do windows get with a dictionary of toxic text than with one of ordinary text?

Two zstandard dictionaries are trained on a bounded sample of labelled rows. A word enters as a staircase
of its beginnings (`` i id idi idio idiot ``), so a shared stem of any length is a match long enough for
the compressor to use; one such staircase is a window. Words end at every character that is no letter. A
word over ten letters is a window from each of its letters on but the last two, so tails of compounds and
text without blanks are read wholly; dictionaries learn from windows of such a word that overlap by half.
The toxic dictionary holds the staircases of words whose beginnings are far more frequent among toxic rows,
the strongest last, where offsets are short; the ordinary one holds those of the commonest words of the
other rows. A window's gain is the bytes that the toxic dictionary saves against the ordinary one, per
byte. Gains repeat with the words, so each worker keeps them in tables of bounded size. Only gains over a
tenth count, so of a run the table holds these and the number of its windows.

A text's score is a logistic function of a few numbers of its gains, calibrated on gains from
dictionaries that haven't seen the row (two folds). Whole texts are read, with no shuffle.

Defined results: a null or blank text has no windows and gets the calibrated score of zero gains; without
labels of both classes every score is the share of toxic rows, (toxic + 1) / (rows + 2); an empty table
gives an empty result; repeated rows score alike; other columns stay out of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import labelled, lasso_logistic, sigmoid
from .shared import is_held_out, table

#: At most so many labelled rows are learned from.
SAMPLE = 5000
#: Of their texts the driver takes so many bytes, and the text with which they become more.
SAMPLE_BYTES = 100 << 20
#: Letters of a window, least letters of a stem, words in the ordinary dictionary.
REACH, STEM, ORDINARY = 10, 3, 2000
#: Bytes of each of a worker's two tables, in two generations, and those that an entry takes beside its high gains.
TABLE, ENTRY = 128 << 20, 200
#: A stem is toxic if so many toxic rows have it and its log odds exceed this.
ROWS, ODDS = 4, 3.0
THRESHOLD = 0.3
#: Gains up to this count for nothing.
HIGH = 0.1
#: Blank-separated runs up to so many characters are remembered.
SHORT = 40
LETTERS = re.compile(r"[^\W\d_]+")


def windows(run: str, learn: bool = False) -> list[str]:
    """The windows of a blank-separated run's words, lower-cased. A word longer than REACH has one from each letter
    that a stem can begin at, and to learn from, whole ones that overlap by half."""
    run = run.lower()
    if run.isalpha() and len(run) <= REACH:
        return [run]
    found = []
    for w in LETTERS.findall(run):
        if len(w) <= REACH:
            found.append(w)
        else:
            at = (*range(0, len(w) - REACH, REACH // 2), len(w) - REACH) if learn else range(len(w) - STEM + 1)
            found.extend(w[i : i + REACH] for i in at)
    return found


def staircase(key: str) -> bytes:
    return f" {' '.join(accumulate(key))} ".encode()


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes


def train(texts: list[str], toxic: np.ndarray) -> Dictionaries:
    keys = [{k for w in set((t or "").split()) for k in windows(w, learn=True)} for t in texts]
    n = Counter(bool(y) for y in toxic)
    words, stems = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for own, y in zip(keys, toxic, strict=True):
        words[bool(y)].update(own)
        stems[bool(y)].update({k[:i] for k in own for i in range(STEM, len(k) + 1)})

    def odds(stem: str) -> float:
        return float(np.log((stems[True][stem] + 0.5) / (n[True] + 1)) - np.log((stems[False][stem] + 0.5) / (n[False] + 1)))

    marked = {s for s, c in stems[True].items() if c >= ROWS and odds(s) > ODDS}
    bad = {k for k in words[True] if any(k[:i] in marked for i in range(STEM, len(k) + 1))}
    order = lambda y, ks: sorted(ks, key=lambda k: (words[y][k], k))
    return Dictionaries(b"".join(map(staircase, order(True, bad))), b"".join(map(staircase, order(False, words[False].keys() - bad)[-ORDINARY:])))


class Gains:
    """Gains of words, remembered: of each run the number of its windows, and their gains over HIGH."""

    def __init__(self, d: Dictionaries):
        self.toxic, self.ordinary = (self._compressor(x) for x in (d.toxic, d.ordinary))
        self.same = {}  # equal gains, and counts of windows without high ones, are one object
        self.by_run, self.old_runs, self.runs_left = {}, {}, TABLE // 2
        self.by_key, self.old_keys, self.keys_left = {}, {}, TABLE // 2

    @staticmethod
    def _compressor(content: bytes):
        p = zstd.ZstdCompressionParameters(window_log=17, hash_log=13, chain_log=13, search_log=5, min_match=5, target_length=32, strategy=zstd.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)
        if len(content) < 8:
            return zstd.ZstdCompressor(compression_params=p)
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstd.ZstdCompressor(dict_data=d, compression_params=p)

    def window(self, key: str) -> float:
        found = self.by_key.get(key)
        if found is None:
            found = self.old_keys.get(key)
            if found is None:
                window = staircase(key)
                found = (len(self.ordinary.compress(window)) - len(self.toxic.compress(window))) / len(window)
                found = self.same.setdefault(found, found)
            self.keys_left -= ENTRY
            if self.keys_left < 0:
                self.old_keys, self.by_key, self.keys_left = self.by_key, {}, TABLE // 2
            self.by_key[key] = found
        return found

    def of(self, run: str) -> tuple[float, ...]:
        """The number of a run's windows, one if it has no letters, and the gains over HIGH among theirs."""
        found = self.old_runs.get(run)
        if found is None:
            keys = windows(run)
            high = tuple(g for g in map(self.window, keys) if g > HIGH)
            found = (max(len(keys), 1), *high)
            if not high:
                found = self.same.setdefault(found, found)
        if len(run) <= SHORT:
            self.runs_left -= ENTRY + 40 * (len(found) - 1)
            if self.runs_left < 0:
                self.old_runs, self.by_run, self.runs_left = self.by_run, {}, TABLE // 2
            self.by_run[run] = found
        return found

    def features(self, text: str | None) -> list[float]:
        runs = (text or "").split()
        if not runs:
            return [0.0] * 5
        known, of = self.by_run.get, self.of
        found = [known(r) or of(r) for r in runs]
        n = sum(f[0] for f in found)
        high = np.sort([g for f in found if len(f) > 1 for g in f[1:]] or [0.0])[::-1]
        return [high[0], high[:3].sum() / 3, (high - HIGH).clip(0).sum() / n, (high - 0.2).clip(0).sum() / np.sqrt(n), (high > 0.3).sum() / n]


@lru_cache(maxsize=1)
def gains_of(d: Dictionaries) -> Gains:
    """The worker's own: its tables outlive a task."""
    return Gains(d)


@dataclass(frozen=True)
class Model:
    dictionaries: Dictionaries
    weights: tuple[float, ...]
    intercept: float


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, text: str = "text") -> Model:
    """Learns from at most `most` labelled rows, and of those from the first of a hash's order that hold at most SAMPLE_BYTES."""
    rows = labelled(docs.select("doc_id", F.col(text).alias("text")), labels, label, most)
    before = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= SAMPLE_BYTES)
    rows = rows.select("doc_id", "text", "y").toPandas().sort_values(["doc_id", "text"], kind="stable")
    y, texts = rows["y"].to_numpy(float), rows["text"].tolist()
    if not 0 < y.sum() < len(y):
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(Dictionaries(b"", b""), (0.0,) * 5, float(np.log(p / (1 - p))))
    x, fold = np.zeros((len(y), 5)), np.arange(len(y)) % 2
    for k in (0, 1):
        gains = Gains(train([t for t, f in zip(texts, fold, strict=True) if f != k], y[fold != k]))
        for i in np.flatnonzero(fold == k):
            x[i] = gains.features(texts[i])
    scale = x.std(axis=0) + 1e-9
    w, b = lasso_logistic(x / scale, y, 0.0005, 2000)
    return Model(train(texts, y), tuple(map(float, w / scale)), b)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, w = gains_of(model.dictionaries), np.array(model.weights)
        for b in it:
            x = np.array([gains.features(t) for t in b.column(1).to_pylist()]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(x @ w + model.intercept))], names=[key, "score"])

    return docs.select(key, text).mapInArrow(batches, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
