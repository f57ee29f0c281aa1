"""Quality classifier (3): a sparse ensemble of rules over text statistics, compiled into columns.

Boosted shallow trees are grown on the statistics of a bounded sample of labelled rows; every path from
a root to a node becomes a conjunction of comparisons; a lasso logistic regression gives most of these
rules the weight zero. What is left is one Spark expression over the statistics, so scoring a corpus is a
projection: no shuffle, no Python.

Defined results: a null text counts as empty, an empty text has zero statistics and gets the score these
earn; without labels of both classes nothing can be learned: every score is the share of good rows, (good + 1) /
(rows + 2), and keep() keeps all rows; an empty table gives an empty result; repeated rows score alike; other
columns, whatever their names, pass through and stay out of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import labelled, lasso_logistic, sigmoid
from .shared import is_held_out, table, unused

#: At most so many labelled rows are learned from.
SAMPLE = 6000
TREES, DEPTH, BINS, RATE, LEAST, PENALTY = 60, 3, 48, 0.3, 15, 0.0015
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, "\\s+")
    n_words = F.greatest(F.size(words), F.lit(1))
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")) / chars

    def per_word(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n_words

    return {
        "chars": F.length(text).cast("double"),
        "word_length": chars / n_words,
        "upper": share("[^\\p{Lu}]+"),
        "signs": share("[\\p{L}\\p{N}\\s.,]+"),
        "digits": share("[^0-9]+"),
        "marks": per_word("[*#$%&!]{2}"),
        "bars": per_word("\\|"),
        "stops": per_word("[.?!](?=\\s|$)"),
        "twice": per_word("(?<!\\S)(\\S+) (?=\\1(?!\\S))"),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": n_words / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, is it above, cut) each; above means >, else <=."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, of: str) -> Column:
        """of: the struct that holds the statistics."""
        out = F.lit(True)
        for name, above, cut in self.terms:
            out = out & (F.col(of)[name] > cut if above else F.col(of)[name] <= cut)
        return out


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    intercept: float
    learned: bool = True  # from labels of both classes

    def column(self, of: str) -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(of), r.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(terms, x: np.ndarray, at: dict[str, int]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in terms:
        out &= x[:, at[name]] > cut if above else x[:, at[name]] <= cut
    return out


def _grow(binned, cuts, names, g, h, rows, terms, depth, found) -> list[tuple[np.ndarray, float]]:
    """Grows a tree on gradients, adds the path of every node but the root, returns its leaves and their steps."""
    if terms:
        found.add(terms)
    best, gain = None, 1e-6
    if depth:
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j in range(len(names)):
            b = binned[rows, j]
            gs, hs, ns = (np.bincount(b, weights=w, minlength=BINS + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            value = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            value[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
            if value.max() > gain:
                best, gain = (j, int(value.argmax())), value.max()
    if best is None:
        return [(rows, -g[rows].sum() / (h[rows].sum() + 1))]
    j, k = best
    low = binned[rows, j] <= k
    out = []
    for side, above in ((low, False), (~low, True)):
        out += _grow(binned, cuts, names, g, h, rows[side], (*terms, (names[j], above, float(cuts[j][k]))), depth - 1, found)
    return out


def train(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    good = float(y.sum())
    if not 0 < good < len(y):
        p = (good + 1) / (len(y) + 2)
        return Model((), float(np.log(p / (1 - p))), False)
    cuts = [np.pad(c := np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])), (0, BINS - len(c)), constant_values=np.inf) for j in range(len(names))]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    found: set = set()
    f = np.zeros(len(y))
    for _ in range(TREES):
        p = sigmoid(f)
        for rows, step in _grow(binned, cuts, names, p - y, p * (1 - p), np.arange(len(y)), (), DEPTH, found):
            f[rows] += RATE * step
    at = {n: j for j, n in enumerate(names)}
    paths = sorted(found)
    holds = np.stack([_holds(t, x, at) for t in paths], axis=1).astype(float)
    holds, first = np.unique(holds, axis=1, return_index=True)  # paths that hold for the same rows are one rule
    w, b = lasso_logistic(holds, y, PENALTY)
    return Model(tuple(Rule(paths[first[i]], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-3)), b)


def with_statistics(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs and a struct of its statistics, made by a generator, so that no optimizer rule repeats them for each use."""
    made = F.struct(*[c.cast("double").alias(k) for k, c in statistics(F.col(text)).items()])
    return docs.select("*", F.inline(F.array(F.struct(made.alias(name)))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, text: str = "text") -> Model:
    """Learns from at most `most` labelled rows."""
    names = list(statistics(F.col(text)))
    rows = with_statistics(labelled(docs.select("doc_id", F.col(text).alias("text")), labels, label, most), "text", "q").select("y", "q.*").toPandas()
    return train(rows[names].to_numpy(float), rows["y"].to_numpy(float), names)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores under a name that docs doesn't have."""
    of = unused(docs, "statistics")
    return with_statistics(docs, text, of).select(*docs.columns, model.column(of).alias(name))


def keep(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject; all of them if it has learned nothing."""
    if not model.learned:
        return docs
    name = unused(docs, "score")
    return score(docs, model, text, name).where(F.col(name) >= threshold).select(*docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
