import tracemalloc

import numpy as np
import pandas as pd

from keepsake.operators import consolidation, coverage


def test_clusters_of_long_chains(spark):
    """0 - n - (n-1) - ... - 1: labels that travel a link a round need n + 1 rounds."""
    n = 60
    chain = [0, *range(n, 0, -1)]
    links = [("x", *sorted(p)) for p in zip(chain, chain[1:], strict=False)] + [("y", 3, 5)]
    entries = spark.createDataFrame([("x", i) for i in chain] + [("y", i) for i in (3, 4, 5)], "grp string, id long")
    pairs = spark.createDataFrame(links, "grp string, a long, b long")
    got = {(r.grp, r.id): r.cluster for r in consolidation.clusters(entries, pairs).collect()}
    assert got == {("x", i): 0 for i in chain} | {("y", 3): 3, ("y", 4): 4, ("y", 5): 3}
    assert consolidation.clusters(entries, pairs.where("false")).where("id <> cluster").count() == 0


def test_links_connect_what_pairs_do(spark, monkeypatch):
    """Near pairs of several blocks and strips are whole; links, fewer, give the same clusters."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(90, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.permutation(90).tolist()
    entries = spark.createDataFrame([("xy"[i % 2], ids[i], x.tolist()) for i, x in enumerate(v)] + [("z", 90, [1.0, 0.0, 0.0, 0.0])], "grp string, id long, vec array<float>")
    monkeypatch.setattr(coverage, "STRIP", 7)
    monkeypatch.setattr(coverage.by_blocks, "__defaults__", (16,))
    near = {("xy"[i % 2], *sorted((ids[i], ids[j]))) for i in range(90) for j in range(i) if i % 2 == j % 2 and v[i] @ v[j] >= 0.9}
    pairs, links = consolidation.near_pairs(entries, 0.9), consolidation.links(entries, 0.9)
    assert {(r.grp, r.a, r.b) for r in pairs.collect()} == near
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(consolidation.clusters(entries, pairs)) == rows(consolidation.clusters(entries, links))


def test_a_block_of_copies_leaves_few_links_and_no_square(spark):
    n = 3000
    x = pd.DataFrame({"a": np.arange(n), "av": [np.ones(4) / 2] * n})
    y = x.rename(columns={"a": "b", "av": "bv"})
    tracemalloc.start()
    least = np.arange(n)
    for rows, cols, _ in consolidation._near(x, y, 0.5):
        least = consolidation.joined(least, rows, cols)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (least == 0).all() and peak < n * n * 8
