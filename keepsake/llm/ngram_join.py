"""N-gram Jaccard join (10): all links between texts whose word shingle sets overlap enough.

A text's tokens are its distinct word shingles. Tokens are hashed into groups; the counts by group are a
point, and the sum of the smaller coordinates of two points bounds their texts' overlap from above. Points
of a block stand in an R-tree (bulk-loaded, nodes keep the largest count of each group and the range of
sizes), which is searched for the points whose bound allows a link; what survives is verified on the sets.

Blocks come from exact filters, so that no pair is lost and no task needs the corpus:

1. Texts with equal sets are one class; only a class's first row goes on.
2. Two sets of similarity t share a token among the first n - ceil(t n) + 1 of either, in any common
   order of tokens. Ours puts tokens that stand in more than a thousandth of the texts last (their number
   is bounded by the mean set size times a thousand), others by hash. These prefixes, 16 bytes a token, are
   dealt to buckets, where the classes under one token form a group; groups of equal members are one.
3. A group's points stand in an R-tree: classes whose bound allows a link are joined, as a forest, not as
   pairs. Connected components of these forests are the blocks, so texts that share no more than a common
   passage don't meet. Only the texts of blocks move.
4. In a block the R-tree is searched again and what survives is verified; blocks yield forests of links.

A group or component of over CHUNK classes is cut by hash into chunks, and each two of its chunks make a
part; components() joins the forests of parts.

Defined results: texts without words, null ones too, have size 0 and link with nothing; fewer words than
a shingle make one token; rows with equal sets link whatever their ids, repeated rows included; a null id
is never a component's id unless no row of it has another; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .mph import mix
from .shared import SHINGLE, partitions, stored, table
from .shingles import shingle_sets

#: Classes in a chunk of a cut component. Share of texts from which a token is common, least texts, most such tokens.
CHUNK, COMMON, LEAST, MOST_COMMON = 2048, 1000, 8, 1 << 20
#: Least and most token groups (coordinates of a point), points in a leaf, children of a node.
GROUPS, MOST_GROUPS, LEAF, FAN = 64, 4096, 32, 16
#: Rows of blocks (an id and a hash each) that are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST = 500_000
#: A count that a byte can't hold stands for any number.
FULL = 1 << 20
#: Tokens that a task holds before it sums or sends them; tokens of prefixes in a bucket on average.
HELD, BUCKET = 1 << 21, 1 << 22


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a sorted set that any set similar enough shares one of, in the common order."""
    n = len(tokens) - least_overlap(len(tokens), percent) + 1
    if len(common):
        at = np.searchsorted(common, tokens)
        is_common = common[np.minimum(at, len(common) - 1)] == tokens
        if is_common.any():
            tokens = np.concatenate([tokens[~is_common], tokens[is_common]])
    return tokens[:n]


def digest_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def width_of(n: int) -> int:
    """Groups for sets of n tokens and more: a power of two, one for four to eight tokens between the bounds."""
    return min(MOST_GROUPS, max(GROUPS, 1 << max(0, (n // 4).bit_length() - 1)))


def point_of(tokens: np.ndarray, width: int) -> np.ndarray:
    """Tokens by group, the low bits of their hashes."""
    return np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width)


def packed_point(tokens: np.ndarray) -> bytes:
    return np.minimum(point_of(tokens, width_of(len(tokens))), 255).astype(np.uint8).tobytes()


def unpacked_point(data: bytes, width: int) -> np.ndarray:
    """A packed point with fewer groups: those of equal lower bits are summed."""
    p = np.frombuffer(data, np.uint8).astype(np.int64)
    p[p == 255] = FULL
    return p.reshape(-1, width).sum(axis=0)


def key_of(digest: bytes, bits: int = 64) -> int:
    """A class's key in the search for candidates. Two classes may have one key: what is joined by keys holds both
    then, and joins() adds the keys of several classes, so that candidates are never fewer for it."""
    return int.from_bytes(digest[:8], "little", signed=True) >> 64 - bits


def _sum_common(sets: list[np.ndarray], docs: int) -> bytes:
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    keep = counts >= max(LEAST // 2, docs // COMMON)
    return np.stack([tokens[keep], counts[keep].astype(np.uint64)]).tobytes()


def describe(docs: DataFrame, key: str, text: str, size: int, bits: int) -> DataFrame:
    """Rows (id, print, n, digest, key, point) of all rows of docs, and rows (n = -1, common) with sums of frequent tokens."""

    kinds = {"id": pa.int64(), "print": pa.int64(), "n": pa.int32(), "digest": pa.binary(), "key": pa.int64(), "point": pa.binary(), "common": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_held, total = [], 0, 0

        def summary() -> pa.RecordBatch:
            row = {"n": -1, "common": _sum_common(held, docs_held)}
            return pa.RecordBatch.from_arrays([pa.array([row.get(c)], t) for c, t in kinds.items()], names=list(kinds))

        for b in batches:
            n, digests, keys, points = [], [], [], []
            for s in shingle_sets(b.column(2), size):
                d = digest_of(s)
                n.append(len(s))
                digests.append(d)
                keys.append(key_of(d, bits) if len(s) else None)
                points.append(packed_point(s))
                if len(s):
                    held.append(s)
                    docs_held += 1
                    total += len(s)
                if total >= HELD:
                    yield summary()
                    held, docs_held, total = [], 0, 0
            own = [b.column(0), b.column(1), *(pa.array(x, kinds[c]) for c, x in (("n", n), ("digest", digests), ("key", keys), ("point", points))), pa.nulls(len(n), pa.binary())]
            yield pa.RecordBatch.from_arrays(own, names=list(kinds))
        if held:
            yield summary()

    return _texts(docs, key, text).mapInArrow(run, "id long, print long, n int, digest binary, key long, point binary, common binary")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(whole).alias("print"), whole.cast("binary").alias("text"))


def common_tokens(described: DataFrame) -> np.ndarray:
    """Tokens in over a thousandth of the texts, sorted; the texts times the share bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                token, count = np.frombuffer(data, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count.astype(np.int64))], names=["token", "count"])

    texts = described.where("n > 0").count()
    sums = described.where("n = -1").select("common").mapInArrow(run, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    found = sums.where(F.col("count") >= max(LEAST, texts // COMMON)).orderBy(F.desc("count"), "token").limit(MOST_COMMON).select("token").toPandas()
    return np.sort(found["token"].to_numpy(np.int64).view(np.uint64))


def groups(docs: DataFrame, common: np.ndarray, tokens: int, key: str, text: str, size: int, percent: int, bits: int) -> DataFrame:
    """(grp, key), distinct: the classes that share a token of their prefixes. tokens: of all prefixes, for the number of buckets."""
    spark = docs.sparkSession
    buckets, shared = max(partitions(spark), -(-tokens // BUCKET)), spark.sparkContext.broadcast(common)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, total = [], [], 0

        def packed() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            owners = np.repeat(np.array(keys, np.int64), [len(h) for h in held])
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            tokens, owners = tokens[order], owners[order]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array([tokens[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()), pa.array([owners[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], names=["bucket", "tokens", "owners"])

        for b in batches:
            for s in shingle_sets(b.column(2), size):
                if len(s):
                    held.append(prefix(s, shared.value, percent))
                    keys.append(key_of(digest_of(s), bits))
                    total += len(held[-1])
                if total >= HELD:
                    yield packed()
                    held, keys, total = [], [], 0
        if held:
            yield packed()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners = [], []
        for b in batches:
            tokens += [np.frombuffer(x, np.uint64) for x in b.column("tokens").to_pylist()]
            owners += [np.frombuffer(x, np.int64) for x in b.column("owners").to_pylist()]
        grp, own = members(np.concatenate(tokens), np.concatenate(owners))
        yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(own)], names=["grp", "key"])

    sent = _texts(docs, key, text).mapInArrow(send, "bucket int, tokens binary, owners binary")
    return sent.groupBy("bucket").applyInArrow(link, "grp long, key long").distinct()


def members(tokens: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, owner) of the tokens that several owners have; a group's number is a hash of its members."""
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    same = tokens[1:] == tokens[:-1]
    shared = np.zeros(len(tokens), bool)
    shared[1:] |= same
    shared[:-1] |= same
    tokens, owners = tokens[shared], owners[shared]
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])  # a class counts once however often it is copied
    tokens, owners = tokens[new], owners[new]
    if not len(tokens):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
    sizes = np.diff(np.append(starts, len(tokens)))
    number = mix(np.add.reduceat(mix(owners.view(np.uint64)), starts) + sizes.astype(np.uint64))
    first = np.zeros(len(starts), bool)
    first[np.unique(number, return_index=True)[1]] = True
    keep = np.repeat(first & (sizes > 1), sizes)
    return np.repeat(number, sizes)[keep].view(np.int64), owners[keep]


def parts(rows: DataFrame, group: str, member: str, chunk: int) -> DataFrame:
    """rows with lo, hi, whole: parts of each group in which every two of its members meet; one part up to chunk members."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = rows.join(sizes, group).withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("int"))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_chunks")).cast("int"))
    other = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return other.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other"), "whole": F.col("_chunks") == 1}).drop("_n", "_chunks", "_own", "_other")


def dealt(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi")


def candidates(placed: DataFrame, percent: int) -> DataFrame:
    """placed: grp, lo, hi, key, n, point, dealt and sorted. A forest (u, v) of keys whose bounds allow links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, {}

        def forest() -> pa.RecordBatch:
            rows = list(held)  # classes of one key stay apart, unless their bounds are the same
            keys = np.array([key for key, _, _ in rows], np.int64)
            points_of = lambda at, width: np.stack([unpacked_point(rows[i][2], width) for i in at])
            root = forest_of(np.array([n for _, n, _ in rows]), points_of, percent)
            moved = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(keys[root[moved]])], names=["u", "v"])

        for b in batches:
            for grp, lo, hi, key, n, point in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (grp, lo, hi) != own:
                    if len(held) > 1:
                        yield forest()
                    own, held = (grp, lo, hi), {}
                held[key, n, point] = None
        if len(held) > 1:
            yield forest()

    return placed.select("grp", "lo", "hi", "key", "n", "point").mapInArrow(run, "u long, v long")


class Tree:
    """An R-tree over points of token counts, bulk-loaded in tiles of size and of the widest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._tiles(points, sizes, np.arange(len(sizes)), 0)
        self.points, self.sizes = points[self.order], sizes[self.order]
        edges = np.append(np.arange(0, len(sizes), LEAF), len(sizes))
        self.levels = [(edges, np.maximum.reduceat(self.points, edges[:-1]), np.minimum.reduceat(self.sizes, edges[:-1]), np.maximum.reduceat(self.sizes, edges[:-1]))]
        while len(self.levels[-1][0]) > FAN + 1:
            _, top, low, high = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            ends = np.append(self.levels[-1][0][:-1][cut], len(sizes))
            self.levels.append((ends, np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    @staticmethod
    def _tiles(points: np.ndarray, sizes: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        by = sizes[rows] if depth == 0 else points[rows, points[rows].var(axis=0).argmax()]
        rows = rows[np.argsort(by, kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        half = half if half < len(rows) else len(rows) - LEAF
        return np.concatenate([Tree._tiles(points, sizes, part, (depth + 1) % 3) for part in (rows[:half], rows[half:])])

    def search(self, at: int, percent: int, skip: np.ndarray) -> np.ndarray:
        """Positions after `at`, with skip false, whose bounds allow a link with the point there."""
        point, n = self.points[at], int(self.sizes[at])
        nodes = np.arange(len(self.levels[-1][2]))
        for height in range(len(self.levels) - 1, -1, -1):
            edges, top, low, high = self.levels[height]
            nodes = nodes[(edges[nodes + 1] > at + 1) & (100 * n >= percent * low[nodes]) & (100 * high[nodes] >= percent * n)]
            nodes = nodes[(100 + percent) * np.minimum(top[nodes], point).sum(axis=1) >= percent * (n + low[nodes])]
            nodes = np.array([k for k in nodes if not skip[edges[k] : edges[k + 1]].all()], np.int64)
            if height:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[height - 1][2])]
        edges = self.levels[0][0]
        found = np.concatenate([np.arange(0), *(np.arange(edges[k], edges[k + 1]) for k in nodes)])
        found = found[(found > at) & ~skip[found]]
        sizes = self.sizes[found]
        found = found[(100 * n >= percent * sizes) & (100 * sizes >= percent * n)]
        bound = np.minimum(self.points[found], point).sum(axis=1)
        return found[(100 + percent) * bound >= percent * (n + self.sizes[found])]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(big, small)
    both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bands(sizes: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Rows by size, so that any two of compatible sizes are in one band; the sizes of a band differ by twice the ratio at most."""
    order = np.argsort(sizes, kind="stable")
    ranked, low = sizes[order].astype(float), 0
    while low < len(order):
        ratio = 100 / percent
        yield order[low : np.searchsorted(ranked, ranked[low] * ratio * ratio, side="right")]
        if ranked[-1] <= ranked[low] * ratio * ratio:
            return
        low = int(np.searchsorted(ranked, ranked[low] * ratio, side="right"))


def forest_of(sizes: np.ndarray, points_of, percent: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """The first member of each one's component, where bounds allow links or, with sets, where sets link.

    points_of(rows, width) gives points. Pairs that are in one component already aren't looked at again. A
    tree of one leaf is its matrix of bounds.
    """
    label = np.arange(len(sizes))

    def join_rows(i: int, j: int) -> None:
        if label[j] != label[i] and (sets is None or linked(sets[i], sets[j], percent)):
            label[label == max(label[i], label[j])] = min(label[i], label[j])

    for rows in bands(sizes, percent):
        if len(rows) < 2 or (label[rows] == label[rows[0]]).all():
            continue
        own = sizes[rows]
        points = points_of(rows, width_of(int(own.min())))
        if len(rows) <= LEAF:
            bound = np.minimum(points[:, None], points[None]).sum(axis=2)
            fits = (100 + percent) * bound >= percent * (own[:, None] + own[None])
            fits &= (100 * own[:, None] >= percent * own[None]) & (100 * own[None] >= percent * own[:, None])
            for i, j in zip(*np.nonzero(np.triu(fits, 1)), strict=True):
                join_rows(rows[i], rows[j])
            continue
        tree = Tree(points, own)
        order = rows[tree.order]
        for i in range(len(order)):
            for j in tree.search(i, percent, label[order] == label[order[i]]):
                join_rows(order[i], order[j])
    return label  # a component's label is its least member: labels only fall


def forests(blocks: DataFrame, size: int, percent: int) -> DataFrame:
    """blocks: comp, lo, hi, whole, node, digest, text, dealt and sorted by comp, lo, hi. Rows (u, v, whole) of nodes: v is the root of u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole, held = None, True, {}

        def forest() -> pa.RecordBatch:
            nodes, sets = np.array(list(held), np.int64), list(held.values())
            points_of = lambda at, width: np.stack([point_of(sets[i], width) for i in at])
            root = forest_of(np.array([len(x) for x in sets]), points_of, percent, sets)
            moved = root != np.arange(len(root))
            columns = [pa.array(nodes[moved]), pa.array(nodes[root[moved]]), pa.array([whole] * int(moved.sum()), pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, names=["u", "v", "whole"])

        for b in batches:
            places = zip(*[b.column(i).to_pylist() for i in range(6)], strict=True)
            for (comp, lo, hi, is_whole, node, digest), s in zip(places, shingle_sets(b.column(6), size), strict=True):
                if (comp, lo, hi) != own:
                    if len(held) > 1:
                        yield forest()
                    own, whole, held = (comp, lo, hi), is_whole, {}
                if digest_of(s) == digest:
                    held[node] = s
        if len(held) > 1:
            yield forest()

    return blocks.mapInArrow(run, "u long, v long, whole boolean")


def join(docs: DataFrame, percent: int = 80, size: int = SHINGLE, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, bits: int = 64) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, class_id (the hex digest of the row's set). bits: of a class's key."""
    described = stored(describe(docs, key, text, size, bits), "shingle-sets")
    rows = described.where("n >= 0")
    one = F.struct(F.col("id").isNull().alias("none"), "id", "print")
    classes = rows.where("n > 0").groupBy("digest").agg(F.min(one).alias("one"), *[F.first(c).alias(c) for c in ("key", "n", "point")])
    classes = classes.select("digest", "key", "n", "point", "one.id", "one.print")

    tokens = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    shared = groups(docs, common_tokens(described), int(tokens), key, text, size, percent, bits)
    points = dealt(parts(shared.join(classes.select("key", "n", "point"), "key"), "grp", "key", chunk), "grp")
    comps = joins(candidates(points, percent), classes)
    inner = classes.select("key", "digest", "id", "print").join(comps, "key").withColumn("node", F.monotonically_increasing_id())
    members = stored(inner, "members")  # numbers the classes of blocks, each with a number of its own
    placed = stored(parts(members.select("digest", "node", "id", "print", "comp"), "comp", "node", chunk), "blocks")
    texts = _texts(docs, key, text)
    few = F.broadcast if placed.count() <= BROADCAST else (lambda df: df)
    moved = texts.join(few(placed), placed["id"].eqNullSafe(texts["id"]) & (placed["print"] == texts["print"]))
    blocks = dealt(moved.select("comp", "lo", "hi", "whole", "node", "digest", "text"), "comp")
    links = stored(forests(blocks, size, percent), "links")

    labels = links.where("whole").select(F.col("u").alias("node"), F.col("v").alias("label")).union(components(links.where("not whole").select("u", "v")))
    ids = members.select("digest", "id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = ids.groupBy("label").agg(F.min("id").alias("component_id"))
    linked_ids = ids.join(least, "label").select("digest", "component_id")
    by_class = classes.select("digest", "id").join(linked_ids, "digest", "left").select("digest", F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    out = rows.join(by_class, "digest", "left")
    return out.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.lower(F.hex("digest")).alias("class_id"))


def joins(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, comp): components of candidates. Keys of several classes are in one each, linked or not."""
    several = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    linked_keys = components(found)
    comps = linked_keys.select(F.col("node").alias("key"), F.col("label").alias("comp")).union(linked_keys.select("label", "label").distinct())
    return comps.union(several.join(comps, "key", "left_anti").select("key", F.col("key").alias("comp")))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = """
WITH RECURSIVE t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(low, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT id, n, unnest(s) AS g FROM c),
i AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS n, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * i >= 80 * (n - i) UNION ALL SELECT b, a FROM i WHERE 100 * i >= 80 * (n - i)),
r(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS id, min(b) AS least FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.least, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN m ON m.id = c.id
"""
