"""Benchmark decontamination (1), native: which documents contain which test items?

An item is contained when at least 80 % of its distinct word shingles stand in the document; an item with
fewer words than a shingle is one shingle of all its words. Items are partitioned by size. A document that
contains an item of up to n shingles lacks at most n - ceil(0.8 n) of them, so of any n - ceil(0.8 n) + t it
has t. Each partition keeps sketches of that size, with its own t, and is searched for documents that hold t
of an item's sketch: no false negatives, however long the document. A sketch holds the shingles that the
fewest items share, the smallest hashes among these, so passages that many items share find few candidates.
Candidates, a few rows for each planted item, are verified on the shingles themselves, word for word.

All of it is DataFrame expressions. The benchmark is broadcast only if it is of BROADCAST bytes at most;
else the joins shuffle. A candidate's text is fetched by id and a hash of the text.

Defined results: null, empty and blank items match nothing; a null text counts as empty; documents and items
with null ids are kept; rows that repeat an id or an item give one row for each pair of ids, with the largest
containment; an empty table on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NEAR, SHINGLE, shingle_hashes, stored, table, words_of

#: Most bytes of a benchmark's items that are broadcast, as shingles.
BROADCAST = 64 << 20
#: Upper ends of the partitions of items by their number of shingles grow by this factor.
GROWTH = 1.25
#: One more shingle of a sketch must be met for each so many shingles of a partition's items.
MORE = 16


def enough(n: Column, least: float) -> Column:
    """The least number of shared shingles: the ceiling of a percentage, in whole numbers."""
    return F.floor((n * round(100 * least) + 99) / 100).cast("int")


def _runs(words: Column, size: int) -> Column:
    """The shingles as texts, of shorter texts the whole."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text", least: float = NEAR, size: int = SHINGLE) -> DataFrame:
    """(item, shingles, n, words, need, sketch) of the items that can be searched: their shingles as texts, how many
    words one has, and how many of the sketch's hashes must be met."""
    cut = benchmark.select(F.col(key).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    sized = cut.select("item", F.array_distinct(_runs(F.col("w"), size)).alias("shingles"), F.least(F.size("w"), F.lit(size)).alias("words")).distinct()
    sized = sized.withColumn("n", F.size("shingles"))
    upper = F.greatest(F.ceil(F.pow(F.lit(GROWTH), F.ceil(F.round(F.log(GROWTH, F.col("n")), 9)))).cast("int"), F.col("n"))
    sized = sized.withColumn("need", 1 + F.floor(upper / MORE).cast("int")).withColumn("kept", upper - enough(upper, least) + F.col("need"))
    hashes = F.transform("shingles", lambda s: hash_of(F.split(s, " "), size))
    own = ("item", "shingles", "n", "words", "need", "kept")
    each = sized.select(*own, F.explode(F.array_distinct(hashes)).alias("hash"))
    shared = each.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    ordered = each.join(shared, "hash").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("all"))
    sketch = F.transform(F.slice("all", F.lit(1), F.col("kept")), lambda x: x["hash"])
    return ordered.select("item", "shingles", "n", "words", F.least("need", F.size("all")).alias("need"), sketch.alias("sketch"))


def hash_of(words: Column, size: int) -> Column:
    """The hash that shingle_hashes gives a run of at most size words."""
    out = F.lit(None).cast("long")
    for k in range(1, size + 1):
        out = F.when(F.size(words) == k, F.xxhash64(*[F.get(words, F.lit(i)) for i in range(k)])).otherwise(out)
    return out


def contained(docs: DataFrame, benchmark: DataFrame, least: float = NEAR, size: int = SHINGLE, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc id, item id, n_item, n_shared, containment) of all pairs from `least` on."""
    items = stored(items_of(benchmark, item, item_text, least, size), "items")
    lengths = sorted(r.words for r in items.select("words").distinct().collect())  # at most size rows
    weight = F.aggregate("shingles", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s) + 24) + 40 * F.size("sketch")
    small = (items.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST
    hint = F.broadcast if small else (lambda df: df)

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(whole).alias("print"), whole.alias("body"))
    of_lengths = [shingle_hashes(F.col("w"), k) for k in lengths] or [F.array().cast("array<bigint>")]
    cut = rows.select("doc", "print", F.inline(F.array(F.struct(words_of(F.col("body")).alias("w")))))
    hashes = cut.select("doc", "print", F.explode(F.concat(*of_lengths)).alias("hash"))
    sketch = items.select(F.struct("item", "n", "need", "words").alias("i"), F.explode("sketch").alias("hash")).groupBy("hash").agg(F.collect_set("i").alias("items"))
    hit = hashes.join(hint(sketch), "hash").select("doc", "print", "hash", F.explode("items").alias("i"))
    met = hit.groupBy("doc", "print", "i").agg(F.count_distinct("hash").alias("met")).where(F.col("met") >= F.col("i.need"))
    pairs = stored(met.select("doc", "print", F.col("i.item").alias("item")).distinct(), "candidates")

    of_doc = pairs.groupBy("doc", "print").agg(F.collect_set(F.struct("item")).alias("found"))
    texts = rows.join(of_doc, rows["doc"].eqNullSafe(of_doc["doc"]) & (rows["print"] == of_doc["print"])).select(rows["doc"], "body", "found")
    spaced = F.concat(F.lit(" "), F.array_join(words_of(F.col("body")), " "), F.lit(" "))
    each = texts.select("doc", spaced.alias("own"), F.explode("found").alias("f")).select("doc", "own", F.col("f.item").alias("candidate"))
    exact = each.join(hint(items.select("item", "shingles", "n")), F.col("candidate").eqNullSafe(F.col("item")))
    held = F.filter("shingles", lambda s: F.contains(F.col("own"), F.concat(F.lit(" "), s, F.lit(" "))))
    shared = exact.select("doc", "item", "n", F.size(held).alias("shared")).where(F.col("shared") >= enough(F.col("n"), least))
    best = shared.groupBy("doc", "item").agg(F.max(F.struct(F.col("shared") / F.col("n"), "shared", "n")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("b.n").alias("n_item"), F.col("b.shared").alias("n_shared"), F.round(F.col("b.shared") / F.col("b.n"), 6).alias("containment"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sets(name: str, key: str) -> str:
    """Shingles of 1 to 5 words; of the items only those of five words, or the whole of a shorter one."""
    own = "least(len(w), 5)" if name == "benchmark" else "k"
    lengths = "" if name == "benchmark" else ", (SELECT DISTINCT k FROM i) l"
    return f"""SELECT {key}, {own} AS k, unnest(list_distinct(list_transform(range(1, len(w) - {own} + 2), lambda j: array_to_string(w[j:j + {own} - 1], ' ')))) AS s
    FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {name}){lengths} WHERE len(w) >= {1 if name == "benchmark" else "k"}"""


SQL = f"""
WITH i AS ({_sets("benchmark", "item_id")}), d AS ({_sets("documents", "doc_id")}),
n AS (SELECT item_id, CAST(count(*) AS INTEGER) AS n_item FROM i GROUP BY item_id),
p AS (SELECT d.doc_id, i.item_id, CAST(count(*) AS INTEGER) AS n_shared FROM d JOIN i USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) AS containment
FROM p JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item
"""
