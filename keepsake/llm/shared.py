"""What the operators of this package share: tables, the shared folder, label splits, native word shingles."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class of a regular expression that Java and RE2 read alike.
BLANK = "[\\x20\\x09-\\x0D]+"
#: Words in a shingle, and the similarity from which two texts are near duplicates.
SHINGLE, NEAR = 5, 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="keepsake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here and no executor's loss undoes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fold that no model learns from. A null id counts as the text 'null'."""
    key = F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null"))
    return F.crc32(key) % 4 == 2


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Words between ASCII blanks, lower-cased; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of all runs of size words, with repeats; fewer words give an empty array."""

    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    return let(words, lambda w: F.when(F.size(w) >= size, runs(w)).otherwise(F.array().cast("array<bigint>")))
