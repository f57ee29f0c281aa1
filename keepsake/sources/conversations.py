"""Conversation and benchmark JSON, snapshots of a memory, and results that grow."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import parse_session_date
from ..operators.extraction import normal_role

SESSIONS = "session_id string, date string, turns array<struct<role:string,content:string,has_answer:boolean>>"
ITEMS = (
    "question_id string, question_type string, question string, answer string, question_date string, answer_session_ids array<string>, haystack_dates array<string>, "
    "haystack_session_ids array<string>, haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"
)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """session_id, ts, turns of a JSON array; order by ts where order matters."""
    return spark.read.schema(SESSIONS).json(path, multiLine=True).select("session_id", parse_session_date(F.col("date")).alias("ts"), "turns")


def turns(found: DataFrame) -> DataFrame:
    each = found.select("session_id", "ts", F.posexplode("turns").alias("turn", "t"))
    return each.select("session_id", "ts", "turn", normal_role(F.col("t.role")).alias("role"), F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Questions with their stratum, whether they ask for abstention, and evidence session ids."""
    items = spark.read.schema(ITEMS).json(path, multiLine=True)
    none = F.col("question_id").endswith("_abs")
    return items.select("*", none.alias("is_abstention"), F.concat("question_type", F.when(none, "_abs").otherwise("")).alias("stratum"))


def haystack(items: DataFrame) -> DataFrame:
    """One row per question and turn, with the session's id and date; parallel arrays are zipped."""
    zipped = items.select("question_id", F.explode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("s"))
    each = zipped.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), parse_session_date(F.col("s.haystack_dates")).alias("ts"), F.col("s.haystack_sessions").alias("turns"))
    return each.select("question_id", "session_id", "ts", F.posexplode("turns").alias("turn", "t")).select("question_id", "session_id", "ts", "turn", normal_role(F.col("t.role")).alias("role"), F.col("t.content").alias("text"), F.coalesce("t.has_answer", F.lit(False)).alias("has_answer"))


def evidence_turns(turns_of: DataFrame) -> DataFrame:
    return turns_of.where("has_answer").groupBy("question_id", "session_id").agg(F.array_sort(F.collect_set("turn")).alias("turns"))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The whole versions of a snapshot, oldest first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(n for n in names if re.fullmatch("v[0-9]{9}", n) and done(n))


def save(df: DataFrame, path: str) -> str:
    """A new version of a snapshot, in a folder of its own; older ones stay, so df may be read from one. The folder's path."""
    found = _versions(df.sparkSession, path)
    to = f"{path}/v{int(found[-1][1:]) + 1 if found else 0:09d}"
    df.write.mode("overwrite").parquet(to)  # what an attempt that failed left there
    return to


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version; columns that came later are null in files without them."""
    found = _versions(spark, path)
    if not found:
        raise ValueError(f"no snapshot in {path}")
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{found[-1]}")


def save_split(items: DataFrame, path: str, key: str = "id") -> None:
    """items: key, dev. Which items are for development and which for the test."""
    items.select(key, "dev").write.mode("errorifexists").json(path)


def load_split(items: DataFrame, path: str, key: str = "id") -> DataFrame:
    """items with the column dev of a saved split; items that it doesn't have are left out."""
    kind = items.schema[key].dataType.simpleString()
    saved = items.sparkSession.read.schema(f"`{key}` {kind}, dev boolean").json(path)
    return items.drop("dev").join(saved, key)


def append_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").json(path)
