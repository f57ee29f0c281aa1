"""Caches and resumable work as anti joins: compute what is missing, append it, read all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def missing(wanted: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    return wanted.join(cached.select(key), key, "left_anti")


def through(wanted: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> DataFrame:
    """wanted with its cached values; what is missing is computed once for each distinct key and appended."""
    spark = wanted.sparkSession
    try:
        cached = spark.read.parquet(path)
    except Exception as e:  # the first run has no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cached = None
    todo = wanted.dropDuplicates([key]) if cached is None else missing(wanted, cached, key).dropDuplicates([key])
    compute(todo).write.mode("append").parquet(path)
    return wanted.join(spark.read.parquet(path), key, "left")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with changes put in or over it; changes holds one row a key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
