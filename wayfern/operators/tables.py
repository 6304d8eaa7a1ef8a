"""Set-based table maintenance: upserts, purges, change types, checks."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folders: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the application's own part of the folder that the session shares; it goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = f"{(base or '/tmp/wayfern-shared').rstrip('/')}/wayfern-{spark.sparkContext.applicationId}"
    if folder not in _own_folders:
        _own_folders.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: it is computed once and its lineage ends.

    ``rows``: what a Python function gets at a time while it is written, where rows are wide.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark, what), spark.conf.get(name)
    if rows is not None:
        spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session or its JVM has ended: what is left is only disk space
        pass


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``new`` to insert, rows that are there already)."""
    return new.join(old.select(*keys), keys, "left_anti"), new.join(old.select(*keys), keys, "left_semi")


def merge_max(old: DataFrame, new: DataFrame, keys: list[str], latest: list[str], first: list[str] = ()) -> DataFrame:
    """One row per key with the largest of ``latest`` and the smallest of ``first``."""
    return old.unionByName(new).groupBy(*keys).agg(*(F.max(c).alias(c) for c in latest), *(F.min(c).alias(c) for c in first))


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in this order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def change_types(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with ``change``: INSERTED, UPDATED, UNCHANGED or MISSING, by null-safe comparison of all other columns."""
    rest = [c for c in new.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("__o"))
    n = new.select(*keys, F.struct(*rest).alias("__n"))
    same = reduce(lambda a, b: a & b, (F.col(f"__o.{c}").eqNullSafe(F.col(f"__n.{c}")) for c in rest), F.lit(True))
    change = F.when(F.col("__o").isNull(), "INSERTED").when(F.col("__n").isNull(), "MISSING").when(same, "UNCHANGED").otherwise("UPDATED")
    return o.join(n, keys, "full").select(*keys, change.alias("change"))


def without_children(parents: DataFrame, key: str, children: list[DataFrame]) -> DataFrame:
    """Parents that no child table refers to."""
    return reduce(lambda p, c: p.join(c.select(key), key, "left_anti"), children, parents)


def purge(df: DataFrame, expires: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows gone); a row expires at its instant, inclusive."""
    gone = F.coalesce(F.col(expires) <= F.lit(now_ms), F.lit(False))
    return df.where(~gone), df.where(gone)


def purge_estimate(expiring: dict[str, tuple[DataFrame, str]], now_ms: int, guarded: tuple[DataFrame, str, str, dict[str, tuple[DataFrame, str]]] | None = None) -> DataFrame:
    """``table``, ``n``: rows that a purge would take, and their sum as ``total``.

    ``expiring``: table and the column of its expiry.  ``guarded``: parents,
    their expiry and key, and the children that keep a parent while they live.
    """
    parts = [df.agg(F.lit(name).alias("table"), F.count_if(F.col(at) <= now_ms).alias("n")) for name, (df, at) in expiring.items()]
    if guarded is not None:
        parents, at, key, children = guarded
        live = [df.where(F.col(c) > now_ms) for df, c in children.values()]
        parts.append(without_children(parents.where(F.col(at) <= now_ms), key, live).agg(F.lit("guarded").alias("table"), F.count(F.lit(1)).alias("n")))
    every = reduce(DataFrame.unionByName, parts)
    return every.unionByName(every.agg(F.lit("total").alias("table"), F.sum("n").alias("n")))


def identity_mismatches(indexed: DataFrame, documents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Index rows whose document is missing or differs."""
    d = documents.select(key, F.struct(*columns).alias("__d"))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__d.{c}")) for c in columns))
    return indexed.join(d, key, "left").where(F.col("__d").isNull() | differs).select(key)


def page(df: DataFrame, order: list[Column], number: int, limit: int) -> DataFrame:
    """Rows of page ``number`` (1 to 1000) of ``limit`` (1 to 20) rows."""
    if not (1 <= number <= 1000 and 1 <= limit <= 20):
        raise ValueError("page")
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """``check``, ``n``: rows that break each check; publishing needs all zero."""
    parts = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
