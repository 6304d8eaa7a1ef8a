"""One signature over all tables, as a tree that names the ranges that differ.

A row belongs to the range that a hash of its key begins with (of the whole
row, where a table has no key), so ranges are alike in size whatever the keys,
and two sides agree on them without having met.  A range's digest is a sum over
its rows, so rows are hashed where they lie and a hot key costs nothing.  Nodes
above are digests of their children, up to one for each table and one for all.

``store`` writes a table by range, so that what differs is found by reading the
ranges whose digests differ, and no other file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import table_digest
from ..operators.tables import cut

#: The column that a stored table is laid out by; a letter first, so that no reader takes it for a number.
RANGE = "__range"
#: Hex digits of a range: 256 ranges.
DIGITS = 2


def in_ranges(df: DataFrame, key: list[str] | None = None, digits: int = DIGITS) -> DataFrame:
    """``df`` with the range of each row; repeated rows and null keys have a range like others."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in key or sorted(df.columns))), {"ignoreNullFields": "false"})
    return df.withColumn(RANGE, F.concat(F.lit("r"), F.substring(F.sha2(row, 256), 1, digits)))


def store(df: DataFrame, path: str) -> None:
    """Write a table with ranges: a folder a range, and large ranges in several files."""
    df.hint("rebalance", RANGE).write.partitionBy(RANGE).parquet(path)


def read(spark: SparkSession, path: str, ranges: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A stored table, or some ranges of it, of which only the folders are read; without its ``schema``, one file tells it."""
    df = spark.read.parquet(path) if schema is None else spark.read.schema(f"{schema}, {RANGE} string").parquet(path)
    return df if ranges is None else df.where(F.col(RANGE).isin(ranges))


def tree(spark: SparkSession, tables: dict[str, DataFrame], digits: int = DIGITS) -> DataFrame:
    """``table``, ``node``, ``n``, ``digest`` of tables with ranges: ranges, the nodes above, ``r`` for a table, and table ``*`` for all.

    A table without rows has its node ``r`` alone.  Rows of ranges and nodes
    number at most 16 ** digits * 16 / 15 a table.
    """
    # tables are read once, whatever is made of their ranges
    level = cut(reduce(DataFrame.unionByName, (_leaves(name, df) for name, df in tables.items())), "ranges")
    every = [level]
    for length in range(digits, 0, -1):
        level = _above(level, F.col("table"), F.substring("node", 1, length))
        every.append(level)
    names = spark.createDataFrame([(name,) for name in tables], "table string")
    none = F.sha2(F.lit(""), 256)
    roots = names.join(every.pop(), "table", "left").select("table", F.lit("r").alias("node"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", none).alias("digest"))
    whole = _above(roots.withColumn("node", F.concat("table", F.lit("/"), "node")), F.lit("*"), F.lit("r"))
    return reduce(DataFrame.unionByName, [*every, roots, whole])


def _leaves(name: str, df: DataFrame) -> DataFrame:
    columns = sorted(c for c in df.columns if c != RANGE)
    return table_digest(df, columns, [RANGE]).select(F.lit(name).alias("table"), F.col(RANGE).alias("node"), "n", "digest")


def _above(level: DataFrame, table: Column, node: Column) -> DataFrame:
    child = F.concat_ws(":", "node", "digest")
    return level.groupBy(table.alias("table"), node.alias("node")).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(child))), 256).alias("digest"))


def signature(tree: DataFrame) -> dict:
    """Rows and digest of all tables together."""
    return tree.where("table = '*'").select("n", "digest").first().asDict()


def differing(a: DataFrame, b: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``table``, ``node``, ``n_a``, ``n_b`` of the lowest nodes that differ between two trees of one depth: ranges, or a table that has none on either side."""
    key = ["table", "node"]
    x = a.select(*key, F.col("n").alias("n_a"), F.col("digest").alias("a")).join(b.select(*key, F.col("n").alias("n_b"), F.col("digest").alias("b")), key, "full")
    lowest = (F.length("node") == digits + 1) | (F.col("n_a").isNull() & (F.col("n_b") == 0)) | (F.col("n_b").isNull() & (F.col("n_a") == 0))
    lowest &= F.col("table") != "*"
    return x.where(~F.col("a").eqNullSafe(F.col("b")) & lowest).select(*key, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two sides has more often, with the ``side`` (``a`` or ``b``); repeated rows count."""
    columns = [c for c in a.columns if c != RANGE]
    a, b = a.select(*columns), b.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def located(spark: SparkSession, a: str, b: str, nodes: list[str], schema: str | None = None) -> DataFrame:
    """``changes`` of two stored tables in the ranges that were found to differ; no other range is read."""
    return changes(read(spark, a, nodes, schema), read(spark, b, nodes, schema))
