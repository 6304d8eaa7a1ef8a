"""The driver's tables seen as stores, menus, reviews, hours, ledger rows and histories.

The statements are plain SQL that Spark and other engines read alike, so that a
check by another engine starts from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut

STORE_ID = "'store_' || lpad(CAST({} AS STRING), 8, '0')"

VIEWS = {
    "stores": f"""
        SELECT {STORE_ID.format('c_custkey')} AS store_id, 'bakery_' || lpad(CAST(c_nationkey AS STRING), 4, '0') AS bakery_id, c_custkey AS k,
               c_name AS display_name, lower(replace(c_name, '#', '')) AS normalized_name, lower(c_mktsegment) AS normalized_brand_name,
               r_name || ' ' || n_name || ' ' || CAST(c_custkey % 97 AS STRING) AS normalized_address, n_name AS district,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '02' || lpad(CAST(c_custkey % 700 AS STRING), 8, '1') END AS normalized_phone,
               CAST(374000000 + c_custkey * 7919 % 3500000 AS INT) AS latitude_e7, CAST(1267000000 + c_custkey * 104729 % 6000000 AS INT) AS longitude_e7,
               CASE WHEN c_acctbal < 0 THEN 'hidden' ELSE 'published' END AS catalog_status,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'inactive' ELSE 'active' END AS business_status
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bakeries": """
        SELECT 'bakery_' || lpad(CAST(n_nationkey AS STRING), 4, '0') AS bakery_id, n_name AS display_name,
               CASE WHEN n_regionkey = 4 THEN 'hidden' ELSE 'published' END AS catalog_status
        FROM nation""",
    "links": f"SELECT {STORE_ID.format('o_custkey')} AS store_id, CAST(o_orderkey AS STRING) AS link_id FROM orders WHERE o_orderstatus <> 'P'",
    "reviews": f"""
        SELECT 'review_' || lpad(CAST(o_orderkey AS STRING), 10, '0') AS review_id, {STORE_ID.format('o_custkey')} AS store_id,
               CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey * 13 % 51 * 100 END AS rating_bp, CAST(CAST(o_orderdate AS DATE) AS STRING) AS published_date
        FROM orders""",
    "menus": f"""
        SELECT DISTINCT {STORE_ID.format('o_custkey')} AS store_id, 'menu_' || CAST(o_custkey AS STRING) || '_' || CAST(p_partkey AS STRING) AS menu_id,
               p_name AS name, lower(replace(p_name, ' ', '')) AS normalized_name, p_brand AS category
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "hours": f"""
        SELECT {STORE_ID.format('c_custkey')} AS store_id, CAST(c_custkey % 7 AS INT) AS weekday, 0 AS sequence, CAST(c_custkey * 37 % 1440 AS INT) AS opens_minute,
               CAST((c_custkey * 37 % 1440 + 480) % 1440 AS INT) AS closes_minute, c_custkey * 37 % 1440 + 480 >= 1440 AS closes_next_day
        FROM customer WHERE c_custkey % 10 <> 0""",
    "texts": """
        SELECT 'review_' || lpad(CAST(doc_id AS STRING), 10, '0') AS review_id, source AS store_id, lower(text) AS normalized_body,
               CAST(CAST('2026-01-01' AS DATE) + CAST(doc_id % 200 AS INT) AS STRING) AS published_date
        FROM documents""",
}


#: ``menus`` by a shorter way: keys are made distinct before names are joined to them, and texts are made of what is left.
MENU_TEXTS = """
        SELECT store_id, 'menu_' || CAST(o_custkey AS STRING) || '_' || CAST(l_partkey AS STRING) AS menu_id,
               p_name AS name, lower(replace(p_name, ' ', '')) AS normalized_name, p_brand AS category, l_partkey AS item_id
        FROM {rows}"""
#: Rows of ``lineitem`` and ``orders`` that a task takes, where there are more than ``FEW`` of them.
ROWS_A_TASK, FEW = 1_000_000, 16_000_000
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


def tables(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def view(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One of ``VIEWS`` over the tables of ``sf_dir``; with ``columns`` its different rows of those.

    Rows are made distinct by these columns then, and no wider ones are moved.
    """
    if name == "menus":
        return _menus(spark, sf_dir, columns)
    text = VIEWS[name]
    used = tables(spark, sf_dir, tuple(n for n in TABLES if f" {n} " in f"{text} ".replace("\n", " ")))
    for n in used:
        text = f"{text} ".replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"FROM {n}\n", f"FROM {{{n}}}\n").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    out = spark.sql(text, **used)
    return out if columns is None else out.select(*columns).distinct()


def dealer(*sized: DataFrame) -> Callable[[DataFrame, str], DataFrame]:
    """Deals rows out by a key, to tasks that get more with the rows of ``sized``; few rows stay where they are.

    By the session's number of partitions alone, the rows of one task would grow with the tables.
    """
    rows = sum(df.count() for df in sized)  # from the files' footers
    tasks = -(-rows // ROWS_A_TASK)
    return lambda df, key: df.repartition(tasks, key) if rows > FEW else df


def _lines(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> tuple[DataFrame, Callable[[DataFrame, str], DataFrame]]:
    """(o_custkey, l_partkey) of each line of an order, if given of the stores ``of`` (``k``), and the dealer of their number."""
    used = tables(spark, sf_dir, ("orders", "lineitem"))
    deal = dealer(*used.values())
    orders = used["orders"] if of is None else used["orders"].join(of.select("k"), F.col("o_custkey") == F.col("k"), "left_semi")
    lines = spark.sql("SELECT o_custkey, l_partkey FROM {l} JOIN {o} ON l_orderkey = o_orderkey", l=deal(used["lineitem"], "l_orderkey"), o=deal(orders, "o_orderkey"))
    return lines, deal


def _named(spark: SparkSession, sf_dir: str, keys: DataFrame, deal: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``keys`` with the different names of their parts and their store, dealt by the store."""
    part = deal(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand"), "p_partkey").distinct()
    rows = spark.sql(f"SELECT {STORE_ID.format('o_custkey')} AS store_id, o_custkey, l_partkey, p_name, p_brand FROM {{keys}} JOIN {{part}} ON l_partkey = p_partkey", keys=keys, part=part)
    return spark.sql(MENU_TEXTS, rows=deal(rows, "store_id"))


def _menus(spark: SparkSession, sf_dir: str, columns: list[str] | None) -> DataFrame:
    if columns is not None:
        return menu_rows(spark, sf_dir, columns).distinct()
    lines, deal = _lines(spark, sf_dir)
    return _named(spark, sf_dir, deal(lines, "l_partkey").distinct(), deal).drop("item_id")


def menu_rows(spark: SparkSession, sf_dir: str, columns: list[str], of: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``menus``, if given of the stores ``of`` only; a row may come more than once, for callers that collect the different ones."""
    lines, deal = _lines(spark, sf_dir, of)
    keys = deal(lines, "l_partkey")
    if columns != ["store_id"]:
        return _named(spark, sf_dir, keys, deal).select(*columns)
    part = deal(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    buyers = keys.join(part, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("o_custkey")
    return deal(buyers, "o_custkey").distinct().select(F.expr(STORE_ID.format("o_custkey")).alias("store_id"))


def menu_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different (o_custkey, l_partkey) of ``menus``, written once: what a query takes from them more than once is not joined again."""
    lines, deal = _lines(spark, sf_dir)
    return cut(deal(lines, "l_partkey").distinct(), "menu-keys")


def menus_of(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """``menus`` over written ``menu_keys``, with the part's key as ``item_id``."""
    deal = dealer(keys)
    return _named(spark, sf_dir, deal(keys, "l_partkey"), deal)


def ctes(*names: str) -> str:
    """The views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
