"""Every registered query of the engine against its SQL, by another engine."""

from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfern.plans import intake, proxy, queries  # noqa: F401  two of them register
from wayfern.plans import registry as plans

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _rows(columns, rows):
    """Rows with columns by name, in one order; whole numbers stay whole, so no data frame of pandas in between."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_plain(row[i])) for i in order) for row in rows)


def _plain(x):
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, Decimal):
        return x.normalize()
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x.replace(tzinfo=None) if isinstance(x, datetime) else x


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    found = plans.QUERIES[name](spark, sf_dir)
    got = found.collect()
    if name in plans.SQL:
        want = duck.execute(plans.SQL[name])
        columns = [x[0] for x in want.description]
        assert sorted(found.columns) == sorted(columns)
        assert _rows(found.columns, got) == _rows(columns, want.fetchall())
    else:
        assert len(got) > 0


def _over(tmp_path, sf_dir, table, sql):
    """The tables with another one in the place of ``table``, and an engine over them."""
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in [*TABLES, "labels", "conversations"]:
        at = tmp_path / f"{t}.parquet"
        if t == table:
            c.execute(f"COPY ({sql}) TO '{at}'")
        else:
            at.symlink_to(f"{sf_dir}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}'")
    return str(tmp_path), c


def test_tiles_of_points_on_their_edges(spark, sf_dir, tmp_path):
    sql = f"SELECT c.* REPLACE (j * 218750 AS c_custkey) FROM (SELECT * FROM '{sf_dir}/customer.parquet' LIMIT 1) c, range(1, 451) r(j)"
    d, c = _over(tmp_path, sf_dir, "customer", sql)
    want = c.execute(plans.SQL["saturated_tiles"]).fetchall()
    assert sorted(map(tuple, plans.QUERIES["saturated_tiles"](spark, d).collect())) == sorted(want) and len(want) > 10


@pytest.mark.parametrize("name", ["review_topk", "review_topk_stored", "review_topk_merged"])
def test_ranks_that_round_alike_go_by_date(spark, sf_dir, tmp_path, name):
    # "the" is in most documents and weighs next to nothing, so its uses move the seventh digit; some have no text
    body = "CASE WHEN i % 11 = 0 THEN NULL WHEN i % 4 = 1 THEN 'licensed ' || repeat('the ', CAST(1 + i * 7 % 5 AS INT)) || repeat('x ', CAST(30 - i * 7 % 5 AS INT)) ELSE 'the ' || repeat('y ', CAST(i % 9 AS INT)) END"
    d, c = _over(tmp_path, sf_dir, "documents", f"SELECT i AS doc_id, {body} AS text, 'en' AS lang, 'src' || CAST(i % 7 AS VARCHAR) AS source, CAST(40 AS BIGINT) AS n_chars FROM range(600) r(i)")
    want = c.execute(plans.SQL[name]).fetchall()
    assert [tuple(r) for r in plans.QUERIES[name](spark, d).collect()] == want and len(want) >= 20


def test_menus_are_made_distinct_by_their_keys(spark, sf_dir, tmp_path):
    # a part that stands twice, and one of two names
    d, c = _over(tmp_path, sf_dir, "part", f"SELECT * FROM '{sf_dir}/part.parquet' UNION ALL SELECT * REPLACE (CASE WHEN p_partkey % 2 = 0 THEN 'other' ELSE p_name END AS p_name) FROM '{sf_dir}/part.parquet' WHERE p_partkey < 20")
    menus, stores = proxy.view(spark, d, "menus"), proxy.view(spark, d, "menus", ["store_id"])
    assert _rows(menus.columns, menus.collect()) == _rows(menus.columns, c.execute(proxy.VIEWS["menus"]).fetchall())
    assert sorted(r.store_id for r in stores.collect()) == [x for x, in c.execute(f"SELECT DISTINCT store_id FROM ({proxy.VIEWS['menus']}) ORDER BY 1").fetchall()]
    wide = [x for x in menus._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x and ("menu_" in x or "store_" in x)]
    assert not wide


MENU_QUERIES = ["filter_reason_counts", "derived_facts", "representative_menus_top3", "reason_codes", "supersede_check", "filtered_left_joins", "evidence_superseded"]


@pytest.mark.parametrize("name", MENU_QUERIES)
def test_many_menus_are_dealt_out_by_their_number(spark, sf_dir, tmp_path, monkeypatch, name):
    # a part of two names, and lines and orders without a key
    d, c = _over(tmp_path, sf_dir, "part", f"SELECT * FROM '{sf_dir}/part.parquet' UNION ALL SELECT * REPLACE ('hot almond' AS p_name) FROM '{sf_dir}/part.parquet' WHERE p_partkey < 20")
    for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        (tmp_path / f"{t}.parquet").unlink()
        c.execute(f"COPY (SELECT * REPLACE (CASE WHEN {key} % 50 <> 0 THEN {key} END AS {key}) FROM '{sf_dir}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    monkeypatch.setattr(proxy, "FEW", 0)
    monkeypatch.setattr(proxy, "ROWS_A_TASK", 500)
    tasks = -(-sum(c.execute(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("lineitem", "orders")) // 500)
    menus = proxy.view(spark, d, "menus")
    assert tasks > 4 and menus.rdd.getNumPartitions() == tasks  # the session has 4
    assert _rows(menus.columns, menus.collect()) == _rows(menus.columns, c.execute(proxy.VIEWS["menus"]).fetchall())
    got, want = plans.QUERIES[name](spark, d), c.execute(plans.SQL[name])
    assert _rows(got.columns, got.collect()) == _rows([x[0] for x in want.description], want.fetchall())


def test_menus_hold_what_is_asked_of_them(spark):
    from wayfern.operators import candidates as C

    stores = spark.createDataFrame([("s1",), ("s2",)], "store_id string")
    menus = spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s1", "b"), ("s3", "a")], "store_id string, category string")
    none = lambda schema: spark.createDataFrame([], f"store_id string, {schema}")
    rest = none("alias_type string, normalized_alias string"), none("weekday int, sequence int, opens_minute int, closes_minute int, closes_next_day boolean"), none("review_count long, latest_date string, rated_count long, rating_sum_bp long")
    of = lambda m: {r.store_id: r.menus and [x.asDict() for x in r.menus] for r in C.nest(stores, m, None, *rest).collect()}
    assert of(menus) == {"s1": [{"category": "a", "aliases": []}, {"category": "b", "aliases": []}], "s2": None}
    assert of(menus.select("store_id")) == {"s1": [{"aliases": []}], "s2": None}


def test_aliases_of_an_item_are_those_of_its_menus(spark):
    from wayfern.operators import candidates as C

    stores = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "store_id string")
    menus = spark.createDataFrame([("s1", "m1", 7), ("s2", "m2", 7), ("s2", "m3", 8)], "store_id string, menu_id string, item_id long").withColumns({c: F.lit("x") for c in ("name", "normalized_name", "category", "evidence_id")})
    items = spark.createDataFrame([(7, "b"), (7, "a"), (9, "c"), (8, None)], "item_id long, normalized_alias string")
    none = lambda schema: spark.createDataFrame([], f"store_id string, {schema}")
    rest = none("alias_type string, normalized_alias string"), none("weekday int, sequence int, opens_minute int, closes_minute int, closes_next_day boolean"), none("review_count long, latest_date string, rated_count long, rating_sum_bp long")
    got = {r.store_id: r.menus and [(m.menu_id, m.aliases) for m in r.menus] for r in C.nest(stores, menus, items, *rest).collect()}
    assert got == {"s1": [("m1", ["a", "b"])], "s2": [("m2", ["a", "b"]), ("m3", [])], "s3": None}
