"""Ledger pages, versions, HTML, table maintenance, sync, streams, users."""

import json

import pytest
from pyspark.sql import functions as F

from wayfern.operators import fulltext, places, reviews, tables
from wayfern.plans import users
from wayfern.sources import html, ledger
from wayfern.sources.versions import StaleSource, Versions
from wayfern.streaming.seen import first_sightings


def item(number, **more):
    base = {"OPN_ATMY_GRP_CD": "3010000", "MNG_NO": number, "LCPMT_YMD": "20200102", "SALS_STTS_CD": "01", "SALS_STTS_NM": "영업/정상", "BPLC_NM": "한강 빵집", "ROAD_NM_ADDR": "서울특별시 마포구 양화로 1", "CRD_INFO_X": "191234.125", "CRD_INFO_Y": "451234.5", "DAT_UPDT_PNT": "20260724010203", "SITE_TEL": "dropped"}
    return base | more


def page(n, items, total=4):
    return json.dumps({"response": {"header": {"resultCode": "00", "resultMsg": "OK"}, "body": {"pageNo": n, "numOfRows": 2, "totalCount": str(total), "items": items}}}, ensure_ascii=False)


@pytest.fixture(scope="module")
def fixture_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("ledger") / "pages.json"
    pages = [page(1, [item("S1"), item("S2", ROAD_NM_ADDR=None, LOTNO_ADDR="서울시 종로구 1", CRD_INFO_X=None, CRD_INFO_Y=None)]), page(2, {"item": [item("B1", ROAD_NM_ADDR="부산광역시 중구 1"), item("S3")]})]
    path.write_text(json.dumps({"basisDate": "2026-07-24", "pages": [json.loads(p) for p in pages]}, ensure_ascii=False))
    return str(path)


def test_ledger_counts_and_reasons(spark, fixture_file):
    decoded = ledger.decode(ledger.read_fixture(spark, fixture_file))
    assert ledger.page_errors(decoded).count() == 0
    checked = ledger.check(ledger.rows(decoded), "snap")
    assert tuple(ledger.summary(checked).first()) == (4, 3, 1)
    assert {r.mng_no: r.reason_code for r in checked.collect()} == {"S1": None, "S2": None, "B1": "NOT_SEOUL", "S3": None}
    assert checked.where("mng_no = 'S1'").first().data_updated_at_ms == 1784822523000
    good = {r.management_number: r for r in ledger.normalise(checked.where("reason_code is null"), "snap").collect()}
    assert (good["S1"].latitude_e7, good["S1"].district, good["S1"].business_status) == (375634614, "마포구", "active")
    assert good["S2"].review_reason_codes == ["COORDINATE_MISSING_OR_INVALID"] and good["S2"].normalized_address == "서울특별시 종로구 1"


@pytest.mark.parametrize(
    "change, want",
    [
        ({"MNG_NO": " "}, "REQUIRED_FIELD_MISSING"),
        ({"ROAD_NM_ADDR": ""}, "ADDRESS_MISSING"),
        ({"LCPMT_YMD": "20260230"}, "DATE_INVALID"),
        ({"DAT_UPDT_PNT": "2026"}, "TIMESTAMP_INVALID"),
        ({"CRD_INFO_Y": None}, "COORDINATE_INVALID"),
        ({"CRD_INFO_X": "1e3"}, "COORDINATE_INVALID"),
    ],
)
def test_first_broken_rule(spark, change, want):
    pages = spark.createDataFrame([(page(1, [item("S1", **change)], 1),)], "json string")
    assert ledger.check(ledger.rows(ledger.decode(pages)), "s").first().reason_code == want


def test_page_errors(spark):
    pages = spark.createDataFrame([(page(1, [item("a")], 2),), (page(1, [item("b")], 3),), ("{",)], "json string")
    assert {r.error for r in ledger.page_errors(ledger.decode(pages)).collect()} == {"SCHEMA_MISMATCH", "PAGE_MISMATCH", "TOTAL_CHANGED", "TOTAL_MISMATCH"}


def test_versions(spark, tmp_path):
    v = Versions(str(tmp_path / "app"))
    df = spark.createDataFrame([(1, "a")], "id int, x string")
    source = {"basis_date": "2026-07-24", "downloaded_at_ms": 5, "snapshot_id": "s1"}
    first = v.publish({"t": df}, source)
    assert v.publish({"t": df.limit(0)}, source) == first and v.read(spark, "t").count() == 1
    with pytest.raises(StaleSource):
        v.publish({"t": df}, source | {"basis_date": "2026-07-01"})
    with pytest.raises(ValueError):
        v.publish({"t": df}, source | {"basis_date": "2026-08-01"}, tables.violations({"any": df}))
    assert v.state()["active"]["version"] == first["version"]
    assert v.backup(spark, str(tmp_path / "copy")).verify(spark) == {"t": True}


def test_html_reviews_and_boundary(spark):
    block = lambda d, r: f'<article data-date="{d}" data-nickname="n" data-rating="{r}"><p>good <b>bread</b></p></article>'
    rows = [("a", block("2026. 7. 4.", "4.5") + block("2026-07-01", "9")), ("b", block("2024-01-01", "5")), ("c", block("2026-07-01", "1") + block("2026-07-02", "1"))]
    got = html.reviews(spark.createDataFrame(rows, "page string, html string"), ["page"])
    first = got.where("page = 'a' and position = 0").first()
    assert (first.published_date, first.rating_bp, first.body) == ("2026-07-04", 4500, "good bread")
    assert {r.page: r.state for r in html.boundary(got, "page", ["position"], "2025-07-30").collect()} == {"a": "MORE", "b": "CUTOFF", "c": "STOP"}


def test_table_maintenance(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, x string, ms long")
    new = spark.createDataFrame([(2, None, 25), (3, "c", 5)], "id int, x string, ms long")
    assert sorted(map(tuple, tables.upsert(old, new, ["id"]).collect()), key=str) == [(1, "a", 10), (2, None, 25), (3, "c", 5)]
    assert {r.id: r.change for r in tables.change_types(old, new, ["id"]).collect()} == {1: "MISSING", 2: "UPDATED", 3: "INSERTED"}
    kept, gone = tables.purge(old, "ms", 10)
    assert [r.id for r in kept.collect()] == [2] and [r.id for r in gone.collect()] == [1]
    with pytest.raises(ValueError):
        tables.page(old, [F.col("id")], 0, 5)


def test_incremental_sync(spark):
    p = [("a", 1, "n"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "q"), ("c", 1, "x"), ("c", 2, "new"), ("d", 1, "z")]
    pages = spark.createDataFrame(p, "store_id string, position int, fingerprint string")
    seen = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "x"), ("d", "z")], "store_id string, fingerprint string")
    anchors = spark.createDataFrame([("a", "x"), ("c", "x"), ("d", "gone")], "store_id string, anchor string")
    got = {r.store_id: (r.mode, r.n_new, r.stopped_at) for r in reviews.incremental_sync(pages, seen, anchors).collect()}
    assert got == {"a": ("INCREMENTAL", 1, 1), "b": ("INITIAL_BACKFILL", 1, 1), "c": ("BACKFILL_FALLBACK", 1, 2), "d": ("BACKFILL_FALLBACK", 0, 1)}


def test_review_publish(spark):
    schema = "review_id string, store_id string, body string, published_date string"
    old = spark.createDataFrame([("r1", "s1", "old", "2026-01-01"), ("r2", "s1", "late", "2024-01-01")], schema)
    new = spark.createDataFrame([("r1", "s1", "newer", "2026-02-01"), ("r3", "s9", "x", "2026-02-01"), ("r4", "s1", " ", "2026-02-01")], schema)
    kept, refused = reviews.publish(old, new, spark.createDataFrame([("s1",)], "store_id string"), "2025-07-30", "v2")
    assert [(r.review_id, r.body, r.version) for r in kept.collect()] == [("r1", "newer", "v2")]
    assert {r.review_id: r.reason_code for r in refused.collect()} == {"r3": "STORE_NOT_PUBLIC", "r4": "BODY_EMPTY"}


def test_fulltext(spark):
    schema = "review_id string, store_id string, normalized_body string, published_date string"
    docs = spark.createDataFrame([("a", "s1", "소금빵 고소함", "2026-01-01"), ("b", "s1", "소금빵 고소함", "2026-01-01"), ("c", "s2", "crème croissant 고소함", "2026-01-02")], schema)
    assert [r.review_id for r in fulltext.search(docs, '"소금빵" 고소함').collect()] == ["a", "b"]
    assert [r.review_id for r in fulltext.search(docs, "creme").collect()] == ["c"]
    best = {r.store_id: r.evidence for r in fulltext.best_evidence(docs, ["croissant", "소금빵"]).collect()}
    assert best["s2"].snippet == "crème [croissant] 고소함" and best["s1"].review_id == "a"
    with pytest.raises(ValueError):
        fulltext.query_tokens("x" * 201)
    ok = fulltext.availability(docs, docs, docs.select("store_id").distinct(), {"status": "ACTIVE", "version": 1, "index_version": 1})
    assert ok["available"] and not fulltext.availability(docs, docs.limit(2), docs, {"status": "ACTIVE", "version": 1, "index_version": 1})["available"]


def test_saturated_tiles(spark):
    box = (0, 1000, 0, 1000)
    points = spark.createDataFrame([(10, 10)] * 5 + [(900, 900)], "latitude_e7 long, longitude_e7 long")
    got = sorted((r.tile, r.depth, r.n, r.status) for r in places.saturated_tiles(points, box, 3, 2).collect())
    assert got == [("0.0.0", 2, 5, "PARTIAL"), ("0.3", 1, 1, "COMPLETE")]
    assert [tuple(r) for r in places.saturated_tiles(points, box, 7, 2).select("tile", "n").collect()] == [("0", 6)]
    # points are read once at any depth
    deep = places.saturated_tiles(points, box, 3, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert deep.count("LogicalRDD") + deep.count("LocalRelation") <= 3


def test_users(spark):
    public = spark.createDataFrame([("s1", "n")], "store_id string, display_name string")
    people = spark.createDataFrame([("u1", "active"), ("u2", "withdrawn")], "user_id string, status string")
    rows = spark.createDataFrame([("u1", "s1", 1)], "user_id string, store_id string, created_at_ms long")
    more = users.add_favorites(rows, rows.unionByName(spark.createDataFrame([("u2", "s1", 2), ("u1", "s9", 3)], rows.schema)), public, people)
    assert more.count() == 1 and users.favorites(more, public, "u1").count() == 1
    assert users.withdraw({"f": rows}, people.where("user_id = 'u1'"))["f"].count() == 0
    assert users.coarse_filters("마포구", 260) == {"area": "마포구", "distance_m": 500}
    with pytest.raises(ValueError):
        users.coarse_filters("양화로 1", None)


def test_first_sightings_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-02 00:00:00"), ("b", "2026-01-03 00:00:00")], "k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = first_sightings(stream, ["k"]).writeStream.format("memory").queryName("sightings").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.k for r in spark.table("sightings").collect()) == ["a", "b"]
