"""Publishing end to end, its guards and refusals, and values that must come out exactly."""

import hashlib
import hmac
import json
import unicodedata

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfern.functions import geo, ids, text, timeutil
from wayfern.operators import candidates as C
from wayfern.operators import reviews
from wayfern.plans import publish, runs, users
from wayfern.plans.search import DataUnavailable, Result, Snapshot, assert_result, fresh, load
from wayfern.sources import html
from wayfern.sources.versions import Conflict, StaleSource, Versions

SOURCE = {"basis_date": "2026-07-01", "downloaded_at_ms": 5, "snapshot_id": "snap1"}
CANDIDATE = "candidate_id string, source_record_id string, management_number string, display_name string, normalized_name string, normalized_brand_name string, normalized_address string, district string, normalized_phone string, latitude_e7 int, longitude_e7 int, business_status string, reject_code string"


def candidate(i, name, status="active", reject=None, **more):
    return (f"c{i}", f"r{i}", str(i), name, name, name, more.get("address", f"a{i}"), "d", more.get("phone"), 375_000_000 + 90_000 * i, 1_270_000_000, status, reject)


def inputs(spark, rows):
    brands = [(f"b{n}", [str(n)], "not_found", "approved", 1, 1) for n in (1, 2)]
    evidence = spark.createDataFrame(brands, "brand_key string, management_numbers array<string>, ftc_status string, admin_status string, n_operator_refs int, n_independence_refs int")
    existing = spark.createDataFrame([("1", "old1"), ("9", "old9")], "management_number string, old_store_id string")
    old = spark.createDataFrame([("old1", "x", "published", "active"), ("old9", "y", "published", "active")], "store_id string, bakery_id string, catalog_status string, business_status string")
    queue = spark.createDataFrame([], "manual_review_id string, snapshot_id string, store_id string, status string, decision string, evidence_refs array<string>")
    return spark.createDataFrame(rows, CANDIDATE), evidence, existing, old, queue


def test_catalog_is_published_once_and_never_backwards(spark, tmp_path):
    v = Versions(str(tmp_path / "app"))
    rows = [candidate(1, "alpha"), candidate(2, "beta", "inactive"), candidate(3, "gamma")]
    entry = publish.publish_catalog(v, *inputs(spark, rows), SOURCE)
    stores = {r.store_id: r.catalog_status for r in v.read(spark, "stores").collect()}
    assert stores["old1"] == "published" and stores["old9"] == "excluded"  # kept by its number, and no longer in the snapshot
    assert sorted(stores.values()) == ["admin_review", "excluded", "excluded", "published"]
    assert {r.status: r.n_stores for r in v.read(spark, "counts").collect()} == {"eligible": 1, "excluded": 1, "admin_review": 1}
    assert [r.status for r in v.read(spark, "queue").collect()] == ["open"]
    assert {r.catalog_status for r in v.read(spark, "bakeries").collect()} == {"published", "excluded"}
    assert publish.publish_catalog(v, *inputs(spark, rows), SOURCE) == entry
    with pytest.raises(StaleSource):
        publish.publish_catalog(v, *inputs(spark, rows), SOURCE | {"basis_date": "2026-06-30"})
    with pytest.raises(publish.PublishRefused, match="REJECTED"):
        publish.publish_catalog(v, *inputs(spark, [*rows, candidate(4, "delta", reject="STORE_NAME_INVALID")]), SOURCE | {"basis_date": "2026-07-02"})
    assert v.state()["active"] == entry


def test_source_that_grew_old_meanwhile_is_refused(spark, tmp_path, monkeypatch):
    v = Versions(str(tmp_path / "app"))
    df = spark.range(1)
    guard, other = v.guard, Versions(str(tmp_path / "app"))

    def first(source, state=None):
        guard(source, state)
        if state is None and source["snapshot_id"] == "snap1":  # a newer source comes in while this one is written
            other.publish({"t": df}, SOURCE | {"basis_date": "2026-08-01", "snapshot_id": "snap2"})

    monkeypatch.setattr(v, "guard", first)
    with pytest.raises(StaleSource):
        v.publish({"t": df}, SOURCE)
    assert v.state()["active"]["source"]["snapshot_id"] == "snap2"
    with pytest.raises(Conflict):  # of two that follow the same state one wins
        v._swap(v.state(), 0)


def test_decided_reviews_leave_the_queue(spark, tmp_path):
    rows = [candidate(3, "gamma")]
    c, evidence, existing, old, queue = inputs(spark, rows)
    opened = publish.catalog(c, evidence, existing, old, queue, "snap")["queue"].collect()
    assert [(r.status, r.decision) for r in opened] == [("open", None)] and opened[0].evidence_refs == sorted(opened[0].evidence_refs)
    listed = evidence.unionByName(spark.createDataFrame([("b3", ["3"], "not_found", "approved", 1, 1)], evidence.schema))
    later = publish.catalog(c, listed, existing, old, spark.createDataFrame(opened, queue.schema), "snap")["queue"].collect()
    assert [(r.status, r.decision) for r in later] == [("approved", "eligible")]


def evidence(spark, menus, aliases=(), shops=(), hours=()):
    return publish.evidence(
        spark.createDataFrame(menus, "store_id string, menu_key string, name string, category string"),
        spark.createDataFrame(list(aliases), "menu_key string, alias string"),
        spark.createDataFrame(list(shops), "store_id string, alias_type string, alias string"),
        spark.createDataFrame(list(hours), "store_id string, weekday int, sequence int, opens_minute int, closes_minute int, closes_next_day boolean"),
    )


def test_evidence_is_addressed_by_content(spark, tmp_path):
    v = Versions(str(tmp_path / "evidence"))
    public = spark.createDataFrame([("s1",)], "store_id string")
    one = evidence(spark, [("s1", "m1", " Ｓalt  Bread ", "x")], [("m1", "sea salt")], hours=[("s1", 1, 0, 600, 700, False)])
    first = publish.publish_evidence(v, one, public, SOURCE)
    assert v.read(spark, "menus").first().asDict() == {"store_id": "s1", "menu_key": "m1", "category": "x", "name": "Salt Bread", "normalized_name": "saltbread"}
    assert publish.publish_evidence(v, one, public, SOURCE) == first
    other = evidence(spark, [("s1", "m1", "Rye", "x")])
    assert publish.publish_evidence(v, other, public, SOURCE)["version"] != first["version"]
    assert publish.superseded(one, public, False) and not publish.superseded(one, public, True) and publish.superseded(one, public.limit(0), True)


def test_a_catalog_supersedes_evidence_in_its_own_swap(spark, tmp_path):
    v = Versions(str(tmp_path / "app"))
    slot, rows = publish.evidence_slot(v), [candidate(1, "alpha"), candidate(2, "beta", "inactive")]
    one = evidence(spark, [("old1", "m1", "Rye", "x")])
    with pytest.raises(StaleSource):  # there is no catalog yet
        publish.publish_evidence(slot, one, None, SOURCE)
    catalog = publish.publish_catalog(v, *inputs(spark, rows), SOURCE)
    with pytest.raises(publish.PublishRefused, match="STORE_NOT_ACTIVE"):  # old9 is no longer public
        publish.publish_evidence(slot, evidence(spark, [("old9", "m1", "Rye", "x")]), None, SOURCE)
    made = publish.publish_evidence(slot, one, None, SOURCE)
    assert slot.state()["active"] == made and v.state()["active"] == catalog and slot.read(spark, "menus").count() == 1
    assert publish.publish_catalog(v, *inputs(spark, rows), SOURCE) == catalog and slot.state()["active"] == made  # the same catalog again

    copy = v.backup(spark, str(tmp_path / "copy"))
    assert copy.slot("evidence").read(spark, "menus").count() == 1 and "evidence/menus" in copy.verify(spark)

    before = v.state()["generation"]
    later = publish.publish_catalog(v, *inputs(spark, rows), SOURCE | {"basis_date": "2026-07-02", "snapshot_id": "snap2"})
    assert v.state()["generation"] == before + 1 and v.state()["active"] == later
    assert slot.state()["active"] is None and slot.state()["superseded"] == [{"version": made["version"], "by": later["version"]}]
    assert publish.publish_evidence(slot, one, None, SOURCE)["version"] != made["version"]


def test_of_a_catalog_and_evidence_swapped_at_once_one_is_refused(spark, tmp_path, monkeypatch):
    v = Versions(str(tmp_path / "app"))
    slot, rows = publish.evidence_slot(v), [candidate(1, "alpha"), candidate(2, "beta", "inactive")]
    publish.publish_catalog(v, *inputs(spark, rows), SOURCE)
    one, newer = evidence(spark, [("old1", "m1", "Rye", "x")]), SOURCE | {"basis_date": "2026-07-02", "snapshot_id": "snap2"}
    written = slot._written
    monkeypatch.setattr(slot, "_written", lambda df, version, name: (publish.publish_catalog(v, *inputs(spark, rows), newer) if name == "hours" else None, written(df, version, name))[1])
    with pytest.raises(StaleSource):  # the catalog came while evidence for the earlier one was written
        publish.publish_evidence(slot, one, None, SOURCE)
    assert slot.state()["active"] is None
    monkeypatch.undo()
    state = slot.state()
    publish.publish_evidence(slot, one, None, SOURCE)
    with pytest.raises(Conflict):
        slot._swap(state, state["generation"])


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ({"menus": [("s1", "m1", "a b", "x"), ("s1", "m2", "A-B", "x")]}, "DUPLICATE"),
        ({"menus": [("s1", "m1", "!!", "x")]}, "INPUT_INVALID"),
        ({"menus": [("s1", "m1", "a" * 201, "x")]}, "INPUT_INVALID"),
        ({"menus": [("s1", "m1", "ab", "x")], "aliases": [("m1", "A b")]}, "DUPLICATE"),
        ({"menus": [("s2", "m1", "ab", "x")]}, "STORE_NOT_ACTIVE"),
        ({"menus": [("s1", "m1", "ab", "x")], "hours": [("s1", 1, 0, 600, 700, False), ("s1", 1, 1, 650, 800, False)]}, "HOURS_OVERLAP"),
        ({"menus": [("s1", "m1", "ab", "x")], "shops": [("s1", "REGION", "x"), ("s1", "REGION", " X ")]}, "DUPLICATE"),
    ],
)
def test_evidence_is_refused(spark, tmp_path, more, want):
    with pytest.raises(publish.PublishRefused, match=want):
        publish.publish_evidence(Versions(str(tmp_path)), evidence(spark, **more), spark.createDataFrame([("s1",)], "store_id string"), SOURCE)


def test_reviews_are_published_and_replayed(spark, tmp_path):
    v = Versions(str(tmp_path / "reviews"))
    schema = "review_id string, store_id string, body string, normalized_body string, rating_bp int, published_date string, collected_at_ms long, reason_code string"
    public = spark.createDataFrame([("s1",)], "store_id string")
    rows = spark.createDataFrame([("r1", "s1", "B", "b", 4000, "2026-01-01", 1, None), ("r2", "s1", "C", "c", None, "2024-01-01", 1, None)], schema)
    first = publish.publish_reviews(v, None, rows, public, "2025-07-30", SOURCE)
    assert [r.review_id for r in v.read(spark, "documents").collect()] == ["r1"]
    again = publish.publish_reviews(v, None, rows, public, "2025-07-30", SOURCE)
    assert again["replayed"] and again["version"] == first["version"]
    newer = SOURCE | {"basis_date": "2026-08-01", "snapshot_id": "run2"}
    update = spark.createDataFrame([("r1", "s1", "new", "new", 1000, "2026-01-02", 2, None)], schema)
    publish.publish_reviews(v, v.read(spark, "documents"), update, public, "2025-07-30", newer)
    assert [(r.body, r.source_run_id) for r in v.read(spark, "documents").collect()] == [("new", "run2")]
    with pytest.raises(StaleSource):
        publish.publish_reviews(v, None, rows, public, "2025-07-30", SOURCE)
    for bad, code in ((update.withColumn("reason_code", F.lit("INPUT_EXPIRED")), "INPUT_EXPIRED"), (update.withColumn("store_id", F.lit("s9")), "STORE_NOT_PUBLIC")):
        with pytest.raises(publish.PublishRefused, match=code):
            publish.publish_reviews(v, None, bad, public, "2025-07-30", SOURCE | {"basis_date": "2026-09-01"})


def test_backup_and_restore(spark, tmp_path):
    v = Versions(str(tmp_path / "app"))
    v.publish({"t": spark.range(5)}, SOURCE)
    copy = v.backup(spark, str(tmp_path / "copy"))
    back = copy.restore(spark, str(tmp_path / "back"), {"rows": lambda x: x.read(spark, "t").count() == 5})
    assert back.verify(spark) == {"t": True}
    with pytest.raises(FileExistsError):
        copy.restore(spark, str(tmp_path / "back"))
    with pytest.raises(ValueError, match="rows"):
        copy.restore(spark, str(tmp_path / "other"), {"rows": lambda x: False})
    assert not Versions(str(tmp_path / "other")).state()["active"]


def test_one_run_at_a_time(tmp_path):
    with runs.single_run(str(tmp_path), "a"), pytest.raises(runs.RunActive, match="a"), runs.single_run(str(tmp_path), "b"):
        pass
    with runs.single_run(str(tmp_path), "c"):
        pass
    runs.write_report(str(tmp_path / "x" / "report.json"), {"b": 1, "a": "é"})
    assert json.loads((tmp_path / "x" / "report.json").read_text()) == {"a": "é", "b": 1} and len([*(tmp_path / "x").iterdir()]) == 1


def test_locators_go_after_full_success(spark):
    ends = spark.createDataFrame([("a", "1", "COMPLETE"), ("a", "2", "NO_REVIEWS"), ("b", "1", "COMPLETE"), ("b", "2", "FAILED"), ("c", "1", None)], "run_id string, store_id string, end string")
    locators = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "run_id string, locator int")
    assert [r.locator for r in runs.locators_to_delete(locators, ends).collect()] == [1]
    assert {r.run_id: r.status for r in runs.batch_status(ends).collect()} == {"a": "SUCCEEDED", "b": "PARTIAL", "c": "RUNNING"}


CONTRACT = {k: ".x" for k in html.CONTRACT_KEYS} | {"version": html.CONTRACT_VERSION, "paginationMode": "append"}


def test_selector_contract():
    assert html.selector_contract(json.dumps(CONTRACT | {"body": "  p.a "}))["body"] == "p.a"
    for bad in (CONTRACT | {"more": "x"}, {k: v for k, v in CONTRACT.items() if k != "body"}, CONTRACT | {"body": " "}, CONTRACT | {"body": "JavaScript:x"}, CONTRACT | {"body": "a" * 257}, CONTRACT | {"paginationMode": "x"}, CONTRACT | {"body": 3}):
        with pytest.raises(html.ContractInvalid):
            html.selector_contract(json.dumps(bad))
    with pytest.raises(html.ContractInvalid):
        html.selector_contract("{")


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_fingerprint_of_a_review(spark):
    key, parts = bytes([7] * 32), ["PLACES", "store_one", "baker user", "2026-07-01", "빵이 맛있어요 / \"good\""]
    want = hmac.new(key, json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode(), hashlib.sha256).hexdigest()
    assert value(spark, reviews.nickname(F.lit("  Ｂaker   USER  "))) == "baker user"
    name = reviews.nickname(F.lit("  Ｂaker   USER  "))
    column = lambda p, n=name: reviews.fingerprint(F.lit(p[0]), F.lit(p[1]), n, F.lit(p[3]), F.lit(p[4]), key)
    assert value(spark, column(parts)) == want
    for i, bad in ((0, ""), (1, " "), (3, "2026-7-1"), (4, None)):
        assert value(spark, column([*parts[:i], bad, *parts[i + 1 :]])) is None
    with pytest.raises(ValueError, match="key"):
        reviews.fingerprint(*(F.lit(p) for p in parts), b"short")
    review = value(spark, reviews.review_id(F.lit("store_one"), F.lit(want)))
    assert review == "review_" + hashlib.sha256(b"store_one" + bytes.fromhex(want)).hexdigest()[:24]


def test_texts(spark):
    assert value(spark, text.phone_digits(F.lit("０２－１２３４－５６７８"))) == "0212345678"
    assert value(spark, text.truncate(F.lit("😀" * 200), 200)) == "😀" * 100
    assert value(spark, text.truncate(F.lit("a" + "😀" * 200), 200)) == "a" + "😀" * 99
    assert value(spark, text.truncate(F.lit("가" * 300), 200)) == "가" * 200 and value(spark, text.truncate(F.lit(None).cast("string"), 5)) is None
    odd = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")] + ["ﬁ", "각", "é", "Ｎame", "한글"]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", text.nfkc(F.col("x")).alias("n"), text.fold_diacritics(F.col("x")).alias("f")).collect()
    for r in rows:
        assert r.n == unicodedata.normalize("NFKC", r.x)
        base = unicodedata.normalize("NFD", r.x) if len(r.x) == 1 else r.x
        assert r.f == (base[0] if len(r.x) == 1 and len(base) > 1 and "LATIN" in unicodedata.name(base[0], "") else r.x)


def test_unknown_distance_stays_unknown(spark):
    none = F.lit(None).cast("int")
    assert value(spark, geo.haversine_m(F.lit(1), F.lit(2), none, F.lit(3))) is None
    assert value(spark, geo.distance_bucket(F.lit(None).cast("long"))) is None


def test_ranks_are_the_order_of_all_rows(spark, sf_dir, monkeypatch):
    from wayfern.operators import tables
    from wayfern.plans import queries as Q

    small, written = "spark.sql.adaptive.coalescePartitions.enabled", {}
    monkeypatch.setattr(C, "cut", lambda df, what: written.setdefault(what, []).append(tables.cut(df, what)) or written[what][-1])
    spark.conf.set(small, "false")  # several ranges, though rows are few
    for more in ({}, {"sort_mode": "DISTANCE"}, {"menu_name": "almond"}):
        rows, q = Q._marked(spark, sf_dir, **more)
        kept = rows.where("removal_reason IS NULL")
        want = kept.select("store_id", F.row_number().over(Window.orderBy(*C.ranking(q))).alias("r"))
        assert {r.store_id: r["rank"] for r in C.ranked(rows, q).collect()} == {r.store_id: r.r for r in want.collect()}
    assert written["places"][0].select(F.shiftright("at", 33)).distinct().count() > 1
    spark.conf.set(small, "true")


def test_old_or_broken_data_are_not_searched(spark):
    basis = lambda d: Snapshot(spark.range(1), spark.range(1), (), True, d)
    at = 1785380400000  # 30 July 2026 in Seoul
    assert fresh(basis("2026-07-25"), at) == "FRESH" and fresh(basis("2026-07-05"), at) == "WARNING" and fresh(basis(None), at) is None
    for stale in ("2026-06-29", "2026-07-31", "x"):
        with pytest.raises(DataUnavailable):
            fresh(basis(stale), at)
    assert value(spark, timeutil.freshness(F.lit("2026-06-30"), F.lit(at))) == "WARNING"
    stores = spark.createDataFrame([("s1",)], "store_id string")
    ghost = spark.createDataFrame([("s9",)], "store_id string")
    with pytest.raises(DataUnavailable):
        load(stores, stores, {"menus": stores, "aliases": ghost, "hours": stores}, stores, (), True, "2026-07-01")
    good = Result(stores, dict.fromkeys(C.REASONS, 0) | {"NOT_OPEN": 2}, 1, "COMPLETE", (), (), "v")
    assert_result(good, 3)
    for n, bad in ((4, good), (3, Result(stores, good.reason_counts, 1, "PARTIAL", (), (), "v")), (3, Result(stores, good.reason_counts, 1, "COMPLETE", (), ("EXPAND",), "v"))):
        with pytest.raises(DataUnavailable):
            assert_result(bad, n)


def test_users_and_sessions(spark):
    s = spark.createDataFrame([("x", "u1", 10, None), ("y", "u1", 10, 3), ("z", "u2", 10, None)], "session_id string, user_id string, expires_at_ms long, revoked_at_ms long")
    assert {r.session_id: r.revoked_at_ms for r in users.revoke(s, 7, user_id="u1").collect()} == {"x": 7, "y": 3, "z": None}
    assert {r.session_id: r.revoked_at_ms for r in users.revoke(s, 7, session_id="z").collect()} == {"x": None, "y": 3, "z": 7}
    h = spark.createDataFrame([("1", "u1"), ("2", "u1"), ("3", "u2")], "history_id string, user_id string")
    assert {r.history_id for r in users.delete_history(h, "u1", ["1"]).collect()} == {"2", "3"} and users.delete_history(h, "u1").count() == 1


def test_encrypted_reviews_are_opened(spark):
    key = b"k" * 32
    rows = spark.createDataFrame([("r1", "s1", "PLACES", None), ("r2", "s1", "PLACES", "INPUT_EXPIRED")], "review_id string, store_id string, provider string, reason_code string")
    payload = F.to_json(F.struct("provider", F.lit(" Good\tBread ").alias("body"), F.lit(4500).alias("rating_bp"), F.lit("2026-07-01").alias("published_date")))
    aad = F.to_json(F.struct("review_id", "store_id", "provider", F.lit(1).alias("schema_version")))
    rows = rows.withColumn("encrypted", ids.encrypt(payload, F.lit(bytearray(key)), F.unhex(F.lit("00" * 12)), aad))
    out = {r.review_id: r for r in publish.opened(rows, key, "2026-07-31").collect()}
    assert (out["r1"].reason_code, out["r1"].normalized_body, out["r1"].rating_bp) == (None, "good bread", 4500)
    assert out["r2"].reason_code == "INPUT_EXPIRED" and out["r2"].body is None
    assert {r.reason_code for r in publish.opened(rows, b"x" * 32, "2026-07-31").collect()} == {"DECRYPT_FAILED", "INPUT_EXPIRED"}
