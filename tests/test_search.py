"""The evaluation fixture: 30 stores, 20 scenarios; 16 of 18 counted ones hit, and which two miss is known."""

import pytest
from pyspark.sql import functions as F

from wayfern.operators import candidates as C
from wayfern.plans.evaluate import evaluate, p95
from wayfern.plans.search import Snapshot, StoreNotFound, VersionMismatch, detail, marked, search

MAPO, JONGNO, GANGNAM = "마포구", "종로구", "강남구"
NOON, TUESDAY_ONE = 1785380400000, 1785772800000
AT_FIRST = (375634614, 1269014494)


def facts():
    stores, menus, menu_aliases, aliases, hours, reviews = [], [], [], [], [], []
    for i in range(1, 31):
        n, s = f"{i:02d}", f"store_{i:02d}"
        district = JONGNO if i == 3 or 11 <= i <= 20 else MAPO if i <= 10 else GANGNAM
        name = {1: "한강 빵집", 2: "새벽 제과", 3: "북촌 제과", 5: "리뷰 소금 연구소"}.get(i, f"검증 빵집 {n}")
        stores.append((s, f"bakery_{n}", name, name.replace(" ", ""), f"서울특별시 {district} 검증로 {i}", district, None if i % 3 == 0 else f"02{10000000 + i}", AT_FIRST[0] + (i - 1) * 10000, AT_FIRST[1] + (i - 1) * 7000))
        special = {1: [("소금빵", "SALT_BREAD"), ("크루아상", "PASTRY")], 2: [("사워도우", "FERMENTED_BREAD"), ("바게트", "BAGUETTE")]}
        own = special.get(i) or [(f"검증메뉴 {n}_{p}", C.CATEGORIES[(2 * i + p) % 8]) for p in range(2 if i <= 20 else 1)]
        if i == 5:
            own = [(own[0][0], "DESSERT"), (own[1][0], "SWEET_BREAD")]
        menus += [(s, f"menu_{n}_{p}", m, m.replace(" ", "").replace("_", ""), c, f"e{n}{p}") for p, (m, c) in enumerate(own)]
        aliases += [(s, "REGION", f"검증동네{n}")] if i != 1 else [(s, "REGION", "홍대입구"), (s, "REGION", "합정역"), (s, "STORE_NAME", "한강제과")]
        hours.append((s, 1, 0, 1320, 120, True) if i == 2 else (s, 4, 0, 600, 1080, False))
        word, count = {1: ("소금빵", 4), 2: ("사워도우", 2), 5: ("소금빵", 4)}.get(i, (f"검증메뉴{n}", i % 5))
        for r in range(count):
            rating = {5: 5000, 1: 3500}.get(i, 3800 + (i + r) % 10 * 100)
            reviews.append((f"review_{n}_{r + 1}", s, f"{word} 후기 {r + 1}", rating, f"2026-07-{30 - r % 10:02d}"))
    menu_aliases.append(("menu_01_0", "시오빵"))
    return stores, menus, menu_aliases, aliases, hours, reviews


@pytest.fixture(scope="module")
def snapshot(spark):
    schemas = (
        "store_id string, bakery_id string, display_name string, normalized_name string, normalized_address string, district string, normalized_phone string, latitude_e7 int, longitude_e7 int",
        "store_id string, menu_id string, name string, normalized_name string, category string, evidence_id string",
        "menu_id string, normalized_alias string",
        "store_id string, alias_type string, normalized_alias string",
        "store_id string, weekday int, sequence int, opens_minute int, closes_minute int, closes_next_day boolean",
        "review_id string, store_id string, normalized_body string, rating_bp int, published_date string",
    )
    t = [spark.createDataFrame(rows, schema).coalesce(1) for rows, schema in zip(facts(), schemas, strict=True)]
    nested = C.nest(*t[:5], C.review_aggregates(t[5])).coalesce(1).persist()
    return Snapshot(nested, t[5].persist(), ("fixture", "v1"))


def scenario(name, expected, forbidden=(), at=NOON, fts=True, **asked):
    return {"id": name, "expected": [f"store_{expected:02d}"], "forbidden": [f"store_{f:02d}" for f in forbidden], "at": at, "fts": fts, "asked": asked}


SCENARIOS = [
    scenario("region-district", 1, [11], region=MAPO),
    scenario("region-neighborhood-alias", 1, [2], region="홍대 입구"),
    scenario("region-station-alias", 1, [2], region="합정역"),
    scenario("store-exact", 1, [2], store_name="한강 빵집"),
    scenario("store-approved-alias", 1, [2], store_name="한강 제과"),
    scenario("menu-exact", 1, menu_name="소금빵"),
    scenario("menu-synonym", 1, menu_name="시오빵"),
    scenario("menu-review-fallback", 5, [1], store_name="리뷰 소금 연구소", menu_name="소금빵"),
    scenario("category-include", 1, [2], categories=(("PASTRY", "INCLUDE"),)),
    scenario("category-exclude", 2, [1], categories=(("SALT_BREAD", "EXCLUDE"),)),
    scenario("open-now", 1, store_name="한강 빵집", open_now=True),
    scenario("overnight-open", 2, at=TUESDAY_ONE, store_name="새벽 제과", open_now=True),
    scenario("distance-boundary", 1, [2], origin=AT_FIRST, max_distance_m=100),
    scenario("distance-sort", 1, origin=AT_FIRST, sort_mode="DISTANCE"),
    scenario("reviews-available", 1, [2], review_status="AVAILABLE"),
    scenario("reviews-insufficient", 2, [1], store_name="새벽 제과", review_status="INSUFFICIENT"),
    scenario("combined-hard-filters", 1, [5], region="홍대입구", menu_name="소금빵", categories=(("SALT_BREAD", "INCLUDE"),), open_now=True, origin=AT_FIRST, max_distance_m=500),
    scenario("fts-unavailable-fallback", 1, [5], fts=False, menu_name="소금빵"),
]


def test_evaluation_hits_sixteen_of_eighteen(snapshot):
    def run(s):
        q = C.Query.make(request_ms=s["at"], **s["asked"])
        rows = marked(Snapshot(snapshot.candidates, snapshot.documents, snapshot.components, s["fts"]), q)
        return [r.store_id for r in rows.where(F.col("removal_reason").isNull()).orderBy(*C.ranking(q)).select("store_id").collect()]

    got = evaluate(SCENARIOS, run)
    assert (got["hits"], got["counted"], got["hit_bp"]) == (16, 18, 8888)
    assert got["misses"] == ["category-exclude", "reviews-available"]
    assert got["forbidden"] == [] and got["deterministic"]


def test_degraded_result_and_versions(snapshot):
    q = C.Query.make(menu_name="소금빵", request_ms=NOON)
    broken = Snapshot(snapshot.candidates, snapshot.documents, snapshot.components, False)
    got = search(broken, q)
    assert (got.status, got.degraded) == ("PARTIAL", ("FTS_UNAVAILABLE",))
    assert sum(got.reason_counts.values()) + got.n_results == 30 and len(got.reason_counts) == 8
    row = got.items.first()
    assert row.review.snippet is None and "FTS_UNAVAILABLE" in row.warning_codes
    assert broken.version != snapshot.version
    with pytest.raises(VersionMismatch):
        search(snapshot, q, "other")


def test_detail(snapshot):
    got = detail(snapshot, "store_01", snapshot.version, NOON, 1, 3)
    assert got["store"].first().average_rating_bp == 3500 and got["total_pages"] == 2
    assert [r.review_id for r in got["reviews"].collect()] == ["review_01_1", "review_01_2", "review_01_3"]
    assert got["menus"].count() == 2
    with pytest.raises(StoreNotFound):
        detail(snapshot, "store_99", snapshot.version, NOON)


@pytest.mark.parametrize("asked", [{"region": ""}, {"region": "!!"}, {"region": "x" * 101}, {"sort_mode": "DISTANCE"}, {"max_distance_m": 5}, {"categories": (("PASTRY", "INCLUDE"), ("PASTRY", "EXCLUDE"))}, {"review_status": "SOME"}])
def test_invalid_queries(asked):
    with pytest.raises(C.SearchInputInvalid):
        C.Query.make(**asked)


def test_relaxations():
    q = C.Query.make(region="강남", open_now=True, categories=(("PASTRY", "INCLUDE"),))
    assert C.relaxations(q, 0) == ["EXPAND_REGION_OR_DISTANCE", "DISABLE_OPEN_NOW", "EXPAND_ADJACENT_CATEGORY"]
    assert C.relaxations(q, 1) == []


def test_p95_is_nearest_rank():
    assert p95([*range(1, 101)]) == 95 and p95([7]) == 7
