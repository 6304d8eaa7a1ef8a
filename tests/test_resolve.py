"""Blocking against brute force, score boundaries, components, eligibility."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from wayfern.operators import eligibility, resolve

SCHEMA = "candidate_id string, source_record_id string, management_number string, display_name string, normalized_name string, normalized_brand_name string, normalized_address string, district string, normalized_phone string, latitude_e7 int, longitude_e7 int, business_status string"


def candidate(i, name="소금빵연구소강남점", brand=None, address="서울특별시 강남구 1", phone=None, lat=375000000, lon=1270000000):
    return (f"c{i}", f"r{i}", f"m{i}", name, name, brand or name, address, "강남구", phone, lat, lon, "active")


def pairs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.a, r.b): (r.score_bp, r.status) for r in resolve.evaluate_pairs(resolve.candidate_pairs(df), df).collect()}


def test_full_match_merges(spark):
    got = pairs(spark, [candidate(1, phone="0212345678"), candidate(2, phone="0212345678")])
    assert got == {("c1", "c2"): (10000, "auto_merge")}


def test_missing_phone_is_reviewed(spark):
    assert pairs(spark, [candidate(1), candidate(2)]) == {("c1", "c2"): (8000, "admin_review")}


def test_distance_boundaries(spark):
    far = lambda d: pairs(spark, [candidate(1, "가나", address="서울특별시 강남구 1"), candidate(2, "다라", address="서울특별시 강남구 2", lat=375000000 + d)])
    assert far(4496) == {("c1", "c2"): (2500, "admin_review")}
    assert far(8993) == {("c1", "c2"): (0, "separate")}
    assert far(8994) == {}


def test_blocking_loses_no_pair(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        name = "".join(rnd.choices("가나다라마", k=rnd.randint(1, 7)))
        rows.append(candidate(f"{i:03d}", name, address=f"서울특별시 강남구 {rnd.randint(0, 40)}", phone=rnd.choice([None, f"02{rnd.randint(0, 30):08d}"]), lat=375000000 + rnd.randint(0, 60) * 3000, lon=1270000000 + rnd.randint(0, 60) * 4000))
    df = spark.createDataFrame(rows, SCHEMA)
    every = spark.createDataFrame([*itertools.combinations(sorted(r[0] for r in rows), 2)], "a string, b string")
    key = lambda x: sorted((r.a, r.b, r.score_bp, r.status) for r in x.collect())
    assert key(resolve.evaluate_pairs(resolve.candidate_pairs(df), df)) == key(resolve.evaluate_pairs(every, df))


def test_candidates_of_dissimilar_names_are_no_pairs(spark):
    # the names share a bigram of their prefixes, so that each copy of one met each of the other
    rows = [candidate(f"{k}{i}", name, address=f"서울특별시 강남구 {k}{i}", lat=375000000 + (20 * k + i) * 40000) for k, name in enumerate(("가나다라마", "가나바사아", "가나다라마바")) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.a[1], r.b[1]) for r in resolve.candidate_pairs(df).collect()]
    assert got and {tuple(sorted(p)) for p in got} == {("0", "0"), ("1", "1"), ("2", "2"), ("0", "2")} and len(got) == 3 * 190 + 400
    names = spark.createDataFrame([(n,) for n in ("가나다라마", "가나다라마바", "가나바사아", "가")] * 5, "n string")
    assert sorted(tuple(r) for r in resolve.similar_names(names).collect()) == [("가", "가"), ("가나다라마", "가나다라마"), ("가나다라마", "가나다라마바"), ("가나다라마바", "가나다라마"), ("가나다라마바", "가나다라마바"), ("가나바사아", "가나바사아")]


def test_each_pair_comes_once_from_chunks_of_blocks(spark, monkeypatch):
    """Blocks of several chunks and tasks, values that are null or empty, names of one brand: every pair of all, once, with all its evidence."""
    monkeypatch.setattr(resolve, "CHUNK", 5)
    monkeypatch.setattr(resolve, "PAIRS_A_TASK", 200)
    rnd = random.Random(11)
    rows = []
    for i in range(150):
        name, brand = "".join(rnd.choices("가나다라", k=rnd.randint(1, 3))), "".join(rnd.choices("가나다𐍈", k=rnd.randint(1, 6)))
        point = (375000000 + rnd.randint(0, 40) * 2500, 1270000000 + rnd.randint(0, 9) * 3000) if rnd.random() < 0.8 else (None, None)
        r = candidate(f"{i:03d}", rnd.choice([name, None]), brand, rnd.choice(["", None, *(f"서울특별시 강남구 {k}" for k in range(25))]), rnd.choice([None, "", *(f"02{k:08d}" for k in range(25))]), *point)
        rows.append(r)
    df = spark.createDataFrame(rows, SCHEMA)
    every = spark.createDataFrame([*itertools.combinations(sorted(r[0] for r in rows), 2)], "a string, b string")
    got, want = resolve.matched_pairs(df), resolve.evaluate_pairs(every, df)
    assert got.columns == want.columns
    key = lambda x: sorted(x.collect(), key=lambda r: (r.a, r.b))
    assert key(got) == key(want) and {r.status for r in key(got)} >= {"separate", "admin_review"}


def test_pairs_are_not_made_distinct(spark):
    """All of a thousand stores share name, address, phone and place: half a million pairs, none of which is shuffled."""
    base = spark.createDataFrame([candidate(0, phone="0212345678")], SCHEMA).drop("candidate_id")
    df = base.crossJoin(spark.range(1000).select(F.format_string("c%04d", "id").alias("candidate_id")))
    got = resolve.candidate_pairs(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a" not in plan and "Distinct" not in plan
    assert got.count() == 499_500 and resolve.matched_pairs(df).groupBy("status", "score_bp").count().collect() == [("auto_merge", 10000, 499_500)]


def test_decisions_equal_those_of_all_pairs(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(260):
        name = "".join(rnd.choices("가나다라", k=rnd.randint(1, 4)))
        point = (375000000 + rnd.randint(0, 90) * 2500, 1270000000 + rnd.randint(0, 9) * 3000) if rnd.random() < 0.8 else (None, None)
        rows.append(candidate(f"{i:03d}", name, address=rnd.choice(["", None, *(f"서울특별시 강남구 {k}" for k in range(60))]), phone=rnd.choice([None, f"02{rnd.randint(0, 60):08d}"]), lat=point[0], lon=point[1]))
    # copies, with and without a phone, a place or an address
    rows += [(f"d{i:03d}", *r[1:]) for i, r in enumerate(rnd.choices(rows, k=60))]
    rows += [candidate(f"e{i}", phone="0212345678", lat=376000000 + i // 2 * 3000) for i in range(6)]
    rows += [candidate(f"f{i}", "홀로", address="서울특별시 중구 9", phone="0311112222", lat=378000000 + i % 2) for i in range(3)]
    rows += [candidate(f"g{i}", f"이웃{i}", address="", phone=f"033000000{i}", lat=379000000 + i) for i in range(2)]
    df = spark.createDataFrame(rows, SCHEMA)
    every = resolve.evaluate_pairs(spark.createDataFrame([*itertools.combinations(sorted(r[0] for r in rows), 2)], "a string, b string"), df)
    got, want = resolve.decide(df).collect(), every.collect()
    known = {(r.a, r.b): r.status for r in want}
    assert all(r.a < r.b and known[r.a, r.b] == r.status for r in got)  # no pair of its own making
    review = lambda x: {c for r in x if r.status == "admin_review" for c in (r.a, r.b)}
    assert review(got) == review(want) and 0 < len(review(want)) < len(rows)
    stores = lambda m: sorted((tuple(r.source_candidate_ids), r.merge_status) for r in resolve.canonical_stores(df, m).collect())
    found = stores(resolve.decide(df))
    assert found == stores(every) and {s for _, s in found} == {"distinct", "auto_merged", "admin_review"}
    assert {r.rule for r in got} == {"SCORE", "COPY", "PHONE_OF_OTHER_ADDRESS", "ADDRESS_OF_OTHER_PHONE", "NEAR_OTHER_ADDRESS", "NEAR_OTHER_PHONE"}
    assert resolve.decide(df.limit(0)).count() == 0


def test_decisions_of_a_chain_grow_with_its_stores(spark):
    """A name and a phone that all stores share, in places of their own or one: a row or two a store, not a row a pair."""
    n = 50_000
    i = F.col("id").cast("string")
    base = spark.range(n).select(F.format_string("c%06d", "id").alias("candidate_id"), i.alias("source_record_id"), i.alias("management_number"), F.lit("소금빵").alias("display_name"), F.lit("소금빵").alias("normalized_name"), F.lit("소금빵").alias("normalized_brand_name"), F.lit("강남구").alias("district"), F.lit("0212345678").alias("normalized_phone"), F.lit("active").alias("business_status"))
    apart = base.withColumns({"normalized_address": F.concat(F.lit("서울특별시 강남구 "), "source_record_id"), "latitude_e7": (F.lit(370000000) + F.col("candidate_id").substr(2, 6).cast("int") * 1000).cast("int"), "longitude_e7": F.lit(1270000000)})
    found = resolve.decide(apart)
    seen = found.select("status", F.explode(F.array("a", "b")).alias("c")).distinct().groupBy("status").count()
    assert [(r.status, r["count"]) for r in seen.collect()] == [("admin_review", n)] and found.count() <= n
    one = base.withColumns({"normalized_address": F.lit("서울특별시 강남구 1"), "latitude_e7": F.lit(370000000), "longitude_e7": F.lit(1270000000)})
    assert [(r.status, r["count"]) for r in resolve.decide(one).groupBy("status").count().collect()] == [("auto_merge", n - 1)]


def test_canonical_stores(spark):
    rows = [candidate(1, phone="0212345678"), candidate(2, phone="0212345678"), candidate(3, "다른가게", address="서울특별시 중구 9", lat=375500000)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = resolve.evaluate_pairs(resolve.candidate_pairs(df), df)
    got = {tuple(r.source_candidate_ids): r.merge_status for r in resolve.canonical_stores(df, m).collect()}
    assert got == {("c1", "c2"): "auto_merged", ("c3",): "distinct"}


def test_components_of_a_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)], "candidate_id string")
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n - 1)], "a string, b string")
    got = {r.candidate_id: r.root for r in resolve.connected(nodes, edges).collect()}
    assert got == {f"{i:03d}": "000" for i in range(n)} | {f"{n:03d}": f"{n:03d}"}


def test_edges_that_lie_one_behind_the_other_take_two_rounds(spark, monkeypatch):
    """A path of 2,000 ids whose edges come in order, and one whose edges are dealt over partitions: as many rounds as are left after each batch."""
    written, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda df, what: written.append(what) or cut(df, what))
    nodes = spark.range(2001).withColumnRenamed("id", "candidate_id")
    edges = spark.range(0, 2000, 1, 2).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in resolve.connected(nodes, edges).collect()} == {0} and len(written) <= 3
    dealt = edges.union(spark.createDataFrame([(None, 1), (5, 5)], "a long, b long")).repartition(4, "a")
    assert {(r.candidate_id, r.root) for r in resolve.connected(nodes, dealt).collect()} == {(i, 0) for i in range(2001)}


BRAND = "store_id string, bakery_id string, brand_key string, business_status string, latitude_e7 int, merge_status string, management_numbers array<string>"
EVIDENCE = "brand_key string, management_numbers array<string>, ftc_status string, admin_status string, n_operator_refs int, n_independence_refs int"


@pytest.mark.parametrize(
    "n, change, want",
    [
        (1, {}, ("INDEPENDENT_SINGLE", "eligible")),
        (2, {}, ("DIRECT_ONLY_SMALL_CHAIN", "eligible")),
        (5, {}, ("DIRECT_ONLY_SMALL_CHAIN", "eligible")),
        (6, {}, ("CHAIN_TOO_LARGE", "excluded")),
        (1, {"ftc": "confirmed_franchise"}, ("FRANCHISE", "excluded")),
        (1, {"ftc": "stale"}, ("UNCERTAIN_REVIEW_REQUIRED", "admin_review")),
        (1, {"admin": "pending"}, ("UNCERTAIN_REVIEW_REQUIRED", "admin_review")),
        (1, {"admin": "rejected"}, ("UNCERTAIN_REVIEW_REQUIRED", "excluded")),
        (1, {"lat": None}, ("UNCERTAIN_REVIEW_REQUIRED", "admin_review")),
        (1, {"merge": "admin_review"}, ("UNCERTAIN_REVIEW_REQUIRED", "admin_review")),
        (1, {"business": "inactive"}, ("UNCERTAIN_REVIEW_REQUIRED", "excluded")),
    ],
)
def test_eligibility(spark, n, change, want):
    c = {"ftc": "not_found", "admin": "approved", "lat": 1, "merge": "distinct", "business": "active"} | change
    stores = spark.createDataFrame([(f"s{i}", "b", "k", c["business"], c["lat"], c["merge"], [f"m{i}"]) for i in range(n)], BRAND)
    evidence = spark.createDataFrame([("k", [f"m{i}" for i in range(n)], c["ftc"], c["admin"], 1, 1)], EVIDENCE)
    got = eligibility.classify(stores, evidence).first()
    assert (got.classification, got.status) == want
    assert got.reasons == sorted(got.reasons)
