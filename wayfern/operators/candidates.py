"""Structured search over candidate rows: derive, filter, rank, explain.

A candidate is a row with ``store_id``, ``bakery_id``, ``display_name``,
``normalized_name``, ``normalized_address``, ``district``, ``normalized_phone``,
``latitude_e7``, ``longitude_e7``, ``menus`` (array of struct(menu_id, name,
normalized_name, category, evidence_id, aliases)), ``aliases`` (array of
struct(alias_type, normalized_alias)), ``hours`` and the review aggregate
``review_count``, ``rated_count``, ``rating_sum_bp``, ``latest_date``.  All
steps are column expressions on that row; the global mean is the one value
that is joined in.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, timeutil
from ..functions.text import expand_terms, plain_search_text, truncate
from .tables import cut

# Codes in their fixed order.
CATEGORIES = ("FERMENTED_BREAD", "PASTRY", "SALT_BREAD", "BAGUETTE", "LOAF_BREAD", "SWEET_BREAD", "SANDWICH", "DESSERT")
REASONS = ("REGION_MISMATCH", "STORE_NAME_MISMATCH", "EXCLUDED_CATEGORY", "INCLUDED_CATEGORY_MISSING", "NOT_OPEN", "DISTANCE_EXCEEDED", "REVIEW_STATUS_MISMATCH", "MENU_MISMATCH")
PRIOR_WEIGHT, DEFAULT_MEAN, ENOUGH_REVIEWS = 5, 4000, 3


class SearchInputInvalid(ValueError):
    """The query breaks its contract."""


@dataclass(frozen=True)
class Query:
    """A validated query; text is normalised when it is made by ``make``."""

    region: str | None = None
    store_name: str | None = None
    terms: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    open_now: bool = False
    origin: tuple[int, int] | None = None
    max_distance_m: int | None = None
    review_status: str = "ANY"
    sort_mode: str = "RELEVANCE"
    request_ms: int = 0
    categories: tuple[str, ...] = field(default=CATEGORIES, compare=False)

    @staticmethod
    def make(region=None, store_name=None, menu_name=None, categories=(), open_now=False, origin=None, max_distance_m=None, review_status="ANY", sort_mode="RELEVANCE", request_ms=0, known=CATEGORIES) -> Query:
        """``categories``: (category, INCLUDE or EXCLUDE) pairs."""

        def key(x):
            if x is None:
                return None
            if not 1 <= len(x) <= 100 or not plain_search_text(x)[1]:
                raise SearchInputInvalid("text must have 1 to 100 characters and a letter or digit")
            return plain_search_text(x)[1]

        names = [c for c, _ in categories]
        if len(names) > 8 or len(set(names)) != len(names) or any(c not in known or m not in ("INCLUDE", "EXCLUDE") for c, m in categories):
            raise SearchInputInvalid("at most 8 different known categories")
        if (max_distance_m is not None or sort_mode == "DISTANCE") and origin is None:
            raise SearchInputInvalid("distance needs an origin")
        if review_status not in ("ANY", "AVAILABLE", "INSUFFICIENT") or sort_mode not in ("RELEVANCE", "DISTANCE"):
            raise SearchInputInvalid("unknown review status or sort mode")
        if max_distance_m is not None and max_distance_m <= 0:
            raise SearchInputInvalid("distance must be positive")
        key(menu_name)
        chosen = lambda mode: tuple(sorted(c for c, m in categories if m == mode))
        return Query(key(region), key(store_name), tuple(expand_terms(menu_name)) if menu_name is not None else (), chosen("INCLUDE"), chosen("EXCLUDE"), open_now, origin, max_distance_m, review_status, sort_mode, request_ms, tuple(known))


def public_stores(stores: DataFrame, bakeries: DataFrame, links: DataFrame) -> DataFrame:
    """Published active stores of published bakeries with an address and a place, linked to the snapshot.  ``links``: the snapshot's ``store_id``."""
    good = (F.col("catalog_status") == "published") & (F.col("business_status") == "active") & (F.col("normalized_address") != "") & F.col("latitude_e7").isNotNull() & F.col("longitude_e7").isNotNull()
    published = bakeries.where(F.col("catalog_status") == "published").select("bakery_id")
    return stores.where(good).join(published, "bakery_id", "left_semi").join(links.select("store_id").distinct(), "store_id", "left_semi")


def review_aggregates(reviews: DataFrame) -> DataFrame:
    """Per store: reviews, latest date, rated reviews and their sum in basis points."""
    return reviews.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("review_count"), F.max("published_date").alias("latest_date"), F.count("rating_bp").alias("rated_count"), F.coalesce(F.sum("rating_bp"), F.lit(0)).cast("long").alias("rating_sum_bp")
    )


#: What a candidate holds of a menu, but for its aliases.
MENU = ("menu_id", "name", "normalized_name", "category", "evidence_id")


def nest(stores: DataFrame, menus: DataFrame, menu_aliases: DataFrame | None, aliases: DataFrame, hours: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Candidate rows; facts of unknown stores are ignored here and counted by ``orphans``.

    ``menu_aliases``: ``normalized_alias`` by ``menu_id``, or by ``item_id`` where ``menus`` has one too, as menus of one item have the same aliases; None: there are none.
    ``menus`` may lack columns of ``MENU`` that the caller does not ask for, and so do the candidates then; without ids their menus are the different ones.
    """
    none, held = F.array().cast("array<string>"), [c for c in MENU if c in menus.columns]
    if menu_aliases is None:
        m = menus.withColumn("menu_alias_list", none)
    else:
        key = "item_id" if "item_id" in menu_aliases.columns else "menu_id"
        by_menu = menu_aliases.groupBy(key).agg(F.sort_array(F.collect_list("normalized_alias")).alias("menu_alias_list"))
        m = menus.join(by_menu, key, "left").withColumn("menu_alias_list", F.coalesce("menu_alias_list", none))
    collect = F.collect_list if "menu_id" in held else F.collect_set
    m = m.groupBy("store_id").agg(F.sort_array(collect(F.struct(*held, F.col("menu_alias_list").alias("aliases")))).alias("menus"))
    a = aliases.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("alias_type", "normalized_alias"))).alias("aliases"))
    h = hours.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("weekday", "sequence", "opens_minute", "closes_minute", "closes_next_day"))).alias("hours"))
    out = stores.join(m, "store_id", "left").join(a, "store_id", "left").join(h, "store_id", "left").join(aggregates, "store_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("review_count", "rated_count", "rating_sum_bp")}
    return out.withColumns(zero)


def orphans(facts: DataFrame, stores: DataFrame) -> DataFrame:
    """Facts of stores that are not there; any row means the data are unusable."""
    return facts.join(stores.select("store_id"), "store_id", "left_anti")


def global_mean(candidates: DataFrame) -> DataFrame:
    """``mean_bp``: mean rating over all candidates, before any filter."""
    n, total = F.sum("rated_count"), F.sum("rating_sum_bp")
    return candidates.agg(F.when(n > 0, F.floor(total / n + 0.5)).otherwise(DEFAULT_MEAN).cast("long").alias("mean_bp"))


def adjusted_rating(total: Column, count: Column, mean: Column) -> Column:
    return F.floor((total + mean * PRIOR_WEIGHT) / (count + PRIOR_WEIGHT) + 0.5).cast("long")


def review_status(count: Column) -> Column:
    return F.when(count >= ENOUGH_REVIEWS, "AVAILABLE").otherwise("INSUFFICIENT")


def _size(x: str | Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0))


def completeness(menus: Column, state: Column, phone: Column, reviews: Column) -> Column:
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(_size(menus) > 0, 3000) + points(state != "UNKNOWN", 2500) + points(phone.isNotNull(), 1500) + points(reviews > 0, 1500) + points(reviews >= ENOUGH_REVIEWS, 1500)


def derive(candidates: DataFrame, q: Query, mean: DataFrame | None = None) -> DataFrame:
    """Adds distance, opening state, review status, completeness and adjusted rating.

    ``mean``: the global mean, if the caller has it from fewer columns than the candidates'.
    """
    distance = F.lit(None).cast("long") if q.origin is None else geo.rounded_m(geo.haversine_m(F.lit(q.origin[0]), F.lit(q.origin[1]), F.col("latitude_e7"), F.col("longitude_e7")))
    out = candidates.withColumns({"distance_m": distance, "opening_state": timeutil.opening_state(F.col("hours"), F.lit(q.request_ms)), "review_status": review_status(F.col("review_count"))})
    out = out.withColumn("completeness", completeness(F.col("menus"), F.col("opening_state"), F.col("normalized_phone"), F.col("review_count")))
    # one row
    return out.crossJoin(F.broadcast(global_mean(candidates) if mean is None else mean)).withColumn("adjusted_rating", adjusted_rating(F.col("rating_sum_bp"), F.col("rated_count"), F.col("mean_bp")))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def _any_contains(keys: Column, key: Column) -> Column:
    return F.exists(keys, lambda a: either_contains(a, key))


def _menu_match(menu: Column, terms: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for key in map(F.lit, terms):
        out = out | either_contains(menu["normalized_name"], key) | _any_contains(menu["aliases"], key)
    return out


def mark(candidates: DataFrame, q: Query, evidence: DataFrame | None = None, fts_available: bool = True) -> DataFrame:
    """Adds the match flags and ``removal_reason``: the first of the filters that a candidate fails, null if none.

    ``evidence``: best review hit of a store (``store_id`` and the struct
    ``evidence`` of term_priority, rank, published_date, review_id, snippet).
    """
    out = candidates
    if evidence is not None and fts_available and q.terms:
        out = out.join(evidence.select("store_id", "evidence"), "store_id", "left")
    else:
        out = out.withColumn("evidence", F.lit(None).cast("struct<term_priority:int,rank:double,published_date:string,review_id:string,snippet:string>"))
    aliased = lambda kind, key: F.coalesce(F.exists("aliases", lambda a: (a["alias_type"] == kind) & either_contains(a["normalized_alias"], F.lit(key))), F.lit(False))
    region = F.lit(False) if q.region is None else either_contains(F.regexp_replace("district", r"[^\p{L}\p{N}]+", ""), F.lit(q.region)) | aliased("REGION", q.region)
    name = F.lit(False) if q.store_name is None else either_contains(F.col("normalized_name"), F.lit(q.store_name)) | aliased("STORE_NAME", q.store_name)
    menu = F.coalesce(F.exists("menus", lambda m: _menu_match(m, q.terms)), F.lit(False)) if q.terms else F.lit(False)
    out = out.withColumns({"categories": F.coalesce(F.array_distinct(F.transform("menus", lambda m: m["category"])), F.array().cast("array<string>")), "region_match": region, "store_name_match": name, "menu_match": menu})
    listed = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    out = out.withColumn("included_count", F.size(F.array_intersect("categories", listed(q.include))))
    out = out.withColumn("usable_evidence", F.col("evidence").isNotNull() & (F.col("review_status") == "AVAILABLE"))
    fails = (
        (q.region is not None, ~F.col("region_match")),
        (q.store_name is not None, ~F.col("store_name_match")),
        (bool(q.exclude), F.arrays_overlap("categories", listed(q.exclude))),
        (bool(q.include), F.col("included_count") == 0),
        (q.open_now, F.col("opening_state") != "OPEN"),
        (q.max_distance_m is not None, F.coalesce(F.col("distance_m") > F.lit(q.max_distance_m), F.lit(True))),
        (q.review_status != "ANY", F.col("review_status") != q.review_status),
        (bool(q.terms), ~F.col("menu_match") & F.col("evidence").isNull()),
    )
    reason = F.lit(None).cast("string")
    for code, (asked, fails_it) in reversed([*zip(REASONS, fails, strict=True)]):
        if asked:
            reason = F.when(fails_it, F.lit(code)).otherwise(reason)
    return out.withColumn("removal_reason", reason)


def reason_counts(marked: DataFrame) -> DataFrame:
    """``reason``, ``n`` with all eight codes, in one pass."""
    wide = marked.agg(*(F.count_if(F.col("removal_reason") == c).alias(c) for c in REASONS))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("reason"), F.col(c).alias("n")) for c in REASONS))).alias("x")).select("x.reason", "x.n")


def ranking(q: Query) -> list[Column]:
    """The total order of results."""
    available = F.col("review_status") == "AVAILABLE"
    used = lambda f: F.when(F.col("usable_evidence"), F.col(f"evidence.{f}"))
    opening = F.when(F.col("opening_state") == "OPEN", 0).when(F.col("opening_state") == "UNKNOWN", 1).otherwise(2).asc()
    distance = F.col("distance_m").asc_nulls_last()
    return [
        F.col("menu_match").desc(),
        F.col("included_count").desc(),
        F.col("usable_evidence").desc(),
        used("term_priority").asc_nulls_last(),
        used("rank").asc_nulls_last(),
        used("published_date").desc_nulls_last(),
        used("review_id").asc_nulls_last(),
        F.when(available, F.col("review_count")).otherwise(0).desc(),
        F.when(available, F.col("latest_date")).desc_nulls_last(),
        *((distance, opening) if q.sort_mode == "DISTANCE" else (opening, distance)),
        F.col("completeness").desc(),
        F.col("adjusted_rating").desc(),
        F.col("store_id").asc(),
    ]


#: What ``ranking`` orders by.
ORDERED_BY = ("menu_match", "included_count", "usable_evidence", "review_status", "review_count", "latest_date", "opening_state", "distance_m", "completeness", "adjusted_rating", "store_id")


def ranked(marked: DataFrame, q: Query) -> DataFrame:
    """Kept candidates with ``rank`` from 1; ``store_id`` is unique.

    Ids and what orders them are range-partitioned and sorted, and written with
    their place within their partition.  A partition starts behind the rows of
    those before it, so only partitions are put into one sequence, neither rows
    nor groups of them; as no two rows are equal in the order, no range is too
    large for one partition.  Whole rows move for the join with their rank only.
    Callers that need the first rows only use ``orderBy(*ranking(q)).limit(n)``.
    """
    rows = cut(marked.where(F.col("removal_reason").isNull()), "ranked")
    evidence = F.struct(*(F.col(f"evidence.{f}") for f in ("term_priority", "rank", "published_date", "review_id")))
    keys = rows.select(*ORDERED_BY, evidence.alias("evidence"))
    placed = keys.repartitionByRange(*ranking(q)).sortWithinPartitions(*ranking(q))
    placed = cut(placed.select("store_id", F.monotonically_increasing_id().alias("at")), "places")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # how such an id is made up
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("start"))  # a row for each partition of the shuffle
    ranks = placed.withColumn("part", part).join(F.broadcast(starts), "part").select("store_id", (F.col("start") + row + 1).cast("int").alias("rank"))
    return rows.join(ranks, "store_id")


def representative_menus(q: Query, n: int = 3) -> Column:
    """Up to ``n`` menus: explicit matches, then included categories, then by name and id."""
    included = lambda m: m["category"].isin(*q.include) if q.include else F.lit(False)
    keyed = F.transform("menus", lambda m: F.struct((~_menu_match(m, q.terms)).alias("a"), (~included(m)).alias("b"), m["normalized_name"].alias("c"), m["menu_id"].alias("menu_id"), truncate(m["name"], 200).alias("name"), m["category"].alias("category"), m["evidence_id"].alias("evidence_id")))
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda m: F.struct(m["menu_id"], m["name"], m["category"], m["evidence_id"]))


def _codes(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(code)) for c, code in pairs)), lambda x: x.isNotNull())


def reason_codes(q: Query) -> Column:
    return _codes(
        (F.col("menu_match"), "MENU_MATCH"),
        (F.col("included_count") > 0, "CATEGORY_MATCH"),
        (F.col("region_match"), "REGION_MATCH"),
        (F.col("store_name_match"), "STORE_NAME_MATCH"),
        (F.lit(q.open_now) & (F.col("opening_state") == "OPEN"), "OPEN_NOW"),
        (F.col("distance_m").isNotNull(), "NEARBY"),
        (F.col("usable_evidence"), "REVIEW_EVIDENCE"),
        (F.col("latest_date").isNotNull(), "RECENT_REVIEW"),
        (F.lit(True), "VERIFIED_DATA"),
    )


def warning_codes(q: Query, fts_available: bool) -> Column:
    return _codes(
        (F.col("review_status") == "INSUFFICIENT", "INSUFFICIENT_REVIEWS"),
        (F.col("opening_state") == "UNKNOWN", "OPENING_HOURS_UNKNOWN"),
        (F.lit(not fts_available and bool(q.terms)), "FTS_UNAVAILABLE"),
    )


def public_items(rows: DataFrame, q: Query, fts_available: bool = True) -> DataFrame:
    """The public columns of ranked rows."""
    snippet = truncate(F.col("evidence.snippet"), 500) if fts_available else F.lit(None).cast("string")
    return rows.select(
        "rank",
        "store_id",
        "bakery_id",
        truncate(F.col("display_name"), 200).alias("display_name"),
        truncate(F.col("normalized_address"), 500).alias("normalized_address"),
        "district",
        "latitude_e7",
        "longitude_e7",
        geo.distance_bucket(F.col("distance_m")).alias("distance_upper_bound_m"),
        "opening_state",
        representative_menus(q).alias("representative_menus"),
        F.array_intersect(F.array(*map(F.lit, q.categories)), "categories").alias("categories"),
        F.struct(F.col("review_status").alias("status"), F.col("review_count").alias("count"), F.col("latest_date").alias("latest_date"), snippet.alias("snippet")).alias("review"),
        reason_codes(q).alias("reason_codes"),
        warning_codes(q, fts_available).alias("warning_codes"),
    )


def relaxations(q: Query, n_results: int) -> list[str]:
    """What a caller may loosen when nothing is left."""
    if n_results:
        return []
    rules = (
        (q.region is not None or q.max_distance_m is not None, "EXPAND_REGION_OR_DISTANCE"),
        (q.open_now, "DISABLE_OPEN_NOW"),
        (q.review_status == "AVAILABLE", "INCLUDE_INSUFFICIENT_REVIEWS"),
        (bool(q.include), "EXPAND_ADJACENT_CATEGORY"),
    )
    return [code for asked, code in rules if asked]
