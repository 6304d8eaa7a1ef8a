"""Brand eligibility: one decision per brand with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_id

MOST_STORES = 5
# Reason codes by registry and review status.
FTC = {"confirmed_franchise": "FTC_FRANCHISE_CONFIRMED", "not_found": "FTC_NO_MATCH", "unavailable": "FTC_UNAVAILABLE", "stale": "FTC_STALE"}
ADMIN = {"approved": "ADMIN_APPROVED", "pending": "ADMIN_PENDING", "rejected": "ADMIN_REJECTED"}


def assign(stores: DataFrame, evidence: DataFrame) -> DataFrame:
    """Stores with a ``bakery_id``: by a listed management number, then by the brand name of such a store, else each name on its own."""
    listed = evidence.select(F.col("brand_key"), F.explode("management_numbers").alias("m"))
    direct = stores.select("store_id", "normalized_brand_name", F.explode("management_numbers").alias("m")).join(listed, "m")
    names = direct.select("normalized_brand_name", "brand_key").groupBy("normalized_brand_name").agg(F.min("brand_key").alias("brand_key"))
    out = stores.join(names, "normalized_brand_name", "left")
    return out.withColumn("brand_key", F.coalesce("brand_key", F.concat(F.lit("name:"), "normalized_brand_name"))).withColumn("bakery_id", stable_id("bakery", F.col("brand_key")))


def assignment_errors(stores: DataFrame, evidence: DataFrame) -> DataFrame:
    """``error``, ``key``: numbers that several brands list or no store has, and names that reach several brands.

    ``stores``: ``management_number`` and ``normalized_brand_name``.
    """
    listed = evidence.select("brand_key", F.explode("management_numbers").alias("m")).distinct()
    there = stores.select(F.col("management_number").alias("m"), "normalized_brand_name")
    missing = listed.join(there, "m", "left_anti").select(F.lit("TARGET_MISSING").alias("error"), F.col("m").alias("key")).distinct()
    several = there.join(listed, "m").groupBy("normalized_brand_name").agg(F.count_distinct("brand_key").alias("n")).where("n > 1")
    return overlaps(evidence).select(F.lit("OVERLAP").alias("error"), F.col("m").alias("key")).unionByName(missing).unionByName(several.select(F.lit("MULTIPLE_BRANDS").alias("error"), F.col("normalized_brand_name").alias("key")))


def overlaps(evidence: DataFrame) -> DataFrame:
    """Management numbers that several brands list."""
    return evidence.select("brand_key", F.explode("management_numbers").alias("m")).groupBy("m").agg(F.count_distinct("brand_key").alias("n")).where("n > 1")


def coded(x: Column, codes: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(y) for kv in codes.items() for y in kv)), x)


def classify(stores: DataFrame, evidence: DataFrame, version: str = "v1") -> DataFrame:
    """``bakery_id``, ``decision_id``, ``classification``, ``status``, ``reasons`` (sorted codes), ``n_stores``.

    ``stores``: store_id, bakery_id, brand_key, business_status, latitude_e7,
    merge_status, management_numbers.  Brands without evidence count as
    unavailable and pending.
    """
    brand = stores.groupBy("bakery_id", "brand_key").agg(
        F.count(F.lit(1)).alias("n_stores"),
        F.array_sort(F.collect_list("store_id")).alias("store_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("management_numbers")))).alias("numbers"),
        F.count_if(F.col("business_status") == "inactive").alias("inactive"),
        F.count_if(F.col("business_status") == "unknown").alias("unknown"),
        F.count_if(F.col("latitude_e7").isNull()).alias("unplaced"),
        F.count_if(F.col("merge_status") == "admin_review").alias("unresolved"),
    )
    e = evidence.select("brand_key", F.col("management_numbers").alias("listed"), "ftc_status", "admin_status", "n_operator_refs", "n_independence_refs")
    x = brand.join(e, "brand_key", "left").fillna({"ftc_status": "unavailable", "admin_status": "pending", "n_operator_refs": 0, "n_independence_refs": 0})
    complete = F.array_sort(F.array_distinct(F.coalesce("listed", F.array().cast("array<string>")))) == F.col("numbers")
    single = F.col("n_stores") == 1
    refs = F.when(single, F.col("n_independence_refs")).otherwise(F.col("n_operator_refs")) > 0
    evidence_code = F.concat(F.when(single, "INDEPENDENCE_EVIDENCE_").otherwise("OPERATOR_EVIDENCE_"), F.when(refs, "PRESENT").otherwise("MISSING"))
    blocked = (F.col("unknown") > 0) | (F.col("unplaced") > 0) | (F.col("unresolved") > 0) | ~complete | F.col("ftc_status").isin("unavailable", "stale") | (F.col("admin_status") != "approved") | ~refs
    outcome = (
        F.when(F.col("inactive") > 0, F.lit("UNCERTAIN_REVIEW_REQUIRED/excluded"))
        .when(F.col("admin_status") == "rejected", "UNCERTAIN_REVIEW_REQUIRED/excluded")
        .when(F.col("ftc_status") == "confirmed_franchise", "FRANCHISE/excluded")
        .when(F.col("n_stores") > MOST_STORES, "CHAIN_TOO_LARGE/excluded")
        .when(blocked, "UNCERTAIN_REVIEW_REQUIRED/admin_review")
        .when(single, "INDEPENDENT_SINGLE/eligible")
        .otherwise("DIRECT_ONLY_SMALL_CHAIN/eligible")
    )
    x = x.withColumn("outcome", outcome)
    open_case = ~((F.col("inactive") > 0) | (F.col("admin_status") == "rejected") | (F.col("ftc_status") == "confirmed_franchise") | (F.col("n_stores") > MOST_STORES))
    large = (F.col("outcome") == "CHAIN_TOO_LARGE/excluded")
    code = lambda c, name: F.when(c, F.lit(name))
    reasons = F.array(
        F.lit("SEOUL_STORE_COUNT"),
        coded(F.col("ftc_status"), FTC),
        coded(F.col("admin_status"), ADMIN),
        evidence_code,
        code(F.col("inactive") > 0, "STORE_NOT_OPERATING"),
        code(large, "CHAIN_LIMIT_EXCEEDED"),
        code(open_case & (F.col("unknown") > 0), "STORE_STATUS_UNRESOLVED"),
        code(open_case & (F.col("unplaced") > 0), "STORE_COORDINATE_UNRESOLVED"),
        code(open_case & (F.col("unresolved") > 0), "DUPLICATE_MATCH_UNRESOLVED"),
        code(open_case & ~complete, "BRAND_MEMBERSHIP_EVIDENCE_INCOMPLETE"),
    )
    return x.select(
        "bakery_id",
        stable_id("eligibility", F.concat_ws(":", F.lit(version), "bakery_id", F.concat_ws(":", "store_ids"))).alias("decision_id"),
        F.substring_index("outcome", "/", 1).alias("classification"),
        F.substring_index("outcome", "/", -1).alias("status"),
        F.array_sort(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull()))).alias("reasons"),
        "n_stores",
    )


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Stores by their brand's status."""
    return decisions.groupBy("status").agg(F.sum("n_stores").alias("n_stores"))
