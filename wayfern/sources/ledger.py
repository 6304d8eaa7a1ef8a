"""The paged ledger source: reading, checking and decoding landed JSON pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeutil
from ..functions.ids import stable_id, table_digest

# Provider fields and the engine's columns.
FIELDS = {
    "OPN_ATMY_GRP_CD": "open_authority_group_code", "MNG_NO": "mng_no", "LCPMT_YMD": "permit_raw", "SALS_STTS_CD": "business_status_code", "SALS_STTS_NM": "business_status_name",
    "DTL_SALS_STTS_CD": "detailed_business_status_code", "DTL_SALS_STTS_NM": "detailed_business_status_name", "CLSBIZ_YMD": "closed_raw", "BPLC_NM": "business_name", "ROAD_NM_ADDR": "road_name_address",
    "LOTNO_ADDR": "lot_number_address", "CRD_INFO_X": "source_coordinate_x", "CRD_INFO_Y": "source_coordinate_y", "DAT_UPDT_PNT": "updated_raw", "LAST_MDFCN_PNT": "modified_raw",
}
ITEM = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"
BODY = "struct<pageNo:string,numOfRows:string,totalCount:string,items:{}>"
PAGE = "struct<response:struct<header:struct<resultCode:string,resultMsg:string>,body:{}>>"
#: Items come as an array or within an object.
PLAIN, WRAPPED = PAGE.format(BODY.format(f"array<{ITEM}>")), PAGE.format(BODY.format(f"struct<item:array<{ITEM}>>"))


def decode(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """``page_no``, ``rows_asked``, ``total``, ``result_code``, ``items`` of raw page texts."""
    plain, wrapped = F.from_json(json_col, PLAIN), F.from_json(json_col, WRAPPED)
    body = lambda f: F.coalesce(plain[f"response"]["body"][f], wrapped["response"]["body"][f])  # noqa: E731,F541
    whole = lambda f: body(f).try_cast("long")
    return pages.select(
        whole("pageNo").alias("page_no"),
        whole("numOfRows").alias("rows_asked"),
        whole("totalCount").alias("total"),
        F.coalesce(plain["response"]["header"]["resultCode"], wrapped["response"]["header"]["resultCode"]).alias("result_code"),
        F.coalesce(plain["response"]["body"]["items"], wrapped["response"]["body"]["items"]["item"]).alias("items"),
    )


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Raw page texts of a multi-page JSON file."""
    whole = spark.read.schema("basisDate string, pages array<string>").option("multiLine", True).json(path)
    return whole.select("basisDate", F.explode("pages").alias("json"))


def pages_digest(pages: DataFrame, json_col: str = "json") -> str:
    """A digest of all pages' texts, whatever their order in the table."""
    return table_digest(pages.select(json_col)).first()["digest"]


def page_errors(decoded: DataFrame) -> DataFrame:
    """``error``, ``n``: undecodable, over-full or refused pages, changing totals, and totals that the pages do not reach."""
    bad = decoded.agg(
        F.count_if(F.col("items").isNull() | F.col("total").isNull()).alias("SCHEMA_MISMATCH"),
        F.count_if(F.size("items") > F.col("rows_asked")).alias("OVERFULL_PAGE"),
        # repeated pages, and numbers from 1 to the last that are not there
        (F.count(F.lit(1)) - F.count_distinct("page_no") + F.coalesce(F.max("page_no"), F.lit(0)) - F.count_distinct("page_no")).alias("PAGE_MISMATCH"),
        F.coalesce(F.max("total") - F.min("total"), F.lit(0)).alias("TOTAL_CHANGED"),
        F.coalesce(F.abs(F.max("total") - F.sum(F.size("items"))), F.lit(0)).alias("TOTAL_MISMATCH"),
    )
    kinds = bad.columns
    return bad.select(F.explode(F.array(*(F.struct(F.lit(k).alias("error"), F.col(k).cast("long").alias("n")) for k in kinds))).alias("x")).select("x.*").where("n > 0")


def rows(decoded: DataFrame) -> DataFrame:
    """Ledger rows with the engine's names and the place they came from."""
    out = decoded.select("page_no", F.posexplode("items").alias("position", "item"))
    return out.select("page_no", "position", *(F.col(f"item.{f}").alias(name) for f, name in FIELDS.items()))


def _blank(x: str) -> Column:
    return F.trim(F.coalesce(F.col(x), F.lit(""))) == ""


def check(ledger: DataFrame, snapshot: str) -> DataFrame:
    """Adds parsed dates, ids and ``reason_code``: the first rule that a row breaks, null if accepted."""
    dates = {"permit_date": "permit_raw", "closed_date": "closed_raw"}
    times = {"data_updated_at_ms": "updated_raw", "last_modified_at_ms": "modified_raw"}
    x = ledger.withColumns({k: timeutil.compact_date(F.col(v)) for k, v in dates.items()} | {k: timeutil.local_timestamp_ms(F.col(v)) for k, v in times.items()})
    address = F.when(~_blank("road_name_address"), F.col("road_name_address")).otherwise(F.col("lot_number_address"))
    number = r"^[+-]?\d+(\.\d+)?$"
    no_x, no_y = _blank("source_coordinate_x"), _blank("source_coordinate_y")
    numeric = F.trim("source_coordinate_x").rlike(number) & F.trim("source_coordinate_y").rlike(number)
    unread = lambda raw, parsed: ~_blank(raw) & F.col(parsed).isNull()
    reason = (
        F.when(_blank("open_authority_group_code") | _blank("mng_no") | _blank("business_name") | _blank("business_status_code"), "REQUIRED_FIELD_MISSING")
        .when(_blank("road_name_address") & _blank("lot_number_address"), "ADDRESS_MISSING")
        .when(~F.trim(address).rlike(r"^(서울특별시|서울시|서울)(\s|$)"), "NOT_SEOUL")
        .when(unread("permit_raw", "permit_date") | unread("closed_raw", "closed_date"), "DATE_INVALID")
        .when(unread("updated_raw", "data_updated_at_ms") | unread("modified_raw", "last_modified_at_ms"), "TIMESTAMP_INVALID")
        .when((no_x != no_y) | (~no_x & ~no_y & ~numeric), "COORDINATE_INVALID")
    )
    record = stable_id("record", F.concat_ws(":", "open_authority_group_code", "mng_no"))
    return x.withColumns({"reason_code": reason, "source_record_id": record, "source_row_id": stable_id("row", F.concat_ws(":", F.lit(snapshot), record))})


def summary(checked: DataFrame, *by: str) -> DataFrame:
    """``n_read``, ``n_accepted``, ``n_rejected``, of all rows or of each group."""
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("reason_code").isNull()).alias("n_accepted"), F.count_if(F.col("reason_code").isNotNull()).alias("n_rejected"))


def normalise(accepted: DataFrame, snapshot: str, version: str = "v1") -> DataFrame:
    """Candidate rows for entity resolution; ``reject_code`` for rows without a usable address or name."""
    from ..functions import geo, text

    closed = "폐업|휴업|취소|말소"
    status = F.concat_ws(" ", "business_status_name", F.coalesce("detailed_business_status_name", F.lit("")))
    x = accepted.withColumns({"adr": text.address(F.coalesce("road_name_address", "lot_number_address")), "nam": text.store_name(F.col("business_name")), "xy": geo.coordinates(F.col("source_coordinate_x"), F.col("source_coordinate_y"))})
    business = F.when(F.col("closed_date").isNotNull() | status.rlike(closed), "inactive").when(F.trim("business_status_code") == "01", "active").otherwise("unknown")
    reviews = F.filter(F.array(F.when(F.col("xy").isNull(), "COORDINATE_MISSING_OR_INVALID"), F.when(business == "unknown", "BUSINESS_STATUS_UNKNOWN")), lambda r: r.isNotNull())
    reject = F.when(F.col("adr").isNull(), "ADDRESS_MISSING_OR_OUTSIDE_SEOUL").when((F.col("nam.display_name") == "") | (F.col("nam.normalized_brand_name") == ""), "STORE_NAME_INVALID")
    return x.select(
        stable_id("candidate", F.concat_ws(":", F.lit(version), F.lit(snapshot), "source_record_id")).alias("candidate_id"),
        "source_record_id",
        "source_row_id",
        F.trim("mng_no").alias("management_number"),
        "nam.*",
        F.col("adr.display_address").alias("display_address"),
        F.col("adr.normalized_address").alias("normalized_address"),
        F.col("adr.district").alias("district"),
        F.lit(None).cast("string").alias("normalized_phone"),
        F.col("xy.latitude_e7").alias("latitude_e7"),
        F.col("xy.longitude_e7").alias("longitude_e7"),
        business.alias("business_status"),
        reviews.alias("review_reason_codes"),
        reject.alias("reject_code"),
    )
