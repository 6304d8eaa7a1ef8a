"""Dates, opening hours and freshness as column expressions (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def compact_date(x: Column) -> Column:
    """``YYYYMMDD`` to ``YYYY-MM-DD``; blank, malformed and impossible dates give null."""
    return F.when(F.trim(x).rlike(r"^\d{8}$"), F.date_format(F.try_to_date(F.trim(x), "yyyyMMdd"), "yyyy-MM-dd"))


def local_timestamp_ms(x: Column) -> Column:
    """``YYYYMMDDHHMMSS`` of Seoul as epoch milliseconds."""
    t = F.when(F.trim(x).rlike(r"^\d{14}$"), F.try_to_timestamp(F.trim(x), F.lit("yyyyMMddHHmmss")))
    return F.unix_millis(F.to_utc_timestamp(t, ZONE))


def dotted_date(x: Column) -> Column:
    """``YYYY. M. D.`` or ``YYYY-MM-DD`` to ISO, else null."""
    dotted = r"^\s*(\d{4})\.\s*(\d{1,2})\.\s*(\d{1,2})\.?\s*$"
    part = lambda i: F.lpad(F.regexp_extract(x, dotted, i), 2, "0")
    iso = F.when(x.rlike(dotted), F.concat_ws("-", F.regexp_extract(x, dotted, 1), part(2), part(3))).when(x.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.trim(x))
    return F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd")


def local_weekday_minute(ms: Column) -> tuple[Column, Column]:
    """(weekday with Sunday 0, minute of the day) in Seoul."""
    t = F.from_utc_timestamp(F.timestamp_millis(ms.cast("long")), ZONE)
    return F.dayofweek(t) - 1, F.hour(t) * 60 + F.minute(t)


def local_date(ms: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(ms.cast("long")), ZONE))


def freshness(basis_date: Column, request_ms: Column) -> Column:
    """FRESH up to 7 days, WARNING up to 30, else STALE; dates ahead and what is no date are STALE."""
    age = F.datediff(local_date(request_ms), F.try_to_date(basis_date.cast("string"), "yyyy-MM-dd"))
    return F.when(age.isNull() | (age < 0) | (age > 30), "STALE").when(age > 7, "WARNING").otherwise("FRESH")


def year_before(date: Column) -> Column:
    """The day one calendar year earlier; 29 February gives the 28th."""
    return F.add_months(date, -12)


def opening_state(hours: Column, request_ms: Column) -> Column:
    """OPEN, CLOSED, or UNKNOWN without hours.

    ``hours``: array of struct(weekday, sequence, opens_minute, closes_minute,
    closes_next_day).  Opening is inclusive, closing exclusive; intervals past
    midnight go on into the next weekday.
    """
    day, minute = local_weekday_minute(request_ms)
    today = lambda h: (h["weekday"] == day) & (minute >= h["opens_minute"]) & (h["closes_next_day"] | (minute < h["closes_minute"]))
    from_before = lambda h: (h["weekday"] == (day + 6) % 7) & h["closes_next_day"] & (minute < h["closes_minute"])
    return F.when(F.coalesce(F.size(hours), F.lit(0)) == 0, "UNKNOWN").when(F.exists(hours, lambda h: today(h) | from_before(h)), "OPEN").otherwise("CLOSED")


def hours_violations(hours: DataFrame, key: str = "store_id") -> DataFrame:
    """``key`` and ``violation`` of opening hours that are out of range, repeated or overlap on the circle of a week."""
    ranged = F.col("weekday").between(0, 6) & F.col("opens_minute").between(0, 1439) & F.col("closes_minute").between(0, 1440)
    directed = F.when(F.col("closes_next_day"), F.col("closes_minute") <= F.col("opens_minute")).otherwise(F.col("closes_minute") > F.col("opens_minute"))
    bad = hours.where(~(ranged & directed)).select(key, F.lit("RANGE").alias("violation"))
    repeated = hours.groupBy(key, "weekday", "sequence").count().where("count > 1").select(key, F.lit("REPEATED").alias("violation"))
    start = F.col("weekday") * 1440 + F.col("opens_minute")
    end = F.col("weekday") * 1440 + F.col("closes_minute") + F.when(F.col("closes_next_day"), 1440).otherwise(0)
    # one group is one store's few intervals
    spans = hours.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(start.alias("s"), end.alias("e")))).alias("x"))
    week = 7 * 1440
    meets = lambda a, b: F.exists(F.array(*map(F.lit, (-week, 0, week))), lambda d: (a["s"] < b["e"] + d) & (b["s"] + d < a["e"]))
    clash = F.exists(F.transform("x", lambda a, i: F.exists(F.slice("x", i + 2, F.size("x")), lambda b: meets(a, b))), lambda y: y)
    return bad.unionByName(repeated).unionByName(spans.where(clash).select(key, F.lit("OVERLAP").alias("violation"))).distinct()
