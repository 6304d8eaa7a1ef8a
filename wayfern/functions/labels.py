"""What a page shows of a result, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts shown for states.
WEEKDAYS = ("일요일", "월요일", "화요일", "수요일", "목요일", "금요일", "토요일")
OPENING = {"OPEN": "영업 중", "CLOSED": "영업 종료", "UNKNOWN": "영업시간 확인 필요"}


def _decimals(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", x), r"0+$", ""), r"\.$", "")


def distance_label(metres: Column) -> Column:
    """Metres below a kilometre, else kilometres with up to two decimals."""
    return F.when(metres.isNull(), "거리 정보 없음").when(metres < 1000, F.concat(metres.cast("string"), F.lit("m 이내"))).otherwise(F.concat(_decimals(metres / 1000), F.lit("km 이내")))


def opening_label(state: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in OPENING.items() for x in kv)), state)


def minute_label(minute: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def interval_label(weekday: Column, opens: Column, closes: Column, next_day: Column) -> Column:
    """``weekday`` counts from Sunday, 0."""
    return F.concat(F.element_at(F.array(*map(F.lit, WEEKDAYS)), (weekday + 1).cast("int")), F.lit(" "), minute_label(opens), F.lit("–"), F.when(next_day, "다음 날 ").otherwise(""), minute_label(closes))


def date_label(iso: Column) -> Column:
    """The basis date ``2026-07-04`` in words; null if it is no date."""
    d = F.try_to_date(iso, "yyyy-MM-dd")
    return F.when(d.isNotNull(), F.concat(F.year(d), F.lit("년 "), F.month(d), F.lit("월 "), F.day(d), F.lit("일 기준")))


def rating_label(basis_points: Column, n_rated: Column) -> Column:
    """Points with up to two decimals; null without a rated review."""
    return F.when(basis_points.isNotNull() & (n_rated > 0), _decimals(F.floor(basis_points / 10 + 0.5) / 100))
