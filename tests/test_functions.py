"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from wayfern.functions import geo, ids, text, timeutil


def one(spark, schema, values, column):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("02-1234-5678", "0212345678"), ("+82 2 1234 5678", "0212345678"), ("010.1234.5678", "01012345678"), ("010-0000-0000", None), ("02-123", None), (None, None)])
def test_phone(spark, raw, want):
    assert one(spark, "x string", (raw,), text.phone_digits(F.col("x"))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("(주) 소금빵 연구소 강남점", ("소금빵 연구소 강남점", "소금빵연구소강남점", "소금빵연구소", "강남점")),
        (" 북촌   제과점 ", ("북촌 제과점", "북촌제과점", "북촌제과점", None)),
        ("한강 빵집", ("한강 빵집", "한강빵집", "한강빵집", None)),
    ],
)
def test_store_name(spark, raw, want):
    assert tuple(one(spark, "x string", (raw,), text.store_name(F.col("x")))) == want


@pytest.mark.parametrize("x, y, want", [("191234.125", "451234.5", (375634614, 1269014494)), ("198765.25", "452345.75", (375735170, 1269866872)), (None, None, None), ("191234.125", None, None), ("not-a-number", "451234.5", None)])
def test_coordinates(spark, x, y, want):
    got = one(spark, "x string, y string", (x, y), geo.coordinates(F.col("x"), F.col("y")))
    assert (None if got is None else (got.latitude_e7, got.longitude_e7)) == want


def test_address(spark):
    got = one(spark, "x string", ("서울시  마포구 양화로 1, 2층",), text.address(F.col("x")))
    assert (got.normalized_address, got.district) == ("서울특별시 마포구 양화로 1 2층", "마포구")
    assert one(spark, "x string", ("부산광역시 해운대구 1",), text.address(F.col("x"))) is None


@pytest.mark.parametrize("raw, want", [("20260724", "2026-07-24"), ("20260230", None), ("", None), (None, None), ("2026-07-24", None)])
def test_compact_date(spark, raw, want):
    assert one(spark, "x string", (raw,), timeutil.compact_date(F.col("x"))) == want


@pytest.mark.parametrize("raw, want", [("2026. 7. 4.", "2026-07-04"), ("2026-07-04", "2026-07-04"), ("2026. 2. 30.", None), ("yesterday", None)])
def test_dotted_date(spark, raw, want):
    assert one(spark, "x string", (raw,), timeutil.dotted_date(F.col("x"))) == want


def test_year_before_clamps(spark):
    assert str(one(spark, "x string", ("2024-02-29",), timeutil.year_before(F.to_date("x")))) == "2023-02-28"


HOURS = "h array<struct<weekday:int,sequence:int,opens_minute:int,closes_minute:int,closes_next_day:boolean>>, t long"


@pytest.mark.parametrize(
    "hours, at, want",
    [
        ([], 1785380400000, "UNKNOWN"),
        ([(4, 0, 600, 720, False)], 1785380400000, "CLOSED"),
        ([(4, 0, 720, 800, False)], 1785380400000, "OPEN"),
        ([(3, 0, 1200, 721, True)], 1785380400000, "OPEN"),
        ([(3, 0, 1200, 720, True)], 1785380400000, "CLOSED"),
    ],
)
def test_opening_state(spark, hours, at, want):
    assert one(spark, HOURS, (hours, at), timeutil.opening_state(F.col("h"), F.col("t"))) == want


@pytest.mark.parametrize("m, want", [(0, 250), (250, 250), (251, 500)])
def test_bucket(spark, m, want):
    assert one(spark, "m int", (m,), geo.distance_bucket(F.col("m"))) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("맛있어요 010-1234-5678", (True, "맛있어요 [redacted]")),
        ("see https://a.example/x and me@b.example now", (True, "see [redacted] and [redacted] now")),
        ("사장 홍길동님 친절", (False, None)),
        ("  ", (False, None)),
        ("me@b.example!", (False, None)),
    ],
)
def test_deidentify(spark, raw, want):
    got = one(spark, "x string", (raw,), text.deidentify(F.col("x")))
    assert (got.accepted, got.text) == want


def test_synonyms_keep_group_order():
    assert text.expand_terms("Sourdough") == ["사워도우", "sourdough", "천연발효빵"]
    assert text.expand_terms("무엇") == ["무엇"]


def test_hmac_and_aes(spark):
    import hashlib
    import hmac

    key = b"s" * 32
    assert one(spark, "x string", ("message",), ids.hmac_sha256(F.col("x"), key)) == hmac.new(key, b"message", hashlib.sha256).hexdigest()
    cell = ids.encrypt(F.col("x"), F.lit(bytearray(key)), F.lit(bytearray(b"n" * 12)), F.lit("a"))
    df = spark.createDataFrame([("뜻",)], "x string").select(cell.alias("e"))
    assert df.select(ids.decrypt(F.col("e"), F.lit(bytearray(key)), F.lit("a")).alias("x")).first().x == "뜻"
    assert df.select(ids.decrypt(F.col("e"), F.lit(bytearray(key)), F.lit("b")).alias("x")).first().x is None
    row = df.first().e
    assert (len(row.ciphertext), len(row.nonce), len(row.auth_tag)) == (3, 12, 16)


def test_table_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert ids.table_digest(a).first() == ids.table_digest(a.orderBy(F.desc("a"))).first()
    assert ids.table_digest(a).first().digest != ids.table_digest(a.fillna("")).first().digest
