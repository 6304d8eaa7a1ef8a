"""The spatial keyword source: landed result pages of a rectangle, checked before their rows are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The provider's page size and last page.
SIZE, LAST_PAGE = 15, 45
DOCUMENT = "struct<id:string,place_name:string,category_name:string,phone:string,address_name:string,road_address_name:string,x:string,y:string>"
PAGE = f"struct<meta:struct<total_count:bigint,pageable_count:bigint,is_end:boolean>,documents:array<{DOCUMENT}>>"


def valid_rect(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (west < east) & (south < north) & (west >= -180) & (east <= 180) & (south >= -90) & (north <= 90)


def checked(pages: DataFrame, json_col: str = "json", size: int = SIZE, last_page: int = LAST_PAGE) -> DataFrame:
    """Pages (``tile``, ``page``, ``status``, the rectangle and the text) with ``body`` and ``error``: the first rule that they break."""
    x = pages.withColumn("body", F.from_json(json_col, PAGE))
    total, pageable, end, n = F.col("body.meta.total_count"), F.col("body.meta.pageable_count"), F.col("body.meta.is_end"), F.size("body.documents")
    expected = F.least(F.lit(size), F.greatest(F.lit(0), pageable - (F.col("page") - 1) * size))
    error = (
        F.when(~(F.col("page").between(1, last_page) & valid_rect(*map(F.col, ("west", "south", "east", "north")))), "REQUEST_INVALID")
        .when(F.col("status").isNull(), "NETWORK_ERROR")
        .when(F.col("status").isin(401, 403, 429), "ACCESS_DENIED")
        .when(~F.col("status").between(200, 299), "HTTP_ERROR")
        .when(total.isNull() | pageable.isNull() | end.isNull() | F.col("body.documents").isNull(), "RESPONSE_INVALID")
        .when((pageable > total) | (n > size), "PAGINATION_INVALID")
        .when((n != expected) | (end != (F.col("page") * size >= pageable)), "PAGE_MISMATCH")
    )
    return x.withColumn("error", error)


def places(pages: DataFrame) -> DataFrame:
    """One row per place of the pages that are right, the first sighting by tile and page."""
    rows = pages.where(F.col("error").isNull()).select("tile", "page", F.posexplode("body.documents").alias("position", "d")).select("tile", "page", "position", "d.*")
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct("tile", "page", "position")).alias("r"))
    return first.select("r.*")
