"""Rows from HTML pages: attribute blocks by pattern, with order and cutoff checks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import dotted_date


# Keys of a selector contract, and what no selector may hold.
CONTRACT_KEYS = ("version", "paginationMode", "reviewItem", "body", "rating", "publishedDate", "nickname", "nextButton", "loginWall", "captcha", "accessDenial")
CONTRACT_VERSION, PAGINATION_MODES = "kakao-review-dom-v2", ("append", "replace")
UNSAFE = re.compile(r"script|iframe|https?://|data:|javascript:", re.IGNORECASE)


class ContractInvalid(ValueError):
    """The selector contract breaks its rules."""


def selector_contract(source: str) -> dict[str, str]:
    """A contract from its JSON text: exactly the known keys, selectors of 1 to 256 characters that load nothing."""
    try:
        found = json.loads(source)
    except ValueError:
        raise ContractInvalid("no JSON") from None
    if not isinstance(found, dict) or sorted(found) != sorted(CONTRACT_KEYS) or not all(isinstance(v, str) for v in found.values()):
        raise ContractInvalid("keys")
    out = {k: v.strip() if k not in ("version", "paginationMode") else v for k, v in found.items()}
    if out["version"] != CONTRACT_VERSION or out["paginationMode"] not in PAGINATION_MODES:
        raise ContractInvalid("version or mode")
    for key in CONTRACT_KEYS[2:]:
        if not 1 <= len(out[key]) <= 256 or UNSAFE.search(out[key]):
            raise ContractInvalid(key)
    return out


def attribute(block: Column, name: str) -> Column:
    """A quoted attribute's value, null if absent."""
    found = F.regexp_extract(block, rf'{name}="([^"]*)"', 1)
    return F.when(F.contains(block, F.lit(f'{name}="')), found)


def tags(pages: DataFrame, html_col: str = "html", tag: str = "a") -> DataFrame:
    """One row per element of this name in page order: ``position``, ``block`` (opening tag and content), and all other columns."""
    blocks = F.regexp_extract_all(F.col(html_col), F.lit(rf"(?s)(<{tag}\b[^>]*>.*?</{tag}>)"), 1)
    return pages.withColumn("__b", blocks).select(*[c for c in pages.columns if c != html_col], F.posexplode("__b").alias("position", "block"))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))


def reviews(pages: DataFrame, page_cols: list[str], html_col: str = "html") -> DataFrame:
    """Review rows of ``<article data-...>`` blocks: date, nickname, rating in basis points, body."""
    x = tags(pages, html_col, "article")
    rating = attribute(F.col("block"), "data-rating")
    return x.select(
        *page_cols,
        "position",
        dotted_date(attribute(F.col("block"), "data-date")).alias("published_date"),
        attribute(F.col("block"), "data-nickname").alias("nickname"),
        F.when(rating.rlike(r"^[0-5](\.\d{1,3})?$"), F.floor(rating.try_cast("double") * 1000 + 0.5).cast("int")).alias("rating_bp"),
        visible_text(F.regexp_replace("block", r"^<[^>]*>", "")).alias("body"),
    )


def boundary(rows: DataFrame, key: str, order: list[str], cutoff: str) -> DataFrame:
    """``key``, ``state``: STOP if a date is missing or dates rise, CUTOFF if one is before ``cutoff``, else MORE."""
    w = Window.partitionBy(key).orderBy(*order)
    x = rows.withColumn("before", F.lag("published_date").over(w))
    x = x.groupBy(key).agg(F.bool_or(F.col("published_date").isNull() | F.coalesce(F.col("published_date") > F.col("before"), F.lit(False))).alias("bad"), F.bool_or(F.col("published_date") < cutoff).alias("old"))
    return x.select(key, F.when(F.col("bad"), "STOP").when(F.coalesce("old", F.lit(False)), "CUTOFF").otherwise("MORE").alias("state"))


def repeated_pages(pages: DataFrame, key: str, order: str, html_col: str = "html") -> DataFrame:
    """Pages whose signature an earlier page of the same key has."""
    x = pages.withColumn("signature", F.sha2(html_col, 256))
    return x.withColumn("r", F.row_number().over(Window.partitionBy(key, "signature").orderBy(order))).where("r > 1").drop("r", html_col)
