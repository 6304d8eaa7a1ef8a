"""Review intake: fingerprints, anchor sync, publishing with a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from .tables import upsert


def nickname(x: Column) -> Column:
    """NFKC, collapsed, lower case."""
    return F.lower(text.collapse(text.nfkc(x)))


def fingerprint(provider: Column, store_id: Column, name: Column, date: Column, body: Column, key: bytes) -> Column:
    """Keyed digest (hex) of a review's identity, null if a part is missing, blank or not an ISO date.

    ``name`` and ``body`` are normalised already (``nickname``, ``text.review_text``); the key has 32 bytes.
    """
    if len(key) != 32:
        raise ValueError("key")
    good = date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    for p in (provider, store_id, name, body):
        good = good & (F.coalesce(F.trim(p), F.lit("")) != "")
    return F.when(good, ids.hmac_sha256(F.to_json(F.array(provider, store_id, name, date, body)), key))


def review_id(store_id: Column, print_hex: Column) -> Column:
    return F.concat(F.lit("review_"), F.substring(F.sha2(F.concat(store_id.cast("binary"), F.unhex(print_hex)), 256), 1, 24))


def incremental_sync(pages: DataFrame, seen: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per store: how a newest-first listing relates to what is known.

    ``pages``: store_id, position, fingerprint; ``seen``: store_id, fingerprint;
    ``anchors``: store_id, anchor (the newest fingerprint of the last run).
    Without an anchor the mode is INITIAL_BACKFILL.  INCREMENTAL stops at the
    anchor.  If the anchor never comes, or an unseen review stands behind it,
    the whole listing is read: BACKFILL_FALLBACK.
    """
    known = seen.select("store_id", "fingerprint").distinct().withColumn("known", F.lit(True))
    rows = pages.join(known, ["store_id", "fingerprint"], "left").join(anchors, "store_id", "left")
    at = F.min(F.when(F.col("fingerprint") == F.col("anchor"), F.col("position"))).over(Window.partitionBy("store_id"))
    rows = rows.withColumns({"at": at, "unseen": F.col("known").isNull()})
    before = F.col("at").isNotNull() & (F.col("position") < F.col("at"))
    x = rows.groupBy("store_id").agg(
        F.first("anchor").alias("known_anchor"),
        F.first("at").alias("at"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("unseen").alias("n_unseen"),
        F.count_if(before).alias("n_before"),
        F.count_if(before & F.col("unseen")).alias("unseen_before"),
        F.min_by("fingerprint", "position").alias("anchor"),
    )
    stops = F.col("at").isNotNull() & (F.col("n_unseen") == F.col("unseen_before"))
    mode = F.when(F.col("known_anchor").isNull(), "INITIAL_BACKFILL").when(stops, "INCREMENTAL").otherwise("BACKFILL_FALLBACK")
    stopped, new = F.when(stops, F.col("n_before")).otherwise(F.col("n")), F.when(stops, F.col("unseen_before")).otherwise(F.col("n_unseen"))
    return x.select("store_id", mode.alias("mode"), (stopped - new).alias("n_seen"), new.alias("n_new"), stopped.alias("stopped_at"), "anchor")


def publish(old: DataFrame, new: DataFrame, public: DataFrame, cutoff: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(documents of the new version, refused rows with ``reason_code``).

    New rows must belong to a public store and have a body; ids replace, rows
    before the cutoff go, all rows get the version.
    """
    known = public.select("store_id").withColumn("public", F.lit(True))
    x = new.join(known, "store_id", "left")
    reason = F.when(F.col("published_date").isNull(), "DATE_INVALID").when(F.col("public").isNull(), "STORE_NOT_PUBLIC").when(F.coalesce(F.trim("body"), F.lit("")) == "", "BODY_EMPTY")
    x = x.withColumn("reason_code", reason).drop("public")
    good = x.where(F.col("reason_code").isNull()).drop("reason_code")
    out = upsert(old, good, ["review_id"]).where(F.col("published_date") >= cutoff).withColumn("version", F.lit(version))
    return out.join(public.select("store_id"), "store_id", "left_semi"), x.where(F.col("reason_code").isNotNull())
