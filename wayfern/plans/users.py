"""Favourites and histories of users, as table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.tables import insert_absent


def favorites(rows: DataFrame, public: DataFrame, user_id: str) -> DataFrame:
    """A user's favourites of public stores, newest first."""
    return rows.where(F.col("user_id") == user_id).join(public.select("store_id", "display_name"), "store_id").orderBy(F.desc("created_at_ms"), "store_id")


def add_favorites(rows: DataFrame, new: DataFrame, public: DataFrame, users: DataFrame) -> DataFrame:
    """New favourites of active users and public stores; those that exist stay as they are."""
    good = new.join(public.select("store_id"), "store_id", "left_semi").join(users.where(F.col("status") == "active").select("user_id"), "user_id", "left_semi")
    return rows.unionByName(insert_absent(rows, good.select(*rows.columns), ["user_id", "store_id"])[0])


def remove_favorites(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Favourites without these (user_id, store_id)."""
    return rows.join(gone.select("user_id", "store_id"), ["user_id", "store_id"], "left_anti").select(*rows.columns)


def add_history(rows: DataFrame, new: DataFrame, users: DataFrame) -> DataFrame:
    """Histories of active users with filters made coarse: areas that name a district, quarter or station, distances in 250 m steps; other areas are left out."""
    area = F.when(F.col("area").rlike("(구|동|역)$"), F.col("area"))
    distance = F.when(F.col("distance_m").isNotNull(), geo.distance_bucket(F.col("distance_m")))
    good = new.withColumn("filters", F.to_json(F.struct(area.alias("area"), distance.alias("distance_m")))).join(users.where(F.col("status") == "active").select("user_id"), "user_id", "left_semi")
    return rows.unionByName(insert_absent(rows, good.select(*rows.columns), ["history_id"])[0])


def delete_history(rows: DataFrame, user_id: str, history_ids: list[str] | None = None) -> DataFrame:
    """Without some of a user's entries, or all of them."""
    mine = F.col("user_id") == user_id
    return rows.where(~(mine if history_ids is None else mine & F.col("history_id").isin(*history_ids)))


def token_hash(token: Column) -> Column:
    """What is kept of a session's token."""
    return F.sha2(token, 256)


def revoke(sessions: DataFrame, now_ms: int, user_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """Sessions with those of a user, or one of them, revoked; earlier revocations stay."""
    hit = F.lit(True)
    if user_id is not None:
        hit = hit & (F.col("user_id") == user_id)
    if session_id is not None:
        hit = hit & (F.col("session_id") == session_id)
    return sessions.withColumn("revoked_at_ms", F.when(hit, F.coalesce("revoked_at_ms", F.lit(now_ms))).otherwise(F.col("revoked_at_ms")))


def history(rows: DataFrame, user_id: str, limit: int = 20) -> DataFrame:
    """Newest entries with their filters as text."""
    if not 1 <= limit <= 100:
        raise ValueError("limit")
    return rows.where(F.col("user_id") == user_id).orderBy(F.desc("created_at_ms"), "history_id").limit(limit)


def coarse_filters(area: str | None, distance_m: int | None) -> dict:
    """What a search history may hold: an area by name, distances in 250 m steps."""
    if area is not None and not area.endswith(("구", "동", "역")):
        raise ValueError("area")
    return {"area": area, "distance_m": None if distance_m is None else max(250, -(-distance_m // 250) * 250)}


def withdraw(tables: dict[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of these users."""
    return {name: df.join(user_ids.select("user_id"), "user_id", "left_anti") for name, df in tables.items()}


def live_sessions(sessions: DataFrame, users: DataFrame, now_ms: int) -> DataFrame:
    """Sessions that are neither expired nor revoked, of active users."""
    good = (F.col("expires_at_ms") > now_ms) & F.col("revoked_at_ms").isNull()
    return sessions.where(good).join(users.where(F.col("status") == "active").select("user_id"), "user_id", "left_semi")
