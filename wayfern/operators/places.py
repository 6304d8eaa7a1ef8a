"""Matching external place observations to stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

NEAR_M = 75


def match(observations: DataFrame, stores: DataFrame) -> DataFrame:
    """``observation_id``, ``status``, ``reason``, ``store_id``, ``n_weak``.

    Strong: address and name agree, and the phone agrees or the point is within
    75 m, without a phone conflict.  Any conflict makes the match ambiguous,
    then several strong ones do; one gives the store's own status; otherwise
    the number of stores that agree in address or name is reported.  Equi-joins
    on address and name and counts by key stand in for comparing everything.
    """
    o, s = observations.alias("o"), stores.alias("s")
    both = o.join(s, (F.col("o.normalized_address") == F.col("s.normalized_address")) & (F.col("o.normalized_name") == F.col("s.normalized_name")))
    phones = F.col("o.normalized_phone").isNotNull() & F.col("s.normalized_phone").isNotNull()
    conflict = F.coalesce(phones & (F.col("o.normalized_phone") != F.col("s.normalized_phone")), F.lit(False))
    agree = F.coalesce(phones & (F.col("o.normalized_phone") == F.col("s.normalized_phone")), F.lit(False))
    near = F.coalesce(geo.haversine_m(F.col("o.latitude_e7"), F.col("o.longitude_e7"), F.col("s.latitude_e7"), F.col("s.longitude_e7")) <= NEAR_M, F.lit(False))
    strong = ~conflict & (agree | near)
    found = both.groupBy(F.col("o.observation_id").alias("observation_id")).agg(
        F.count_if(conflict).alias("conflicts"), F.count_if(strong).alias("strong"), F.min(F.when(strong, F.col("s.store_id"))).alias("store_id"), F.min(F.when(strong, F.col("s.catalog_status"))).alias("catalog_status"), F.count(F.lit(1)).alias("both")
    )
    by_address = stores.groupBy("normalized_address").agg(F.count(F.lit(1)).alias("same_address"))
    by_name = stores.groupBy("normalized_name").agg(F.count(F.lit(1)).alias("same_name"))
    x = observations.select("observation_id", "normalized_address", "normalized_name").join(found, "observation_id", "left").join(by_address, "normalized_address", "left").join(by_name, "normalized_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = (
        F.when(zero("conflicts") > 0, "AMBIGUOUS").when(zero("strong") > 1, "AMBIGUOUS").when((zero("strong") == 1) & (F.col("catalog_status") == "published"), "ELIGIBLE").when(zero("strong") == 1, "EXCLUDED").otherwise("UNMATCHED")
    )
    reason = F.when(zero("conflicts") > 0, "PHONE_CONFLICT").when(zero("strong") > 1, "MULTIPLE_STRONG")
    return x.select("observation_id", status.alias("status"), reason.alias("reason"), F.when(status.isin("ELIGIBLE", "EXCLUDED"), F.col("store_id")).alias("store_id"), (zero("same_address") + zero("same_name") - zero("both")).cast("long").alias("n_weak"))


def first_seen(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One observation of each content key: the first seen."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return observations.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def saturated_tiles(points: DataFrame, box: tuple[int, int, int, int] | None, most: int, max_depth: int = 8, key: Column | None = None) -> DataFrame:
    """``tile``, ``depth``, ``n``, ``status`` of leaf tiles: a tile with ``most`` points or more is split, down to ``max_depth`` where it stays PARTIAL.

    Points are read once, for the counts of the finest tiles; those are rolled
    up to all depths, and a tile is a leaf if its parent is full and it is not.
    ``key``: the points' tiles at ``max_depth``, where they are not by ``box``.
    """
    key = geo.tile_key(F.col("latitude_e7"), F.col("longitude_e7"), max_depth, box) if key is None else key
    finest = points.groupBy(key.alias("t")).agg(F.count(F.lit(1)).alias("c"))
    every = finest.select("c", F.split("t", r"\.").alias("t")).withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    every = every.groupBy(F.array_join(F.slice("t", F.lit(1), F.col("depth") + 1), ".").alias("tile"), "depth").agg(F.sum("c").alias("n"))
    full = F.col("n") >= most
    parents = every.where(full).select(F.col("tile").alias("parent"))
    leaves = every.where(~full | (F.col("depth") == max_depth)).withColumn("parent", F.regexp_replace("tile", r"\.?\d$", ""))
    inner = leaves.where("depth > 0").join(parents, "parent", "left_semi")
    return inner.unionByName(leaves.where("depth = 0").select(*inner.columns)).select("tile", "depth", "n", F.when(full, "PARTIAL").otherwise("COMPLETE").alias("status"))
