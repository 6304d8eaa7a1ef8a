"""Search quality over scenarios: hits, forbidden results, determinism, latency."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import digest

LEAST_HIT_BP, MOST_P95_MS, TOP = 8500, 1500, 5


def p95(values: list[int]) -> int:
    """Nearest rank."""
    ordered = sorted(values)
    return ordered[max(0, -(-95 * len(ordered) // 100) - 1)]


def hit_rate(ranked: DataFrame, expected: DataFrame, scenario: str, top: int = TOP) -> DataFrame:
    """``counted`` scenarios, ``hits`` (an expected ``store_id`` among the first ``top`` ranks) and ``hit_bp``."""
    first = ranked.where(F.col("rank") <= top).select(scenario, "store_id").withColumn("hit", F.lit(1))
    per = expected.join(first, [scenario, "store_id"], "left").groupBy(scenario).agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    return per.agg(F.count(F.lit(1)).alias("counted"), F.sum("hit").alias("hits"), F.floor(F.sum("hit") * 10_000 / F.count(F.lit(1))).cast("long").alias("hit_bp"))


def nearest_rank(df: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """``key``, ``value``: the nearest-rank percentile of each key."""
    return df.groupBy(key).agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(value))


def evaluate(scenarios: list[dict], run: Callable[[dict], list[str]], repeats: int = 1) -> dict:
    """``scenarios``: id, expected (top ids, any of which is a hit), forbidden, counts; ``run`` gives store ids in order."""
    hits, counted, misses, forbidden, times, stable = 0, 0, [], [], [], True
    for s in scenarios:
        prints = set()
        for _ in range(repeats):
            began = time.perf_counter()
            found = run(s)
            times.append(-(-int((time.perf_counter() - began) * 1e6) // 1000))
            prints.add(digest(found))
        stable &= len(prints) == 1
        forbidden += [(s["id"], x) for x in s.get("forbidden", ()) if x in found]
        if s.get("counts", True):
            counted += 1
            ok = any(x in found[:TOP] for x in s["expected"])
            hits += ok
            if not ok:
                misses.append(s["id"])
    rate = hits * 10_000 // counted if counted else 0
    return {"hit_bp": rate, "hits": hits, "counted": counted, "misses": misses, "forbidden": forbidden, "deterministic": stable, "p95_ms": p95(times), "passed": rate >= LEAST_HIT_BP and not forbidden and stable and p95(times) < MOST_P95_MS}
