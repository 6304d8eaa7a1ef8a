"""The seen-fingerprint ledger as a stream: first sightings within a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How long a sighting counts.
TTL_MS = 400 * 24 * 3600 * 1000


def first_sightings(stream: DataFrame, key: list[str], at: str = "ts", ttl_ms: int = TTL_MS, late: str = "1 day") -> DataFrame:
    """``key`` and ``at`` of rows whose key was not seen in the ``ttl_ms`` before; every sighting extends that time.

    State is one time for each key and goes once the watermark passes its end.
    """
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, at])

    def step(values: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for batch in batches for t in batch[at]):
            now = int(t.timestamp() * 1000)
            if last is None or now - last > ttl_ms:
                out.append(t)
            last = now if last is None else max(last, now)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({c: [v] * len(out) for c, v in zip(key, values, strict=True)} | {at: out})

    return stream.withWatermark(at, late).groupBy(*key).applyInPandasWithState(step, schema, "last long", "append", "EventTimeTimeout")


def record(ledger: DataFrame, sightings: DataFrame, key: list[str], now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """The ledger with a run's sightings: first and last time of each key, without what has expired."""
    from ..operators.tables import merge_max

    return merge_max(ledger, sightings, key, ["last_seen_ms"], ["first_seen_ms"]).where(F.col("last_seen_ms") + F.lit(ttl_ms) > F.lit(now_ms))


def windowed_counts(stream: DataFrame, key: str, at: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling window, rows later than ``late`` left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")
