"""Runs over many stores: checkpoints of pages, one active run, and what a batch comes to."""

from __future__ import annotations

import json
import os
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import change_types, latest_by
from ..sources.lease import Held, Lease

# How a run reads a store, and how a store ends.
MODES = ("INITIAL_BACKFILL", "INCREMENTAL", "BACKFILL_FALLBACK")
DONE, FAILED, STOPPED, PAUSED = ("COMPLETE", "NO_REVIEWS"), ("FAILED",), ("PROVIDER_STOPPED",), ("OPERATOR_PAUSED", "BUDGET_PAUSED")


class RunActive(RuntimeError):
    """Another run holds the slot."""


@contextmanager
def single_run(folder: str, run_id: str, ttl_ms: int = 15 * 60_000, clock=None):
    """Hold the one slot for active runs, and yield its lease to renew and check; a holder that died is followed when its lease ends."""
    lease = Lease(folder, "active-run", ttl_ms, **({"clock": clock} if clock else {}))
    try:
        lease.acquire(run_id)
    except Held as e:
        raise RunActive(str(e)) from None
    try:
        yield lease
    finally:
        lease.release()


def write_report(path: str, report: dict) -> None:
    """A JSON report that is there whole or not at all."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    part = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(report, ensure_ascii=False, sort_keys=True, indent=1))
    os.replace(part, at)


def cursor(complete: Column, mode: Column, seen: Column, date: Column) -> Column:
    """``page-complete|mode|seen|date``; null if a part is not what it must be."""
    good = mode.isin(*MODES) & (seen >= 0) & (date.isNull() | F.try_to_date(date, "yyyy-MM-dd").isNotNull())
    return F.when(good, F.concat_ws("|", F.when(complete, "1").otherwise("0"), mode, seen.cast("string"), F.coalesce(date, F.lit(""))))


def read_cursor(x: Column) -> Column:
    """struct(complete, mode, seen, date) of a cursor, null if it is none."""
    pattern = rf"^([01])\|({'|'.join(MODES)})\|(\d+)\|(\d{{4}}-\d{{2}}-\d{{2}})?$"
    part = lambda i: F.regexp_extract(x, pattern, i)
    return F.when(x.rlike(pattern), F.struct((part(1) == "1").alias("complete"), part(2).alias("mode"), part(3).cast("long").alias("seen"), F.nullif(part(4), F.lit("")).alias("date")))


def resume_points(checkpoints: DataFrame, now_ms: int) -> DataFrame:
    """``store_id``, ``next_page`` and the cursor's parts of stores that a run goes on with: from the last page, or behind it if that is complete."""
    last = latest_by(checkpoints.where(F.col("expires_at_ms") > now_ms), ["store_id"], [F.desc("page_no"), F.desc("updated_at_ms")])
    x = last.withColumn("c", read_cursor(F.col("cursor")))
    return x.select("store_id", F.when(F.col("c").isNull(), 1).otherwise(F.col("page_no") + F.col("c.complete").cast("int")).cast("long").alias("next_page"), "c.mode", F.coalesce("c.seen", F.lit(0)).alias("seen"), "c.date")


def work_list(observations: DataFrame, locators: DataFrame, now_ms: int) -> DataFrame:
    """Matched stores with a locator that is still valid: what a batch collects."""
    live = locators.where(F.col("delete_by_ms") > now_ms)
    return observations.where(F.col("match_status") == "MATCHED_ELIGIBLE").join(live, "observation_id")


def batch_status(stores: DataFrame) -> DataFrame:
    """``run_id``, ``status`` and counts of each run from its stores' ends (``store_id``, ``end``, null while open).

    A store's failure stays its own.  A provider's stop outweighs a pause, a
    pause outweighs failures; only runs whose stores are all done succeed.
    """
    of = lambda names: F.count_if(F.coalesce(F.col("end").isin(*names), F.lit(False)))
    x = stores.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_stores"), of(DONE).alias("n_done"), of(FAILED).alias("n_failed"), of(STOPPED).alias("n_stopped"), of(PAUSED).alias("n_paused"))
    status = F.when(F.col("n_stopped") > 0, "PROVIDER_STOPPED").when(F.col("n_paused") > 0, "PAUSED").when(F.col("n_done") == F.col("n_stores"), "SUCCEEDED").when(F.col("n_done") + F.col("n_failed") == F.col("n_stores"), "PARTIAL").otherwise("RUNNING")
    return x.withColumn("status", status)


def locators_to_delete(locators: DataFrame, stores: DataFrame) -> DataFrame:
    """Locators of runs that have succeeded in full."""
    return locators.join(batch_status(stores).where(F.col("status") == "SUCCEEDED").select("run_id"), "run_id", "left_semi")


def page_changes(old: DataFrame, new: DataFrame, keys: list[str], page: str = "page_no") -> DataFrame:
    """Per page: rows read, inserted, updated and unchanged, from a null-safe comparison of all columns."""
    changes = change_types(old, new.drop(page), keys)
    rows = new.select(page, *keys).join(changes, keys)
    of = lambda kind: F.count_if(F.col("change") == kind)
    return rows.groupBy(page).agg(F.count(F.lit(1)).alias("n_read"), of("INSERTED").alias("n_inserted"), of("UPDATED").alias("n_updated"), of("UNCHANGED").alias("n_unchanged"))
