"""A batch over many stores: collected a wave at a time, each wave one commit, paused, stopped and resumed between waves.

A run's state is a version of tables that grows by commits.  The first one
holds ``targets`` (the stores and how each is read) and ``locators`` (where
each is read); every wave adds its own ``ends_n`` (how its stores ended) and
``rows_n`` (what was collected), so that ends and rows are there together or
not at all, and no wave writes again what an earlier one wrote.  A run that was
killed in a wave collects that wave again; nothing of it had been committed.

A store that fails stays failed while the others go on, and is tried again
when the run is resumed.  A provider's stop ends the run after its wave: what
that wave has collected is kept, and stores behind it stay pending.  Pauses
leave the run open.  Once all stores are done the locators go.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut, latest_by, remove
from ..sources.lease import Fenced, Lease
from ..sources.versions import Conflict, Versions
from .runs import MODES

# States of a store, of a run, and reasons.
PENDING, RUNNING, COMPLETE, NO_REVIEWS, FAILED_STORE, STOPPED_PROVIDER = "PENDING", "RUNNING", "COMPLETE", "NO_REVIEWS", "FAILED_STORE", "STOPPED_PROVIDER"
STATES = (RUNNING, COMPLETE, NO_REVIEWS, FAILED_STORE, STOPPED_PROVIDER)
DONE = (COMPLETE, NO_REVIEWS)
FINAL = ("SUCCEEDED", "PARTIAL")
BUDGET_MS = 28_800_000
COUNTS = ("collected_count", "duplicate_count", "rejected_pii_count")

ENDS = "store_id string, state string, mode string, reason_code string, collected_count long, duplicate_count long, rejected_pii_count long"

#: Takes a wave's targets (store_id, observation_id, mode, locator) and gives a row of ``ENDS`` for each store that it came to, and the collected rows, if any.
#: Ends and rows are computed one after the other: what must be asked for once is written first.
Collect = Callable[[DataFrame], tuple[DataFrame, DataFrame | None]]


class BatchConflict(RuntimeError):
    """The run was begun with other facts or other targets."""


class KeyVersionMismatch(RuntimeError):
    """A store was last read under another key."""


class Batch:
    """One run's state below ``versions``, which no other run shares.

    ``run``: run_id, as_of_date, key_version and whatever else must be the same
    when the run is resumed.  ``lease``: renewed before each wave's commit,
    which a lost one ends.
    """

    def __init__(self, spark: SparkSession, versions: Versions, run: dict, lease: Lease | None = None, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.spark, self.versions, self.lease, self.clock = spark, versions, lease, clock
        self.source = run | {"basis_date": run["as_of_date"], "downloaded_at_ms": 0, "snapshot_id": run["run_id"]}

    # -- state ------------------------------------------------------------------

    def _waves(self, kind: str) -> DataFrame | None:
        """Rows of all committed waves with ``wave``."""
        active = self.versions.state()["active"]
        found = [n for n in active["tables"] if n.startswith(f"{kind}_")] if active else []
        if not found:
            return None
        paths = [f"{self.versions.root}/{active['tables'][n].get('at', active['version'])}/{n}" for n in found]
        return self.spark.read.parquet(*paths)

    def rows(self) -> DataFrame | None:
        """What was collected, each row with the ``wave`` that committed it."""
        return self._waves("rows")

    def stores(self) -> DataFrame:
        """``store_id``, ``state`` and ``mode`` as last committed, and counts over all waves."""
        targets = self.versions.read(self.spark, "targets")
        ends = self._waves("ends")
        if ends is None:
            return targets.select("store_id", F.lit(PENDING).alias("state"), "mode", *(F.lit(0).cast("long").alias(c) for c in COUNTS))
        last = latest_by(ends, ["store_id"], [F.desc("wave")]).select("store_id", "state", F.col("mode").alias("now"))
        sums = ends.groupBy("store_id").agg(*(F.sum(c).alias(c) for c in COUNTS))
        x = targets.join(last, "store_id", "left").join(sums, "store_id", "left")
        # only a store that was to be read incrementally falls back
        mode = F.when((F.col("mode") == "INCREMENTAL") & (F.col("now") == "BACKFILL_FALLBACK"), F.col("now")).otherwise(F.col("mode"))
        return x.select("store_id", F.coalesce("state", F.lit(PENDING)).alias("state"), mode.alias("mode"), *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS))

    def summary(self) -> dict:
        """Status, stores by mode, failures and counts of the run as committed."""
        of = lambda c, n: F.count_if(c).alias(n)
        modes = [of(F.col("mode") == m, f"{m.lower()}_store_count") for m in MODES]
        x = self.stores().agg(F.count(F.lit(1)).alias("store_count"), *modes, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), of(F.col("state") == FAILED_STORE, "failed_store_count"))
        active = self.versions.state()["active"]
        return {"run_id": self.source["run_id"], "status": active["status"], "finished_at_ms": active["finished_at_ms"]} | x.first().asDict()

    # -- running ----------------------------------------------------------------

    def _begin(self, targets: DataFrame, sync: DataFrame) -> None:
        known = sync.select("store_id", F.col("key_version").alias("known"))
        x = cut(targets.join(known, "store_id", "left"), "targets")
        if x.where(F.col("known") != self.source["key_version"]).take(1):
            raise KeyVersionMismatch(self.source["key_version"])
        mode = F.when(F.col("known").isNotNull(), "INCREMENTAL").otherwise("INITIAL_BACKFILL").alias("mode")
        self.versions.publish({"targets": x.select("store_id", "observation_id", mode), "locators": x.select("store_id", "locator")}, self.source)
        self._note("begin", RUNNING, {})

    def _note(self, step: str, status: str, tables: dict[str, DataFrame | None]) -> None:
        if self.lease is not None:
            self.lease.renew()
        finished = self.clock() if status not in (RUNNING, "PAUSED_OPERATOR", "PAUSED_BUDGET") else None
        self.versions.derive(step, tables, status=status, finished_at_ms=finished)

    def run(self, targets: DataFrame, sync: DataFrame, collect: Collect, budget_ms: int, wave: int = 1000, paused: Callable[[], bool] = lambda: False) -> dict:
        """Collect all stores that are not done, in the order of their ids, ``wave`` at a time; the summary.

        ``targets``: store_id (once each), observation_id, locator.  ``sync``:
        store_id and the key_version it was last read under.  A run that has
        ended is not run again.  ``paused`` and the budget are asked before
        each wave.  A store that ``collect`` gives no end stays as it was.
        """
        if not 1 <= budget_ms <= BUDGET_MS:
            raise ValueError("budget")
        self.source |= {"run_budget_ms": budget_ms}
        deadline = self.clock() + budget_ms
        active = self.versions.state()["active"]
        if active is None:
            self._begin(targets, sync)
        elif active["source"] != self.source:
            raise BatchConflict(self.source["run_id"])
        elif active.get("status") in FINAL:
            return self.summary()
        elif not self._same(targets):
            raise BatchConflict(self.source["run_id"])
        else:
            self._note("resume", RUNNING, {})

        last, status = None, None
        while status is None:
            todo = self.stores().where(~F.col("state").isin(*DONE))
            todo = todo if last is None else todo.where(F.col("store_id") > last)  # each store once a call
            ids = todo.select("store_id").orderBy("store_id").limit(wave)
            last, n = ids.agg(F.max("store_id"), F.count(F.lit(1))).first()
            if n == 0:
                break
            if paused():
                status = "PAUSED_OPERATOR"
            elif self.clock() >= deadline:
                status = "PAUSED_BUDGET"
            if status is not None:
                self._note(status, status, {})
                break
            status = self._wave(todo.where(F.col("store_id") <= last), collect)
        if status is None:
            failed = bool(self.stores().where(F.col("state") == FAILED_STORE).take(1))
            at = self.versions.state()["active"]
            self._note("end", FINAL[failed], {} if failed else {"locators": None})
            if not failed:  # what the version no longer names is not kept either
                remove(self.spark, f"{self.versions.root}/{at['tables']['locators'].get('at', at['version'])}/locators")
        return self.summary()

    def _same(self, targets: DataFrame) -> bool:
        pair = lambda df: df.select("store_id", "observation_id")
        a, b = pair(targets), pair(self.versions.read(self.spark, "targets"))
        return not a.exceptAll(b).unionByName(b.exceptAll(a)).take(1)

    def _wave(self, stores: DataFrame, collect: Collect) -> str | None:
        """Collect and commit some stores; the run's status if it ends here."""
        read = lambda name: self.versions.read(self.spark, name)
        todo = stores.select("store_id", "mode").join(read("targets").drop("mode"), "store_id").join(read("locators"), "store_id")
        number = 1 + sum(n.startswith("ends_") for n in self.versions.state()["active"]["tables"])
        try:
            ends, rows = collect(cut(todo, "wave"))
            ends = cut(ends.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in ENDS.split(", "))).withColumn("wave", F.lit(number)), "ends")
            if ends.where(~F.coalesce(F.col("state").isin(*STATES), F.lit(False))).take(1):
                raise ValueError("state")
            status = self._status(ends)
            tables = {f"ends_{number}": ends} | ({} if rows is None else {f"rows_{number}": rows.withColumn("wave", F.lit(number))})
            self._note(f"wave {number}", status or RUNNING, tables)
        except (Fenced, Conflict):
            raise
        except Exception:  # noqa: BLE001  whatever it was, the run ends and says so; it can be resumed
            status = "FAILED_FINAL"
            self._note("failed", status, {})
        return status

    @staticmethod
    def _status(ends: DataFrame) -> str | None:
        """How a wave's ends end the run, if they do; of several stops the first store's reason counts."""
        stop = ends.where(F.col("state") == STOPPED_PROVIDER).agg(F.min_by(F.coalesce("reason_code", F.lit("")), "store_id")).first()[0]
        if stop is not None:
            return "STOPPED_POLICY" if stop == "DOM_CONTRACT_CHANGED" else "STOPPED_ACCESS"
        # a store that ran out of time between its pages
        return "PAUSED_BUDGET" if ends.where(F.col("state") == RUNNING).take(1) else None
