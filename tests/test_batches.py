"""A batch over stores: failures, stops, pauses, resuming, modes and crashes."""

import pytest
from pyspark.sql import functions as F

from wayfern.plans import batches
from wayfern.plans.batches import Batch, BatchConflict, KeyVersionMismatch
from wayfern.sources.lease import Fenced, Lease
from wayfern.sources.versions import Versions

RUN = {"run_id": "r", "discovery_run_id": "d", "as_of_date": "2026-07-29", "key_version": "k1"}
HOUR = 3_600_000


class Shops:
    """Three stores whose ends a test states; notes which ones were asked for."""

    def __init__(self, spark, tmp_path, known=(), **more):
        self.spark, self.asked = spark, []
        self.batch = Batch(spark, Versions(str(tmp_path / "run")), RUN, clock=lambda: 1000, **more)
        self.targets = spark.createDataFrame([(f"store_{i}", f"o{i}", f"at/{i}") for i in (1, 2, 3)], "store_id string, observation_id string, locator string")
        self.sync = spark.createDataFrame(list(known), "store_id string, key_version string")

    def run(self, ends=None, wave=1, budget=HOUR, **more):
        def collect(todo):
            found = [(r.store_id, r.mode) for r in todo.orderBy("store_id").collect()]
            self.asked += [s for s, _ in found]
            rows = []
            for store, mode in found:
                end = (ends or {}).get(store, {})
                if isinstance(end, Exception):
                    raise end
                rows.append((store, end.get("state", "COMPLETE"), end.get("mode", mode), end.get("reason"), end.get("n", 1), 0, 0))
            e = self.spark.createDataFrame(rows, batches.ENDS)
            return e, e.select("store_id", F.explode(F.sequence(F.lit(1), F.col("collected_count"))).alias("i"))

        return self.batch.run(self.targets, self.sync, collect, budget, wave, **more)

    def states(self):
        return [r.state for r in self.batch.stores().orderBy("store_id").collect()]


def test_failed_store_is_passed_and_a_stop_leaves_later_ones_pending(spark, tmp_path):
    s = Shops(spark, tmp_path)
    got = s.run({"store_1": {"state": "FAILED_STORE"}, "store_2": {"state": "STOPPED_PROVIDER", "reason": "CAPTCHA"}})
    assert (got["status"], got["store_count"], got["failed_store_count"]) == ("STOPPED_ACCESS", 3, 1)
    assert s.asked == ["store_1", "store_2"] and s.states() == ["FAILED_STORE", "STOPPED_PROVIDER", "PENDING"]


def test_paused_batch_goes_on_behind_what_is_done(spark, tmp_path):
    s = Shops(spark, tmp_path)
    got = s.run(paused=lambda: bool(s.asked))
    assert got["status"] == "PAUSED_OPERATOR" and got["finished_at_ms"] is None and s.asked == ["store_1"]
    s.asked.clear()
    got = s.run()
    assert got["status"] == "SUCCEEDED" and s.asked == ["store_2", "store_3"] and got["collected_count"] == 3
    assert sorted(r.store_id for r in s.batch.rows().collect()) == ["store_1", "store_2", "store_3"]
    assert "locators" not in s.batch.versions.state()["active"]["tables"] and not list((tmp_path / "run").rglob("locators"))
    s.asked.clear()
    assert s.run() == got and not s.asked


def test_a_store_out_of_time_stays_running(spark, tmp_path):
    s = Shops(spark, tmp_path)
    got = s.run({"store_1": {"state": "RUNNING"}})
    assert got["status"] == "PAUSED_BUDGET" and got["finished_at_ms"] is None and s.states() == ["RUNNING", "PENDING", "PENDING"]


def test_modes_are_counted_as_stores_were_read(spark, tmp_path):
    s = Shops(spark, tmp_path, known=[("store_2", "k1"), ("store_3", "k1")])
    got = s.run({"store_3": {"mode": "BACKFILL_FALLBACK"}, "store_1": {"mode": "BACKFILL_FALLBACK"}}, wave=3)
    assert [got[f"{m}_store_count"] for m in ("initial_backfill", "incremental", "backfill_fallback")] == [1, 1, 1] and got["status"] == "SUCCEEDED"


def test_a_failed_store_makes_the_run_partial(spark, tmp_path):
    s = Shops(spark, tmp_path)
    got = s.run({"store_1": {"state": "FAILED_STORE", "n": 0}})
    assert (got["status"], got["failed_store_count"]) == ("PARTIAL", 1) and s.asked == ["store_1", "store_2", "store_3"]
    assert "locators" in s.batch.versions.state()["active"]["tables"]


def test_other_facts_or_targets_are_a_conflict(spark, tmp_path):
    s = Shops(spark, tmp_path)
    assert s.run(paused=lambda: True)["status"] == "PAUSED_OPERATOR"
    with pytest.raises(BatchConflict):
        s.run(budget=HOUR + 1)
    s = Shops(spark, tmp_path)
    s.targets = s.targets.limit(2)
    with pytest.raises(BatchConflict):
        s.run()
    with pytest.raises(ValueError):
        s.run(budget=8 * HOUR + 1)
    with pytest.raises(KeyVersionMismatch):
        Shops(spark, tmp_path / "other", known=[("store_1", "k0")]).run()
    assert not s.asked


def test_contract_changes_errors_and_the_budget_end_a_run_that_can_be_resumed(spark, tmp_path):
    s = Shops(spark, tmp_path)
    assert s.run({"store_1": {"state": "STOPPED_PROVIDER", "reason": "DOM_CONTRACT_CHANGED"}, "store_2": {"state": "STOPPED_PROVIDER", "reason": "CAPTCHA"}}, wave=2)["status"] == "STOPPED_POLICY"
    assert s.run({"store_2": RuntimeError("x")})["status"] == "FAILED_FINAL" and s.states() == ["COMPLETE", "STOPPED_PROVIDER", "PENDING"]
    assert s.run({"store_2": {"state": "ASLEEP"}})["status"] == "FAILED_FINAL"
    ticks = iter([1000, 1000, 1000 + HOUR])
    s.batch.clock = lambda: next(ticks)
    assert s.run()["status"] == "PAUSED_BUDGET" and s.states()[0] == "COMPLETE"
    s.batch.clock = lambda: 5000
    assert s.run()["status"] == "SUCCEEDED"


def test_a_killed_wave_is_collected_again_and_counts_once(spark, tmp_path, monkeypatch):
    s = Shops(spark, tmp_path)
    note = s.batch._note

    def killed(step, status, tables):
        if step == "wave 2":
            raise KeyboardInterrupt
        note(step, status, tables)

    monkeypatch.setattr(s.batch, "_note", killed)
    with pytest.raises(KeyboardInterrupt):
        s.run()
    again = Shops(spark, tmp_path)
    got = again.run()
    assert again.asked == ["store_2", "store_3"] and got["collected_count"] == 3 and again.batch.rows().count() == 3


def test_a_run_whose_lease_is_lost_commits_nothing(spark, tmp_path):
    now = [0]
    lease, other = (Lease(str(tmp_path / "lease"), ttl_ms=10, clock=lambda: now[0]) for _ in range(2))
    lease.acquire("a")
    s = Shops(spark, tmp_path, lease=lease)

    def taken_over():
        if s.asked and other.token is None:
            now[0] = 20
            other.acquire("b")
        return False

    with pytest.raises(Fenced):
        s.run(paused=taken_over)
    assert s.states() == ["COMPLETE", "PENDING", "PENDING"]


def test_no_stores(spark, tmp_path):
    s = Shops(spark, tmp_path)
    s.targets = s.targets.limit(0)
    got = s.run()
    assert (got["status"], got["store_count"], got["collected_count"]) == ("SUCCEEDED", 0, 0)
