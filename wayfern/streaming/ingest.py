"""Page-by-page ingestion of a landed snapshot as a stream.

Landed pages are files, one a page; a file stream takes some of them a trigger
and ``foreachBatch`` commits what they give.  A commit is one small file, made
whole, that names the folders of a batch's tables; rows without it do not
exist for readers.  A batch that was written but not committed is written
again, one that was committed but not noted by the stream is skipped: each page
counts once, and a run that was killed goes on behind its last commit.

Tables of a snapshot: ``source_rows`` (never changed: the same row with another
content stops the run), ``staged`` (the last checked content of each accepted
row, of which commits hold the changes), ``issues`` (refused rows with their
reason) and ``checkpoints`` (a row for each page of the run's last attempt).

A row's key is its management number; rows without one are known by their
place.  Each batch reads keys and digests of the snapshot's rows so far, so
pages a trigger grow with the snapshot: a run has at most ``MOST_BATCHES``.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import digest, stable_id
from ..operators.tables import change_types, latest_by
from ..sources import ledger
from ..sources.lease import Fenced, Lease, create_whole, numbered, replace_whole

# States of a run.
RUNNING, SUCCEEDED, FAILED = "RUNNING", "SUCCEEDED", "FAILED_FINAL"
COUNTS = ("n_read", "n_inserted", "n_updated", "n_rejected")

#: Batches of a run at most: what they read of those before them is at most half as many times the snapshot.
MOST_BATCHES = 16


class ImmutableRow(RuntimeError):
    """A source row of one snapshot came with another content."""


class PageRefused(RuntimeError):
    """A landed page does not hold what a page must."""


def land(pages: DataFrame, folder: str) -> None:
    """Pages (``page_no``, ``json``) as files of a folder for each page."""
    pages.select("page_no", "json").write.partitionBy("page_no").text(folder)


def landed_pages(spark: SparkSession, folder: str) -> int:
    """How many files a landed folder has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getFileCount()


def snapshot(basis_date: str, pages: DataFrame) -> dict:
    """A source's description from its pages, whatever their order."""
    return {"basis_date": basis_date, "snapshot_id": "snapshot_" + digest([basis_date, ledger.pages_digest(pages)])[:24]}


class Ingestion:
    """Runs over one snapshot.  ``log_dir`` is a folder of the driver, ``root`` one that all tasks share."""

    def __init__(self, spark: SparkSession, root: str, snapshot_id: str, log_dir: str | None = None):
        self.spark, self.snapshot_id = spark, snapshot_id
        self.root = f"{root.rstrip('/')}/{snapshot_id}"
        self.log = Path(log_dir or root.removeprefix("file://")) / snapshot_id / "log"
        self.run_id = "run_" + digest([snapshot_id, "ledger"])[:24]

    # -- what is committed ----------------------------------------------------

    def run_state(self) -> dict:
        at = self.log / "run.json"
        return json.loads(at.read_text()) if at.exists() else {"run_id": self.run_id, "attempt": 0, "status": None}

    def commits(self) -> list[dict]:
        """Commits in their order."""
        found = []
        for attempt in numbered(self.log, "attempt-*"):
            folder = self.log / f"attempt-{attempt}"
            found += [json.loads((folder / f"batch-{n}").read_text()) for n in numbered(folder, "batch-*")]
        return found

    def _table(self, name: str, commits: list[dict]) -> DataFrame | None:
        """Committed rows of a table with ``attempt`` and ``batch``."""
        paths = [(c["tables"][name], c["attempt"], c["batch"]) for c in commits if name in c["tables"]]
        if not paths:
            return None
        # a commit's folder names its attempt and batch, which partition discovery reads
        return self.spark.read.option("basePath", f"{self.root}/{name}").parquet(*(p for p, _, _ in paths))

    def read(self, name: str) -> DataFrame | None:
        commits = self.commits()
        found = self._table(name, commits)
        if found is None or name == "source_rows":
            return found.drop("attempt", "batch") if found is not None else None
        keys = {"staged": ["source_record_key"], "issues": ["source_row_id"], "checkpoints": ["page_no"]}[name]
        return latest_by(found, keys, [F.desc("attempt"), F.desc("batch")]).drop("attempt", "batch")

    # -- running --------------------------------------------------------------

    def run(self, landed: str, pages_a_trigger: int = 100, lease: Lease | None = None) -> dict:
        """Commit all landed pages; goes on with an attempt that did not end, else begins a new one.

        ``pages_a_trigger``: at least so many pages go into a batch, and more if there would be over ``MOST_BATCHES``.
        ``lease``: renewed before each commit, which a lost one ends.
        """
        state = self.run_state()
        if state["status"] != RUNNING:
            state = {"run_id": self.run_id, "attempt": state["attempt"] + 1, "status": RUNNING}
            self._note(state)
        attempt = state["attempt"]

        def batch(df: DataFrame, number: int) -> None:
            self._commit(df, attempt, number, lease)

        pages_a_trigger = max(pages_a_trigger, -(-landed_pages(self.spark, landed) // MOST_BATCHES))
        pages = self.spark.readStream.schema("value string, page_no long").option("wholetext", True).option("maxFilesPerTrigger", pages_a_trigger).format("text").load(landed)
        query = pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.root}/stream/attempt-{attempt}").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception as e:
            for kind in (ImmutableRow, PageRefused, Fenced):
                if kind.__name__ in str(e):
                    if kind is not Fenced:  # a fenced run's attempt is its follower's
                        self._note(state | {"status": FAILED, "error": kind.__name__})
                    raise kind(self.snapshot_id) from None
            raise  # the attempt stays open, and the next run goes on with it
        found = self.summary(attempt)
        self._note(state | {"status": SUCCEEDED} | found)
        return self.run_state()

    def summary(self, attempt: int) -> dict:
        pages = self._table("checkpoints", [c for c in self.commits() if c["attempt"] == attempt])
        if pages is None:
            return {"n_pages": 0} | dict.fromkeys(COUNTS, 0)
        return pages.agg(F.count(F.lit(1)).alias("n_pages"), *(F.sum(c).alias(c) for c in COUNTS)).first().asDict()

    def _note(self, state: dict) -> None:
        self.log.mkdir(parents=True, exist_ok=True)
        replace_whole(self.log / "run.json", json.dumps(state, sort_keys=True))

    def _write(self, name: str, df: DataFrame, attempt: int, number: int) -> str:
        path = f"{self.root}/{name}/attempt={attempt}/batch={number}"
        df.write.mode("overwrite").parquet(path)
        return path

    def _commit(self, landed: DataFrame, attempt: int, number: int, lease: Lease | None) -> None:
        at = self.log / f"attempt-{attempt}" / f"batch-{number}"
        if at.exists():
            return
        past = self.commits()
        decoded = ledger.decode(landed.select(F.col("value").alias("json")))
        bad = decoded.where(F.col("page_no").isNull() | F.col("items").isNull() | (F.size("items") > F.col("rows_asked")) | (F.col("result_code") != "00"))
        if bad.take(1):
            raise PageRefused(self.snapshot_id)
        fields = list(ledger.FIELDS.values())
        rows = ledger.rows(decoded)
        place = F.concat_ws(":", F.lit("place"), "page_no", "position")
        blank = F.trim(F.coalesce("mng_no", F.lit(""))) == ""
        payload = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
        rows = rows.withColumn("source_row_key", F.when(blank, place).otherwise(F.concat_ws(":", "open_authority_group_code", "mng_no"))).withColumn("payload_json", payload).withColumn("payload_sha256", F.sha2("payload_json", 256))
        key = F.concat_ws(":", F.lit(self.snapshot_id), "source_row_key")
        # one write of the batch's rows, from which all that follows reads
        path = self._write("arrived", rows.withColumn("source_row_id_", stable_id("row", key)), attempt, number)
        arrived = self.spark.read.parquet(path)

        facts = arrived.select("source_row_key", "payload_sha256")
        old = self._table("source_rows", past)
        known = facts if old is None else facts.unionByName(old.select("source_row_key", "payload_sha256").join(facts.select("source_row_key").distinct(), "source_row_key", "left_semi"))
        if known.groupBy("source_row_key").agg(F.min("payload_sha256").alias("a"), F.max("payload_sha256").alias("b")).where("a <> b").take(1):
            raise ImmutableRow(self.snapshot_id)
        first = latest_by(arrived, ["source_row_key"], [F.col("page_no"), F.col("position")])
        fresh = first if old is None else first.join(old.select("source_row_key"), "source_row_key", "left_anti")

        checked = ledger.check(arrived, self.snapshot_id)
        accepted = checked.where(F.col("reason_code").isNull())
        content = [c for c in fields if not c.endswith("_raw")] + ["permit_date", "closed_date", "data_updated_at_ms", "last_modified_at_ms"]
        staged = latest_by(accepted, ["source_row_key"], [F.col("page_no"), F.col("position")])
        staged = staged.select(F.col("source_row_key").alias("source_record_key"), F.col("source_row_id_").alias("source_row_id"), *content, "page_no")
        before = self._table("staged", past)
        empty = self.spark.createDataFrame([], staged.drop("page_no").schema)
        current = empty if before is None else latest_by(before.join(staged.select("source_record_key"), "source_record_key", "left_semi"), ["source_record_key"], [F.desc("attempt"), F.desc("batch")]).drop("attempt", "batch")
        change = change_types(current, staged.drop("page_no"), ["source_record_key"])
        moved = staged.join(change, "source_record_key").where(F.col("change") != "UNCHANGED")
        moved_path = self._write("changes", moved, attempt, number)
        moved = self.spark.read.parquet(moved_path)

        of = lambda kind: F.count_if(F.col("change") == kind)
        by_page = moved.groupBy("page_no").agg(of("INSERTED").alias("n_inserted"), of("UPDATED").alias("n_updated"))
        last = F.max_by("source_row_key", "position").alias("last_key")
        read = checked.groupBy("page_no").agg(F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("reason_code").isNotNull()).alias("n_rejected"), last)
        pages = decoded.select("page_no").distinct().join(read, "page_no", "left").join(by_page, "page_no", "left")
        pages = pages.select("page_no", "last_key", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS))
        tables = {
            "source_rows": fresh.select(F.col("source_row_id_").alias("source_row_id"), "source_row_key", "page_no", "position", "payload_json", "payload_sha256"),
            "staged": moved.drop("page_no", "change"),
            "issues": checked.where(F.col("reason_code").isNotNull()).select(F.col("source_row_id_").alias("source_row_id"), F.col("reason_code").alias("rule_code"), "page_no"),
            "checkpoints": pages,
        }
        written = {name: self._write(name, df, attempt, number) for name, df in tables.items()}
        if lease is not None:
            lease.renew()
        create_whole(at, json.dumps({"attempt": attempt, "batch": number, "tables": written}, sort_keys=True))
