"""Immutable table versions below a root folder and a manifest that names the active one."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.ids import digest, table_digest
from .lease import Lease, create_whole, numbered


class StaleSource(RuntimeError):
    """A newer source is active already."""


class Conflict(RuntimeError):
    """Another publisher was first."""


class SchemaUnknown(RuntimeError):
    """Tables of a later schema than this code knows."""


class Versions:
    """Tables at ``root/version/table``; the manifest's highest generation holds the state.

    Who follows a generation makes the next one's file, whole and exclusively,
    so that of two publishers that read the same state one wins and the other
    one is refused, and a publisher that dies leaves nothing to clear.  With a
    ``lease``, one that has been taken over is refused as well.

    ``manifest_dir`` is a folder of the driver; tables may be in any store that
    Spark reads and writes.
    """

    def __init__(self, root: str, manifest_dir: str | None = None, lease: Lease | None = None):
        self.root, self.lease = root.rstrip("/"), lease
        self.manifest = Path(manifest_dir or root.removeprefix("file://")) / "manifest.json"

    def state(self) -> dict:
        """The state of the highest generation."""
        generations = numbered(self.manifest.parent, f"{self.manifest.stem}.*.json")
        at = self.manifest.with_suffix(f".{generations[-1]}.json") if generations else self.manifest
        return json.loads(at.read_text()) if at.exists() else {"active": None, "history": []}

    def source_order(self, source: dict) -> tuple:
        return (source["basis_date"], str(source["downloaded_at_ms"]).rjust(16, "0"), source["snapshot_id"])

    def guard(self, source: dict, state: dict | None = None) -> None:
        active = (state or self.state())["active"]
        if active and self.source_order(active["source"]) > self.source_order(source):
            raise StaleSource(active["version"])

    def publish(self, tables: dict[str, DataFrame], source: dict, checks: DataFrame | None = None, beside: Callable[[dict, dict], dict] | None = None) -> dict:
        """Write all tables under a version made from the source, then swap.

        The same source gives the same version and returns what was published;
        a failed check or a newer active source leaves the manifest untouched.
        ``beside`` gets the entry and the state that it follows, and gives what
        else of the state changes in the same swap.
        """
        self.guard(source)
        version = "v_" + digest(source)[:24]
        state = self.state()
        for past in state["history"]:
            if past["version"] == version:
                if past != state["active"]:  # back to earlier tables of this source
                    self._swap(state | {"active": past} | (beside(past, state) if beside else {}), state.get("generation", 0))
                return past
        if checks is not None:
            broken = {r["check"]: r["n"] for r in checks.where("n > 0").collect()}  # a row a check
            if broken:
                raise ValueError(f"checks failed: {broken}")
        entry = {"version": version, "source": source, "tables": {}}
        for name, df in tables.items():
            entry["tables"][name] = self._written(df, version, name)
        state = self.state()
        self.guard(source, state)
        self._swap(state | {"active": entry, "history": [*state["history"], entry]} | (beside(entry, state) if beside else {}), state.get("generation", 0))
        return entry

    def _swap(self, state: dict, seen: int) -> None:
        """Follow the state of generation ``seen``: one file, made whole, is the whole step, so that a crash leaves the one or the other state."""
        if self.lease is not None:
            self.lease.check()
        state = state | {"generation": seen + 1}
        if not create_whole(self.manifest.with_suffix(f".{seen + 1}.json"), json.dumps(state, sort_keys=True, ensure_ascii=False)):
            raise Conflict(f"generation {seen + 1}")

    def derive(self, step: str, tables: dict[str, DataFrame | None], **facts) -> dict:
        """Follow the active version by one with these tables in place of its own (None: without it); the others are shared, not written again."""
        state = self.state()
        old = state["active"]
        entry = old | {"version": "v_" + digest([old["version"], state.get("generation", 0), step])[:24]} | facts
        shared = {name: {"at": old["version"]} | f for name, f in old["tables"].items() if name not in tables}
        entry["tables"] = shared | {name: self._written(df, entry["version"], name) for name, df in tables.items() if df is not None}
        self._swap(state | {"active": entry, "history": [*state["history"], entry]}, state.get("generation", 0))
        return entry

    def slot(self, name: str) -> Slot:
        """Another pointer of this manifest with versions of its own."""
        return Slot(self, name)

    def tables(self, spark: SparkSession, entry: dict) -> dict[str, DataFrame]:
        """All tables of an entry."""
        return {name: spark.read.parquet(f"{self.root}/{facts.get('at', entry['version'])}/{name}") for name, facts in entry["tables"].items()}

    def _written(self, df: DataFrame, version: str, name: str) -> dict:
        path = f"{self.root}/{version}/{name}"
        df.write.mode("overwrite").parquet(path)
        row = table_digest(df.sparkSession.read.parquet(path)).first()
        return {"rows": row["n"], "digest": row["digest"], "at": version}

    def migrate(self, spark: SparkSession, steps: list[Callable[[dict[str, DataFrame]], dict[str, DataFrame | None]]]) -> dict:
        """Bring the active version's tables to the schema after all ``steps``, each a swap of its own.

        A step gets the tables and gives those that it changes (None: dropped).
        Steps that were done are not done again; a version of a schema that
        these steps do not reach is refused.
        """
        active = self.state()["active"]
        if active.get("schema", 0) > len(steps):
            raise SchemaUnknown(active["schema"])
        for number in range(active.get("schema", 0), len(steps)):
            tables = {name: self.read(spark, name) for name in active["tables"]}
            active = self.derive(f"schema {number + 1}", steps[number](tables), schema=number + 1)
        return active

    def read(self, spark: SparkSession, table: str, version: str | None = None) -> DataFrame:
        state = self.state()
        entry = next((e for e in [state["active"], *state["history"]] if e and e["version"] == version), None) if version else state["active"]
        folder = entry["tables"][table].get("at", entry["version"]) if entry and table in entry["tables"] else version
        return spark.read.parquet(f"{self.root}/{folder}/{table}")

    def verify(self, spark: SparkSession) -> dict[str, bool]:
        """Whether each table of the active version, and of the slots' active ones (``slot/table``), still has its digest."""
        state = self.state()
        found = {}
        for prefix, of, entry in [("", self, state["active"]), *((f"{name}/", self.slot(name), own["active"]) for name, own in state.get("slots", {}).items() if own["active"])]:
            tables = of.tables(spark, entry)
            found |= {prefix + name: table_digest(tables[name]).first()["digest"] == facts["digest"] for name, facts in entry["tables"].items()}
        return found

    def backup(self, spark: SparkSession, target: str) -> Versions:
        """Copy the active version and those of the slots, and check the copies' digests."""
        state, copy = self.state(), Versions(target)

        def copied(of: Versions, to: Versions, entry: dict) -> dict:
            for name, df in of.tables(spark, entry).items():
                df.write.parquet(f"{to.root}/{entry['version']}/{name}")
            entry = entry | {"tables": {name: f | {"at": entry["version"]} for name, f in entry["tables"].items()}}
            return {"active": entry, "history": [entry]}

        whole = copied(self, copy, state["active"])
        slots = {name: copied(self.slot(name), copy.slot(name), own["active"]) for name, own in state.get("slots", {}).items() if own["active"]}
        copy._swap(whole | ({"slots": slots} if slots else {}), 0)
        if not all(copy.verify(spark).values()):
            raise ValueError("the copy differs")
        return copy

    def restore(self, spark: SparkSession, target: str, checks: dict[str, Callable[[Versions], bool]] | None = None) -> Versions:
        """A backup's active version as a new root, which must not exist; digests and further ``checks`` must hold.

        A target whose check fails is left without a manifest, so that nothing reads it.
        """
        if Versions(target).state()["active"]:
            raise FileExistsError(target)
        if not all(self.verify(spark).values()):
            raise ValueError("the backup is damaged")
        copy = self.backup(spark, target)
        failed = [name for name, check in (checks or {}).items() if not check(copy)]
        if failed:
            copy.clear()
            raise ValueError(f"checks failed: {failed}")
        return copy

    def clear(self) -> None:
        """Take the manifest away, so that nothing reads these tables."""
        for n in numbered(self.manifest.parent, f"{self.manifest.stem}.*.json"):
            self.manifest.with_suffix(f".{n}.json").unlink()
        self.manifest.unlink(missing_ok=True)


class Slot(Versions):
    """A second pointer of a manifest: its versions follow the first pointer's, and a swap of either sees the other.

    What is published names the version of the first pointer that it was made
    for (``for_version`` of its source), and is refused once that is not the
    active one any more.  The manifest's one generation counts swaps of all
    pointers, so that of a swap here and one there that read the same state,
    one is refused.
    """

    def __init__(self, of: Versions, name: str):
        super().__init__(f"{of.root}/{name}", str(of.manifest.parent), of.lease)
        self.of, self.name = of, name

    def state(self) -> dict:
        whole = self.of.state()
        return {"active": None, "history": []} | whole.get("slots", {}).get(self.name, {}) | {"generation": whole.get("generation", 0)}

    def guard(self, source: dict, state: dict | None = None) -> None:
        first = self.of.state()["active"]
        if not first or source.get("for_version") != first["version"]:
            raise StaleSource(source.get("for_version"))
        super().guard(source, state)

    def _swap(self, state: dict, seen: int) -> None:
        whole = self.of.state()
        if whole.get("generation", 0) != seen:
            raise Conflict(f"generation {seen + 1}")
        self.of._swap(whole | {"slots": self.put(whole, {k: v for k, v in state.items() if k != "generation"})}, seen)

    def put(self, whole: dict, state: dict) -> dict:
        """The slots of a whole state with this one's state in it."""
        return whole.get("slots", {}) | {self.name: state}
