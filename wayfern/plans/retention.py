"""Deleting what has expired, children before parents, with an audit and a switch that stops later runs.

Tables are those of the active version of ``Versions``; a purge is one swap to
a version without the expired rows and with the run's row in the audit, so that
rows and audit are gone and noted together or not at all.  Tables that lose no
row stay where they are.  After a failure the switch file is made, whatever
becomes of the audit, and runs are refused until someone has taken it away.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import without_children
from ..sources.lease import create_whole
from ..sources.versions import Versions

#: How long a row of the audit is kept.
AUDIT_MS = 400 * 24 * 3600 * 1000
AUDIT = "delete_run_id string, cutoff_at_ms long, attempted_count long, deleted_count long, failed_count long, status string, started_at_ms long, finished_at_ms long, expires_at_ms long"


class KillSwitch(RuntimeError):
    """A purge has failed and nobody has looked at it yet."""


@dataclass(frozen=True)
class Node:
    """A table that expires by ``expires``, at its instant and later; a row stays while a child table has a row of its ``key``."""

    name: str
    expires: str
    key: str | None = None
    children: tuple[str, ...] = ()


def in_order(graph: list[Node]) -> list[Node]:
    """Children before parents; ``ValueError`` if tables are each other's children or a child is not of the graph."""
    nodes, done, out = {n.name: n for n in graph}, set(), []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above or name not in nodes:
            raise ValueError(f"children of {above[-1] if above else name}: {name}")
        if name not in done:
            for child in nodes[name].children:
                visit(child, (*above, name))
            done.add(name)
            out.append(nodes[name])

    for n in graph:
        visit(n.name, ())
    return out


def split(tables: dict[str, DataFrame], graph: list[Node], now_ms: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(rows that stay, rows that go) of each table; parents see their children as they are left."""
    kept, gone = dict(tables), {}
    for node in in_order(graph):
        df = tables[node.name]
        due = F.coalesce(F.col(node.expires) <= F.lit(now_ms), F.lit(False))
        if not node.children:
            kept[node.name], gone[node.name] = df.where(~due), df.where(due)
            continue
        free = without_children(df.where(due).select(node.key).distinct(), node.key, [kept[c] for c in node.children])
        marked = df.join(free.withColumn("__free", F.lit(True)), node.key, "left").withColumn("__due", due & F.coalesce("__free", F.lit(False)))
        kept[node.name], gone[node.name] = (marked.where(c).select(*df.columns) for c in (~F.col("__due"), F.col("__due")))
    return kept, gone


def counts(gone: dict[str, DataFrame]) -> dict[str, int]:
    """Rows that go, by table, in one job."""
    parts = [df.select(F.lit(name).alias("table")) for name, df in gone.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return {r["table"]: r["count"] for r in every.groupBy("table").count().collect()}  # a row a table


def purge(spark: SparkSession, versions: Versions, graph: list[Node], run_id: str, switch: str, now_ms: int | None = None, before_delete: Callable[[], None] | None = None, audit: str = "delete_audit") -> dict:
    """Delete expired rows and note the run; ``KillSwitch`` if the switch is there."""
    now_ms = int(time.time() * 1000) if now_ms is None else now_ms
    if Path(switch).exists():
        raise KillSwitch(json.loads(Path(switch).read_text())["run_id"])
    attempted = 0

    def noted(deleted: int, failed: int, status: str) -> DataFrame:
        row = spark.createDataFrame([(run_id, now_ms, attempted, deleted, failed, status, now_ms, now_ms, now_ms + AUDIT_MS)], AUDIT)
        old = versions.read(spark, audit).where(F.col("expires_at_ms") > now_ms) if audit in versions.state()["active"]["tables"] else None
        return row if old is None else old.where(F.col("delete_run_id") != run_id).unionByName(row)

    try:
        tables = {n.name: versions.read(spark, n.name) for n in graph}
        kept, gone = split(tables, graph, now_ms)
        found = counts(gone)
        attempted = sum(found.values())
        if before_delete is not None:
            before_delete()
        versions.derive(f"purge {run_id}", {n: kept[n] for n in found} | {audit: noted(attempted, 0, "SUCCEEDED")})
        return {"status": "SUCCEEDED", "attempted": attempted, "deleted": attempted, "failed": 0, "by_table": found}
    except Exception:  # noqa: BLE001  whatever it was, later runs must not go on
        try:
            versions.derive(f"failed {run_id}", {audit: noted(0, attempted, "FAILED")})
        except Exception:  # noqa: BLE001  the switch matters more than the audit
            pass
        create_whole(Path(switch), json.dumps({"run_id": run_id, "reason": "DELETE_FAILED", "at_ms": now_ms}))
        return {"status": "FAILED_FINAL", "attempted": attempted, "deleted": 0, "failed": attempted, "by_table": {}}
