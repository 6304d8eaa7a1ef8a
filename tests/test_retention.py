"""Purges with audit and switch, and migrations of stored tables."""

import pytest
from pyspark.sql import functions as F

from wayfern.plans import retention
from wayfern.plans.retention import Node
from wayfern.sources.versions import SchemaUnknown, Versions

DAY = 24 * 3600 * 1000
NOW = 1000 * DAY
GRAPH = [Node("run", "expires_at_ms", "run_id", ("raw", "place")), Node("place", "expires_at_ms", "place_id", ("raw", "locator")), Node("raw", "keep_until_ms"), Node("locator", "delete_by_ms"), Node("seen", "expires_at_ms")]
SOURCE = {"basis_date": "2026-07-24", "downloaded_at_ms": 1, "snapshot_id": "s"}


def store(spark, tmp_path, raw=((1, 1, 1, NOW), (2, 1, 2, NOW + 1)), seen=(("a", NOW), ("b", NOW + 1))):
    v = Versions(str(tmp_path / "app"))
    frame = spark.createDataFrame
    tables = {
        "raw": frame(list(raw), "id long, run_id long, place_id long, keep_until_ms long"),
        "locator": frame([(1, NOW), (3, NOW + 5)], "place_id long, delete_by_ms long"),
        "place": frame([(1, NOW), (2, NOW), (3, NOW), (4, None)], "place_id long, expires_at_ms long").withColumn("run_id", F.lit(1).cast("long")),
        "run": frame([(1, NOW), (9, NOW), (8, NOW + 1)], "run_id long, expires_at_ms long"),
        "seen": frame(list(seen), "fingerprint string, expires_at_ms long"),
        "other": frame([(1,)], "x int"),
    }
    v.publish(tables, SOURCE)
    return v


def rows(spark, v, name, column):
    return sorted(r[column] for r in v.read(spark, name).select(column).collect())


def test_rows_go_at_their_instant_and_parents_stay_while_a_child_does(spark, tmp_path):
    v = store(spark, tmp_path)
    before = v.state()["active"]
    found = retention.purge(spark, v, GRAPH, "p1", str(tmp_path / "switch"), NOW)
    assert found == {"status": "SUCCEEDED", "attempted": 5, "deleted": 5, "failed": 0, "by_table": {"raw": 1, "locator": 1, "seen": 1, "place": 1, "run": 1}}
    assert [rows(spark, v, *x) for x in (("raw", "id"), ("locator", "place_id"), ("place", "place_id"), ("run", "run_id"), ("seen", "fingerprint"))] == [[2], [3], [2, 3, 4], [1, 8], ["b"]]
    audit = v.read(spark, "delete_audit").collect()
    assert [(a.delete_run_id, a.attempted_count, a.deleted_count, a.status, a.expires_at_ms - NOW) for a in audit] == [("p1", 5, 5, "SUCCEEDED", 400 * DAY)]
    assert v.state()["active"]["tables"]["other"]["at"] == before["version"]  # not written again
    assert all(v.verify(spark).values())
    # the audit's own rows go after 400 days
    later = retention.purge(spark, v, GRAPH, "p2", str(tmp_path / "switch"), NOW + 400 * DAY)
    assert later["status"] == "SUCCEEDED" and [r.delete_run_id for r in v.read(spark, "delete_audit").collect()] == ["p2"]
    assert rows(spark, v, "place", "place_id") == [4] and rows(spark, v, "run", "run_id") == [1]  # place 4 never expires


def test_expired_state_leaves_retained_rows_alone(spark, tmp_path):
    v = store(spark, tmp_path, raw=[(1, 1, 1, NOW + 9)], seen=[("a", NOW - 1)])
    found = retention.purge(spark, v, [n for n in GRAPH if n.name == "seen"], "p", str(tmp_path / "switch"), NOW)
    assert found["by_table"] == {"seen": 1} and rows(spark, v, "raw", "id") == [1]
    assert retention.purge(spark, v, [n for n in GRAPH if n.name == "seen"], "q", str(tmp_path / "switch"), NOW)["deleted"] == 0


def test_a_failure_deletes_nothing_is_noted_and_stops_later_runs(spark, tmp_path):
    v, switch = store(spark, tmp_path), str(tmp_path / "switch")

    def broken():
        raise RuntimeError("secret text")

    found = retention.purge(spark, v, GRAPH, "bad", switch, NOW, broken)
    assert (found["status"], found["attempted"], found["deleted"], found["failed"]) == ("FAILED_FINAL", 5, 0, 5)
    assert rows(spark, v, "raw", "id") == [1, 2]
    row = v.read(spark, "delete_audit").first()
    assert (row.delete_run_id, row.status, row.failed_count) == ("bad", "FAILED", 5) and "secret" not in str(row) + (tmp_path / "switch").read_text()
    with pytest.raises(retention.KillSwitch, match="bad"):
        retention.purge(spark, v, GRAPH, "next", switch, NOW)
    (tmp_path / "switch").unlink()
    assert retention.purge(spark, v, GRAPH, "next", switch, NOW)["deleted"] == 5
    assert sorted(r.status for r in v.read(spark, "delete_audit").collect()) == ["FAILED", "SUCCEEDED"]


def test_the_switch_is_made_even_if_the_audit_cannot_be_written(spark, tmp_path, monkeypatch):
    v, switch = store(spark, tmp_path), tmp_path / "switch"
    monkeypatch.setattr(v, "derive", lambda *a, **b: (_ for _ in ()).throw(OSError("disk")))
    assert retention.purge(spark, v, GRAPH, "bad", str(switch), NOW)["status"] == "FAILED_FINAL"
    assert switch.exists() and "delete_audit" not in v.state()["active"]["tables"]


def test_tables_that_are_each_others_children_are_refused():
    assert [n.name for n in retention.in_order(GRAPH)] == ["raw", "locator", "place", "run", "seen"]
    with pytest.raises(ValueError, match="children"):
        retention.in_order([Node("a", "e", "k", ("b",)), Node("b", "e", "k", ("a",))])


def _two_names(tables):
    return {"seen": tables["seen"].withColumn("kind", F.lit("v1"))}


def _renamed(tables):
    return {"places": tables["place"].withColumnRenamed("place_id", "id"), "place": None}


def test_migrations_run_once_in_order_and_restore_older_backups(spark, tmp_path):
    v = store(spark, tmp_path)
    old = v.backup(spark, str(tmp_path / "backup"))
    with pytest.raises(ZeroDivisionError):
        v.migrate(spark, [_two_names, lambda t: 1 // 0])
    assert v.state()["active"]["schema"] == 1 and v.read(spark, "seen").columns == ["fingerprint", "expires_at_ms", "kind"]
    assert v.migrate(spark, [_two_names, _renamed])["schema"] == 2
    assert "place" not in v.state()["active"]["tables"] and v.read(spark, "places").columns[0] == "id" and all(v.verify(spark).values())
    generation = v.state()["generation"]
    assert v.migrate(spark, [_two_names, _renamed])["schema"] == 2 and v.state()["generation"] == generation
    with pytest.raises(SchemaUnknown):
        v.migrate(spark, [_two_names])
    back = old.restore(spark, str(tmp_path / "restored"))
    assert back.state()["active"].get("schema", 0) == 0
    back.migrate(spark, [_two_names, _renamed])
    assert back.read(spark, "places").count() == 4 and all(back.verify(spark).values())
    again = v.backup(spark, str(tmp_path / "copy"))
    assert all(again.verify(spark).values()) and again.read(spark, "other").count() == 1
