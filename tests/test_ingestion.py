"""The page source, ingestion page by page, leases and manifests that survive a crash."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from test_tables_and_sources import item, page
from wayfern.plans import runs
from wayfern.sources import ledger, paged
from wayfern.sources.lease import Fenced, Held, Lease
from wayfern.sources.versions import Conflict, Versions
from wayfern.streaming import ingest

PAGES = [page(1, [item("S1"), item("S2")]), page(2, {"item": [item("B1", ROAD_NM_ADDR="부산광역시 중구 1"), item("S3", OWNER_NM="secret")]})]
SECRET = "do-not-log-this-key"


class Server:
    """A local endpoint: ``answers`` by page, each a list of (status, text) for its attempts."""

    def __init__(self, answers):
        self.asked: list[dict] = []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                outer.asked.append(asked)
                answer = answers.get(int(asked["pageNo"]), [(404, "")])
                status, text = answer.pop(0) if len(answer) > 1 else answer[0]
                self.send_response(status)
                self.end_headers()
                self.wfile.write(text.encode())

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @property
    def endpoint(self):
        return f"http://127.0.0.1:{self.server.server_port}/info"


def test_pages_are_read_once_each_with_the_asked_parameters(spark):
    server = Server({i + 1: [(200, p)] for i, p in enumerate(PAGES)})
    rows = sorted(paged.read_pages(spark, server.endpoint, 2, serviceKey=SECRET, pagesPerTask=1).collect())
    assert [(r.page_no, r.total, r.n_rows, r.attempts, r.error) for r in rows] == [(1, 4, 2, 1, None), (2, 4, 2, 1, None)]
    assert sorted((a["pageNo"], a["numOfRows"], a["returnType"], a["serviceKey"]) for a in server.asked) == [("1", "2", "json", SECRET), ("2", "2", "json", SECRET)]
    assert ledger.rows(ledger.decode(spark.createDataFrame(rows, paged.SCHEMA))).count() == 4


def test_errors_are_codes_without_the_key_or_the_body(spark, capfd):
    server = Server({1: [(429, '{"private": "full response body"}')]})
    scan = paged.read_pages(spark, server.endpoint, 10, serviceKey=SECRET, waitMs=1, attempts=2)
    scan.explain(True)
    rows = scan.collect()
    assert [(r.page_no, r.attempts, r.error, r.json) for r in rows] == [(1, 2, "HTTP_ERROR", None)]
    with pytest.raises(paged.PageError, match="HTTP_ERROR") as e:
        paged.whole(spark.createDataFrame(rows, paged.SCHEMA))
    said = f"{e.value} {rows} {capfd.readouterr()}"
    assert SECRET not in said and "full response body" not in said


def test_each_page_has_its_own_error_and_bounded_attempts(spark):
    many = [page(i, [item(f"S{i}"), item(f"T{i}")], 14) for i in range(1, 8)]
    answers = {i: [(200, p)] for i, p in enumerate(many, 1)}
    answers |= {2: [(503, ""), (200, many[1])], 3: [(500, "")], 4: [(200, "{")], 5: [(200, many[5])], 6: [(200, page(6, [item("x")] * 3, 14))], 7: [(403, "")]}
    server = Server(answers)
    rows = paged.read_pages(spark, server.endpoint, 2, waitMs=1, pagesPerTask=2).collect()
    assert {r.page_no: (r.attempts, r.error) for r in rows} == {1: (1, None), 2: (2, None), 3: (3, "HTTP_ERROR"), 4: (1, "RESPONSE_INVALID"), 5: (1, "PAGE_MISMATCH"), 6: (1, "PAGINATION_INVALID"), 7: (1, "HTTP_ERROR")}
    nobody = paged.read_pages(spark, "http://127.0.0.1:9/", 2, waitMs=1, timeoutMs=500).collect()
    assert [(r.attempts, r.error) for r in nobody] == [(3, "NETWORK_ERROR")]


TWO = [item("a"), item("b")]


@pytest.mark.parametrize(
    ("pages", "error"),
    [([page(1, TWO, 4)], "HTTP_ERROR"), ([page(1, TWO, 3), page(2, [item("c")], 4)], "PAGINATION_INVALID"), ([page(1, TWO, 2).replace('"00"', '"22"')], "RESPONSE_INVALID"), ([page(1, TWO, 4), page(2, [item("c")], 4)], "PAGINATION_INVALID")],
)
def test_a_scan_that_is_not_whole_is_refused(spark, tmp_path, pages, error):
    for i, p in enumerate(pages, 1):
        (tmp_path / f"page-{i}.json").write_text(p)
    found = spark.createDataFrame(paged.read_pages(spark, str(tmp_path), 2).collect(), paged.SCHEMA)
    with pytest.raises(paged.PageError, match=error):
        paged.whole(found)


def _landed(spark, tmp_path, texts, name="landed"):
    pages = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "page_no long, json string")
    ingest.land(pages, f"{tmp_path}/{name}")
    return f"{tmp_path}/{name}", ingest.snapshot("2026-07-24", pages)["snapshot_id"]


def _tables(run):
    return {n: sorted(map(str, run.read(n).collect())) for n in ("source_rows", "staged", "issues", "checkpoints")}


def test_ingestion_counts_and_runs_again(spark, tmp_path):
    landed, snapshot = _landed(spark, tmp_path, PAGES)
    run = ingest.Ingestion(spark, f"{tmp_path}/root", snapshot)
    first = run.run(landed, pages_a_trigger=1)
    assert {k: first[k] for k in ("status", "n_pages", *ingest.COUNTS)} == {"status": "SUCCEEDED", "n_pages": 2, "n_read": 4, "n_inserted": 3, "n_updated": 0, "n_rejected": 1}
    assert sorted((r.page_no, r.n_read, r.n_inserted, r.n_updated, r.n_rejected, r.last_key) for r in run.read("checkpoints").collect()) == [(1, 2, 2, 0, 0, "3010000:S2"), (2, 2, 1, 0, 1, "3010000:S3")]
    before = _tables(run)
    payloads = [r.payload_json for r in run.read("source_rows").collect()]
    assert len(payloads) == 4 and not any("OWNER_NM" in p or "secret" in p or "dropped" in p for p in payloads)
    second = run.run(landed, pages_a_trigger=1)
    assert (second["run_id"], second["attempt"], second["n_inserted"], second["n_updated"], second["n_rejected"]) == (first["run_id"], 2, 0, 0, 1)
    counts = lambda t: {k: v for k, v in t.items() if k != "checkpoints"}
    assert counts(_tables(run)) == counts(before)


def test_a_run_of_many_pages_has_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_BATCHES", 2)
    landed, snapshot = _landed(spark, tmp_path, [page(i, [item(f"S{i}")], 5) for i in range(1, 6)])
    run = ingest.Ingestion(spark, f"{tmp_path}/root", snapshot)
    assert run.run(landed, pages_a_trigger=1)["n_inserted"] == 5 and len(run.commits()) == 2


def test_a_drifted_staged_row_is_repaired_as_an_update(spark, tmp_path):
    landed, snapshot = _landed(spark, tmp_path, PAGES)
    run = ingest.Ingestion(spark, f"{tmp_path}/root", snapshot)
    run.run(landed)
    commit = run.commits()[0]
    held = spark.read.parquet(commit["tables"]["staged"])
    whole = spark.createDataFrame(held.collect(), held.schema)
    whole.withColumn("business_name", F.when(F.col("mng_no") == "S1", "tampered").otherwise(F.col("business_name"))).write.mode("overwrite").parquet(commit["tables"]["staged"])
    again = run.run(landed)
    assert (again["n_inserted"], again["n_updated"], again["n_rejected"]) == (0, 1, 1)
    assert {r.mng_no: r.business_name for r in run.read("staged").collect()} == dict.fromkeys(("S1", "S2", "S3"), "한강 빵집")


@pytest.mark.parametrize("committed", [False, True])
def test_a_run_that_was_cut_off_goes_on_behind_its_last_commit(spark, tmp_path, monkeypatch, committed):
    """Cut off between writing the third page and its commit, or between its commit and the stream's own note."""
    texts = [page(i, [item(f"S{i}"), item(f"T{i}")], 8) for i in range(1, 5)]
    landed, snapshot = _landed(spark, tmp_path, texts)
    whole = ingest.Ingestion(spark, f"{tmp_path}/whole", snapshot)
    whole.run(landed, pages_a_trigger=1)
    cut, make = ingest.Ingestion(spark, f"{tmp_path}/cut", snapshot), ingest.create_whole

    def breaking(path, text):
        if path.name != "batch-2":
            return make(path, text)
        if committed:
            make(path, text)
        raise RuntimeError("cut off")

    monkeypatch.setattr(ingest, "create_whole", breaking)
    with pytest.raises(Exception, match="cut off"):
        cut.run(landed, pages_a_trigger=1)
    monkeypatch.undo()
    left = cut.commits()
    # what was written but not committed does not exist
    assert (len(left), cut.run_state()["status"], cut.read("source_rows").count()) == (2 + committed, "RUNNING", 4 + 2 * committed)
    state = cut.run(landed, pages_a_trigger=1)
    assert (state["attempt"], state["n_pages"], state["n_read"], state["n_inserted"]) == (1, 4, 8, 8)
    assert len(cut.commits()) == 4 and cut.commits()[: len(left)] == left and _tables(cut) == _tables(whole)


def test_a_changed_row_of_one_snapshot_stops_the_run(spark, tmp_path):
    landed, snapshot = _landed(spark, tmp_path, PAGES)
    run = ingest.Ingestion(spark, f"{tmp_path}/root", snapshot)
    run.run(landed)
    before = _tables(run)
    drifted, _ = _landed(spark, tmp_path, [PAGES[0].replace("양화로 1", "양화로 2"), PAGES[1]], "drifted")
    with pytest.raises(ingest.ImmutableRow):
        run.run(drifted)
    assert _tables(run) == before and run.run_state()["status"] == "FAILED_FINAL"
    twice, other = _landed(spark, tmp_path, [page(1, [item("S1"), item("S1", BPLC_NM="other")], 2)], "twice")
    with pytest.raises(ingest.ImmutableRow):
        ingest.Ingestion(spark, f"{tmp_path}/root", other).run(twice)
    broken, third = _landed(spark, tmp_path, ["{}"], "broken")
    with pytest.raises(ingest.PageRefused):
        ingest.Ingestion(spark, f"{tmp_path}/root", third).run(broken)


def test_a_run_that_lost_its_lease_commits_nothing(spark, tmp_path):
    now = [0]
    landed, snapshot = _landed(spark, tmp_path, PAGES)
    run = ingest.Ingestion(spark, f"{tmp_path}/root", snapshot)
    slow, fast = (Lease(str(tmp_path / "lease"), ttl_ms=100, clock=lambda: now[0]) for _ in range(2))
    slow.acquire("slow")
    now[0] = 200
    fast.acquire("fast")
    with pytest.raises(Fenced):
        run.run(landed, lease=slow)
    assert run.commits() == []
    assert run.run(landed, lease=fast)["n_read"] == 4


def test_lease_is_taken_over_when_its_holder_dies(tmp_path):
    now = [1000]
    a, b = (Lease(str(tmp_path), ttl_ms=50, clock=lambda: now[0]) for _ in range(2))
    assert a.acquire("a") == 1
    with pytest.raises(Held, match="a"):
        b.acquire("b")
    now[0] += 49
    a.renew()
    now[0] += 49
    with pytest.raises(Held):
        b.acquire("b")
    now[0] += 1
    assert b.acquire("b") == 2 and b.check() == 2
    with pytest.raises(Fenced):
        a.check()
    a.release()  # must not end its follower's lease
    assert b.check() == 2
    b.release()
    with pytest.raises(Fenced):
        b.check()
    assert a.acquire("a") == 3
    clock = lambda: now[0]
    lost = runs.single_run(str(tmp_path / "runs"), "killed", 50, clock)
    lost.__enter__()
    with pytest.raises(runs.RunActive, match="killed"), runs.single_run(str(tmp_path / "runs"), "next", 50, clock):
        pass
    now[0] += 51
    with runs.single_run(str(tmp_path / "runs"), "next", 50, clock) as lease:
        lease.renew()


def test_publishing_survives_a_crash_and_goes_back(spark, tmp_path, monkeypatch):
    v = Versions(str(tmp_path / "app"))
    source = {"basis_date": "2026-07-24", "downloaded_at_ms": 5, "snapshot_id": "a"}
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    a = v.publish({"t": one}, source)
    monkeypatch.setattr("wayfern.sources.lease.os.link", lambda *x: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        v.publish({"t": two}, source | {"snapshot_id": "b"})
    monkeypatch.undo()
    assert v.state()["active"] == a
    v.publish({"t": two}, source | {"snapshot_id": "b"})
    assert v.read(spark, "t").first().x == 2
    with pytest.raises(Conflict):  # a publisher that read the state before b
        v._swap({"active": a, "history": [a]}, 1)
    from wayfern.sources.versions import StaleSource

    with pytest.raises(StaleSource):
        v.publish({"t": one}, source)
    # the same order of source: going back makes the earlier tables active again
    c = v.publish({"t": one}, source | {"snapshot_id": "b", "note": "c"})
    assert v.publish({"t": two}, source | {"snapshot_id": "b"}) == v.state()["active"] != c
    assert v.read(spark, "t").first().x == 2
    now = [0]
    lease, other = (Lease(str(tmp_path / "lease"), ttl_ms=10, clock=lambda: now[0]) for _ in range(2))
    lease.acquire("slow")
    now[0] = 20
    other.acquire("next")
    with pytest.raises(Fenced):
        Versions(str(tmp_path / "app"), lease=lease).publish({"t": one}, source | {"basis_date": "2026-08-01"})
    assert Versions(str(tmp_path / "app"), lease=other).publish({"t": one}, source | {"basis_date": "2026-08-01"})["version"] == v.state()["active"]["version"]
