"""The adaptive area scan against small endpoints."""

import json

import pytest
from pyspark.sql import functions as F

from wayfern.sources import frontier, keyword

BOX = (126.0, 37.0, 127.0, 38.0)


def body(docs, pageable, end):
    return json.dumps({"meta": {"total_count": pageable, "pageable_count": pageable, "is_end": end}, "documents": docs})


def endpoint(asked, answer):
    def ask(requests):
        rows = [r.asDict() for r in requests.collect()]
        asked.extend((r["tile"], r["page"]) for r in rows)
        out = [(*(r[c] for c in frontier.REQUEST_COLUMNS), *answer(r)) for r in rows]
        return requests.sparkSession.createDataFrame(out, f"{frontier.REQUEST}, status int, json string")

    return ask


def test_only_saturated_tiles_are_asked_again(spark):
    asked: list = []
    docs = [{"id": f"p{i:03}", "place_name": "x"} for i in range(20)]

    def answer(r):
        if r["tile"] == "0":
            return 200, body(docs[:15], 675, False)
        if r["tile"] == "0.3":  # overlaps its neighbour
            return 200, body(docs[(r["page"] - 1) * 15 : r["page"] * 15], 20, r["page"] == 2)
        return 200, body(docs[:1] if r["tile"] == "0.1" else [], int(r["tile"] == "0.1"), True)

    status, tiles, pages = frontier.scan(spark, endpoint(asked, answer), BOX)
    assert status == "COMPLETE" and sorted(asked) == [("0", 1), ("0.0", 1), ("0.1", 1), ("0.2", 1), ("0.3", 1), ("0.3", 2)]
    assert {r.tile: (r.state, r.n_pages) for r in tiles.collect()} == {"0": ("SATURATED", 1), "0.0": ("DONE", 1), "0.1": ("DONE", 1), "0.2": ("DONE", 1), "0.3": ("DONE", 2)}
    seen = {r.id: r.tile for r in frontier.observations(pages, tiles).collect()}
    assert len(seen) == 20 and seen["p000"] == "0.1" and seen["p001"] == "0.3"
    south_east = pages.where("tile = '0.1' and page = 1").first()
    assert (south_east.west, south_east.south, south_east.east, south_east.north) == (126.5, 37.0, 127.0, 37.5)


def test_a_saturated_tile_of_the_last_depth_stays_partial(spark):
    asked: list = []
    status, tiles, pages = frontier.scan(spark, endpoint(asked, lambda r: (200, body([{"id": str(i)} for i in range(15)], 675, False))), BOX, depth=8, tile="deep")
    assert (status, asked, tiles.first().state) == ("PARTIAL", [("deep", 1)], "PARTIAL")
    asked.clear()
    status, tiles, _ = frontier.scan(spark, endpoint(asked, lambda r: (200, body([{"id": str(i)} for i in range(15)], 675, False))), BOX, max_depth=2)
    assert status == "PARTIAL" and len(asked) == 1 + 4 + 16
    assert {(r.state, r["count"]) for r in tiles.groupBy("state").count().collect()} == {("SATURATED", 5), ("PARTIAL", 16)}


@pytest.mark.parametrize(("answer", "want"), [((403, None), "STOPPED_ACCESS"), ((None, None), "PARTIAL"), ((200, "{"), "FAILED_FINAL"), ((500, None), "FAILED_FINAL")])
def test_errors_end_the_scan_and_keep_what_was_seen(spark, answer, want):
    asked: list = []

    def ask(r):
        return (200, body([{"id": "a"}] * 15, 675, False)) if r["tile"] == "0" else answer if r["tile"] == "0.2" else (200, body([{"id": r["tile"]}], 1, True))

    status, tiles, pages = frontier.scan(spark, endpoint(asked, ask), BOX)
    assert status == want and len(asked) == 5
    assert {r.id for r in frontier.observations(pages, tiles).collect()} == {"0.0", "0.1", "0.3"}
    assert {r.tile for r in tiles.where("state = 'REFUSED'").collect()} == {"0.2"}


def test_client_asks_in_tasks_and_keeps_the_key_to_itself(spark, capfd):
    from test_ingestion import Server

    server = Server({1: [(200, body([{"id": "a"}], 1, True))], 2: [(401, "secret body")]})
    server.server.RequestHandlerClass.do_GET = _by_page(server)
    ask = frontier.client(server.endpoint, "word", "key-not-to-log")
    requests = spark.createDataFrame([("0", 0, *BOX, 1), ("0", 0, *BOX, 2)], frontier.REQUEST)
    rows = keyword.checked(ask(requests)).orderBy("page").collect()
    assert [(r.status, r.error) for r in rows] == [(200, None), (401, "ACCESS_DENIED")]
    assert server.asked[0]["query"] == "word" and server.asked[0]["rect"] == "126.0,37.0,127.0,38.0"
    assert "key-not-to-log" not in f"{rows} {capfd.readouterr()}" and "secret body" not in str(rows)
    nobody = keyword.checked(frontier.client("http://127.0.0.1:9/", "w", "k", 0.5)(requests.where(F.col("page") == 1))).first()
    assert nobody.error == "NETWORK_ERROR"


def _by_page(server):
    from urllib.parse import parse_qs, urlparse

    def do_get(handler):
        asked = {k: v[0] for k, v in parse_qs(urlparse(handler.path).query).items()}
        server.asked.append(asked)
        status, text = (200, body([{"id": "a"}], 1, True)) if asked["page"] == "1" else (401, "secret body")
        handler.send_response(status)
        handler.end_headers()
        handler.wfile.write(text.encode())

    return do_get
