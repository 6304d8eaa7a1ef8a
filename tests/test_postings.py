"""The stored text index against plain BM25 over all documents."""

import random

import pytest

from wayfern.operators import fulltext, postings

SCHEMA = "review_id string, store_id string, normalized_body string, published_date string"


def documents(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(f"r{i:05}", f"s{i % 7}", " ".join(r.choices(words, weights, k=int(2 ** r.uniform(2, 8)))), f"2026-01-{i % 28 + 1:02}") for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = postings.TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    out.build(spark.createDataFrame(documents(4000), SCHEMA).repartition(4), "v1")
    return out


def plain(spark, rows, text, limit, stores=None):
    found = fulltext.search(spark.createDataFrame(rows, SCHEMA), text, limit, stores)
    return [(r.review_id, round(r.rank, 9)) for r in found.collect()]


@pytest.mark.parametrize(("text", "limit", "stores"), [("w0", 10, None), ("w3 w17", 5, None), ("w1 w2 w40", 100, ["s1", "s3"]), ("w399 w0", 20, None)])
def test_search_equals_plain_bm25(spark, index, text, limit, stores):
    found, facts = index.search("v1", text, limit, stores)
    assert [(r.review_id, round(r["rank"], 9)) for r in found.collect()] == plain(spark, documents(4000), text, limit, stores)
    # the folders of the terms only, and of common terms not even all blocks
    every = len(spark.read.parquet(f"{index.root}/v1/segment/postings").inputFiles())
    assert every >= 16 and facts["files"] <= every / 2
    if limit <= 10:
        assert facts["blocks_scored"] <= facts["blocks"] * (0.6 if text == "w0" else 0.9), facts


def test_files_that_hold_the_terms_are_the_only_ones_read(spark, index):
    assert len(index.postings("v1", ["w17"]).inputFiles()) <= 2 and index.postings("v1", ["zzz"]).count() == 0
    assert index.search("v1", "unheard w0", 5)[0].collect() == []
    with pytest.raises(ValueError):
        index.search("v1", "- - -")


def test_an_index_is_written_once_and_extended_without_rewriting(spark, index):
    rows = documents(4000)
    before = sorted(spark.read.parquet(f"{index.root}/v1/segment/postings").inputFiles())
    index.build(spark.createDataFrame([], SCHEMA), "v1")  # it is there already
    changed = [(a, b, c + " w17 w17", d) for a, b, c, d in rows[::50]]
    new = [("x1", "s1", "w3 w17", "2026-02-01")]
    removed = rows[::50] + rows[1::40]
    index.extend("v1", "v2", spark.createDataFrame(changed + new, SCHEMA), spark.createDataFrame(removed, SCHEMA))
    gone = {r[0] for r in removed}
    now = [r for r in rows if r[0] not in gone] + changed + new
    for text in ("w3 w17", "w0", "w17"):
        assert [(r.review_id, round(r["rank"], 9)) for r in index.search("v2", text, 30)[0].collect()] == plain(spark, now, text, 30)
    # back again in a third version: the newest form counts
    index.extend("v2", "v3", spark.createDataFrame(rows[:1], SCHEMA), spark.createDataFrame(changed[:1], SCHEMA))
    now = [r for r in now if r[0] != rows[0][0]] + rows[:1]
    assert [(r.review_id, round(r["rank"], 9)) for r in index.search("v3", "w17 w0", 100)[0].collect()] == plain(spark, now, "w17 w0", 100)
    assert [r.review_id for r in index.search("v1", "w3 w17", 5)[0].collect()] == [x for x, _ in plain(spark, rows, "w3 w17", 5)]
    assert sorted(spark.read.parquet(f"{index.root}/v1/segment/postings").inputFiles()) == before
