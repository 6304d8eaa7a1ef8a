"""The corpus operators over small tables with nulls, repeats, ties and odd texts."""

import hashlib
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from wayfern.llm import bpe, decontam, lang_id, length_stats, line_dedup, near_dup, pii, queries, secret_scan, token_store, topk

# a column whose name clashes with what operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string"
LONG = " ".join(f"wort{i}" for i in range(300))
ROWS = [
    (1, LONG, "de", "s", 1, "x", None),
    (2, LONG, "de", "s", 1, "x", None),
    (2, LONG, "de", "s", 1, "x", None),
    (3, LONG.replace("wort7 ", "anders "), None, None, None, None, None),
    (4, None, None, None, None, None, None),
    (5, "", "en", "s", 0, "x", "y"),
    (6, " 12 !! ", "en", "s", 0, "x", "y"),
    (7, "the cat and the dog\n" + "a line of eight words that is shared here\nown end", "en", "s", 0, "x", "y"),
    (8, "quite another start\n" + "a line of eight words that is shared here\nother end", "en", "s", 0, "x", "y"),
    (None, "a row without an id", "en", "s", 0, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, empty):
    rows = bpe.encode_decode(docs, P.path(queries.BYTE_BPE), P.PATTERN).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    nothing = hashlib.sha256(b"").hexdigest()
    assert (by[4].n_tokens, by[4].ids_sha256, by[4].decoded_sha256) == (0, nothing, nothing) == (by[5].n_tokens, by[5].ids_sha256, by[5].decoded_sha256)
    assert by[1].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    path = P.path(queries.BYTE_BPE)
    back = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r[0], r[1] or "") for r in ROWS}
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0


def test_length_table(spark, empty):
    lengths = [0, 0, 3, 5, 5, 5, 2000, 4096]
    table = length_stats.suffix_table(length_stats.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")))
    for r in table.collect():
        limit = r.n_tokens
        assert r.n_docs == lengths.count(limit)
        assert (r.docs_at_least, r.tokens_at_least) == (sum(n >= limit for n in lengths), sum(n for n in lengths if n >= limit))
        assert (r.truncated_total, r.n_truncated) == (sum(min(n, limit) for n in lengths), sum(n > limit for n in lengths))
    got = {r.context_limit: (r.truncated_total, r.n_truncated) for r in length_stats.truncated_totals(table, [0, 4, 1024, 9999]).collect()}
    assert got == {c: (sum(min(n, c) for n in lengths), sum(n > c for n in lengths)) for c in (0, 4, 1024, 9999)}
    assert {r.probability: r.n_tokens for r in length_stats.quantiles(table, [0.1, 0.5, 1.0]).collect()} == {0.1: 0, 0.5: 5, 1.0: 4096}
    none = length_stats.suffix_table(length_stats.length_histogram(empty.select(F.lit(1).alias("n_tokens"))))
    assert none.count() == 0 and length_stats.truncated_totals(none, [5]).first().truncated_total == 0


def test_language(spark, docs, empty, sf_dir):
    real = queries.table(spark, sf_dir, "documents")
    model = lang_id.train(real.where(~queries.held_out()), P.path(queries.PIECES))
    got = lang_id.predict(real, model).join(real.select("doc_id", "lang"), "doc_id").where(queries.held_out())
    assert got.where(F.col("lang_pred") == F.col("lang")).count() >= 0.95 * got.count()
    rows = {r.doc_id: r for r in lang_id.predict(docs, model).collect()}
    assert rows[4].lang_pred == rows[5].lang_pred == rows[6].lang_pred == "und" and rows[4].score == 0.0
    assert all(0 <= r.score <= 1 for r in rows.values())
    nothing = lang_id.train(empty, P.path(queries.PIECES))
    assert {r.lang_pred for r in lang_id.predict(docs, nothing).collect()} == {"und"}
    assert lang_id.predict(empty, model).count() == 0


def test_scans(docs, empty):
    for scan in (secret_scan.scan, pii.scan):
        assert scan(docs).count() == len(ROWS) and scan(empty).count() == 0
    cleaned = pii.redact(docs.where("doc_id = 7").withColumn("text", F.lit("mail a@b.cd now"))).first()
    assert cleaned.text == "mail [email] now"


def test_topk(spark):
    v = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [2.0, -1.0]), (100, [0.1]), (200, [1.0, 1.0])]
    e = spark.createDataFrame([(*r, 1) for r in v], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(e, F.col("vec_id") % 100 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 1572864), (0, 2, 200, 1572864), (0, 3, 1, 1310720), (200, 1, 0, 1572864), (200, 2, 1, 1572864), (200, 3, 1, 1572864)]
    assert topk.top_k(e.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_near_duplicates(docs, empty, monkeypatch):
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, None: None}
    for short in (48, 1):
        monkeypatch.setattr(near_dup, "SHORT", short)
        rows = near_dup.near_duplicates(docs).collect()
        assert len(rows) == len(ROWS)
        assert {r.doc_id: r.component_id for r in rows} == want
        assert {r.doc_id for r in rows if r.kept} == {1, 4, 5, 6, 7, 8, None}
    assert near_dup.near_duplicates(empty).count() == 0


def test_line_dedup(docs, empty):
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[8].text == "quite another start\nother end" and by[8].gone == [1]
    assert by[7].gone is None and by[2].text == "" and by[1].text == LONG and by[4].text is None
    assert line_dedup.dedup_lines(empty).count() == 0


def test_decontamination(spark, docs, empty):
    item = "If a train travels from Paris at 60 km per hour for 3 hours then how far from Paris will the train be"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short words only here now")], "item_id long, text string")
    texts = [(10, "Before. " + item), (11, "x " + item.replace("60", "85").replace("Paris", "Lyon")), (12, item.replace("Paris", "Lyon", 1)), (13, "nothing of the kind"), (14, None), (15, "so short words only here now then")]
    got = {(r.doc_id, r.item_id): r.changed for r in decontam.find(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got[10, 1] is False and got[11, 1] is True and (15, 4) in got
    assert {d for d, _ in got} <= {10, 11, 12, 15}
    assert decontam.find(empty, bench).count() == 0 and decontam.find(docs, bench.limit(0)).count() == 0


def test_token_files(docs, empty):
    rows = token_store.store(docs, P.path(queries.WORD_BPE), n_parts=3, file_ids=400).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    end = zlib.crc32((1).to_bytes(4, "little"))
    assert [(r.n_tokens, r.ids_crc32) for r in rows if r.doc_id in (4, 5)] == [(1, end)] * 2
    assert token_store.store(empty, P.path(queries.WORD_BPE)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as C

    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == C.COLUMNS and docs.count() > 0
    ids = {r.doc_id for r in C.STAGES[-1][1](spark, docs, sf_dir).collect()}
    assert ids == {r.doc_id for r in docs.collect()} == {r.doc_id for r in C.run(spark, sf_dir).collect()}
