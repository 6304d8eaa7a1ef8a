"""Suffix dedup, whitening and hard negatives against brute force, and their odd inputs."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfern.llm import hard_negatives, queries, suffix_dedup, whiten

EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def _stripped(docs):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by comparing all strings of 50 bytes."""
    first = {}
    for d, text in docs:
        data = (text or "").encode()
        for p in range(len(data) - 49):
            first[data[p : p + 50]] = min(d, first.get(data[p : p + 50], d))
    for d, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first[data[p : p + 50]] < d:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield d, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def _texts(seed):
    r = random.Random(seed)
    words = ["été", "de", "a", "b", "the", "日本", "x" * 9, " ", "-" * 30]
    passages = [" ".join(r.choices(words, k=n)) for n in (8, 12, 15, 20, 40, 60)] + ["-" * 700, "ab" * 60]
    out = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choices(words, k=r.randint(1, 12))) for _ in range(r.randint(0, 4))]
        out.append((i * 3 % 100, r.choice(["", " ", "\n"]).join(parts)))
    return [*out, (200, None), (201, ""), (202, "x" * 49), (203, "x" * 50), (204, "x" * 50), (205, out[0][1])]


@pytest.mark.parametrize(("seed", "bucket_bytes", "hot"), [(1, 1 << 22, 4096), (2, 2000, 4096), (3, 2000, 2), (4, 1 << 22, 3)])
def test_suffix_dedup_equals_brute_force(spark, seed, bucket_bytes, hot):
    docs = _texts(seed)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bucket_bytes=bucket_bytes, hot_above=hot)
    assert sorted(map(tuple, got.drop("kept").collect())) == sorted(_stripped(docs))


def test_suffix_dedup_slices_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 100)
    text = np.frombuffer("".join(t or "" for _, t in _texts(9)).encode(), np.uint8)
    ends = np.array([40, 40, 300, 351, 5000, len(text)])
    first, n, place, hashes = suffix_dedup.segments(text, ends)
    covered = np.concatenate([np.arange(a, a + k) for a, k in zip(first, n, strict=True)])
    begins = np.concatenate([[0], ends[:-1]])
    assert covered.tolist() == [p for a, e in zip(begins, ends, strict=True) for p in range(a, e - 49)]
    assert all(a + o + suffix_dedup.TOKEN <= a + 50 for a, o in zip(first, place, strict=True))
    monkeypatch.undo()
    whole = "no doc_id here " * 9
    docs = spark.createDataFrame([(None, whole, 1), (7, whole, 2), (7, whole, 2), (8, whole, 3), (7, "y" + whole, 4)], "doc_id long, text string, d int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_substrings(docs).collect())
    assert got == [(0, 135, 0), (7, 135, 0), (7, 135, 0), (7, 136, 0), (8, 135, 135)]
    assert suffix_dedup.dedup_substrings(docs.where("false")).collect() == []


def _plain_whitening(x):
    y = x - x.mean(0)
    values, vectors = np.linalg.eigh(y.T @ y / len(y))
    return y @ vectors[:, ::-1] / np.sqrt(values[::-1]), values[::-1] / values.sum()


def test_whitening_of_the_table(spark, sf_dir):
    got = queries.op12_whitening(spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.stack(rows.embedding).astype(float))
    want, share = _plain_whitening(x)
    n, whole = len(x), x.astype(int) + 1_000_000
    deviation = dict(zip(rows.vec_id, ((n * whole - whole.sum(0)) ** 2).sum(1), strict=True))
    z = got.pivot(index="vec_id", columns="component", values="whitened").loc[rows.vec_id].to_numpy()
    assert z.shape == (n, 32) and np.allclose(np.abs(z), np.abs(want[:, :32]), atol=1e-6)
    assert np.allclose(got.groupby("component").explained.first(), share[:32], rtol=1e-8)
    assert (got.deviation == got.vec_id.map(deviation)).all() and (got.n == n).all() and got.identity_error.max() < 1e-9


def test_whitening_is_exact_for_large_entries(spark):
    """Entries so large that doubles lose the covariance, which residues do not."""
    r = random.Random(5)
    x = [[r.randrange(1 << 44), (1 << 44) + r.randrange(2), r.randrange(4)] for _ in range(60)]
    rows = spark.createDataFrame([(i, [c / 64 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    fits = whiten.fit_lists(whiten.finite_vectors(rows, "vec_id", "embedding"), 64, 1_000_000)
    found = whiten.exact_scatters(whiten.finite_vectors(rows, "vec_id", "embedding"), fits, 64, 1_000_000)[3]
    sums = [sum(v[i] + 1_000_000 for v in x) for i in range(3)]
    y = [[60 * (c + 1_000_000) - s for c, s in zip(v, sums, strict=True)] for v in x]
    assert found == [[sum(v[i] * v[j] for v in y) for j in range(3)] for i in range(3)]


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [3.0, 2.0], 0), (3, None, 0), (4, [None, 1.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (None, [9.0, 9.0], 0), (7, [], 0), (8, [1.0], 0), (9, [1e30], 0)]
    got = whiten.whiten(spark.createDataFrame(rows, EMBEDDINGS)).collect()
    # the constant second dimension has no component; one number to a vector is a fit list of its own
    assert sorted((r.vec_id, r.component, r.n) for r in got) == [(1, 1, 3), (1, 1, 3), (2, 1, 3), (8, 1, 2), (9, 1, 2)]
    assert [r.explained for r in got] == [1.0] * 5 and max(r.identity_error for r in got) < 1e-9
    # n*x - S is -64, -64, ... with x = 1000064, 1000064, 1000192
    assert {r.vec_id: r.deviation for r in got if r.vec_id < 3} == {1: 128**2, 2: 256**2}
    assert whiten.whiten(spark.createDataFrame([], EMBEDDINGS)).collect() == []
    assert whiten.whiten(spark.createDataFrame(rows[:2], EMBEDDINGS)).collect() == []


def _duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    return con


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives_equal_sql(spark, tmp_path, seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, 6))
    rows = [(int(i), (base[i % 12] + r.normal(size=6) * (0.02 if seed else 0.4)).astype(np.float32).tolist(), None if i % 97 == 5 else int(i % 12) % 10) for i in range(1500)]
    rows += [(1500 + i, rows[0][1], 3) for i in range(250)] + [(2000, None, 1), (2100, [None] * 6, 1), (2200, [float("nan")] * 6, 1)]
    spark.createDataFrame(rows, EMBEDDINGS).repartition(6).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    con = _duck(rows)
    want = con.execute(queries.oracle_sql()["op13_hard_negatives"]).fetchall()
    assert len(want) > 50 and sorted(map(tuple, got.collect())) == sorted(want)


def test_hard_negatives_of_odd_tables(spark):
    label = F.col("label")
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.5], 2), (4, [-1.0], 1), (None, [1.0], 2), (5, [1.0], None), (6, [1.0, 2.0], 1), (7, [0.9], 2)]
    df = spark.createDataFrame(rows, EMBEDDINGS).withColumn("anchor_id", F.lit("clash"))
    got = sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") == 0, label).collect()))
    assert got == [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 7, 65536, 58880)]
    assert hard_negatives.hard_negatives(df.where("false"), F.col("vec_id") == 0, label).collect() == []


def test_annuli_leave_blocks_unread():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 300
    m = np.floor(np.repeat(centres, 100, axis=0) + r.normal(size=(4000, 16)) * 10)
    length2 = float((m * m).sum(1).max())
    pivots = np.column_stack([m[::100], np.sqrt(np.maximum(length2 - (m[::100] ** 2).sum(1), 0))])
    at, key = hard_negatives.keys(m, length2, pivots)
    rows = hard_negatives.Annuli(np.arange(4000), np.arange(4000) // 100, m, at, key, pivots, length2)
    q = m[50::400]
    ids, one = np.arange(50, 4000, 400), np.ones(10, np.int64)
    w, place, scored = hard_negatives.search(rows, ids, ids // 100, q, True, np.arange(10), one * hard_negatives.LONG.min, one * hard_negatives.LONG.max, 5)
    for i in range(10):
        s = (m @ q[i]).astype(np.int64)
        own = [x for x in range(4000) if x // 100 == ids[i] // 100 and x != ids[i]]
        assert rows.ids[place[w == i]].tolist() == sorted(own, key=lambda x: (-s[x], x))[:5]
    assert scored < 0.5 * 10 * len(rows.first)
