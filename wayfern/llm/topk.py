"""Exact top-k inner-product search by block-at-a-time pruning.

Vectors are quantised to integers and sorted by the nearest of some pivots and
the distance from it, so that rows that lie together follow each other.  Then
consecutive rows form document-range blocks; a block keeps a forward index (its vectors as one matrix) and the
largest and smallest value of each dimension.  For a query the sum over its
dimensions of the better of weight*largest and weight*smallest bounds every
score in the block.  A query visits blocks in descending order of that bound,
scores a block through its forward index, and stops when the next bound falls
below its k-th score so far.  Its k-th score among a bounded sample of rows is
where every query starts from in every shard.

Pivots and sample are at most ``SAMPLE`` rows, and ``SAMPLE_VALUES`` components,
of the smallest hashes.  They steer the order and the start only: any other
sample gives the same result.

Distribution: blocks are dealt to shards of ``SHARD_BYTES`` and queries to
groups of bounded size; each (shard, group) pair is one task's work and returns
at most k rows a query, from which a last step takes the best k.  What is moved
is blocks times query groups plus queries times shards; beside the sample
nothing is broadcast or collected.

Defined cases: vectors that are null, hold null or a non-finite component take
no part.  Scores are between vectors of the same length only.  Rows that share
the query's id are not its candidates; other repeated rows each are.  A query
id on several rows is searched with the smallest vector.  Ties go to the
smaller id.  Scores beyond a long are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, bytes of a shard's vectors and queries of a group.
BLOCK, SHARD_BYTES, GROUP = 128, 1 << 25, 1024
#: Rows and components of the sample, and pivots among its rows.
SAMPLE, SAMPLE_VALUES, PIVOTS = 1024, 1 << 20, 64
EXACT = 1 << 52
LONG = np.iinfo(np.int64)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *more: str) -> DataFrame:
    """``vec_id``, ``v`` and ``more`` columns: floor(scale * x) of every component, as doubles, for rows that take part."""
    raw = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.transform(raw, lambda x: x * F.lit(float(scale)))
    # floor() of a double gives a long, which large values would overflow
    v = F.transform(v, lambda x: F.when(F.abs(x) < F.lit(float(EXACT)), F.floor(x).cast("double")).otherwise(x))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & raw.isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), *more)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of one length as blocks: ids, vectors and bounds as bytes."""
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    waiting: dict[int, list] = {}

    def block(rows: list) -> dict:
        nonlocal number
        number += 1
        m = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        return {"dim": m.shape[1], "block": (part << 32) + number, "n": len(rows), "ids": np.array([r[0] for r in rows], np.int64).tobytes(), "m": m.tobytes(), "hi": m.max(0).tobytes(), "lo": m.min(0).tobytes()}

    for batch in batches:
        out = []
        for key, v in zip(batch["vec_id"], batch["v"], strict=True):
            rows = waiting.setdefault(len(v), [])
            rows.append((key, v))
            if len(rows) == BLOCK:
                out.append(block(rows))
                waiting[len(v)] = []
        if out:
            yield pd.DataFrame(out)
    if rest := [block(rows) for rows in waiting.values() if rows]:
        yield pd.DataFrame(rest)


def _product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles while all sums stay exact, else Python integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ m.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])(q) @ np.vectorize(int, otypes=[object])(m).T if q.shape[1] else np.zeros((len(q), len(m)), object)
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def nearest(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest pivot, squared distance from it) of each vector."""
    apart = (m * m).sum(1)[:, None] - 2 * (m @ pivots.T) + (pivots * pivots).sum(1)
    at = apart.argmin(1)
    return at, apart[np.arange(len(m)), at]


def kth_of_sample(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among the sample's other rows: its result holds nothing below."""
    scores = _product(q, m)
    scores[q_ids[:, None] == ids] = LONG.min
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(q_ids), LONG.min)


def search_blocks(q_ids: np.ndarray, q: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, start: np.ndarray | None = None) -> tuple[list[list[tuple[int, int]]], int]:
    """The best k (score, id) of each query within these blocks, and how many (query, block) pairs were scored.

    ``blocks``: (ids, vectors, largest, smallest of each dimension); ``start``:
    scores below which a query's rows are not wanted.
    """
    start = np.full(len(q_ids), LONG.min) if start is None else start
    best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    if not blocks or not len(q_ids):
        return best, 0
    hi, lo = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    bounds = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    # rounding must not lower a bound
    bounds += np.abs(bounds) * 1e-12 + (np.abs(q) @ np.maximum(np.abs(hi), np.abs(lo)).T) * 1e-12
    order = np.argsort(-bounds, axis=1, kind="stable")
    going, visited = np.arange(len(q_ids)), 0
    for step in range(len(blocks)):
        at = order[going, step]
        kth = np.array([max(start[i], best[i][-1][0]) if len(best[i]) == k else start[i] for i in going], np.float64)
        # a block at the bound itself may still hold a tie with a smaller id
        keep = bounds[going, at] >= kth
        going, at = going[keep], at[keep]
        if not len(going):
            break
        visited += len(going)
        for b in np.unique(at):
            rows = going[at == b]
            ids, m = blocks[b][:2]
            scores = _product(q[rows], m)
            for i, s in zip(rows, scores, strict=True):
                other = ids != q_ids[i]
                floor = max(start[i], best[i][-1][0]) if len(best[i]) == k else start[i]
                good = np.flatnonzero(other & (s >= floor))
                if len(good) > k:
                    good = good[np.lexsort((ids[good], -s[good]))[:k]]
                best[i] = sorted([*best[i], *zip(s[good].tolist(), ids[good].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
    return best, visited


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows for every row that ``is_query`` (a condition on ``vec_id``) selects."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale)
    sized = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.greatest(F.size(F.col(f"`{vec_col}`")), F.lit(0)).alias("dim"))
    n_rows, n_queries, n_values = sized.agg(F.count(F.lit(1)), F.coalesce(F.count_if(is_query), F.lit(0)), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(1, -(-8 * n_values // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, n_rows // BLOCK))
    groups = max(1, -(-n_queries // GROUP))
    n_sample = int(min(SAMPLE, max(PIVOTS, SAMPLE_VALUES * n_rows // max(1, n_values))))
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    taken = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(n_sample).collect()  # bounded by SAMPLE
    for dim in {len(r.v) for r in taken}:
        own = [r for r in taken if len(r.v) == dim]
        sample[dim] = np.array([r.vec_id for r in own], np.int64), np.array([r.v for r in own], np.float64).reshape(len(own), dim)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["pivot"], batch["apart"] = 0, 0.0
            dims = batch["v"].map(len)
            for dim in dims.unique():
                if dim in sample:
                    mine = dims == dim
                    batch.loc[mine, "pivot"], batch.loc[mine, "apart"] = nearest(np.stack([*batch.loc[mine, "v"]]).reshape(-1, dim), sample[dim][1][:PIVOTS])
            yield batch

    order = [F.size("v"), F.col("pivot"), F.col("apart"), F.col("vec_id")]
    near = rows.mapInPandas(placed, "vec_id long, v array<double>, pivot int, apart double")
    sorted_rows = near.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("vec_id", "v")
    packed = sorted_rows.mapInPandas(_blocks, "dim int, block long, n int, ids binary, m binary, hi binary, lo binary")
    left = packed.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    right = asked.withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).withColumn("dim", F.size("v")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
    schema = "query_id long, vec_id long, score long"

    def score(blocks: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(queries):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})
        q_ids = queries["vec_id"].to_numpy(np.int64)
        q = np.array([*queries["v"]], np.float64).reshape(len(q_ids), -1)
        dim = q.shape[1]
        unpacked = [
            (np.frombuffer(r.ids, np.int64), np.frombuffer(r.m, np.float64).reshape(r.n, dim), np.frombuffer(r.hi, np.float64), np.frombuffer(r.lo, np.float64))
            for r in blocks.itertuples(index=False)
        ]
        start = kth_of_sample(q_ids, q, *sample[dim], k) if dim in sample else None
        best, _ = search_blocks(q_ids, q, unpacked, k, start)
        flat = [(int(i), key, s) for i, rows in zip(q_ids, best, strict=True) for s, key in rows]
        return pd.DataFrame(flat, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    keys = ["shard", "grp", "dim"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
