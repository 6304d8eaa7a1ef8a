"""Hard negatives by one-dimensional distance keys.

Vectors are quantised to integers and augmented by one component that gives all
of them the same length M: the inner product of a query q with a row is then
(|q|^2 + M^2 - d^2) / 2 for the distance d of their augmented vectors, so the
best scores are the nearest rows.  Each row belongs to the nearest of some
pivots, its key is (pivot, distance from it), and rows are written once, sorted
by that key.  A row at distance r or less from a query lies in one annulus of
each pivot, an interval of its keys.

A search expands those intervals: rows of a shard form ``BLOCK`` neighbouring
keys each, the interval of a block bounds the distance of all its rows from
below, and rounds take the blocks in the order of that bound, twice as many in
each.  After a round the bound of the next block, turned into a score, certifies
what is found: a query ends when all rows that are left score less than its
k-th row, or less than its window of scores.

First each anchor's best ``positives`` rows of its own label are found; then,
for each of their scores s, the best ``negatives`` rows of other labels with
scores from ``low`` to ``high`` hundredths of s.

Distribution: sorted rows are dealt to shards of ``SHARD_BYTES`` by ranges of
keys and anchors to groups of ``GROUP``; a (shard, group) pair is one task's
work and returns at most k rows for a window, of which a last step takes the
best.  No label, pivot or vector is in one place: a hot label's rows are spread
by their keys, and equal keys by their ids.  Only the pivots (``PIVOTS`` rows of
the smallest hashes, which steer the order, not the result) go to the driver.

Defined cases: rows whose id, label or vector is null, or whose vector holds
null or a non-finite component, take no part.  Scores are between vectors of
the same length only.  Rows that share the anchor's id are not its candidates;
other repeated rows each are.  An anchor id on several rows is taken with the
smallest label and vector.  Ties go to the smaller id.  A negative score of a
positive leaves an empty window, and such pairs have no row.  Scores beyond a
long are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .topk import LONG, _product, quantised

#: Vectors of a block, bytes of a shard's vectors, anchors of a group, rows taken as pivots.
BLOCK, SHARD_BYTES, GROUP, PIVOTS = 128, 1 << 25, 1024, 64


def keys(m: np.ndarray, length2: float, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance from it) of augmented vectors; ``pivots`` are augmented."""
    extra = np.sqrt(np.maximum(length2 - (m * m).sum(1), 0.0))
    apart = length2 - 2 * (m @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]) + (pivots * pivots).sum(1)
    at = apart.argmin(1)
    return at, np.sqrt(np.maximum(apart[np.arange(len(m)), at], 0.0))


class Annuli:
    """A shard's rows of one length: blocks of neighbouring keys."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, pivot: np.ndarray, key: np.ndarray, pivots: np.ndarray, length2: float):
        order = np.lexsort((ids, key, pivot))
        self.ids, self.labels, self.m = ids[order], labels[order], m[order]
        self.pivots, self.length2 = pivots, length2
        pivot, key = pivot[order], key[order]
        cuts = np.flatnonzero(np.diff(pivot, prepend=-1))
        edges = [np.arange(a, b, BLOCK) for a, b in zip(cuts, [*cuts[1:], len(pivot)], strict=True)]
        self.first = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], len(pivot))
        self.pivot, self.low, self.high = pivot[self.first], key[self.first], key[self.end - 1]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest score that each block may hold for each query, rounded up."""
        q2 = (q * q).sum(1)
        d = np.sqrt(np.maximum(q2[:, None] - 2 * (q @ self.pivots[:, :-1].T) + (self.pivots * self.pivots).sum(1), 0.0))[:, self.pivot]
        slack = 1e-7 * (d + self.high + 1)
        least = np.maximum(np.maximum(d - self.high, self.low - d) - slack, 0.0)
        whole = q2[:, None] + self.length2
        return (whole - least * least) / 2 + 1e-9 * whole + 1


def search(rows: Annuli, q_ids: np.ndarray, q_labels: np.ndarray, q: np.ndarray, same: bool, window_of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k rows of each window: (windows, rows' places, and how many (query, block) pairs were scored).

    Window w belongs to query ``window_of[w]`` (ascending) and takes rows of
    the query's label (``same``) or of others, with scores from ``low[w]`` to
    ``high[w]``.
    """
    none = np.zeros(0, np.int64)
    if not len(rows.first) or not len(window_of):
        return none, none, 0
    bounds = rows.bounds(q)
    order = np.argsort(-bounds, axis=1, kind="stable")
    n_blocks, at, step, scored = order.shape[1], 0, 4, 0
    windows, places, scores = none, none, none
    floor = low.copy()  # scores below which a window wants nothing
    going = np.ones(len(window_of), bool)
    starts = np.searchsorted(window_of, np.arange(len(q) + 1))
    n_windows = np.diff(starts)
    while at < n_blocks and going.any():
        asked = np.unique(window_of[going])
        part = order[asked, at : at + step]
        # only blocks that may still hold a row at or above the query's lowest floor
        lowest = np.full(len(q), LONG.max)
        np.minimum.at(lowest, window_of[going], floor[going])
        wanted = bounds[asked[:, None], part] >= lowest[asked][:, None]
        scored += int(wanted.sum())
        found_q, found_row, found_score = [none], [none], [none]
        for b in np.unique(part[wanted]):
            who = asked[((part == b) & wanted).any(1)]
            a, e = rows.first[b], rows.end[b]
            s = _product(q[who], rows.m[a:e])
            good = ((q_labels[who][:, None] == rows.labels[a:e]) == same) & (q_ids[who][:, None] != rows.ids[a:e]) & (s >= lowest[who][:, None])
            i, j = np.nonzero(good)
            found_q.append(who[i])
            found_row.append(a + j)
            found_score.append(s[i, j])
        fq, fr, fs = np.concatenate(found_q), np.concatenate(found_row), np.concatenate(found_score)
        # each found row for each window of its query
        each = n_windows[fq]
        w = np.repeat(starts[fq] - np.cumsum(each) + each, each) + np.arange(each.sum())
        fr, fs = np.repeat(fr, each), np.repeat(fs, each)
        fits = going[w] & (fs >= floor[w]) & (fs <= high[w])
        windows, places, scores = np.concatenate([windows, w[fits]]), np.concatenate([places, fr[fits]]), np.concatenate([scores, fs[fits]])
        best = np.lexsort((rows.ids[places], -scores, windows))
        windows, places, scores = windows[best], places[best], scores[best]
        rank = np.arange(len(windows)) - np.searchsorted(windows, windows)
        full = windows[rank == k - 1]
        floor[full] = np.maximum(floor[full], scores[rank == k - 1])
        kept = rank < k
        windows, places, scores = windows[kept], places[kept], scores[kept]
        at += step
        step *= 2
        if at < n_blocks:
            going &= bounds[window_of, order[window_of, at]] >= floor
    return windows, places, scored


def _mine(stored: DataFrame, asked: DataFrame, shards: int, groups: int, same: bool, k: int, scale: tuple[float, dict[int, np.ndarray]]) -> DataFrame:
    """``anchor_id``, ``window``, ``id``, ``score``: the best k rows of each window in each shard.

    ``asked``: ``anchor_id``, ``label``, ``v`` and arrays ``low`` and ``high`` of its windows.
    """
    length2, pivots = scale
    left = stored.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = asked.withColumn("dim", F.size("v")).withColumn("grp", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def work(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor_id", "window", "id", "score")})
        if not len(rows) or not len(anchors):
            return out
        dim = int(rows["dim"].iloc[0])
        blocks = [np.frombuffer(x, np.float64).reshape(-1, dim) if dim else np.zeros((n, 0)) for x, n in zip(rows["m"], rows["n"], strict=True)]
        join = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in rows[c]])
        annuli = Annuli(join("ids", np.int64), join("labels", np.int64), np.vstack(blocks), join("pivot", np.int32), join("apart", np.float64), pivots[dim], length2)
        q = np.array([*anchors["v"]], np.float64).reshape(len(anchors), dim)
        sizes = anchors["low"].map(len).to_numpy()
        window_of = np.repeat(np.arange(len(anchors)), sizes)
        low, high = (np.concatenate([np.asarray(x, np.int64) for x in anchors[c]]) for c in ("low", "high"))
        ids = anchors["anchor_id"].to_numpy(np.int64)
        w, place, _ = search(annuli, ids, anchors["label"].to_numpy(np.int64), q, same, window_of, low, high, k)
        query = window_of[w]
        scores = np.concatenate([_product(q[i : i + 1], annuli.m[place[a:b]])[0] for i, a, b in _runs(query)]) if len(query) else query
        number = w - np.searchsorted(window_of, query)
        return pd.DataFrame({"anchor_id": ids[query], "window": number, "id": annuli.ids[place], "score": scores}).astype(np.int64)

    on = ["shard", "grp", "dim"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(work, "anchor_id long, window long, id long, score long")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of runs of equal values."""
    edges = np.flatnonzero(np.diff(values, prepend=values[0] - 1))
    for a, b in zip(edges, [*edges[1:], len(values)], strict=True):
        yield int(values[a]), int(a), int(b)


def store(vectors: DataFrame, n_rows: int, n_values: int) -> tuple[DataFrame, int, tuple[float, dict[int, np.ndarray]]]:
    """(rows written as packed slices of sorted keys, number of shards, (M^2, pivots by length)).

    ``vectors``: ``vec_id``, ``label``, ``v`` of integers as doubles.
    """
    shards = max(1, -(-8 * n_values // SHARD_BYTES), min(vectors.sparkSession.sparkContext.defaultParallelism, n_rows // BLOCK))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    length2 = float(vectors.agg(F.max(squares)).first()[0] or 0.0) * (1 + 1e-9)
    pivots: dict[int, np.ndarray] = {}
    taken = vectors.select(F.size("v").alias("dim"), "v", "vec_id").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(PIVOTS).collect()
    for dim in {len(r.v) for r in taken}:
        m = np.array([r.v for r in taken if len(r.v) == dim], np.float64).reshape(-1, dim)
        pivots[dim] = np.column_stack([m, np.sqrt(np.maximum(length2 - (m * m).sum(1), 0.0))])

    class Pivots(dict):
        def __missing__(self, dim: int) -> np.ndarray:  # a length that the pivots have not
            return np.zeros((1, dim + 1))

    pivots = Pivots(pivots)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pivot, apart = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            dims = batch["v"].map(len).to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                pivot[mine], apart[mine] = keys(np.array([*batch["v"].iloc[mine]], np.float64).reshape(len(mine), dim), length2, pivots[int(dim)])
            yield batch.assign(pivot=pivot, apart=apart)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        for batch in batches:
            dims = batch["v"].map(len).to_numpy()
            for dim in np.unique(dims):
                b = batch[dims == dim]
                row = {"shard": shard, "dim": int(dim), "n": len(b), "m": np.array([*b["v"]], np.float64).tobytes()}
                yield pd.DataFrame([row | {"ids": b["vec_id"].to_numpy(np.int64).tobytes(), "labels": b["label"].to_numpy(np.int64).tobytes(), "pivot": b["pivot"].to_numpy(np.int32).tobytes(), "apart": b["apart"].to_numpy(np.float64).tobytes()}])

    order = [F.size("v"), F.col("pivot"), F.col("apart"), F.col("vec_id")]
    ordered = vectors.mapInPandas(keyed, "vec_id long, label long, v array<double>, pivot int, apart double").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    rows = cut(ordered.mapInPandas(packed, "shard int, dim int, n int, m binary, ids binary, labels binary, pivot binary, apart binary"), "annuli")
    # ranges may be more than asked for, where a setting raises their number
    last = rows.agg(F.max("shard")).first()[0]
    return rows, int(last or 0) + 1, (length2, pivots)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``is_anchor``: a condition on ``vec_id``; ``label``: a whole number from the
    columns of ``vectors``.
    """
    labelled = vectors.where(label.isNotNull()).withColumn("label", label.cast("long"))
    rows = quantised(labelled, id_col, vec_col, scale, "label")
    n_rows, n_anchors, n_values = rows.agg(F.count(F.lit(1)), F.coalesce(F.count_if(is_anchor), F.lit(0)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    groups = max(1, -(-n_anchors // GROUP))
    stored, shards, keyed = store(rows, n_rows, n_values)
    asked = rows.where(is_anchor).groupBy(F.col("vec_id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("a")).select("anchor_id", "a.label", "a.v")

    everything = [F.array(F.lit(int(x)).cast("long")).alias(c) for c, x in (("low", LONG.min), ("high", LONG.max))]
    near = _mine(stored, asked.select("*", *everything), shards, groups, True, positives, keyed)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = near.withColumn("window", F.row_number().over(best)).where(F.col("window") <= positives)
    chosen = cut(found.select("anchor_id", "window", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # whole scores from low to high hundredths of a positive's; that of a negative score is empty
    scores = chosen.where(F.col("positive_score") >= 0).groupBy("anchor_id").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    # hundreds and the rest of a score apart, which stays a long
    def hundredths(share: int, rounding) -> Column:
        return F.transform("scores", lambda s: F.call_function("div", s, F.lit(100)) * share + rounding((s % 100) * share / 100).cast("long"))

    windows = asked.join(scores, "anchor_id").withColumn("low", hundredths(low, F.ceil)).withColumn("high", hundredths(high, F.floor))
    hard = _mine(stored, windows.select("anchor_id", "label", "v", "low", "high"), shards, groups, False, negatives, keyed)
    best = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    top = hard.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    scored = scores.select("anchor_id", F.posexplode("scores").alias("window", "positive_score")).withColumn("window", F.col("window").cast("long"))
    return (
        chosen.drop("window")
        .join(scored, ["anchor_id", "positive_score"])
        .join(top, ["anchor_id", "window"])
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
