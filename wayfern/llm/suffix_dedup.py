"""Removal of long repeated strings by range-partitioned suffix sorting.

Texts are bytes.  Every byte covered by a string of ``WIDTH`` bytes that also
starts in a document of smaller id is removed.

Tokens.  In each window of ``WIDTH`` bytes the leading token is the ``TOKEN``
bytes of the smallest hash.  Equal windows have equal leading tokens, and
neighbouring windows mostly share theirs, so the suffixes that start at
neighbouring windows travel as one segment of bytes, some 19 suffixes in 68
bytes.  A document's segments cover all of its windows.

Steps:

1. Exact copies of a text are set aside: all of their bytes start in the first.
2. Token hashes are dealt out by value and met in tasks; a window can only
   repeat if documents of two ids have its token, so only such segments go on.
3. Splitters from a sample of tokens range-partition the segments by their
   leading token into buckets.
4. A bucket sorts locally by multikey quicksort, a word of eight bytes at a
   time, all groups of a step at once, leaving a group as soon as it has one
   member: first whole segments (of equal ones the smallest id holds all their
   windows), then the windows of segments that differ under one token.
5. A token in more than ``HOT`` segments is dealt over several buckets by the
   segments' contents, and what each bucket holds of it is compared across
   buckets, window by window, as the smallest id in one may still not be the
   first of all.  Before, a task sends equal segments of such tokens once.

Distribution: the text is shuffled once, by document; what else moves is four
bytes and a place for a token, and the segments of shared tokens, both packed and
compressed.  Splitters (16 bytes a bucket) are all that the driver sees, from at
most ``SAMPLE_DOCS`` documents' ``SAMPLE_TOKENS`` tokens; they steer the balance
only.  Long texts are read in slices of ``SLICE`` bytes.

Defined cases: null and empty texts have no bytes, and texts under ``WIDTH``
bytes lose nothing; rows without an id are no source and lose nothing; repeated
rows, and rows of one id, take nothing from each other.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a repeated string and of a token.
WIDTH, TOKEN = 50, 16
#: Tokens that one task meets; text bytes for each bucket of segments; segments of a token that one bucket takes.
MEET, BUCKET_BYTES, HOT = 1 << 20, 1 << 22, 4096
#: Bytes of text that are hashed at once; windows of a segment at most.
SLICE, MOST = 1 << 22, 255
SAMPLE_DOCS, SAMPLE_TOKENS = 2048, 64
_STEP, _MIX, _MIX2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``TOKEN`` bytes from each position."""
    h, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < TOKEN:
        h = h[:-size] * np.uint64(pow(_STEP, size, 1 << 64)) + h[size:]
        size *= 2
    return _mixed(h)


def smallest_of(h: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each ``n`` neighbours."""
    size = 1
    while size * 2 <= n:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (n - size)], h[n - size :]) if size < n else h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, token's place behind it, token's hash) of each segment.

    ``ends``: where each document ends in ``data``.  Segments are in order, of
    1 to ``MOST`` windows, and never go over a document's end.
    """
    found = []
    over = WIDTH - TOKEN + 1
    for low in range(0, len(data) - WIDTH + 1, SLICE):
        part = data[low : low + SLICE + WIDTH - 1]
        h = token_hashes(part)
        least = smallest_of(h, over)
        # windows that would go over the end of a document
        near = ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, low + len(part), side="right")] - low
        edge = np.zeros(len(least) + 1, np.int32)
        np.add.at(edge, np.clip(near - WIDTH + 1, 0, len(least)), 1)
        np.add.at(edge, np.clip(near, 0, len(least)), -1)
        inside = np.cumsum(edge[:-1]) == 0
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        first = np.flatnonzero(change & inside)
        if not len(first):
            continue
        n = np.bincount(np.cumsum((change & inside)[inside]) - 1)
        parts = -(-n // MOST)
        step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * MOST
        first, n = np.repeat(first, parts) + step, np.minimum(np.repeat(n, parts) - step, MOST)
        place = np.concatenate([h[first[i : i + 65536, None] + np.arange(over)].argmin(1) for i in range(0, len(first), 65536)])
        found.append((first + low, n, place, least[first]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    first, n, place, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, n, place, hashes


def _pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for a in arrays:
        np.save(out, a, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    data = io.BytesIO(zstandard.ZstdDecompressor().decompress(blob))
    return [np.load(data, allow_pickle=False) for _ in range(n)]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, where each ends)."""
    column = column.cast(pa.large_binary())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    return data, edges[:-1] - edges[0], edges[1:] - edges[0]


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions from each start on, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, rows) in ascending order of the key, rows in their order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        yield int(keys[order[a]]), order[a:b]


def classes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers that are equal exactly where the strings are, by multikey quicksort.

    All groups of strings that agree so far are split by their next eight bytes
    at once; one that has a single member left is done.  Eight more bytes must
    follow the last string in ``data``.
    """
    words = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    out = np.zeros(len(starts), np.int64)
    active, group, base, at = np.arange(len(starts)), np.asarray(lengths, np.int64), 0, 0
    while len(active):
        rest = np.clip(lengths[active] - at, 0, 8)
        word = words[starts[active] + np.where(rest > 0, at, 0)].astype(np.uint64)
        spare = (8 * (8 - rest)).astype(np.uint64)
        word = np.where(rest > 0, word >> np.minimum(spare, np.uint64(63)), 0)
        order = np.lexsort((word, group))
        w, g = word[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        number = np.cumsum(new) - 1
        active = active[order]
        out[active] = base + number
        base += int(number[-1]) + 1
        at += 8
        going = (np.bincount(number)[number] > 1) & (lengths[active] > at)
        active, group = active[going], number[going]
    return out


def _least(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The smallest value among the members of each one's class."""
    least = np.full(int(of.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, of, values)
    return least[of]


def _stretches(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, number) of each stretch of set flags that have one owner."""
    begin, end = flags.copy(), flags.copy()
    same = flags[1:] & flags[:-1] & (owner[1:] == owner[:-1])
    begin[1:] &= ~same
    end[:-1] &= ~same
    first = np.flatnonzero(begin)
    return first, np.flatnonzero(end) - first + 1


def bucket_marks(data: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a bucket finds about its segments, which lie one after the other in ``data``.

    Returns (segment, first window, number of windows) of stretches that an
    earlier document holds, and (segment, window) that a hot token's first
    holders in this bucket have.
    """
    lengths = n + WIDTH - 1
    starts = np.cumsum(lengths) - lengths
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    of = classes(data, starts, lengths)
    whole = np.flatnonzero(ids > _least(ids, of))
    holders = np.flatnonzero(ids == _least(ids, of))
    _, first = np.unique(of[holders], return_index=True)
    rep = holders[first]
    # windows are compared where a token has segments of different contents
    token = classes(data, starts[rep] + place[rep], np.full(len(rep), TOKEN))
    rep = rep[(np.bincount(token)[token] > 1) | hot[rep]]
    owner = np.repeat(rep, n[rep])
    window = gathered(np.zeros(len(rep), np.int64), n[rep])
    same = classes(data, starts[owner] + window, np.full(len(owner), WIDTH))
    least = _least(ids[owner], same)
    at, number = _stretches(ids[owner] > least, owner)
    # equal segments of one id have what their representative has
    order = holders[np.argsort(of[holders], kind="stable")]
    low, high = np.searchsorted(of[order], of[owner[at]]), np.searchsorted(of[order], of[owner[at]], side="right")
    twins = order[gathered(low, high - low)]
    at_, number_ = np.repeat(window[at], high - low), np.repeat(number, high - low)
    first_of = np.flatnonzero(hot[owner] & (ids[owner] == least))
    low, high = np.searchsorted(of[order], of[owner[first_of]]), np.searchsorted(of[order], of[owner[first_of]], side="right")
    return (
        np.concatenate([whole, twins]),
        np.concatenate([np.zeros(len(whole), np.int64), at_]),
        np.concatenate([n[whole], number_]),
        order[gathered(low, high - low)],
        np.repeat(window[first_of], high - low),
    )


def removed(spans: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """(which bytes are removed, how many stretches they form) for packed stretches of windows."""
    edge = np.zeros(size + 1, np.int64)
    first = spans >> 16
    np.add.at(edge, first, 1)
    np.add.at(edge, first + (spans & 0xFFFF) + WIDTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return gone, int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_above: int = HOT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of each row, and ``kept``, the remaining bytes where any were removed and any are left."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(text).alias("t"), F.crc32(text.cast("binary")).alias("c"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("text"))
    size, n_docs = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    meet = max(1, size // (18 * MEET))
    buckets = max(1, size // bucket_bytes)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, ends = _texts(batch.column(0))
            first, _, place, _ = segments(data, ends)
            doc = np.searchsorted(ends, first, side="right")
            taken = np.concatenate([x[:: -(-len(x) // SAMPLE_TOKENS)] for _, x in _groups(doc)]) if len(doc) else doc
            yield pa.RecordBatch.from_arrays([pa.array([data[a : a + TOKEN].tobytes() for a in (first + place)[taken]], pa.binary())], names=["token"])

    every = max(1, n_docs // SAMPLE_DOCS)
    tokens = sorted(bytes(r.token) for r in base.where(F.pmod("t", F.lit(every)) == 0).select("text").mapInArrow(sample, "token binary").collect()) if buckets > 1 else []
    splitters = np.array([tokens[len(tokens) * i // buckets] for i in range(1, buckets)] if tokens else [], f"S{TOKEN}")

    # one row of each text goes on; its text is shuffled here, and this exchange serves all three uses of ``texts``
    owners = base.where((F.col("n_bytes") >= WIDTH) & F.col("d").isNotNull()).groupBy("t", "c", "n_bytes").agg(F.min("d").alias("d"))
    texts = base.join(owners.select("d", "t").hint("shuffle_merge"), ["d", "t"]).select("d", "t", "text")

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = _longs(batch.column(0)), _longs(batch.column(1))
            data, begin, ends = _texts(batch.column(2))
            first, n, place, hashes = segments(data, ends)
            doc = np.searchsorted(ends, first, side="right")
            hashes = _mixed(hashes)
            task = ((hashes >> np.uint64(32)) * np.uint64(meet)) >> np.uint64(32)
            rest = hashes.astype(np.uint32)
            out = []
            for key, at in _groups(task.astype(np.int64)):
                who, count = np.unique(doc[at], return_counts=True)
                start = np.diff(first[at], prepend=0)
                out.append((key, _pack(d[who], t[who], count.astype(np.int32), start, n[at].astype(np.uint8), place[at].astype(np.uint8), rest[at], begin[who])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["task", "tokens"])

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for blob in rows["tokens"]:
            d, t, count, start, n, place, rest, begin = _unpack(blob, 8)
            start = np.cumsum(start) - np.repeat(begin, count)
            parts.append((np.repeat(d, count), np.repeat(t, count), start, n, place, rest))
        d, t, start, n, place, rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(rest, kind="stable")
        cuts = np.flatnonzero(np.diff(rest[order].astype(np.int64), prepend=-1))
        sizes = np.diff(np.append(cuts, len(order)))
        several = np.minimum.reduceat(d[order], cuts) != np.maximum.reduceat(d[order], cuts)
        level = np.where(sizes > hot_above, np.ceil(np.log2(np.maximum(sizes, 1) / hot_above)), 0).astype(np.int64)
        shared = np.repeat(several, sizes)
        at, level = order[shared], np.repeat(level, sizes)[shared]
        back = np.argsort(at)  # in the order of documents, which packs better
        at, level = at[back], level[back]
        return pd.DataFrame({"d": d[at], "t": t[at], "place": start[at] << 24 | n[at].astype(np.int64) << 16 | place[at].astype(np.int64) << 8 | level})

    places = texts.mapInArrow(meetings, "task long, tokens binary").groupBy("task").applyInPandas(met, "d long, t long, place long").groupBy("d", "t").agg(F.collect_list("place").alias("places"))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = _longs(batch.column(0)), _longs(batch.column(1))
            data, begin, _ = _texts(batch.column(2))
            each = _longs(batch.column(3).value_lengths())
            doc, place = np.repeat(np.arange(len(d)), each), _longs(batch.column(3).flatten())
            start, n, off, level = place >> 24, place >> 16 & 255, place >> 8 & 255, place & 255
            low = begin[doc] + start
            token = data[(low + off)[:, None] + np.arange(TOKEN)].view(f"S{TOKEN}").ravel()
            bucket, sub = np.searchsorted(splitters, token, side="right"), np.zeros(len(low), np.int64)
            sent = np.ones(len(low), bool)
            seen: dict[bytes, int] = {}
            for i in sorted(np.flatnonzero(level).tolist(), key=lambda i: d[doc[i]]):
                held = data[low[i] : low[i] + n[i] + WIDTH - 1].tobytes()
                sub[i] = int.from_bytes(hashlib.blake2b(held, digest_size=4).digest(), "little") % (1 << int(level[i]))
                # equal segments of later documents need not be sent: the first of them holds their windows
                sent[i] = seen.setdefault(held, int(d[doc[i]])) == d[doc[i]]
            out = []
            for key, at in _groups(bucket << 32 | sub):
                who, number = np.unique(doc[at], return_inverse=True)
                own = at[sent[at]]
                held = data[gathered(low[own], n[own] + WIDTH - 1)]
                out.append((key, _pack(d[who], t[who], number.astype(np.int32), start[at], n[at].astype(np.uint8), off[at].astype(np.uint8), level[at] > 0, sent[at], held)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "suffixes"])

    def sort_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for blob in rows["suffixes"]:
            d, t, number, *rest = _unpack(blob, 9)
            parts.append((d[number], t[number], *rest))
        d, t, start, n, off, hot, sent, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        n, off = n.astype(np.int64), off.astype(np.int64)
        own, rest = np.flatnonzero(sent), np.flatnonzero(~sent)
        segment, window, number, first, at = bucket_marks(data, d[own], n[own], off[own], hot[own])
        segment, first = own[segment], own[first]
        begins = np.zeros(len(sent), np.int64)
        begins[own] = np.cumsum(n[own] + WIDTH - 1) - n[own] - WIDTH + 1
        held = [data[a : a + WIDTH].tobytes() for a in begins[first] + at]
        owner = np.concatenate([segment, rest, first])
        span = np.concatenate([start[segment] + window << 16 | number, start[rest] << 16 | n[rest], start[first] + at << 16 | 1])
        return pd.DataFrame({"d": d[owner], "t": t[owner], "span": span, "held": [*[None] * (len(owner) - len(held)), *held]})

    cut = texts.join(places, ["d", "t"]).select("d", "t", "text", "places").mapInArrow(cut_out, "bucket long, suffixes binary")
    marks = cut.groupBy("bucket").applyInPandas(sort_bucket, "d long, t long, span long, held binary")
    # across buckets: a hot token's window is removed unless its document is the first of all that hold it
    alone = F.col("held").isNull()
    across = Window.partitionBy("held", F.when(alone, F.col("d")), F.when(alone, F.col("t")))
    spans = marks.withColumn("first", F.min("d").over(across)).where(alone | (F.col("first") < F.col("d"))).groupBy("d", "t").agg(F.collect_list("span").alias("spans"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, ends = _texts(batch.column(2))
            each = batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, upto = _longs(batch.column(3).flatten()), np.cumsum(each)
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i in range(len(begin)):
                own = data[begin[i] : ends[i]]
                gone, n_spans = removed(flat[upto[i] - each[i] : upto[i]], len(own)) if each[i] else (np.zeros(0, bool), 0)
                kept = own[~gone].tobytes() if each[i] else own.tobytes()
                out["n_removed"].append(len(own) - len(kept))
                out["n_spans"].append(n_spans)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept if each[i] and kept else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["kept"], pa.binary())], names=["d", "t", *out])

    found = texts.join(spans, ["d", "t"], "left").select("d", "t", "text", "spans").mapInArrow(remove, "d long, t long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    found = found.groupBy("d", "t").agg(*(F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept_sha256", "kept")))
    untouched = (F.col("n_bytes") < WIDTH) | F.col("d").isNull()
    rows = base.select("d", "t", "n_bytes", F.when(untouched, F.sha2("text", 256)).alias("own_sha256")).join(found, ["d", "t"], "left")
    copy = F.col("n_removed").isNull()  # a later copy of a whole text: all its bytes start in the first
    return rows.select(
        F.col("d").alias("doc_id"),
        "n_bytes",
        F.when(untouched, F.lit(0)).when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(untouched, F.lit(0)).when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(untouched, F.col("own_sha256")).when(copy, F.sha2(F.lit(b""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        "kept",
    )
