"""Line deduplication by pairwise alignment.

A run is the shortest stretch of neighbouring lines, from or up to a line, that
holds ``BLOCK_WORDS`` words.  Documents overlap if they share a run.  Instead of
all pairs of a run's holders, each later holder is paired with the run's
earliest one, so that a run in many documents gives as many pairs as holders
and no line is too frequent to be looked at.  That loses nothing: every line of
a block that a document shares with any earlier one lies in a run of that
block, and the run's earliest holder has it as well.

Each pair is aligned with patience diff over line hashes: lines that are unique
in both are matched along their longest common order, then the gaps between
matches in the same way, with equal lines at a gap's ends matched directly.
Aligned lines that follow each other in both documents form a block.  Lines
that are left are compared by runs, which finds passages that a document
repeats and passages in another order.  Blocks of ``BLOCK_WORDS`` words or more
are deleted from the later document, each time it holds them.

Words are parted by white space; in scripts that are written without it every
``LETTERS_A_WORD`` letters in a row, or a rest of them, count as a word.

Documents are ordered by id, then by a hash of their text.

Defined cases: null texts and rows without an id are left as they are; exact
repeats of a row are one document; rows that share an id but not the text are
compared like other documents; a document all of whose lines are deleted keeps
an empty text.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, map_batches

#: Words of the shortest run and of the shortest block.
BLOCK_WORDS = 8
#: Letters that count as a word in scripts without spaces.
LETTERS_A_WORD = 2
# Thai to Myanmar, Khmer, kana, Han
_unspaced = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")
_unspaced_marks = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]+")
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """(hash, words) of each line."""
    lines = text.split("\n")
    count = _count_words if not text.isascii() and _unspaced.search(text) else lambda x: len(x.split())
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines], [count(x) for x in lines]


def _count_words(line: str) -> int:
    return len(_unspaced_marks.sub(" ", _unspaced.sub(" ", line)).split()) + sum(-(-len(x) // LETTERS_A_WORD) for x in _unspaced.findall(line))


def _unique_matches(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines that occur once in either range, along their longest common order."""
    seen: dict[int, list[int]] = {}
    for side, lines, lo, hi in ((0, a, a0, a1), (1, b, b0, b1)):
        for i in range(lo, hi):
            entry = seen.setdefault(lines[i], [0, 0, -1, -1])
            entry[side] += 1
            entry[2 + side] = i
    pairs = sorted((e[2], e[3]) for e in seen.values() if e[0] == 1 and e[1] == 1)
    tails: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(tops[at - 1] if at else -1)
        tails[at : at + 1] = [j]
        tops[at : at + 1] = [k]
    out = []
    k = tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions of two sequences, ascending."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            found = _unique_matches(a, b, a0, a1, b0, b1)
            out += found
            if found:
                for (x, y), (p, q) in zip([(a0 - 1, b0 - 1), *found], [*found, (a1, b1)], strict=True):
                    if x + 1 < p and y + 1 < q:
                        todo.append((x + 1, p, y + 1, q))
    return sorted(out)


def runs(lines: list[int], words: list[int], least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, line behind the last) of the shortest runs of ``least`` words from and up to each line."""
    n = len(lines)
    total = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    ends = np.searchsorted(total, total[:-1] + least)
    starts = np.searchsorted(total, total[1:] - least, side="right") - 1
    from_line, to_line = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate([from_line * (n + 1) + ends[from_line], starts[to_line] * (n + 1) + to_line + 1]))
    low, high = both // (n + 1), both % (n + 1)
    power = np.full(n + 1, _STEP, np.uint64)
    back = np.full(n + 1, _STEP_BACK, np.uint64)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(lines, np.int64).astype(np.uint64) * power[:n])])
    h = (summed[high] - summed[low]) * back[low] + (high - low).astype(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), low, high


def _run_matches(earlier: list[int], later: list[int], words: list[int], least: int) -> np.ndarray:
    """Whether each line of the later document lies in a run that the earlier one holds anywhere."""
    known = dict(zip(later, words, strict=True))
    # a line that only the earlier document has parts its runs
    shared = [x in known for x in earlier]
    held, at = [], 0
    while at < len(earlier):
        end = at
        while end < len(earlier) and shared[end]:
            end += 1
        if end > at:
            part = earlier[at:end]
            held.append(runs(part, [known[x] for x in part], least)[0])
        at = end + 1
    edges = np.zeros(len(later) + 1, np.int64)
    if held:
        h, low, high = runs(later, words, least)
        found = np.isin(h, np.concatenate(held))
        np.add.at(edges, low[found], 1)
        np.add.at(edges, high[found], -1)
    return np.cumsum(edges)[:-1] > 0


def common_blocks(earlier: list[int], later: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Positions of the later document's lines that lie in common blocks of ``least`` words or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for match in [*patience(earlier, later), (-9, -9)]:
        if match != (last[0] + 1, last[1] + 1):
            if sum(words[j] for j in block) >= least:
                out += block
            block = []
        block.append(match[1])
        last = match
    if len(out) < len(later):
        out = sorted({*out, *np.flatnonzero(_run_matches(earlier, later, words, least)).tolist()})
    return out


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``d`` (id), ``t`` (hash of the text), ``gone``: positions of the lines to delete, for documents that lose any."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{text_col}`").alias("text"))

    def make(ids: list, hashes: list, texts: list) -> dict:
        found = [line_hashes(x) for x in texts]
        keys = [np.unique(runs(*f)[0]).astype(np.int64).tolist() for f in found]
        return {"d": ids, "t": hashes, "lines": [f[0] for f in found], "words": [f[1] for f in found], "runs": keys}

    lines = map_batches(source.where(F.col("d").isNotNull() & F.col("text").isNotNull()), ["d", "t", "text"], make, "d long, t long, lines array<long>, words array<int>, runs array<long>", 1024)
    sequences = cut(lines, "lines")
    seeds = sequences.select("d", "t", F.explode("runs").alias("run"))
    shared = seeds.groupBy("run").agg(F.min(F.struct("d", "t")).alias("first"), F.max(F.struct("d", "t")).alias("last")).where(F.col("first") != F.col("last"))
    pairs = seeds.join(shared.select("run", F.col("first.d").alias("d0"), F.col("first.t").alias("t0")), "run").where((F.col("d") != F.col("d0")) | (F.col("t") != F.col("t0"))).select("d", "t", "d0", "t0").distinct()
    own = sequences.drop("runs").dropDuplicates(["d", "t"])
    both = pairs.join(own.select(F.col("d").alias("d0"), F.col("t").alias("t0"), F.col("lines").alias("earlier")), ["d0", "t0"]).join(own, ["d", "t"])

    def align(ids: list, hashes: list, earlier: list, later: list, words: list) -> dict:
        found = [common_blocks(a, b, w) for a, b, w in zip(earlier, later, words, strict=True)]
        rows = [i for i, f in enumerate(found) if f]
        return {"d": [ids[i] for i in rows], "t": [hashes[i] for i in rows], "gone": [found[i] for i in rows]}

    aligned = map_batches(both, ["d", "t", "earlier", "lines", "words"], align, "d long, t long, gone array<int>", 1024)
    return aligned.select("d", "t", F.explode("gone").alias("at")).groupBy("d", "t").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text shortened, and ``gone``, the positions of its deleted lines (null: none).

    A column ``gone`` that ``docs`` has is replaced.
    """
    docs = docs.drop("gone")
    d, t = free_name(docs, "later_id"), free_name(docs, "later_text")
    found = cut(deletions(docs, id_col, text_col), "deletions").select(F.col("d").alias(d), F.col("t").alias(t), "gone")
    text = F.col(f"`{text_col}`")
    joined = docs.join(found, (F.col(f"`{id_col}`").cast("long") == F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    lines = F.split(text, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined.withColumn(text_col, F.when(F.col("gone").isNull(), text).otherwise(kept)).drop(d, t)
