"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct five-word shingles.
Documents of equal sets are one class with one representative.  A sketch keeps
the k smallest hashes of a set; every two values that follow each other in a
sketch are the key of an inverted list.  Of a union's sketch each value is
common to two sets with the probability of their similarity, and two common
neighbours are neighbours in both sketches: at 0.75 and k = 40 a pair has no
common key with a probability below 3e-10, and while both sets fit their
sketches it always has one (a value that only one set holds parts at most one
of the c - 1 neighbours, and there are at most a third as many such values as
common ones).

Candidates come from the lists.  Lists up to ``SHORT`` give their pairs.  Longer
ones give each member with two pivots only; confirmed links join members to
components.  What is left are long lists with several components.  There,
counts of the values that other components have bound how similar a member can
be to any of them, which settles nearly all members (see ``_undecided``); the
rest is compared by whole sets, in blocks of members, and gives links between
components only.  So a long list neither meets in one task nor is spelled out
in pairs.  For pairs of short lists and pivots the sketch of the union
estimates the similarity and drops those far from linked (of pairs at 0.75 a
share of 4e-10; none where both sets fit their sketches); the exact sets decide
the rest.

Defined cases: documents without words have an empty set and are linked with
nothing; documents of fewer than five words have one shingle, the whole
sequence; rows of one id are one node; rows without an id stay, unlinked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches
from .components import components

#: Values of a sketch, words of a shingle, least similarity in hundredths.
K, WORDS, HUNDREDTHS = 40, 5, 75
#: Members of the longest list whose pairs are listed; members and values of a block of longer ones.
SHORT, BLOCK, BLOCK_VALUES = 48, 1536, 1 << 20
#: Values of a piece of a set.
PIECE = 128
#: Values of several components up to which they are sent to the tasks.
FOREIGN = 2_000_000
#: Common values of the union's sketch, in hundredths, below which a pair is not looked at further.
ESTIMATE = 30
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at space and
    the characters 9 to 13, as asked.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    z = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        z = _mix(z + h[i : len(h) - size + 1 + i] * _A)
    return np.unique(z)


def linked(a: np.ndarray, b: np.ndarray, hundredths: int = HUNDREDTHS) -> bool:
    if 100 * min(len(a), len(b)) < hundredths * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= hundredths * (len(a) + len(b) - common)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> tuple[int, int]:
    """(values of the union's sketch that both sketches hold, size of the union's sketch)."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = both[1:] == both[:-1]
    distinct = np.concatenate([[True], ~same]) if len(both) else np.zeros(0, bool)
    number = np.cumsum(distinct)  # each value's place in the union
    return int((same & (number[1:] <= k)).sum()), min(k, int(number[-1])) if len(both) else 0


def sketches(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n``, ``c1``, ``c2`` (the set's own hash), ``sketch`` (ascending as unsigned numbers)."""

    def make(keys: list, texts: list) -> dict:
        out: dict = {"doc_id": keys, "n": [], "c1": [], "c2": [], "sketch": []}
        for text in texts:
            s = shingle_set(text)
            whole = xxhash.xxh128_digest(s.tobytes())
            c1, c2 = np.frombuffer(whole, np.int64).tolist()
            out["n"].append(len(s))
            out["c1"].append(c1)
            out["c2"].append(c2)
            out["sketch"].append(s[:k].tobytes())
        return out

    return map_batches(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), ["doc_id", "text"], make, "doc_id long, n long, c1 long, c2 long, sketch binary", 512)


def list_keys(reps: DataFrame) -> DataFrame:
    """``key``, ``rep``, ``n``: an entry of each inverted list that a representative is in."""

    def make(keys: list, sizes: list, packed: list) -> dict:
        reps, ns, out = [], [], []
        for rep, n, data in zip(keys, sizes, packed, strict=True):
            s = np.frombuffer(data, np.uint64)
            pairs = _mix(s[:-1] * np.uint64(3) + s[1:] * _A).astype(np.int64)
            out.append(pairs)
            reps.append(np.full(len(pairs), rep, np.int64))
            ns.append(np.full(len(pairs), n, np.int64))
        return {"key": np.concatenate(out), "rep": np.concatenate(reps), "n": np.concatenate(ns)}

    return map_batches(reps.where(F.col("n") > 2), ["rep", "n", "sketch"], make, "key long, rep long, n long", 4096)


def _close_in_size(a: str, b: str):
    return F.lit(100) * F.least(a, b) >= F.lit(HUNDREDTHS) * F.greatest(a, b)


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sketches do not rule them out."""
    sketch = reps.select("rep", "sketch")
    both = pairs.join(sketch.withColumnsRenamed({"rep": "a", "sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"rep": "b", "sketch": "sb"}), "b")

    def make(aa: list, bb: list, sa: list, sb: list) -> dict:
        good = []
        for x, y in zip(sa, sb, strict=True):
            common, size = union_estimate(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
            good.append(100 * common >= ESTIMATE * size)
        return {"a": [a for a, g in zip(aa, good, strict=True) if g], "b": [b for b, g in zip(bb, good, strict=True) if g]}

    return map_batches(both, ["a", "b", "sa", "sb"], make, "a long, b long", 4096)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(texts.withColumnsRenamed({"rep": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"rep": "b", "text": "tb"}), "b")

    def make(aa: list, bb: list, ta: list, tb: list) -> dict:
        out: dict = {"a": [], "b": []}
        sets: dict[str, np.ndarray] = {}
        for a, b, x, y in zip(aa, bb, ta, tb, strict=True):
            for t in (x, y):
                if t not in sets:
                    sets[t] = shingle_set(t)
            if linked(sets[x], sets[y]):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_batches(both, ["a", "b", "ta", "tb"], make, "a long, b long", 256)


def whole_sets(texts: DataFrame) -> DataFrame:
    """``rep``, ``hashes``: each text's whole set."""

    def make(keys: list, found: list) -> dict:
        return {"rep": keys, "hashes": [shingle_set(t).tobytes() for t in found]}

    return map_batches(texts, ["rep", "text"], make, "rep long, hashes binary", 256)


def component_values(sets: DataFrame) -> DataFrame:
    """``comp``, ``h``: the values of each component's sets; what repeats among the rows of one call is given once.

    Sets are dealt out in pieces, so that a very long text is no longer task.
    """

    def cut_up(keys: list, comps: list, packed: list) -> dict:
        size = 8 * PIECE
        rows = [(rep, comp, at, x[at : at + size]) for rep, comp, x in zip(keys, comps, packed, strict=True) for at in range(0, len(x), size)]
        return dict(zip(("rep", "comp", "at", "hashes"), map(list, zip(*rows, strict=True)) if rows else ([], [], [], []), strict=True))

    def make(comps: list, packed: list) -> dict:
        values = [np.frombuffer(x, np.int64) for x in packed]
        comp, h = np.repeat(np.array(comps, np.int64), [len(v) for v in values]), np.concatenate(values)
        order = np.lexsort((h, comp))
        comp, h = comp[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (comp[1:] != comp[:-1])
        return {"comp": comp[new], "h": h[new]}

    pieces = map_batches(sets, ["rep", "comp", "hashes"], cut_up, "rep long, comp long, at long, hashes binary", 4096)
    return map_batches(pieces.repartition("rep", "at"), ["comp", "hashes"], make, "comp long, h long", 8192)


def set_values(sets: DataFrame) -> DataFrame:
    """``rep``, ``h``: a row for each value of each set."""

    def make(keys: list, packed: list) -> dict:
        values = [np.frombuffer(x, np.int64) for x in packed]
        return {"rep": np.repeat(np.array(keys, np.int64), [len(v) for v in values]), "h": np.concatenate(values)}

    return map_batches(sets, ["rep", "hashes"], make, "rep long, h long", 256)


def shared_counts(sets: DataFrame, foreign: DataFrame) -> DataFrame:
    """``rep``, ``s``: how many of the set's values are among ``foreign`` (``h``, distinct).

    Up to ``FOREIGN`` values go to the tasks; more of them are joined.
    """
    spark = sets.sparkSession
    if foreign.count() > FOREIGN:
        return set_values(sets).join(foreign, "h", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("s"))
    shared = spark.sparkContext.broadcast(np.sort(foreign.toPandas()["h"].to_numpy(np.int64)))

    def make(keys: list, packed: list) -> dict:
        found = shared.value
        out = []
        for x in packed:
            v = np.frombuffer(x, np.int64)
            at = np.minimum(np.searchsorted(found, v), max(0, len(found) - 1))
            out.append(int((found[at] == v).sum()) if len(found) else 0)
        return {"rep": keys, "s": out}

    return map_batches(sets, ["rep", "hashes"], make, "rep long, s long", 4096)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Number of common values of each left and right set, by products of slices of their incidence matrices."""
    values, codes = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in left + right])
    on_left = rows < len(left)
    used = (np.bincount(codes[on_left], minlength=len(values)) > 0) & (np.bincount(codes[~on_left], minlength=len(values)) > 0)
    place = np.cumsum(used) - 1
    kept = np.flatnonzero(used[codes])
    order = kept[np.argsort(place[codes[kept]], kind="stable")]
    rows, place = rows[order], place[codes[order]]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(used.sum()), columns):
        part = slice(*np.searchsorted(place, (at, at + columns)))
        m = np.zeros((len(left) + len(right), columns), np.float32)
        m[rows[part], place[part] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def block_links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each left and right set are linked."""
    common = common_counts(left, right)
    n_left, n_right = (np.array([len(s) for s in side], np.float64) for side in (left, right))
    return 100 * common >= HUNDREDTHS * (n_left[:, None] + n_right[None, :] - common)


def _cell_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links within one cell of a long list, as far as they join components that are still apart.

    The component with most members is only compared with the others.  A cell
    gives fewer links than it has members.
    """
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    out: list[tuple[int, int]] = []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> None:
        for at in range(0, len(left) if len(right) else 0, 256):
            part = left.iloc[at : at + 256]
            found = block_links(*([np.frombuffer(s, np.uint64) for s in side["hashes"]] for side in (part, right)))
            a, b, ca, cb = part["rep"].to_numpy(), right["rep"].to_numpy(), part["comp"].to_numpy(), right["comp"].to_numpy()
            for x, y in zip(*np.nonzero(found & (ca[:, None] != cb[None, :])), strict=True):
                p, q = find(int(ca[x])), find(int(cb[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(a[x]), int(b[y])))

    most = group["comp"].value_counts().index[0]
    left, right = group[group["c"] == i], group[group["c"] == j]
    compare(left[left["comp"] != most], right)
    if i != j:
        compare(right[right["comp"] != most], left[left["comp"] == most])
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def _undecided(long: DataFrame, first: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``key``, ``rep``, ``comp``, ``n``; ``rep``, ``hashes``) of members of long lists that may be linked with another component's.

    Of a set, only values that another component has too can be common with
    it.  With s such values in the smaller count, the similarity of two sets is
    at most s / (n1 + n2 - s).  That leaves out documents of which the shared
    passages are too small a part, however long the passages' lists are.
    """
    by_rep = long.groupBy("rep", "n").agg(F.collect_list("key").alias("keys"))  # at most K - 1 each
    placed = by_rep.join(first.withColumnRenamed("node", "rep"), "rep", "left")
    members = cut(placed.select("rep", "n", F.coalesce("component", "rep").alias("comp"), F.explode("keys").alias("key")), "members")
    apart = F.min("comp") < F.max("comp")
    mixed = cut(members.join(members.groupBy("key").agg(apart.alias("apart")).where("apart"), "key", "left_semi"), "mixed")
    sets = cut(whole_sets(texts.join(mixed.select("rep").distinct(), "rep", "left_semi")), "sets")
    held = component_values(sets.join(mixed.select("rep", "comp").distinct(), "rep"))
    foreign = cut(held.groupBy("h").agg(apart.alias("apart")).where("apart").select("h"), "foreign")
    # the largest set that this one can be linked with, from 100 * s >= HUNDREDTHS * (n1 + n2 - s)
    partner = F.floor(F.col("s") * (100 + HUNDREDTHS) / HUNDREDTHS) - F.col("n")
    able = cut(mixed.join(shared_counts(sets, foreign), "rep").where(100 * F.col("s") >= HUNDREDTHS * F.col("n")).select("key", "rep", "comp", "n", partner.alias("partner")), "able")
    lists = able.groupBy("key").agg(apart.alias("apart"), F.min("n").alias("least")).where("apart")
    return able.join(lists.drop("apart"), "key").where(F.col("partner") >= F.col("least")).select("key", "rep", "comp", "n"), sets


def links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``node``, ``component`` of all representatives that have links.

    ``docs``: ``doc_id`` and ``text``, of which each representative's text is
    read once.
    """
    entries = list_keys(reps)
    counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    shared = cut(entries.join(counts, "key"), "lists")
    short = shared.where(F.col("members") <= SHORT)
    long = shared.where(F.col("members") > SHORT)
    listed = short.groupBy("key").agg(F.collect_list(F.struct("rep", "n")).alias("m")).select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["rep"] > x["rep"]) & (100 * F.least(x["n"], y["n"]) >= HUNDREDTHS * F.greatest(x["n"], y["n"]))), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))).alias("p")).select("p.a", "p.b")
    pivots = long.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("p1"), F.min(F.struct(F.xxhash64("rep", "key").alias("h"), "rep", "n")).alias("p2"))
    pivots = pivots.select("key", F.explode(F.array("p1", F.struct("p2.rep", "p2.n"))).alias("p"))
    starred = long.join(pivots, "key").where((F.col("rep") != F.col("p.rep")) & (F.lit(100) * F.least("n", "p.n") >= F.lit(HUNDREDTHS) * F.greatest("n", "p.n"))).select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))
    pairs = cut(_estimated(listed.unionByName(starred).distinct(), reps), "pairs")
    involved = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).union(long.select("rep")).distinct()
    texts = cut(docs.withColumnRenamed("doc_id", "rep").join(involved, "rep", "left_semi"), "texts")
    found = cut(_confirmed(pairs, texts), "links")
    first = cut(components(found), "components")
    undecided, sets = _undecided(long, first, texts)
    members = cut(undecided, "undecided")
    lists = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("values"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where(F.col("c0") < F.col("c1"))
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("values") / F.lit(BLOCK_VALUES))).cast("int")
    cells = (
        members.join(lists.select("key", blocks.alias("blocks")), "key")
        .withColumn("c", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("blocks")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "rep", "comp", "c", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"))
        .join(sets, "rep")
    )
    more = cells.groupBy("key", "i", "j").applyInPandas(_cell_links, "a long, b long")
    return components(found.unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept``: one row per document."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = cut(sketches(source), "sketches")
    some = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = cut(some.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    found = links(reps.select("rep", "n", "sketch"), source)
    # one row for each class with its component; documents without words are in none
    classes = reps.select("c1", "c2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    worded = rows.where("n > 0").drop("sketch").join(classes, ["c1", "c2"], "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    whole = worded.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
