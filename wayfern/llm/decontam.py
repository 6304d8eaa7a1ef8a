"""Benchmark decontamination by template canonicalisation.

Words become template words: numbers, units and names turn into typed
placeholders, everything else is lower-cased and bared of punctuation around
it.  Neighbouring names, and neighbouring numbers, are one placeholder in a second
reading of each text, so that a name or number may be replaced by one of
another word count.  Windows of template words of the benchmark and of the
documents are hash-joined, each reading with its like.  Windows with fewer than
``LITERALS`` literal words are joined by the words themselves, so that dense
lists of numbers or names match where they are copied.

Items whose texts differ by the values of their slots only are one class, which
a document is compared with once; the class's items are listed once.  A document
is compared with the classes of which it holds a window that ``common`` classes
have at most, or that is among the class's least shared ones; of a window that
more share, such as a passage's with many questions, with the first ``common``
of them or, with ``every``, with all, and what is found by such windows alone is
marked as shared.  Then all their windows are matched.  Matches of one document and one item that lie on one diagonal
(document position minus item position) form a run; a run counts if it spans
enough words, has such a window and its slots are consistent: within the run each value of the
item's slots always stands against one value of the document's and the other
way round.  That finds verbatim copies and questions whose numbers, names or
units were replaced.

A Bloom filter of the benchmark's windows, of a bounded size, is sent to the
tasks that cut documents, so that only windows that may match are joined.  It
never decides a match, and with a benchmark too large for it all windows are
joined.

Defined cases: null and empty texts match nothing; a benchmark item of fewer
words than a window is one window by itself, and items of fewer than
``LITERALS`` words match nothing; fewer literal words match exact copies only;
items of equal text are one class, and ``find`` reports each; rows that share a
document id are compared one by one and reported once for each class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_batches, split_words

#: Template words in a window, words that a run must span, literal words a window must hold.
WINDOW, SPAN, LITERALS = 8, 13, 4
#: Classes of items up to which a window tells an item from others.
COMMON = 8
#: Share of slot pairs of a run that must be consistent.
CONSISTENT = 0.8
#: Windows up to which the benchmark's hashes are kept in a Bloom filter, and its bits.
BLOOM_WINDOWS, BLOOM_BITS = 4_000_000, 1 << 26
CACHE_WORDS = 700_000
# Unit words and symbols.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz pound pounds ounce ounces gram grams ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent % $ € £ kb mb gb hz w kw v a j cal kcal mph kph °c °f degrees meter meters metre metres kilometers kilometres".split()
)
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
LITERAL, NUMBER, UNIT, NAME = range(4)
_bare = regex.compile(r"^[^\p{L}\p{N}$€£%°]+|[^\p{L}\p{N}$€£%°]+$")
_ends = regex.compile(r"[.!?:;][\"')\]]*$")


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


#: Tells windows of joined words from others.
_JOINED = np.uint64(0xD6E8FEB86659FD93)
#: Tells windows of the words themselves from others.
_EXACT = np.uint64(0xA0761D6478BD642F)
_MARKS = np.array([0, *(_hash(f"\0{kind}") for kind in ("number", "unit", "name"))], np.uint64)


def word_facts(word: str) -> tuple[int, int, bool]:
    """(hash of the bare lower-case word, class, whether a sentence ends behind it); 0 if nothing is left."""
    bare = _bare.sub("", word)
    low = bare.lower()
    if not bare:
        return 0, LITERAL, _ends.search(word) is not None
    if any(c.isdigit() for c in bare) or low in NUMBER_WORDS:
        kind = NUMBER
    elif low in UNITS and len(low) > 1 or low in "$€£%":
        kind = UNIT
    else:
        # a capital and then small letters; in capitals throughout is no name
        kind = NAME if bare[0].isupper() and bare[1:].islower() else LITERAL
    return _hash(low), kind, _ends.search(word) is not None


class Templates:
    """Template words of texts; what is known of a word is kept while it repeats."""

    def __init__(self, entries: int = CACHE_WORDS):
        self.entries, self.known = entries, {}
        self.hash, self.kind, self.ends = np.zeros(1, np.uint64), np.zeros(1, np.int8), np.zeros(1, bool)

    def _rows(self, words: list[str]) -> np.ndarray:
        found = list(map(self.known.get, words))
        lost = [w for w, x in zip(words, found, strict=True) if x is None]
        if lost:
            if len(self.known) + len(lost) > self.entries:
                self.known.clear()
                self.hash, self.kind, self.ends, lost = self.hash[:1], self.kind[:1], self.ends[:1], words
            facts = list(map(word_facts, lost))
            self.known.update(zip(lost, range(len(self.hash), len(self.hash) + len(lost)), strict=True))
            self.hash = np.concatenate([self.hash, np.array([f[0] for f in facts], np.uint64)])
            self.kind = np.concatenate([self.kind, np.array([f[1] for f in facts], np.int8)])
            self.ends = np.concatenate([self.ends, np.array([f[2] for f in facts], bool)])
            found = list(map(self.known.get, words))
        return np.array(found, np.int64)

    def canonical(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template hashes, slot values: 0 for literal words, first word of each text) of all texts in a row."""
        flat = pc.replace_substring(pc.replace_substring(pc.replace_substring(texts, "\n", " "), "\t", " "), "\r", " ")
        words, index, first = split_words(flat)
        rows = self._rows(words)[index]
        values, kinds, ends = self.hash[rows], self.kind[rows], self.ends[rows]
        kept = values != 0
        starts = np.zeros(len(rows), bool)
        starts[1:] = ends[:-1]
        starts[first[:-1][np.diff(first) > 0]] = True
        # a capital at a sentence's start says nothing
        kinds = np.where((kinds == NAME) & starts, LITERAL, kinds)
        template = np.where(kinds == LITERAL, values, _MARKS[kinds])[kept]
        slots = np.where(kinds == LITERAL, np.uint64(0), values)[kept]
        return template, slots, np.concatenate([[0], np.cumsum(kept)])[first]


def collapse(template: np.ndarray, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring names or numbers of a text as one word: template, slots, first words, and the words' places before (with the end)."""
    n = len(template)
    joins = np.zeros(n, bool)
    joins[1:] = (slots[1:] != 0) & (slots[:-1] != 0) & (template[1:] == template[:-1]) & (template[1:] != _MARKS[UNIT])
    joins[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(~joins)
    if not len(at):
        return template, slots, first, np.zeros(1, np.int64)
    sizes = np.diff(np.append(at, n))
    power = np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    value = np.add.reduceat(slots * np.cumprod(power)[np.arange(n) - np.repeat(at, sizes)], at)
    return template[at], value, np.searchsorted(at, first), np.append(at, n)


def windows(template: np.ndarray, slots: np.ndarray, first: np.ndarray, size: int = WINDOW, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of ``size`` words within one text that holds literal words enough; ``exact``: of all others, by their words."""
    n = len(template)
    if n < size or not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    literal = np.concatenate([[0], np.cumsum(slots == 0)])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero((text[: n - size + 1] == text[size - 1 :]) & ((literal[size:] - literal[:-size] >= LITERALS) != exact))
    words = np.where(slots == 0, template, slots) if exact else template
    base = np.uint64(0x100000001B3)
    h = np.full(len(at), size, np.uint64)
    for i in range(size):
        h = h * base + words[at + i]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ _EXACT if exact else h, at


def bloom(keys: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    size = min(bits, max(1 << 16, 1 << int(32 * len(keys) + 1).bit_length()))
    out = np.zeros(size >> 3, np.uint8)
    for shift in (0, 29):
        slot = (keys >> np.uint64(shift)) & np.uint64(size - 1)
        np.bitwise_or.at(out, (slot >> np.uint64(3)).astype(np.int64), np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8))
    return out


def in_bloom(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    size = np.uint64(len(found) * 8 - 1)
    ok = np.ones(len(keys), bool)
    for shift in (0, 29):
        slot = (keys >> np.uint64(shift)) & size
        ok &= (found[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return ok


def _forms(reads: list[tuple[np.ndarray, np.ndarray, np.ndarray]], short: list[int]) -> list[int]:
    """A hash for each text of both readings' template words, of which slots are equal to each other, and of the values that exact windows hold."""
    out = []
    for k in range(len(reads[0][2]) - 1):
        state = xxhash.xxh64()
        for joined, (template, slots, first) in enumerate(reads):
            a, b = first[k], first[k + 1]
            t, x = template[a:b], slots[a:b]
            _, at, back = np.unique(x, return_index=True, return_inverse=True)
            state.update(t.tobytes() + np.where(x == 0, -1, at[back]).astype(np.int64).tobytes())
            kept = np.zeros(len(x), bool)
            for size in () if joined else (*short, WINDOW):
                for w in windows(t, x, np.array([0, len(x)]), size, True)[1]:
                    kept[w : w + size] = True
            state.update(np.where(kept, x, np.uint64(0)).tobytes())
        out.append(int(np.int64(np.uint64(state.intdigest()))))
    return out


def _windows_of(rows: DataFrame, short: list[int], filtered: np.ndarray | None, items: bool) -> DataFrame:
    """``key``, ``t`` (the text's hash), ``joined`` (the reading), ``h``, ``at`` (word position), ``slots`` (the window's slot values) and ``n_words`` of the text.

    ``low`` and ``high`` are the window's ends in words that are not joined;
    ``form`` is the class of an item, null for documents.

    ``rows``: ``key``, ``t`` and ``text``.

    ``short``: lengths of items that are shorter than a window; an item has
    windows of its own length then, a document of each such length.
    """
    kind = dict(rows.dtypes)["key"]
    shared = rows.sparkSession.sparkContext.broadcast(filtered)
    state: dict = {}

    def make(keys: list, hashes: list, texts: pa.Array) -> dict:
        found = shared.value
        read = state.setdefault("templates", Templates()).canonical(texts)
        out: dict = {"key": [], "t": [], "joined": [], "h": [], "at": [], "slots": [], "n_words": [], "low": [], "high": [], "form": []}
        forms = _forms([read, collapse(*read)[:3]], short) if items else None
        for joined in (False, True):
            template, slots, first, place = collapse(*read) if joined else (*read, np.arange(len(read[0]) + 1))
            n_words = np.diff(first)
            for size in (*short, WINDOW):
                h, at = windows(template, slots, first, size)
                if joined:
                    h = h ^ _JOINED
                else:
                    h, at = map(np.concatenate, zip((h, at), windows(template, slots, first, size, True), strict=True))
                text = np.searchsorted(first, at, side="right") - 1
                ok = np.ones(len(h), bool) if found is None else in_bloom(h, found)
                if items:
                    ok &= (n_words[text] == size) | ((size == WINDOW) & (n_words[text] > size))
                h, at, text = h[ok], at[ok], text[ok]
                out["key"] += [keys[t] for t in text]
                out["t"] += [hashes[t] for t in text]
                out["joined"] += [joined] * len(h)
                out["h"] += h.astype(np.int64).tolist()
                out["at"] += (at - first[text]).tolist()
                out["slots"] += [slots[a : a + size].astype(np.int64).tolist() for a in at.tolist()]
                out["n_words"] += n_words[text].tolist()
                out["form"] += [forms[t] if items else None for t in text]
                begin = read[2][text]
                out["low"] += (place[at] - begin).tolist()
                out["high"] += (place[at + size] - begin).tolist()
        return out

    return map_batches(rows, ["key", "t", "text"], make, f"key {kind}, t long, joined boolean, h long, at int, slots array<long>, n_words int, low int, high int, form long", 1024, arrow_in=True)


def _word_counts(items: DataFrame, text_col: str) -> DataFrame:
    def make(texts: pa.Array) -> dict:
        read = Templates().canonical(texts)
        return {"n": [*np.diff(read[2]).tolist(), *np.diff(collapse(*read)[2]).tolist()]}

    return map_batches(items, [text_col], make, "n int", arrow_in=True)


def _read_items(benchmark: DataFrame, short: list[int], item_id: str, text_col: str) -> DataFrame:
    """The windows of all items with their class ``form``: items of one form have the same windows and the same slots equal to each other."""
    keyed = benchmark.select(F.col(f"`{item_id}`").alias("key"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{text_col}`").alias("text"))
    return cut(_windows_of(keyed, short, None, True), "benchmark-windows")


def _values(at: str, slots: str) -> Column:
    """(position, value) of a window's slots."""
    places = F.transform(slots, lambda x, k: F.struct((F.col(at) + k).alias("p"), x.alias("v")))
    return F.filter(places, lambda x: x["v"] != 0)


def _filled(items: DataFrame) -> DataFrame:
    """``form``, ``joined``, ``filled`` (a hash of all slot values) and ``item`` of every item and reading."""
    one = items.groupBy("form", "joined", F.col("key").alias("item"), "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(_values("at", "slots"))))).alias("x"))
    return one.select("form", "joined", "item", F.xxhash64("x").alias("filled")).distinct()


def _short_lengths(benchmark: DataFrame, text_col: str) -> list[int]:
    return sorted(r.n for r in _word_counts(benchmark, text_col).where((F.col("n") < WINDOW) & (F.col("n") >= LITERALS)).distinct().collect())  # a few lengths below a window


def _runs(docs: DataFrame, items: DataFrame, short: list[int], doc_id: str, text_col: str, common: int | None, every: bool = False) -> DataFrame:
    """The best run of each document and class: ``doc``, ``form``, ``joined``, ``filled``, ``span``, ``slots``, ``changed``, ``shared``, ``first`` and ``n_items``.

    ``every``: all classes of a window are asked, however many share it.
    """
    classes = items.groupBy("form").agg(F.min("key").alias("first"), F.count_distinct(F.struct("key")).alias("n_items"))
    filtered = None
    if items.count() <= BLOOM_WINDOWS:
        filtered = bloom(items.select("h").distinct().toPandas()["h"].to_numpy(np.int64).astype(np.uint64))
    # all items of a form have each of its windows, so the least item stands for it in all
    rep = items.groupBy("form", "joined", "h", "at").agg(F.min(F.struct("key", "t", "slots", "n_words", "low", "high")).alias("r"))
    rep = cut(rep.select("form", "joined", "h", F.col("at").alias("i_at"), F.col("r.slots").alias("i_slots"), "r.n_words", "r.low", "r.high", F.col("r.key").alias("key")), "benchmark-windows")
    rated = rep.join(rep.groupBy("h").agg(F.count_distinct("form").alias("n_forms")), "h")
    if common is None:
        i = rated.withColumns({"telling": F.lit(True), "asked": F.lit(True)})
    else:
        least = rated.groupBy("form", "joined").agg(F.greatest(F.min("n_forms"), F.lit(common)).alias("most"))
        telling = F.col("n_forms") <= F.col("most")
        i = rated.join(least, ["form", "joined"]).withColumns({"telling": telling, "asked": F.lit(True)})
    if common is not None and not every:
        order = Window.partitionBy("h").orderBy(F.col("key").asc_nulls_last(), "form")
        # the first forms of a window that more share: they are asked, though it tells no form from others
        owners = rated.where(F.col("n_forms") > common).select("h", "form", "key").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= common).select("h", "form", F.lit(True).alias("owner"))
        i = i.join(owners, ["h", "form"], "left").withColumn("asked", F.col("telling") | F.coalesce("owner", F.lit(False)))
    i = cut(i.select("form", "joined", "h", "i_at", "i_slots", "n_words", "low", "high", "telling", "asked"), "benchmark-windows")
    keyed = docs.select(F.col(f"`{doc_id}`").alias("key"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"), F.col(f"`{text_col}`").alias("text"))
    found = _windows_of(keyed, short, filtered, False).join(i.select("h").distinct(), "h", "left_semi")
    d = cut(found.select(F.col("key").alias("doc"), "t", "h", F.col("at").alias("d_at"), F.col("slots").alias("d_slots")), "document-windows")
    asked = d.join(i.where("asked").select("h", "form").distinct(), "h").select(F.col("doc").alias("c_doc"), F.col("t").alias("c_t"), F.col("form").alias("c_form")).distinct()
    compared = d.join(asked, (F.col("t") == F.col("c_t")) & F.col("doc").eqNullSafe(F.col("c_doc")))
    pairs = F.filter(
        F.transform(F.arrays_zip("i_slots", "d_slots"), lambda x, k: F.struct((F.col("i_at") + k).alias("p"), x["i_slots"].alias("i"), x["d_slots"].alias("d"))),
        lambda x: x["i"] != 0,
    )
    matched = compared.join(i.withColumnRenamed("h", "i_h"), (F.col("h") == F.col("i_h")) & (F.col("form") == F.col("c_form")))
    matched = matched.select("doc", "t", "form", "telling", "asked", "joined", "low", "high", (F.col("d_at") - F.col("i_at")).alias("diagonal"), "i_at", F.least(F.lit(WINDOW), "n_words").alias("w"), "n_words", pairs.alias("pairs"))
    runs = matched.groupBy("doc", "t", "form", "joined", "diagonal").agg(
        F.bool_or("telling").alias("telling"),
        F.bool_or("asked").alias("asked"),
        F.min("i_at").alias("first_at"),
        F.max("i_at").alias("last"),
        (F.max("high") - F.min("low")).alias("words"),
        F.size(F.collect_set("i_at")).alias("n"),
        F.max("w").alias("w"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    span = F.col("last") - F.col("first_at") + F.col("w")
    values = F.transform("pairs", lambda x: F.struct(x["i"], x["d"]))
    kinds = F.size(F.array_distinct(values))
    one_way = F.least(F.size(F.array_distinct(F.transform("pairs", lambda x: x["i"]))), F.size(F.array_distinct(F.transform("pairs", lambda x: x["d"]))))
    good = F.col("asked") & (span >= F.least(F.lit(SPAN), "n_words")) & (2 * F.col("n") > F.col("last") - F.col("first_at")) & (one_way >= F.lit(CONSISTENT) * kinds)
    filled = F.xxhash64(F.array_sort(F.transform("pairs", lambda x: F.struct(x["p"].alias("p"), x["d"].alias("v")))))
    best = F.struct(F.col("words").alias("span"), F.size("pairs").alias("slots"), F.exists("pairs", lambda x: x["i"] != x["d"]).alias("changed"), (~F.col("telling")).alias("shared"), "joined", filled.alias("filled"))
    return runs.where(good).groupBy("doc", "form").agg(F.max(best).alias("r")).select("doc", "form", "r.*").join(classes, "form")


def find_classes(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", common: int | None = COMMON, every: bool = False) -> DataFrame:
    """A row for each document and class of items it holds; items that differ by the values of their slots only are one class.

    Columns: the document's id; the id of the best item (the one whose values the
    document has, if it holds one whole, else the class's least); ``class_id``, the
    least item of the class; ``n_items`` of it (``members`` lists them); ``shared``,
    whether the run is of windows only that more than ``common`` classes share, of
    which ``common`` classes are reported then, or all with ``every``; ``span_words``
    (words of the longest counting run), ``n_slots`` (its slots) and ``changed``
    (whether any slot's value differs from the best item's).  With ``every`` each
    class that shares a window is compared, and ``shared`` still tells which runs
    have no window of their own; with ``common`` None no window counts as shared.
    """
    short = _short_lengths(benchmark, text_col)
    items = _read_items(benchmark, short, item_id, text_col)
    found = _runs(docs, items, short, doc_id, text_col, common, every)
    exact = _filled(items).groupBy("form", "joined", "filled").agg(F.min("item").alias("item"), F.lit(True).alias("equal"))
    out = found.join(exact, ["form", "joined", "filled"], "left")
    columns = {doc_id: F.col("doc"), item_id: F.coalesce("item", "first"), "class_id": F.col("first"), "n_items": F.col("n_items"), "shared": F.col("shared")}
    more = {"span_words": F.col("span").cast("long"), "n_slots": F.col("slots").cast("long"), "changed": F.col("equal").isNull() & F.col("changed")}
    return out.select(*(c.alias(name) for name, c in (columns | more).items()))


def members(benchmark: DataFrame, item_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``class_id`` and the item's id, once for each item that has a window."""
    items = _read_items(benchmark, _short_lengths(benchmark, text_col), item_id, text_col)
    classes = items.groupBy("form").agg(F.min("key").alias("class_id"))
    return items.select("form", "key").distinct().join(classes, "form").select("class_id", F.col("key").alias(item_id)).distinct()


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", common: int | None = COMMON) -> DataFrame:
    """A row for each document and item it holds: the classes of ``find_classes`` spelled out.

    Columns: the two ids, ``span_words`` (words of the longest counting run),
    ``n_slots`` (its slots) and ``changed`` (whether any slot's value differs; a run
    that is not of a whole item is held against the class's least item).  A run of
    windows only that more than ``common`` classes share, as of a prompt, is no
    contamination here; with ``common`` None it is.
    """
    short = _short_lengths(benchmark, text_col)
    items = _read_items(benchmark, short, item_id, text_col)
    found = _runs(docs, items, short, doc_id, text_col, common).where(~F.col("shared")).withColumnRenamed("filled", "d_filled")
    every = found.join(_filled(items), ["form", "joined"])
    out = every.groupBy("doc", "item").agg(F.max(F.struct("span", "slots", ((F.col("filled") != F.col("d_filled")) & F.col("changed")).alias("changed"))).alias("run"))
    return out.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("run.span").cast("long").alias("span_words"), F.col("run.slots").cast("long").alias("n_slots"), F.col("run.changed").alias("changed"))
