"""Language identification by unigrams summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary.
The probability of a word is the sum, over every way of cutting it into pieces,
of the product of the pieces' probabilities; a forward pass over the word's
positions gives that sum.  A text's score for a language is the sum of its
words' log probabilities, and the prediction is the language of the highest
score.  ``score`` is that language's share of the posterior under equal priors.

Training estimates the piece probabilities by expectation maximisation
(forward-backward over the words) from a bounded sample of labelled documents:
``sample_docs`` whole documents of each language, the distinct texts of the
smallest hashes.  The model holds a probability for each piece and language, so
that its size follows from the vocabulary and the languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
documents without a language are not learned from; if nothing can be learned
every text is ``und``; ties go to the first language by name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, split_words

UND = "und"
#: Labelled documents of distinct texts of each language that a model is fitted on.
SAMPLE_DOCS = 300
#: The hash limit lets so many times as many texts pass, so that the sample is full with certainty for practical purposes.
MARGIN = 2.0
ROUNDS = 3
#: Share of the uniform distribution mixed into every language's pieces.
SMOOTHING = 0.02
#: Log probability of a character that no piece covers, the same in all languages.
UNKNOWN = -14.0
#: Cells (words x positions x languages) of a forward table in training, unless one word has more.
CELLS = 2_000_000
CACHE_WORDS = 700_000
BASE = np.uint64(0x100000001B3)
_letters = regex.compile(r"\p{L}+")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], int]:
    """Piece -> id of a sentencepiece model, and the longest length; all its pieces of letters, in lower case (words are runs of letters)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    pieces = sorted({p.lower() for p in names if regex.fullmatch(r"▁?\p{L}+|▁", p)})
    return {p: i for i, p in enumerate(pieces)}, max(map(len, pieces))


class Lattice:
    """All pieces within some words: edges (word, start, end, piece), by end."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int):
        edges = []
        get = pieces.get
        for w, word in enumerate(words):
            n = len(word)
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    p = get(word[i:j])
                    if p is not None:
                        edges.append((j, w, i, p))
                    elif j == i + 1:
                        edges.append((j, w, i, -1))
        table = np.array(edges, np.int64).reshape(-1, 4)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.end, self.word, self.start, self.piece = table.T
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(self.lengths.max(initial=0)) + 1
        self.cuts = np.searchsorted(self.end, np.arange(self.width + 1))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """log of the sum over segmentations up to each position: (words, positions, languages).

        ``logp`` has a last row for characters that no piece covers.
        """
        langs = logp.shape[1]
        alpha = np.full((len(self.lengths), self.width, langs), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, self.width):
            e = slice(self.cuts[j], self.cuts[j + 1])
            words = self.word[e]
            if not len(words):
                continue
            values = alpha[words, self.start[e]] + logp[self.piece[e]]
            first = np.flatnonzero(np.diff(words, prepend=-1))
            alpha[words[first], j] = np.logaddexp.reduceat(values, first, axis=0)
        return alpha

    def expected(self, logp: np.ndarray, counts: np.ndarray, n_pieces: int) -> np.ndarray:
        """Expected number of uses of each piece, (pieces, languages), for words seen ``counts`` times."""
        langs = logp.shape[1]
        alpha = self.forward(logp)
        total = alpha[np.arange(len(self.lengths)), self.lengths]
        beta = np.full_like(alpha, -np.inf)
        beta[np.arange(len(self.lengths)), self.lengths] = 0.0
        uses = np.zeros((n_pieces, langs))
        for j in range(self.width - 1, 0, -1):
            e = slice(self.cuts[j], self.cuts[j + 1])
            words, start, piece = self.word[e], self.start[e], self.piece[e]
            if not len(words):
                continue
            through = logp[piece] + beta[words, j]
            share = np.exp(alpha[words, start] + through - total[words]) * counts[words]
            known = piece >= 0
            np.add.at(uses, piece[known], share[known])
            np.logaddexp.at(beta, (words, start), through)
        return uses


@dataclass(frozen=True)
class Model:
    """``logp``: (pieces + 1, languages) log probabilities, the last row for uncovered characters."""

    path: str
    languages: tuple[str, ...]
    logp: np.ndarray


def fit(words: list[str], counts: np.ndarray, languages: list[str], path: str, rounds: int = ROUNDS) -> Model:
    """EM from distinct words and how often each language has them, (words, languages)."""
    pieces, longest = vocabulary(path)
    n, langs = len(pieces), len(languages)
    logp = np.full((n + 1, langs), -np.log(n))
    logp[-1] = UNKNOWN
    if langs and words:
        # in slices of like lengths, as the forward table has a cell for each position and language
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        slices, at = [], 0
        while at < len(order):
            width = (lengths[order[at:]] + 1) * langs * np.arange(1, len(order) - at + 1)
            end = at + max(1, int(np.searchsorted(width, CELLS, side="right")))
            slices.append(order[at:end])
            at = end
        lattices = [Lattice([words[i] for i in s], pieces, longest) for s in slices]
        for _ in range(rounds):
            uses = sum(x.expected(logp, counts[s], n) for x, s in zip(lattices, slices, strict=True))
            share = uses / np.maximum(uses.sum(0), 1e-9)
            logp[:-1] = np.log((1 - SMOOTHING) * share + SMOOTHING / n)
    return Model(path, tuple(languages), logp.astype(np.float32))


class PieceTable:
    """Piece numbers by the pieces' hashes, open addressing in NumPy."""

    def __init__(self, pieces: dict[str, int]):
        self.n = len(pieces)
        hashes = np.zeros(self.n, np.uint64)
        for piece, i in pieces.items():
            h = 0
            for c in piece:
                h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        self.bits = max(10, (8 * self.n).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)  # no piece hashes to 0
        self.numbers = np.full(1 << self.bits, -1, np.int32)
        for i, (h, slot) in enumerate(zip(hashes.tolist(), self._slot(hashes).tolist(), strict=True)):
            while self.keys[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.numbers[slot] = h, i

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, hashes: np.ndarray, single: bool = False) -> np.ndarray:
        """Numbers of pieces; others are n for single characters and n + 1 for longer strings."""
        slot = self._slot(hashes)
        there = self.keys[slot]
        out = np.where(there == hashes, self.numbers[slot], self.n + (0 if single else 1))
        todo = np.nonzero((there != hashes) & (there != 0))
        while len(todo[0]):
            at = (slot[todo] + 1) & ((1 << self.bits) - 1)
            slot[todo] = at
            there = self.keys[at]
            hit = there == hashes[todo]
            out[tuple(t[hit] for t in todo)] = self.numbers[at[hit]]
            more = ~hit & (there != 0)
            todo = tuple(t[more] for t in todo)
        return out


class Scorer:
    """Words' log probabilities, kept while they repeat."""

    def __init__(self, model: Model, entries: int = CACHE_WORDS):
        self.model, self.entries = model, entries
        self.pieces, self.longest = vocabulary(model.path)
        self.table_of = PieceTable(self.pieces)
        # rows for pieces, for uncovered characters and for longer strings that are no piece
        self.prob = np.concatenate([np.exp(model.logp.astype(np.float64)), np.zeros((1, len(model.languages)))])
        self.absent = len(self.pieces) + 1
        self.words: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, len(model.languages)), np.float64)
        self.letters = np.zeros(1, bool)

    def _score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language, words of one length at a time."""
        out = np.zeros((len(words), len(self.model.languages)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, rows in by_length.items():
            step = max(1, 400_000 // n)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                codes = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), n)
                out[part] = self._forward(codes)
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        """The forward pass over words of one length.

        Probabilities are kept for the last ``longest`` positions only and
        rescaled as they shrink; ``shift`` has the log of what was divided out.
        """
        n, length = codes.shape
        langs = len(self.model.languages)
        columns = np.ascontiguousarray(codes.T).astype(np.uint64) + np.uint64(1)
        # the hash of the piece from i on for each length, one character longer a step
        hashes = columns.copy()
        found = [self.table_of.find(hashes, single=True)]
        for size in range(2, min(self.longest, length) + 1):
            hashes = hashes[: length - size + 1] * BASE + columns[size - 1 :]
            found.append(self.table_of.find(hashes))
        alpha = [np.ones((n, langs))]
        shift = np.zeros((n, 1))
        for j in range(1, length + 1):
            total = np.zeros((n, langs))
            for size in range(1, min(self.longest, j) + 1):
                piece = found[size - 1][j - size]
                if size == 1 or (piece != self.absent).any():
                    total += alpha[-size] * self.prob[piece]
            alpha = [*alpha[-self.longest + 1 :], total]
            if j % 8 == 0:
                scale = total.max(1, keepdims=True)
                alpha = [np.maximum(a / scale, 1e-250) for a in alpha]
                shift += np.log(scale)
        return np.log(alpha[-1]) + shift

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > self.entries:
            self.known.clear()
            self.words.clear()
            self.table, self.letters = self.table[:1], self.letters[:1]
        lower = pc.utf8_lower(pa.array(chunks, pa.string())).to_pylist()
        split = [(w,) if w.isalpha() else _letters.findall(w) for w in lower]
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.words]
        at = len(self.table)
        self.words.update(zip(new, range(at, at + len(new)), strict=True))
        self.table = np.concatenate([self.table, self._score(["▁" + w for w in new])])
        single = [i for i, ws in enumerate(split) if len(ws) == 1]
        self.known.update((chunks[i], self.words[split[i][0]]) for i in single)
        rest = [i for i, ws in enumerate(split) if len(ws) != 1]
        rows = np.zeros((len(rest), self.table.shape[1]))
        for k, i in enumerate(rest):
            if split[i]:
                rows[k] = self.table[[self.words[w] for w in split[i]]].sum(0)
        self.known.update((chunks[i], len(self.table) + k) for k, i in enumerate(rest))
        self.table = np.concatenate([self.table, rows])
        letters = np.ones(len(self.table) - at, bool)
        letters[len(new) :] = [bool(split[i]) for i in rest]
        self.letters = np.concatenate([self.letters, letters])

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs = self.model.languages
        if not langs:
            return [UND] * len(texts), [0.0] * len(texts)
        chunks, index, first = split_words(pc.replace_substring(texts, "\n", " "))
        found = list(map(self.known.get, chunks))
        lost = [c for c, x in zip(chunks, found, strict=True) if x is None]
        if lost:
            self._learn(chunks if len(self.known) + len(lost) > self.entries else lost)
            found = list(map(self.known.get, chunks))
        rows = np.array(found, np.int64)[index]
        n = len(first) - 1
        which = np.repeat(np.arange(n), np.diff(first))
        has = np.bincount(which, self.letters[rows], n) > 0
        scores = np.stack([np.bincount(which, self.table[rows, k], n) for k in range(len(langs))], 1)
        best = scores.argmax(1)
        share = 1 / np.exp(np.clip(scores - scores.max(1, keepdims=True), -700, 0)).sum(1)
        return [langs[b] if h else UND for b, h in zip(best, has, strict=True)], np.where(has, share, 0.0).tolist()


def train(labelled: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit a model on ``sample_docs`` whole documents of each language, or all distinct texts of one that has fewer.

    The sample depends on the texts alone and takes a text once; copies do not
    lower the rate, as it comes from the number of distinct texts.  Hashes are
    compared in the scan, so that little more than the sample is moved; word
    counts are aggregated by the executors.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    labelled = labelled.where(lang.isNotNull() & text.isNotNull())
    rows = labelled.select(text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("h")).withColumn("order", F.pmod("h", F.lit(1 << 30)))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = sizes.select("lang", (F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(MARGIN * sample_docs) / F.col("n"))).cast("long").alias("limit"))
    kept = rows.join(F.broadcast(share), "lang").where(F.col("order") < F.col("limit"))  # a row a language
    texts = kept.groupBy("lang", "order", "h").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "h"))  # over some hundred texts a language
    sample = texts.withColumn("place", place).where(F.col("place") <= sample_docs)

    def words(langs: list, texts: list) -> dict:
        out: dict[tuple[str, str], int] = {}
        for lang, text in zip(langs, texts, strict=True):
            for w in _letters.findall(text.lower()):
                out[lang, w] = out.get((lang, w), 0) + 1
        return {"lang": [k[0] for k in out], "word": [k[1] for k in out], "n": list(out.values())}

    counted = map_batches(sample, ["lang", "text"], words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counted.toPandas().sort_values(["lang", "word"])  # bounded by the sample
    languages = sorted(found["lang"].unique().tolist())
    distinct, code = np.unique(found["word"].to_numpy(str), return_inverse=True) if len(found) else (np.array([], str), np.array([], int))
    counts = np.zeros((len(distinct), len(languages)))
    if len(found):
        counts[code, np.searchsorted(languages, found["lang"].to_numpy(str))] = found["n"]
    return fit(["▁" + w for w in distinct.tolist()], counts, languages, path)


_scorers: dict[int, Scorer] = {}


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (one id column at least), ``lang_pred`` and ``score``.

    A narrow transformation; the model is broadcast, a few MB whatever the input.
    """
    import zlib

    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    key = zlib.crc32(model.logp.tobytes() + "\0".join(model.languages).encode())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(*columns) -> dict:
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        langs, scores = _scorers[key].predict(columns[-1])
        return dict(zip(keep, columns, strict=False)) | {"lang_pred": langs, "score": scores}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return map_batches(docs, [*keep, text_col], make, f"{schema}, lang_pred string, score double", 1024, arrow_in=True)
