"""Byte-level BPE encoding and decoding.

Method: for each piece (a match of the vocabulary's split pattern) a segment
tree over its byte positions holds, at every inner node, the leftmost position
of the lowest pair rank below it.  A merge reads the root, then updates the
three leaves it touches (the merged pair's, its left neighbour's and that of
the byte that vanished) and their ancestors: O(log n) a merge, O(n log n) a
piece, so a piece of 100,000 letters is no special case.

All pieces that a batch of texts brings for the first time are encoded
together: their trees are rows of one NumPy array for each tree height, and
every step merges the lowest pair of all of them.  Encoded chunks (pieces that
follow a single space) are kept in a dictionary of bounded size in each Python
worker, as words repeat.

Defined cases: a null text counts as empty; an empty text has no ids, the
SHA-256 of the empty string twice, and ``n_tokens`` 0.  Special-token strings
are ordinary text.  Repeated rows give repeated results; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import Packed, map_batches, split_words

#: Chunks a worker keeps at most; beyond it the dictionary starts anew.
CACHE_ENTRIES = 700_000
#: Pieces of one tree height from which NumPy pays, and the height up to which it does.
FEW, TALL = 12, 7
#: Stands for a line feed while texts are cut; texts that hold it take the pattern.
MARK = "\x01"
NO_RANK = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PairTable:
    """(left id, right id) -> id of the merged token, by open addressing in NumPy."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        self.bits = max(8, int(2 * len(keys)).bit_length())
        self.keys = np.full((1 << self.bits) + 1, -1, np.int64)
        self.merged = np.full((1 << self.bits) + 1, NO_RANK, np.int32)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == -1
            self.keys[slot[todo[free]]] = keys[todo[free]]
            lost = self.keys[slot[todo]] != keys[todo]
            won = todo[~lost]
            self.merged[slot[won]] = np.array(merged, np.int32)[won]
            todo = todo[lost]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; NO_RANK for pairs that do not merge (ids below 0 never do)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.full(len(keys), NO_RANK, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.merged[slot[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str, cache_entries: int = CACHE_ENTRIES):
        ranks = read_ranks(path)
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.byte_ids = np.full(256, -1, np.int32)
        for i in range(256):
            self.byte_ids[i] = ranks[bytes([i])]
        size = max(ranks.values()) + 1
        self.wide = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        by_id = {rank: token for token, rank in ranks.items()}
        self.tokens = Packed([by_id.get(i, b"") for i in range(size)])
        self.decimals = Packed([b"%d " % i for i in range(size)])
        self.whole = {token: np.array([rank], self.wide).tobytes() for token, rank in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.cache_entries = cache_entries
        #: Where cutting before spaces and line feeds may differ from the pattern.
        self.uneven = re.compile(r"\s[ \n](?:\s|\Z)")

    # -- encoding ---------------------------------------------------------

    def merge_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        by_height: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (known := self.whole.get(piece)) is not None:
                out[i] = known
            else:
                by_height.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for height, rows in by_height.items():
            if len(rows) < FEW or height > TALL:
                for i in rows:
                    out[i] = self._merge_one(pieces[i], height)
                continue
            step = max(1, (1 << 20) >> height)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._merge_trees([pieces[r] for r in part], height), strict=True):
                    out[i] = ids
        return out

    def _merge_trees(self, pieces: list[bytes], height: int) -> list[bytes]:
        """Merge pieces of at most 2**height bytes, a tree each.

        ``tree`` is a heap of keys rank * width + position, so that the lowest
        key is the leftmost pair of the lowest rank.
        """
        n, width = len(pieces), 1 << height
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < lengths[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        never = np.int64(NO_RANK) << height
        tree = np.full((n, 2 * width), never, np.int64)
        pair = inside[:, 1:]
        first = self.pairs.find(ids[:, :-1][pair], ids[:, 1:][pair]).astype(np.int64) << height
        tree[:, width : 2 * width - 1][pair] = np.where(first == never, never, first + np.nonzero(pair)[1])
        for level in range(height - 1, -1, -1):
            lo, hi = 1 << level, 2 << level
            np.minimum(tree[:, 2 * lo : 2 * hi : 2], tree[:, 2 * lo + 1 : 2 * hi : 2], out=tree[:, lo:hi])
        # from here on flat: byte i of row r is at r * width + i, node k of its tree at r * 2 * width + k
        after = np.arange(1, n * width + 1).reshape(n, width)
        after[after - np.arange(n)[:, None] * width >= lengths[:, None]] = -1
        after, before = after.ravel(), np.arange(-1, n * width - 1)
        before[::width] = -1
        ids, flat = ids.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < never)
        while len(live):
            base = live * width
            root = flat[2 * base + 1]
            at = base + (root & (width - 1))
            gone = after[at]
            beyond = after[gone]
            ids[at] = root >> height
            ids[gone] = -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            self._update(flat, base, gone - base, np.full(len(live), never), height)
            self._update(flat, base, at - base, self._keys(ids, at, np.where(has, beyond, -1), base, height), height)
            previous = before[at]
            some = np.flatnonzero(previous >= 0)
            p, at, row = previous[some], at[some], base[some]
            self._update(flat, row, p - row, self._keys(ids, p, at, row, height), height)
            live = live[flat[2 * base + 1] < never]
        kept = (ids >= 0).reshape(n, width)
        packed, ends = ids[kept.ravel()].astype(self.wide).tobytes(), (np.cumsum(kept.sum(1)) * self.wide.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _merge_one(self, piece: bytes, height: int) -> bytes:
        """The same for one piece, in plain Python: for long pieces, of which there are few."""
        width, never = 1 << height, NO_RANK << height
        rank = self.ranks.get
        token = [piece[i : i + 1] for i in range(len(piece))]
        after, before = [*range(1, len(piece)), -1], list(range(-1, len(piece) - 1))

        def key(at: int) -> int:
            found = rank(token[at] + token[after[at]]) if after[at] >= 0 else None
            return never if found is None else (found << height) + at

        tree = [never] * (2 * width)
        tree[width : width + len(piece)] = map(key, range(len(piece)))
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(at: int, value: int) -> None:
            node = at + width
            while node and tree[node] != value:
                tree[node] = value
                other = tree[node ^ 1]
                value = value if value < other else other
                node >>= 1

        while tree[1] < never:
            at = tree[1] & (width - 1)
            gone = after[at]
            token[at], token[gone] = token[at] + token[gone], b""
            after[at] = after[gone]
            if after[at] >= 0:
                before[after[at]] = at
            put(gone, never)
            put(at, key(at))
            if before[at] >= 0:
                put(before[at], key(before[at]))
        return np.array([self.ranks[t] for t in token if t], self.wide).tobytes()

    def _keys(self, ids: np.ndarray, left: np.ndarray, right: np.ndarray, base: np.ndarray, height: int) -> np.ndarray:
        """Keys of the pairs at these flat positions; a right position of -1 is no pair."""
        rank = self.pairs.find(ids[left], np.where(right >= 0, ids[right], -1)).astype(np.int64)
        return np.where(rank == NO_RANK, np.int64(NO_RANK) << height, (rank << height) + left - base)

    @staticmethod
    def _update(flat: np.ndarray, base: np.ndarray, leaf: np.ndarray, keys: np.ndarray, height: int) -> None:
        """Set leaves, then their ancestors from the bottom to the root."""
        tree = 2 * base
        node = leaf + (1 << height)
        flat[tree + node] = keys
        for _ in range(height):
            keys = np.minimum(keys, flat[tree + (node ^ 1)])
            node >>= 1
            flat[tree + node] = keys

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks to the dictionary."""
        # letters after at most one space are one piece
        split = [(c,) if c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else self.pattern.findall(c) for c in chunks]
        new = [p for p in dict.fromkeys(p for ps in split for p in ps) if p not in self.cache]
        self.cache.update(zip(new, self.merge_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True))
        for chunk, ps in zip(chunks, split, strict=True):
            if len(ps) != 1:
                self.cache[chunk] = b"".join(map(self.cache.__getitem__, ps))

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text.

        A text is cut before each space and line feed.  The pattern never
        matches across such a cut, as long as no white space stands on both
        sides of one: a space run's last character always begins a match or is
        one.  Texts with longer runs (``uneven``) are split by the pattern.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = {i for i, t in enumerate(texts.to_pylist()) if t and (self.uneven.search(t) or MARK in t)}
        marked = pc.replace_substring(texts, "\n", f" {MARK}")
        words, index, first = split_words(marked)
        # a word stands for itself behind its space; marked ones and a text's first have none
        heads = first[:-1][np.diff(first) > 0]
        head_words = [words[i] for i in index[heads]]
        chunks = ["\n" + w[1:] if w[:1] == MARK else " " + w for w in words] + ["\n" + w[1:] if w[:1] == MARK else w for w in head_words]
        index = index.astype(np.int64)
        index[heads] = len(words) + np.arange(len(heads))
        packed = Packed(self._packed(chunks)).units(self.wide.itemsize, self.wide.str)
        ids = packed.join(index)
        ends = np.concatenate([[0], np.cumsum(packed.lengths[index])])[first]
        out = [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in odd:
            out[i] = np.frombuffer(b"".join(self._packed(self.pattern.findall(texts[i].as_py()))), self.wide)
        return out

    def _packed(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, chunks))
        if None in found:
            lost = [i for i, x in enumerate(found) if x is None]
            if len(self.cache) + 2 * len(lost) > self.cache_entries:
                self.cache.clear()
            self._learn([chunks[i] for i in lost])
            for i in lost:
                found[i] = self.cache[chunks[i]]
        return found

    # -- decoding ---------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.tokens.join(ids).tobytes()

    def decimal_ids(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by one space."""
        return self.decimals.join(ids).tobytes()[:-1]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every document, as digests.

    Columns: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.  A
    narrow transformation: no shuffle, memory bounded by an Arrow batch and
    the dictionary.
    """
    kind = dict(docs.dtypes)[id_col]

    def make(keys: list, texts: pa.Array) -> dict:
        c = codec(path, pattern)
        encoded = c.encode_batch(texts)
        return {
            id_col: keys,
            "n_tokens": [len(ids) for ids in encoded],
            "ids_sha256": [hashlib.sha256(c.decimal_ids(ids)).hexdigest() for ids in encoded],
            "decoded_sha256": [hashlib.sha256(c.decode_bytes(ids)).hexdigest() for ids in encoded],
        }

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", 1024, arrow_in=True)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``token_ids``, an array of every document's ids."""
    kind = dict(docs.dtypes)[id_col]

    def make(keys: list, texts: pa.Array) -> dict:
        return {id_col: keys, "token_ids": [ids.tolist() for ids in codec(path, pattern).encode_batch(texts)]}

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {kind}, token_ids array<int>", 1024, arrow_in=True)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """The id column and ``text`` of ``token_ids``; ids that cut a character decode to U+FFFD, null ids to null."""
    kind = dict(rows.dtypes)[id_col]

    def make(keys: list, lists: list) -> dict:
        c = codec(path, pattern)
        return {id_col: keys, "text": [None if ids is None else c.decode_bytes(np.array(ids, np.int64)).decode("utf-8", "replace") for ids in lists]}

    return map_batches(rows, [id_col, "token_ids"], make, f"`{id_col}` {kind}, text string", 256)


def token_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``n_tokens`` of every document."""
    kind = dict(docs.dtypes)[id_col]

    def make(keys: list, texts: pa.Array) -> dict:
        return {id_col: keys, "n_tokens": [len(ids) for ids in codec(path, pattern).encode_batch(texts)]}

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {kind}, n_tokens long", 1024, arrow_in=True)
