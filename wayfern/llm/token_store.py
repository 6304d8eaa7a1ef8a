"""Token ids in binary files of compressed byte planes.

File format (integers little-endian): ``WFTP``, u32 version, then chunks, the
document index, the chunk index and a footer.

* A chunk holds up to ``CHUNK_IDS`` ids.  Ids are taken in blocks of
  ``BLOCK_IDS``; a block is transposed into byte planes, plane b holding byte b
  of every id.  For each plane the parts of all blocks are joined and compressed
  with zstandard; planes of only zeros are left out by a mask.
* The document index (zstandard): a u8 null mark and i64 doc_id for each
  document, then a u64 number of ids each, in file order.
* The chunk index: for each chunk u64 first id, u32 ids, u64 place, u32 size,
  so that any range of ids is read without the rest of the file.
* Footer: u64 place of the document index, u64 of the chunk index, u64 chunks,
  u64 documents, ``WFTP``.

Documents are range-partitioned and sorted by id; a partition goes on to a new
file after ``FILE_IDS`` ids or ``FILE_DOCS`` documents, so that files and their
indexes stay of a bounded size however much a partition holds.  The files, in
order of their partition and number, hold all ids in ascending document order.
A file is written under a temporary name and renamed, hence a task that is run
again replaces it by the same bytes.

Defined cases: a null text counts as empty and gives just the end id; documents
with equal ids keep an order by their text; a null id sorts first; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .common import Packed, cut, scratch, split_words

MAGIC, VERSION = b"WFTP", 1
BLOCK_IDS = 4096
CHUNK_IDS = 1 << 18
#: Ids and documents after which a partition goes on to a new file.
FILE_IDS, FILE_DOCS = 1 << 28, 1 << 20
#: Byte planes of a 32-bit id.
PLANES = 4
LEVEL = 3


# -- planes ---------------------------------------------------------------


def pack_planes(ids: np.ndarray, block: int = BLOCK_IDS, level: int = LEVEL) -> bytes:
    """One chunk: a u8 mask of planes, then u32 size and zstandard frame of each plane in it."""
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    blocks = padded.view(np.uint8).reshape(-1, block, PLANES)
    press = zstandard.ZstdCompressor(level=level, write_content_size=True)
    mask, out = 0, []
    for p in range(PLANES):
        plane = np.ascontiguousarray(blocks[:, :, p])
        if plane.any():
            mask |= 1 << p
            frame = press.compress(plane)
            out += [struct.pack("<I", len(frame)), frame]
    return bytes([mask]) + b"".join(out)


def unpack_planes(data: bytes, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    at, rows = 1, -(-n // block)
    out = np.zeros((rows, block, PLANES), np.uint8)
    unpress = zstandard.ZstdDecompressor()
    for p in range(PLANES):
        if data[0] >> p & 1:
            (size,) = struct.unpack_from("<I", data, at)
            out[:, :, p] = np.frombuffer(unpress.decompress(data[at + 4 : at + 4 + size]), np.uint8).reshape(rows, block)
            at += 4 + size
    return out.reshape(-1).view("<u4")[:n]


class Writer:
    """Writes one file, holding a chunk of ids at most besides one document's."""

    def __init__(self, sink, chunk_ids: int = CHUNK_IDS, block: int = BLOCK_IDS):
        self.sink, self.chunk_ids, self.block = sink, chunk_ids, block
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list[tuple[int | None, int]] = []
        self.chunks: list[tuple[int, int, int, int]] = []
        self.at = 0
        self._put(MAGIC + struct.pack("<I", VERSION))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.chunk_ids:
            self._flush(whole=False)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        end = len(ids) if whole else len(ids) - len(ids) % self.chunk_ids
        for a in range(0, end, self.chunk_ids):
            part = ids[a : min(end, a + self.chunk_ids)]
            data = pack_planes(part, self.block)
            self.chunks.append((self.n_ids, len(part), self.at, len(data)))
            self._put(data)
            self.n_ids += len(part)
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole=True)
        docs_at = self.at
        marks = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        keys = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        lengths = np.array([n for _, n in self.docs], "<u8").tobytes()
        self._put(zstandard.ZstdCompressor(level=LEVEL).compress(marks + keys + lengths))
        chunks_at = self.at
        for c in self.chunks:
            self._put(struct.pack("<QIQI", *c))
        self._put(struct.pack("<QQQQ", docs_at, chunks_at, len(self.chunks), len(self.docs)) + MAGIC)


class Reader:
    """Reads documents in file order, or any range of ids, a chunk at a time."""

    def __init__(self, source, block: int = BLOCK_IDS):
        self.source, self.block = source, block
        size = source.size()
        foot = source.read_at(36, size - 36)
        if foot[-4:] != MAGIC or source.read_at(4, 0) != MAGIC:
            raise ValueError("not a token file")
        docs_at, chunks_at, n_chunks, n_docs = struct.unpack("<QQQQ", foot[:32])
        raw = zstandard.ZstdDecompressor().decompress(source.read_at(chunks_at - docs_at, docs_at)) if n_docs else b""
        nulls = np.frombuffer(raw, np.uint8, n_docs)
        keys = np.frombuffer(raw, "<i8", n_docs, n_docs)
        self.doc_ids = [None if null else int(k) for null, k in zip(nulls, keys, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        index = source.read_at(24 * n_chunks, chunks_at) if n_chunks else b""
        self.chunks = list(struct.iter_unpack("<QIQI", index))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end`` of this file."""
        parts = [self._chunk(c)[max(0, start - c[0]) : end - c[0]] for c in self.chunks if c[0] < end and c[0] + c[1] > start]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def _chunk(self, c: tuple[int, int, int, int]) -> np.ndarray:
        return unpack_planes(self.source.read_at(c[3], c[2]), c[1], self.block)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        chunks = iter(self.chunks)
        have = np.zeros(0, "<u4")
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts, got = [have], len(have)
            while got < n:
                parts.append(self._chunk(next(chunks)))
                got += len(parts[-1])
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield doc_id, have[:n]
            have = have[n:]


# -- encoding with the tokenizers library --------------------------------


class WordEncoder:
    """A tokenizer whose merges never cross white space, with encoded words kept.

    Words between spaces are encoded once and looked up from then on.  A new
    word of Latin letters, bare of the punctuation around it, is one piece in
    lower case; such bodies are joined by spaces, encoded some hundred at a
    time and parted again at the tokens that end a word.  All other words are
    encoded as they are.
    """

    #: Punctuation that is split from letters; not the apostrophe, which may begin a piece with letters.
    AROUND = ".,;:!?|()[]{}\"*#$%&-_/"

    def __init__(self, path: str, entries: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.entries = entries
        self.known: dict[str, bytes] = {}
        self.latin = re.compile("[A-Za-z\xdf-\xf6\xf8-\xff\xc0-\xd6\xd8-\xde]+")

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bodies(self, bodies: list[str], together: int = 256) -> list[bytes]:
        """Packed ids of lower-case Latin words."""
        groups = [bodies[i : i + together] for i in range(0, len(bodies), together)]
        out: list[bytes] = []
        for group, packed in zip(groups, self._pack([" ".join(g) for g in groups]), strict=True):
            ends = ((np.flatnonzero(self.ends[np.frombuffer(packed, "<u4")]) + 1) * 4).tolist()
            if len(ends) != len(group):
                out += self._pack(group)
            else:
                out += [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out

    def _learn(self, words: list[str]) -> None:
        parts, bodies, rest = {}, {}, []
        for word in words:
            right = word.rstrip(self.AROUND)
            body = right.lstrip(self.AROUND)
            if self.latin.fullmatch(body):
                before, after = word[: len(right) - len(body)], word[len(right) :]
                parts[word] = (before, low := body.lower(), after)
                bodies[low] = None
                rest += [x for x in (before, after) if x and x not in self.known]
            else:
                rest.append(word)
        rest = list(dict.fromkeys(rest))
        self.known.update(zip(rest, self._pack(rest), strict=True))
        known = self.known
        new = [b for b in bodies if b not in known]
        known.update(zip(new, self._bodies(new), strict=True))
        for word, (before, body, after) in parts.items():
            if before or after:
                known[word] = (known[before] if before else b"") + known[body] + (known[after] if after else b"")
            else:
                known[word] = known[body]

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.known.get, words))
        if None in found:
            lost = [i for i, x in enumerate(found) if x is None]
            if len(self.known) + 2 * len(lost) > self.entries:
                self.known.clear()
            self._learn([words[i] for i in lost])
            for i in lost:
                found[i] = self.known[words[i]]
        return found

    def encode_batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        words, index, first = split_words(pc.replace_substring(texts, "\n", " "))
        packed = Packed(self._words(words)).units(4, "<u4")
        ids = packed.join(index)
        ends = np.concatenate([[0], np.cumsum(packed.lengths[index])])[first].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# -- writing and reading tables -------------------------------------------


def write(docs: DataFrame, out_dir: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", n_parts: int | None = None, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write the ids of all documents; returns the written list of files.

    Columns: ``file_no``, ``uri``, ``n_docs``, ``n_ids`` and ``base``, the
    number of ids in all files before it.  Texts are dealt out by ranges of the
    id before they are encoded, so that each is encoded once.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    n_parts = n_parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = pairs.repartitionByRange(n_parts, "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        encoder, end = word_encoder(path), np.array([end_id], "<u4")

        def encoded() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode_batch(part.column(1)), strict=True):
                        yield doc_id, np.concatenate([ids, end])

        waiting, number = encoded(), 0
        doc = next(waiting, None)
        while doc is not None:
            uri = f"{out_dir}/part-{partition:06d}-{number:06d}.wftp"
            with storage.write_atomic(uri) as sink:
                writer, n_ids = Writer(sink), 0
                while doc is not None and n_ids < file_ids and len(writer.docs) < file_docs:
                    writer.add(*doc)
                    n_ids += len(doc[1])
                    doc = next(waiting, None)
                writer.close()
            file_no = (partition << 32) + number
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([file_no], pa.int64()), "uri": [uri], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})
            number += 1

    files = cut(dealt.mapInArrow(run, "file_no long, uri string, n_docs long, n_ids long"), "token-files")
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_read(uri) as source:
                    rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                    for doc_id, ids in Reader(source).documents():
                        for name, value in zip(rows, (doc_id, base, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())), strict=True):
                            rows[name].append(value)
                        base += len(ids)
                        if len(rows["start"]) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], names=list(rows))
                            rows = {name: [] for name in rows}
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], names=list(rows))

    spread = files.select("uri", "base").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, path: str, out_dir: str | None = None, **options) -> DataFrame:
    """Write all documents' ids, then give the rows read back from the files."""
    return read(write(docs, out_dir or scratch(docs.sparkSession, "tokens"), path, **options))
