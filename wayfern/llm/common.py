"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folder for written tables of runs within one machine that name no shared one.
LOCAL_SHARED = "/tmp/wayfern-shared"
#: Rows of an Arrow batch while a table is written.
ARROW_ROWS = 1024
_own_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/wayfern-{spark.sparkContext.applicationId}"
    if folder not in _own_folders:
        _own_folders.add(folder)
        atexit.register(discard, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table or folder that nothing reads any more."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session or its JVM has ended: what is left is only disk space
        pass


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage and survives the loss of any executor, unlike a cache or
    a local checkpoint.
    """
    return cut_to(df, scratch(df.sparkSession, what))


def cut_to(df: DataFrame, path: str) -> DataFrame:
    """``cut`` with a path of the caller's, who may discard it later.

    While it is written, Python gets batches of ``ARROW_ROWS`` rows at most:
    those of some thousand pairs of texts would take a good part of an
    executor's memory outside the heap.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def finite_vectors(vectors: DataFrame, id_col: str, vec_col: str, *more) -> DataFrame:
    """``vec_id`` (long), ``v`` (doubles) and ``more`` columns, for rows with an id and a vector of finite components."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & finite).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"), *more)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def split_words(texts: pa.Array, at: str = " ") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at each ``at``: distinct words, each word's place among them, each text's first word.

    A null text has no words, an empty one an empty word.  Arrow does the
    cutting and numbering, so that Python handles each distinct word once.
    """
    lists = pc.split_pattern(texts, at)
    words = lists.flatten().dictionary_encode()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


class Packed:
    """Byte strings by number, joined without a Python loop."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        """The bytes of these strings, one after the other."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        source = np.repeat(self.starts[numbers] - ends + lengths, lengths)
        source += np.arange(len(source))
        return self.data[source]

    def units(self, size: int, dtype: str) -> Packed:
        """The same strings as rows of numbers of ``size`` bytes: joins are that much shorter."""
        out = object.__new__(Packed)
        out.lengths, out.starts, out.data = self.lengths // size, self.starts // size, self.data.view(dtype)
        return out


def map_batches(df: DataFrame, columns: list[str], make: Callable, schema: str, rows: int = 1024, arrow_in: bool = False) -> DataFrame:
    """Apply ``make(*column lists) -> dict of column lists`` to slices of Arrow batches.

    ``arrow_in``: the last column is passed as an Arrow array instead of a list.

    Only ``columns`` are read; ``rows`` bounds what one call sees.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = _parse_datatype_string(schema)
    assert isinstance(spark_schema, StructType)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                last = part.num_columns - 1
                out = make(*(part.column(i) if arrow_in and i == last else part.column(i).to_pylist() for i in range(last + 1)))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*(F.col(f"`{c}`") for c in columns)).mapInArrow(run, spark_schema)
