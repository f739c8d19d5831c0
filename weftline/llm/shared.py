"""What several operators need: table access, folds, lineage cuts, text slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to numpy in pieces of about so many bytes.
SLICE_BYTES = 1 << 20
#: Rows of a side that is broadcast at most; a larger one is joined by a shuffle.
SENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, whatever is in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 4; rows of fold 2 are held out. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir. One is set only where it is unset, and only on one machine."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftline-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows behind a reliable checkpoint, which Spark deletes once nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame) -> DataFrame:
    """df, a few numbers a row, marked for a broadcast if it has SENT rows at most; df must be cheap to count."""
    return F.broadcast(df) if df.count() <= SENT else df


#: Rows of an Arrow batch, and as many whole texts as one should hold.
BATCH, TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


class Scratch:
    """Intermediate tables as compressed Parquet under the shared folder, ``weftline-*``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, *, rows: int | None = None) -> DataFrame:
        """As cut(), for large tables; the files stay until emptied().

        rows: how many whole texts, say, go to a Python worker at once, if fewer than usual.
        """
        self.paths.append(f"{shared_folder(self.spark).rstrip('/')}/weftline-{uuid.uuid4().hex}")
        usual = self.spark.conf.get(BATCH)
        try:
            if rows is not None and rows < int(usual):
                self.spark.conf.set(BATCH, str(rows))
            df.write.parquet(self.paths[-1])
        finally:
            self.spark.conf.set(BATCH, usual)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def emptied(self) -> None:
        """Delete the files. Nothing that still has to be computed may need them."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths = []


def written(df: DataFrame) -> DataFrame:
    """Scratch.written() of a table that the result itself is read from, so that it stays."""
    return Scratch(df.sparkSession).written(df)


def sample_rows(df: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About ``most`` rows of df, or all if there are fewer, by a threshold on a hash of ``key``.

    Needs one count and no shuffle of rows; the same rows on every run and partitioning.
    """
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes: (first row, end row, bytes, offsets); a null is empty.

    A text longer than ``most`` comes alone and whole.
    """
    if not len(texts):
        return
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


#: For prefix hashes: powers of an odd multiplier and of its inverse, mod 2**64.
MULT = 0x9E3779B97F4A7C15
UNMULT = pow(MULT, -1, 1 << 64)


class Powers:
    """Powers of MULT and of its inverse up to the longest slice seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            grown = []
            for base in (MULT, UNMULT):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                grown.append(np.multiply.accumulate(x))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (byte + 1) * MULT**k over i <= k < j, mod 2**64."""
    up, _ = POWERS.to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same wherever the bytes stand."""
    _, down = POWERS.to(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with the memory that its task no longer needs given back at the end.

    Python workers live on after a task, and what their allocators keep adds to that of
    the workers beside them.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            POWERS.forget()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return whole


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]
