"""Shared helpers: scratch tables on shared storage, vectorised hashing, small parsing tools."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
#: White space as the contracts define it: space and \t \n \v \f \r.
SPACE = " \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset in local mode a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"{tempfile.gettempdir()}/checkpoints"
    return found.rstrip("/")


class Scratch:
    """Intermediate tables written as Parquet below the shared folder.

    A written table cuts the lineage: an executor lost later costs a re-read, not a recomputation.
    ``drop`` removes a table that nothing lazy refers to any more; the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/signalkiln/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.n = 0
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may be gone when Python ends
            pass

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:02d}-{label}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._remove(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that a batch of long texts stays in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Return freed memory of a Python worker to the system at the end of a task; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` any number of times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown when a longer text comes."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.up = self.down = np.ones(0, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            out = []
            for b in (self.base, self.inverse):
                p = np.ones(size, np.uint64)
                have = 1
                while have < size:
                    step = np.uint64(pow(b, have, 1 << 64))
                    p[have : 2 * have] = p[:have] * step
                    have *= 2
                out.append(p)
            self.up, self.down = out
            self.n = size
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """s with s[j] - s[i] the polynomial of data[i:j], shifted by i."""
    up, _ = POWERS.to(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end) of the data behind prefix_hash's ``s``."""
    _, down = POWERS.to(len(s))
    return mix64((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


_K = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text with A-Z lower-cased.

    With fewer words than ``width`` the whole sequence is the one shingle; without words it is empty.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    a, b = word_bounds(data)
    if not len(a):
        return np.zeros(0, np.uint64)
    words = range_hash(prefix_hash(data), a, b)
    if len(words) < width:
        k = mix64(np.arange(1, len(words) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        return mix64(np.array([(words * k).sum(dtype=np.uint64) + np.uint64(len(words))], np.uint64))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j : j + n] * _K[j % 8] * np.uint64(2 * (j // 8) + 1)
    return np.unique(mix64(out))
