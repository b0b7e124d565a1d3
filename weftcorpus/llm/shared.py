"""What the operators of this subpackage share: words, hashes of words, shared storage."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Odd multiplier of the polynomial window hashes (arithmetic is modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty, lone surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs of ``[^\\x20\\x09-\\x0D]``: exactly what bytes.split() splits at."""
    return text_bytes(text).split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered per worker process up to ``limit`` words."""

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums and products of hashes are spread over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, BASE, np.uint64)
        down = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any ranges of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal ranges of values; ranges of unlike lengths differ too."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, n: int) -> np.ndarray:
        count = len(self.sums) - n
        if count <= 0:
            return np.zeros(0, np.uint64)
        h = (self.sums[n:] - self.sums[:count]) * self.down[:count]
        return mixed(h + np.uint64(n * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session makes one of its own;
    on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    found = found or tempfile.mkdtemp(prefix="weft-shared-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_written: list[tuple[SparkSession, str]] = []
_cleaned = [0.0]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and any executor can read it again.

    The tables of a session are removed when the driver ends, or by release().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    if time.monotonic() - _cleaned[0] > 4:
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # the cleaner then removes shuffle files and broadcasts of plans that nothing holds any more
        _cleaned[0] = time.monotonic()
    table = spark.read.schema(df.schema).parquet(path)
    table._weft_path = path
    return table


def drop(table: DataFrame) -> None:
    """Removes a table that written() has returned, once nothing reads it any more."""
    path = getattr(table, "_weft_path", None)
    for entry in [e for e in _written if e[1] == path]:
        _written.remove(entry)
        _remove(*entry)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Removes every table that written() has made."""
    while _written:
        spark, path = _written.pop()
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session has ended, and its folder with it
            return


atexit.register(release)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs that run inside hand at most about size at once to Python workers: batches stand outside the heap, in the
    executor and again in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def partitions(spark: SparkSession, amount: int, each: int) -> int:
    """The session's number of shuffle partitions, or as many more as keep each at an amount of about each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
