"""Shared by the corpus operators: tables, intermediate tables, and fast hashing of words."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

#: Near-duplicate operators take shingles of so many words, and pairs from this similarity on.
SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 75

_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_WORD_FACTORS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names
    none, a local session takes one under /tmp, and a cluster, whose machines wouldn't see each
    other's files, is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = kept.get() if kept.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder: they cut the lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *kept: DataFrame) -> None:
        """Remove tables that no later plan reads. Shuffle files of the plans that wrote them go when
        the driver collects its garbage, so it is asked to: else they lie on the disks meanwhile."""
        jvm = self.spark._jvm
        for df in kept:
            for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and what their
    allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of each hold about most_bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased, split at ASCII white space), and for
    each text the index of its first word, n + 1 in all. Equal words have equal hashes
    in every process: a polynomial of the bytes modulo 2 ** 64, then mixed."""
    first, last = int(offsets[0]), int(offsets[-1])
    data = data[first:last]
    offsets = offsets - first
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers(_R, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_R_INVERSE, n)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(_WORD_FACTORS[2])), np.searchsorted(starts, offsets)


_MULTIPLIERS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text, the hashes of its k-word shingles (k up to 5) in order, repeats kept.
    words and at are as word_hashes() gives them. A text of fewer words is one shingle,
    one without words has none."""
    mixes = [mixed(words ^ np.uint64(_WORD_FACTORS[j])) * np.uint64(_MULTIPLIERS[(j + 1) % 5]) for j in range(k)]

    def total(start: int, width: int, n: int) -> np.ndarray:
        out = mixes[0][start : start + n] + np.uint64(width)
        for j in range(1, width):
            out += mixes[j][start + j : start + j + n]
        return mixed(out)

    whole = total(0, k, len(words) - k + 1) if len(words) >= k else None
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield whole[a : b - k + 1]
        else:
            yield total(a, b - a, 1) if b > a else np.zeros(0, np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for hashes in shingle_hashes(*word_hashes(data, offsets), k):
        yield np.unique(hashes)
