"""Shared pieces: the shared folder, written tables, words and hashes of whole texts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id sorts after every other one: it can lose words or rows to others, never take them.
LAST_ID = 2**63 - 1


def order_key(id_col: str = "doc_id"):
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. One of our own only where that is unset and the master local, as in tests: on a cluster
    executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="burstline-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _file(spark: SparkSession, path: str):
    """A path and its file system, as Spark takes it: without a scheme it is in the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    path, system = _file(spark, path)
    return system.makeQualified(path).toString()


def delete(spark: SparkSession, path: str) -> None:
    path, system = _file(spark, path)
    system.delete(path, True)


#: Folders of this session, innermost scratch() last.
_FOLDERS: list[list[str]] = [[]]


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/burstline/{name}-{uuid.uuid4().hex}"
    _FOLDERS[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """Folders made inside are deleted at the end: for a result that is written inside, by kept()."""
    _FOLDERS.append([])
    try:
        yield
    finally:
        for path in _FOLDERS.pop():
            delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """As written(), but the folder outlives the innermost scratch()."""
    out = written(df, name)
    if len(_FOLDERS) > 1:
        _FOLDERS[-2].append(_FOLDERS[-1].pop())
    return out


def clear(spark: SparkSession) -> None:
    """Delete all folders of this session. Results not yet read or written elsewhere are lost."""
    for folders in _FOLDERS:
        while folders:
            delete(spark, folders.pop())


#: Shuffle files of a finished write are of no more use; without this they stay until the driver collects its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    before = spark.conf.get(_CLEANED, "false")
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage, survives lost executors, frees its shuffles."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---- words of UTF-8 buffers -------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes below 0x80 that are neither letters nor digits separate words where punctuation doesn't count.
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[:0x80] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _PUNCT[_a:_b] = False

def lowered(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with capitals of ASCII and Latin-1 made small."""
    low = raw.copy()
    low[(raw >= 0x41) & (raw <= 0x5A)] |= 0x20
    second = np.flatnonzero(raw == 0xC3) + 1
    second = second[second < len(raw)]
    low[second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]] += 0x20
    return low


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; a null is an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE):
    """Starts and ends (bytes) of all words, and for each document the number of its first word."""
    inside = np.zeros(len(raw) + 1, dtype=bool)
    inside[:-1] = ~separators[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets] = False  # a word never runs from one document into the next
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[-1] = False
    cut = offsets[offsets > 0] - 1
    after[cut] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_TAIL = np.asarray([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_LONG = 64  # bytes of a word from which on XXH64 hashes it


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; those of two seeds are independent of each other.

    The hash starts from the word's length and takes its bytes in, eight at a time, each time through a full mix: two words of up to eight
    bytes never collide, other pairs with odds of 2**-64. Words of over 64 bytes go through XXH64.
    """
    size = (ends - starts).astype(np.int64)
    out = mix((size.astype(np.uint64) + np.uint64(seed << 40) + np.uint64(1)) * _MULT)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    on = np.flatnonzero(size <= _LONG)
    for step in range(0, _LONG, 8):
        on = on[size[on] > step]
        if not len(on):
            break
        part = eight[starts[on] + step].view("<u8")[:, 0] & _TAIL[np.minimum(size[on] - step, 8)]
        out[on] = mix(out[on] ^ part)
    long = np.flatnonzero(size > _LONG)
    if len(long):
        import xxhash

        for i in long.tolist():
            out[i] = xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes(), seed)
    return out


def windows(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n words; entry i is that of the run that starts at word i.

    Runs of twice a length are two of that length end to end; one of n words is two of the greatest power of two in n, from both its ends.
    """
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, length = hashes, 1
    while length < n:
        step = min(length, n - length)
        out = mix(out[: len(out) - step] * _MULT + out[step:])
        length += step
    return mix(out[:m] + np.uint64((seed + 1) * 0xD6E8FEB86659FD93 % 2**64))


def chunks(offsets: np.ndarray, limit: int = 1 << 20):
    """Runs of documents [i, j) of about `limit` bytes together, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


# ---- ranges of a sorted key, in SQL expressions -------------------------------------------------


def range_bucket(key, bounds: list):
    """Number of bounds (sorted) at or below `key`, found in two steps of about the square root of their count."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.array(*(F.lit(b) for b in bounds[::step]))
    groups = F.array(*(F.array(*(F.lit(b) for b in bounds[i + 1 : i + step])) if len(bounds[i + 1 : i + step]) else F.slice(heads, 1, 0) for i in range(0, len(bounds), step)))
    at = F.size(F.filter(heads, lambda x: x <= key))
    inner = F.size(F.filter(F.element_at(groups, F.greatest(at, F.lit(1))), lambda x: x <= key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + 1 + inner)
