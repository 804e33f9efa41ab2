"""Repeated passages by level-wise doubling.

Lengths double up to the window: 7 and 13 words for a window of 13; 7, 13, 25 and 50 for one of 50. Windows that two documents share at one
length alone are extended to the next. At each level but the last, of all windows of the next length the one of least hash in it stands for it, so
equal longer windows have equal stand-ins, and only a part of all positions is looked at. longest_repeats() goes on doubling until no candidate is left.

Texts are dealt out once, into parts of about `PART` bytes each, in a table bucketed by part, so no level moves them again. A level names the
windows of a part, each distinct one once with the least and the greatest doc_id that has it there. Names meet by hash, at most one a part however
often a window occurs, and those of two documents go back to their parts with the least doc_id of all. Whole texts are named first: of exact copies only the
one of smallest doc_id has its windows looked at.

A name is 64 bits of one hash of its words, and beside it 32 bits of a second, made of independent word hashes (whole texts: 120 bits of SHA-256). So
of n windows of different words, a pair is taken for equal with odds of n**2 / 2**97.

Defined cases: a null text has no words; texts shorter than the window lose nothing; rows of one doc_id count
as one document and don't remove each other's words; a null doc_id sorts last, so it can lose words but
never takes them; empty tables give no rows; columns other than the two named may have any names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from burstline.llm.common import LAST_ID, buffers, chunks, new_folder, order_key, partitions, shuffles_freed, windows, word_hashes, words, written

#: Bytes of text that a part has at most, but for chance and for single longer texts: a worker holds one part at a time.
PART = 16 << 20
#: Words of the first level's windows, at least.
FIRST = 7

_NAMES = "h long, c long, part long, a long, z long"
_TEXTS = -1  # the level of names of whole texts


def lengths(window: int) -> list[int]:
    """The window and its halves, rounded up, as long as they have FIRST words; two at least."""
    out = [window]
    while len(out) < 2 or (out[0] + 1) // 2 >= FIRST:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Names:
    """Names (h, c) that two documents share, with the least key of those that have each."""

    def __init__(self, h: np.ndarray, c: np.ndarray, a: np.ndarray):
        order = np.lexsort((c, h))
        self.h, self.c, self.a = h[order], c[order], a[order]
        edge = np.flatnonzero(np.diff(self.h, prepend=self.h[:1] - 1)) if len(h) else np.zeros(0, np.int64)
        self.most = int(np.diff(np.append(edge, len(h))).max()) if len(h) else 0  # names of one h: nearly always one

    def least(self, h: np.ndarray, c: np.ndarray | None) -> np.ndarray:
        """The least key for each name; LAST_ID, which no key is above, for names that are not here. Without c any c will do."""
        out = np.full(len(h), LAST_ID)
        at = np.searchsorted(self.h, h)
        for step in range(self.most):
            place = np.minimum(at + step, len(self.h) - 1)
            same = self.h[place] == h
            if c is not None:
                same &= self.c[place] == c
            out[same] = self.a[place[same]]
        return out


class Chunk:
    """Words of a run of texts and the windows that lie within one text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.starts, self.ends, self.first = words(raw, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.lanes = [word_hashes(raw, self.starts, self.ends, seed) for seed in range(2)]

    def at(self, length: int) -> np.ndarray:
        """First words of the full windows."""
        m = max(len(self.doc) - length + 1, 0)
        return np.flatnonzero(self.doc[:m] == self.doc[length - 1 : length - 1 + m])

    def names(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        h, c = (windows(lane, length) for lane in self.lanes)
        return h[at].view(np.int64), (c[at] >> np.uint64(32)).astype(np.int64)

    def stand_ins(self, at: np.ndarray, length: int, short: int) -> np.ndarray:
        """For each window of `length` at `at`, the first word of the window of `short` words in it whose hash is least in the upper bits (the leftmost of equals)."""
        span = length - short + 1
        m = len(self.doc) - length + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        bits = np.uint64(max(1, (span - 1).bit_length()))
        upper = (windows(self.lanes[0], short) >> bits) << bits
        # Least values of runs of `span`, by runs of powers of two; the low bits say how far into the run.
        best, run = upper, 1
        while run < span:
            step = min(run, span - run)
            right = best[step:] + np.uint64(step)
            best = np.minimum(best[: len(right)], right)
            run += step
        low = (np.uint64(1) << bits) - np.uint64(1)
        return at + (best[at] & low).astype(np.int64)


def _chunks(texts) -> Iterator[tuple[int, Chunk]]:
    raw, offsets = buffers(texts)
    for i, j in chunks(offsets):
        yield i, Chunk(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _distinct(parts: list) -> tuple[np.ndarray, ...]:
    """(h, c, k) as distinct (h, c) with the least and the greatest k."""
    h, c, a, z = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1, 2, -1))
    if not len(h):
        return h, c, a, z
    order = np.argsort(h)
    same = np.append(False, h[order][1:] == h[order][:-1])
    if (same[1:] & (c[order][1:] != c[order][:-1])).any():
        order = np.lexsort((c, h))
    h, c = h[order], c[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
    at = np.flatnonzero(new)
    return h[at], c[at], np.minimum.reduceat(a[order], at), np.maximum.reduceat(z[order], at)


def _table(parts: list, part: int):
    import pyarrow as pa

    h, c, a, z = _distinct(parts)
    columns = {"h": h, "c": c, "part": np.full(len(h), part), "a": a, "z": z}
    return pa.table({n: pa.array(v, pa.int64()) for n, v in columns.items()})


def _lists(table) -> dict[int, Names]:
    """Names that came back to a part, by level."""
    level, *rest = (table.column(n).to_numpy() for n in ("level", "h", "c", "a"))
    return {n: Names(*(x[level == n] for x in rest)) for n in np.unique(level).tolist()}


_NONE = Names(*(np.zeros(0, np.int64) for _ in range(3)))


class _Part:
    """The texts of a part, with the names that came back to it."""

    def __init__(self, left, right):
        self.left, self.lists = left, _lists(right)
        self.part = left.column("part")[0].as_py() if left.num_rows else 0
        self.keys, t1, t2 = (left.column(n).to_numpy() for n in ("k", "t1", "t2"))
        self.copy = self.lists.get(_TEXTS, _NONE).least(t1, t2) < self.keys

    def shared(self, level: int) -> Names:
        return self.lists.get(level, _NONE)

    def candidates(self, chunk: Chunk, i: int, level: int, sizes: list[int]) -> np.ndarray:
        """First words of a level's windows that hold a shared stand-in of the level before (at the first level: all), but not of copies."""
        at = chunk.at(sizes[level])
        at = at[~self.copy[i + chunk.doc[at]]]
        if level == 0 or not len(at):
            return at
        inner = chunk.stand_ins(at, sizes[level], sizes[level - 1])
        names = self.shared(level - 1)
        if not names.most:
            return at[:0]
        short = windows(chunk.lanes[0], sizes[level - 1]).view(np.int64)
        return at[names.least(short[inner], None) < LAST_ID]


def _level(level: int, sizes: list[int], every: bool):
    """Names of a level's candidates; unless `every`, of those that stand for a window of the next level."""

    def run(left, right):
        part, parts = _Part(left, right), []
        for i, chunk in _chunks(left.column("text")):
            last = level == len(sizes) - 1
            if last or every:
                at = part.candidates(chunk, i, level, sizes)
            else:
                long = chunk.at(sizes[level + 1])
                long = long[~part.copy[i + chunk.doc[long]]]
                at = np.unique(chunk.stand_ins(long, sizes[level + 1], sizes[level]))
                if level:
                    at = np.intersect1d(at, part.candidates(chunk, i, level, sizes), assume_unique=True)
            h, c = chunk.names(at, sizes[level])
            if level == 0 and not every:
                c[:] = 0  # the first level only thins out
            k = part.keys[i + chunk.doc[at]]
            parts.append(_distinct([(h, c, k)]))
        return _table(parts, part.part)

    return run


def _kept(part: _Part, chunk: Chunk, i: int, level: int, window: int) -> np.ndarray:
    """Which words of a chunk stay."""
    at = chunk.at(window)
    names = part.shared(level)
    edge = np.zeros(len(chunk.doc) + window + 1, np.int64)
    if names.most and len(at):
        hit = at[names.least(*chunk.names(at, window)) < part.keys[i + chunk.doc[at]]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
    keep = np.cumsum(edge)[: len(chunk.doc)] == 0
    return keep & ~np.repeat(part.copy[i : i + len(chunk.count)] & (chunk.count >= window), chunk.count)


def _joined(chunk: Chunk, data: bytes, keep: np.ndarray, a: int, b: int) -> bytes:
    if keep[a:b].all():
        return b" ".join(data[chunk.starts[a] : chunk.ends[b - 1]].split()) if b > a else b""
    at = np.flatnonzero(keep[a:b]) + a
    return b" ".join([data[x:y] for x, y in zip(chunk.starts[at].tolist(), chunk.ends[at].tolist(), strict=True)])


def _digest(level: int, window: int):
    def run(left, right):
        import pyarrow as pa

        part, size = _Part(left, right), left.num_rows
        total, gone, digest = np.zeros(size, np.int64), np.zeros(size, np.int64), [""] * size
        for i, chunk in _chunks(left.column("text")):
            data, keep = chunk.raw.tobytes(), _kept(part, chunk, i, level, window)
            left_over = np.append(0, np.cumsum(keep))
            for k, (a, b) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
                total[i + k], gone[i + k] = b - a, b - a - (left_over[b] - left_over[a])
                digest[i + k] = hashlib.sha256(_joined(chunk, data, keep, a, b)).hexdigest()
        ids = pa.array(part.keys, pa.int64(), mask=part.keys == LAST_ID)
        return pa.table({"doc_id": ids, "n_words": pa.array(total), "n_removed": pa.array(gone), "kept_sha256": pa.array(digest, pa.string())})

    return run


def _strip(level: int, window: int):
    """The row, the text if words went from it (else null)."""

    def run(left, right):
        import pyarrow as pa

        part, changed = _Part(left, right), [None] * left.num_rows
        for i, chunk in _chunks(left.column("text")):
            data, keep = chunk.raw.tobytes(), _kept(part, chunk, i, level, window)
            left_over = np.append(0, np.cumsum(keep))
            lost = np.flatnonzero(np.diff(left_over[chunk.first]) < chunk.count)
            for k in lost.tolist():
                changed[i + k] = _joined(chunk, data, keep, int(chunk.first[k]), int(chunk.first[k + 1])).decode("utf-8", "replace")
        return pa.table({"row": left.column("row"), "text": left.column("text"), "changed": pa.array(changed, pa.string())})

    return run


class _Dealt:
    """Documents dealt into parts, and the levels over them."""

    def __init__(self, docs: DataFrame, carried: list[str]):
        spark = docs.sparkSession
        self.n = partitions(spark)
        text = F.col("text").cast("string")
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0  # one number
        sha = F.sha2(F.coalesce(text, F.lit("")), 256)
        rows = docs.select(
            F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(max(4 * self.n, -(-size // PART)))).alias("part"), order_key().alias("k"),
            *(F.conv(F.substr(sha, F.lit(a), F.lit(15)), 16, 10).cast("long").alias(name) for name, a in (("t1", 1), ("t2", 16))),
            text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in carried if c != "text")).alias("row") if carried else F.lit(None).cast("int").alias("row"),
        )
        self.rows = _bucketed(rows.repartition(self.n, "part"), self.n, "part")
        same = self.rows.groupBy(F.col("t1").alias("h"), F.col("t2").alias("c"), "part").agg(F.min("k").alias("a"), F.max("k").alias("z"))
        self.lists = self._shared(same, _TEXTS)

    def _shared(self, names: DataFrame, level: int) -> DataFrame:
        """Names of two documents, a row for each part that has them. A name has at most one row a part, so a window over it is bounded."""
        own = Window.partitionBy("h", "c")
        met = names.select("part", "h", "c", F.min("a").over(own).alias("a"), F.max("z").over(own).alias("z")).where("a < z")
        return written(met.select("part", F.lit(level).alias("level"), "h", "c", "a"), "shared")

    def with_lists(self, lists: DataFrame, run, schema, columns=("part", "k", "t1", "t2", "text")) -> DataFrame:
        return self.rows.select(*columns).groupBy("part").cogroup(lists.groupBy("part")).applyInArrow(run, schema)

    def level(self, level: int, sizes: list[int], before: DataFrame | None, every: bool = False) -> DataFrame:
        lists = self.lists if before is None else self.lists.unionByName(before)
        return self._shared(self.with_lists(lists, _level(level, sizes, every), _NAMES), level)

    def judged(self, window: int) -> tuple[DataFrame, int]:
        """Names of whole texts and of windows that two documents share, and the level of the windows."""
        sizes, found = lengths(window), None
        for level in range(len(sizes)):
            found = self.level(level, sizes, found)
        return self.lists.unionByName(found), len(sizes) - 1


def _bucketed(rows: DataFrame, n: int, key: str) -> DataFrame:
    """rows, written to the shared folder as a table of n buckets by `key`: what is grouped by it later needs no exchange."""
    spark, name = rows.sparkSession, f"burstline_{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        rows.write.format("parquet").bucketBy(n, key).option("path", new_folder(spark, "dealt")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved here: the files stay, the name can go
    spark.sql(f"DROP TABLE {name}")
    return table


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    dealt = _Dealt(docs, [])
    lists, level = dealt.judged(window)
    return dealt.with_lists(lists, _digest(level, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """docs in all its columns; a text that loses words becomes its kept words joined by spaces, and n_chars follows."""
    dealt = _Dealt(docs, docs.columns)
    lists, level = dealt.judged(window)
    schema = StructType().add("row", dealt.rows.schema["row"].dataType).add("text", "string").add("changed", "string")
    out = dealt.with_lists(lists, _strip(level, window), schema, ("part", "k", "t1", "t2", "text", "row"))
    made = {"text": F.coalesce("changed", "text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("changed"), F.col("row.n_chars"))
    types = {f.name: f.dataType for f in docs.schema}
    return out.select(*(made.get(c, F.col(f"row.`{c}`")).cast(types[c]).alias(c) for c in docs.columns))


def longest_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id and longest of every document that shares a window with another: the greatest of window, twice it, four times
    it and so on at which it still shares one; no candidate is left beyond. Null doc_ids count as one document."""
    dealt = _Dealt(docs, [])
    dealt.lists = dealt.lists.limit(0)  # copies share all their windows and are looked at too
    sizes = [window]
    found = [dealt.level(0, sizes, None, every=True)]
    while not found[-1].isEmpty():
        sizes.append(2 * sizes[-1])
        found.append(dealt.level(len(sizes) - 1, sizes, found[-1], every=True))

    def longest(left, right):
        import pyarrow as pa

        part = _Part(left, right)
        best = np.zeros(left.num_rows, np.int64)
        for i, chunk in _chunks(left.column("text")):
            for level, names in part.lists.items():
                at = chunk.at(sizes[level])
                hit = at[names.least(*chunk.names(at, sizes[level])) < LAST_ID]
                np.maximum.at(best, i + chunk.doc[hit], sizes[level])
        return pa.table({"k": pa.array(part.keys), "longest": pa.array(best)})

    lists = found[0]
    for more in found[1:]:
        lists = lists.unionByName(more)
    by_row = dealt.with_lists(lists, longest, "k long, longest long").groupBy("k").agg(F.max("longest").alias("longest")).where("longest > 0")
    return by_row.select(F.when(F.col("k") != LAST_ID, F.col("k")).alias("doc_id"), "longest")
