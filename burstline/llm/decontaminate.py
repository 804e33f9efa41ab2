"""Benchmark decontamination: containment search by size-partitioned MinHash, verified by exact shingles.

Items of up to `FEW` distinct shingles are searched exactly: every shingle of a document is looked up among theirs, and an item that
has the threshold's share of distinct hits is a candidate. The sketches below could lose such items, whose few hashes other
shingles of a window may displace.

Larger items fall into classes by their number of distinct shingles, in powers of two. For a class of up to u shingles, a document's
shingles are cut into overlapping windows of 2u, so a short item is compared with pieces of about its own size however long the
document is. Sketches are one-permutation MinHashes of 4u bins: the least hash of each bin. A window and an item that share
the least hash of any bin are a candidate. With four bins a shingle, a shingle of the item is displaced in a window with odds of about
0.21, so an item of 33 shingles or more of which four fifths (27 at least) are in the document, together or scattered, is missed with odds
of about 0.21 ** 27 < 1e-17. At a lower threshold t the odds are about 0.21 ** (t * 33). Candidates are then verified on the words of the whole document.

The benchmark is a stated query set: it goes to the executors in blocks of at most `block_bytes` of text, one pass over the documents
for each block, so what is sent and what the driver holds is bounded whatever the benchmark's size.

Words are runs of characters other than ASCII white space and punctuation, lower-cased. Defined cases: items and documents
of fewer than `n` words match nothing; null and empty texts too; rows of docs are judged one by one; repeated items (same id and text)
count once; a null doc_id or item_id stays null; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.common import _PUNCT, buffers, chunks, windows, word_hashes, words, written


#: Distinct shingles of an item up to which it is searched exactly.
FEW = 32


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int, threshold: float):
        self.n, self.threshold, self.items = n, threshold, items
        raw = np.frombuffer(b"".join(t for _, t in items), np.uint8)
        offsets = np.cumsum([0, *(len(t) for _, t in items)])
        starts, ends, first = words(raw, offsets, _PUNCT)
        hashes, data = word_hashes(raw, starts, ends), raw.tobytes()
        self.shingles: list[frozenset] = []
        self.hashes: list[np.ndarray] = []
        classes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k in range(len(items)):
            own = [data[a:b] for a, b in zip(starts[first[k] : first[k + 1]].tolist(), ends[first[k] : first[k + 1]].tolist(), strict=True)]
            self.shingles.append(frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)))
            h = np.unique(windows(hashes[first[k] : first[k + 1]], n))
            self.hashes.append(h)
            if len(h) > FEW:
                classes.setdefault(int(len(h) - 1).bit_length(), []).append((k, h))
        # Of items of few shingles: all hashes, sorted, and whose they are, and a table of their first 20 bits.
        few = [k for k, h in enumerate(self.hashes) if 0 < len(h) <= FEW]
        values = np.concatenate([np.zeros(0, np.uint64), *(self.hashes[k] for k in few)])
        owners, order = np.repeat(np.asarray(few, np.int64), [len(self.hashes[k]) for k in few]), np.argsort(values, kind="stable")
        self.few = values[order], owners[order], np.zeros(1 << 20, bool)
        self.few[2][values >> np.uint64(44)] = True
        self.sizes = np.asarray([len(h) for h in self.hashes], np.int64)
        # For each class: u, bits of a bin's number, sorted sketch hashes and whose they are, and a table of their first 20 bits.
        self.classes = []
        for c, members in sorted(classes.items()):
            bits = c + 2
            sketch = []
            for k, h in members:  # h is sorted, so the first of each bin is its least
                _, at = np.unique(h >> np.uint64(64 - bits), return_index=True)
                sketch += [(int(x), k) for x in h[at]]
            sketch.sort()
            values, owners = np.asarray([x for x, _ in sketch], np.uint64), np.asarray([k for _, k in sketch])
            table = np.zeros(1 << 20, bool)
            table[values >> np.uint64(44)] = True
            self.classes.append((1 << c, bits, values, owners, table))

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shingles shared) where containment reaches the threshold."""
        starts, ends, first = words(raw, offsets, _PUNCT)
        hashes = windows(word_hashes(raw, starts, ends), self.n)
        count = np.maximum(np.diff(first) - self.n + 1, 0)
        doc = np.repeat(np.arange(len(count)), count)
        local = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        h = hashes[first[doc] + local] if len(doc) else hashes[:0]
        pairs = [self._candidates(h, doc, local, count, *one) for one in self.classes]
        pairs = np.unique(np.concatenate([self._exact(h, doc), *pairs]), axis=0)
        found, data = [], None
        for d, k in pairs.tolist():
            data = raw.tobytes() if data is None else data
            begin = int(np.searchsorted(doc, d))
            at = first[d] + np.flatnonzero(np.isin(h[begin : begin + count[d]], self.hashes[k]))
            own = {tuple(data[starts[i + j] : ends[i + j]] for j in range(self.n)) for i in at.tolist()}
            shared = len(own & self.shingles[k])
            if shared >= self.threshold * len(self.shingles[k]) - 1e-9:
                found.append((d, k, shared))
        return found

    def _exact(self, h, doc) -> np.ndarray:
        """Texts and items of few shingles of which they have enough."""
        values, owners, table = self.few
        hit = np.flatnonzero(table[h >> np.uint64(44)])
        low, high = np.searchsorted(values, h[hit], "left"), np.searchsorted(values, h[hit], "right")
        n = high - low
        if not n.sum():
            return np.zeros((0, 2), np.int64)
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        # A place stands for an item and one of its shingles, so a shingle counts once a text.
        once = np.unique(np.repeat(doc[hit], n) * len(values) + place)
        met, shared = np.unique(once // len(values) * len(self.sizes) + owners[once % len(values)], return_counts=True)
        who, item = met // len(self.sizes), met % len(self.sizes)
        enough = shared >= self.threshold * self.sizes[item] - 1e-9
        return np.stack([who[enough], item[enough]], axis=1)

    def _candidates(self, h, doc, local, count, u, bits, values, owners, table) -> np.ndarray:
        blocks = -(-count // u)
        base = np.cumsum(blocks) - blocks
        total, bins = int(blocks.sum()), 1 << bits
        if not total:
            return np.zeros((0, 2), np.int64)
        least = np.full(total * bins, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, (base[doc] + local // u) * bins + (h >> np.uint64(64 - bits)).astype(np.int64), h)
        least = least.reshape(total, bins)
        owner = np.repeat(np.arange(len(count)), blocks)
        # A window is a block and the next of its document.
        window = least.copy()
        follows = np.flatnonzero(owner[1:] == owner[:-1])
        window[follows] = np.minimum(least[follows], least[follows + 1])
        flat = window.reshape(-1)
        hit = np.flatnonzero(table[flat >> np.uint64(44)])
        low, high = np.searchsorted(values, flat[hit], "left"), np.searchsorted(values, flat[hit], "right")
        n = high - low
        who = np.repeat(owner[hit // bins], n)
        item = owners[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if n.sum() else np.zeros(0, np.int64)
        return np.stack([who, item], axis=1)


def item_blocks(items: DataFrame, block_bytes: int = 8 << 20) -> Iterator[list[tuple[int | None, bytes]]]:
    """The benchmark in blocks, each of bounded size, read one partition at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null").distinct()
    for row in rows.toLocalIterator():
        text = row.text.encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


_FOUND = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _found(docs: DataFrame, block: list, n: int, threshold: float) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))

    def find(batches: Iterator) -> Iterator:
        import pyarrow as pa

        searcher = Searcher(block, n, threshold)
        for batch in batches:
            raw, offsets = buffers(batch.column(1))
            names, found = batch.column(0), []
            for i, j in chunks(offsets):
                part = searcher.find(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found += [(names[i + d].as_py(), block[k][0], shared, len(searcher.shingles[k])) for d, k, shared in part]
            columns = [pa.array([x[c] for x in found], pa.int64()) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[2] / x[3] for x in found], pa.float64())], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

    return rows.mapInArrow(find, _FOUND)


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """A row for each document row and item of which it holds `threshold` or more."""
    blocks = item_blocks(items, block_bytes)
    block, out = next(blocks, None), None
    while block is not None:
        after, found = next(blocks, None), _found(docs, block, n, threshold)
        # With several blocks each one's finds are written before the next is read, so the driver and a plan hold one or two at a time.
        found = found if out is None and after is None else written(found, "found")
        out, block = found if out is None else out.unionByName(found), after
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20) -> DataFrame:
    """docs, in all its columns, without rows that hold `threshold` or more of any item."""
    blocks = item_blocks(items, block_bytes)
    block = next(blocks, None)
    while block is not None:
        after = next(blocks, None)

        def keep(batches: Iterator, block=block) -> Iterator:
            import pyarrow as pa

            searcher = Searcher(block, n, threshold)
            for batch in batches:
                raw, offsets = buffers(batch.column(batch.num_columns - 1))
                good = np.ones(batch.num_rows, bool)
                for i, j in chunks(offsets):
                    for d, _, _ in searcher.find(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                        good[i + d] = False
                rest = pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([batch.schema.field(c) for c in range(batch.num_columns - 1)]))
                yield rest.filter(pa.array(good))

        docs = docs.select("*", F.lower(F.col("text").cast("string")).alias("__lowered")).mapInArrow(keep, docs.schema)
        if after is not None:  # as above: one block a plan
            docs = written(docs, "clean")
        block = after
    return docs
