"""Best-fit packing of token pieces into sequences, after Martello and Toth's dominance reduction.

Lengths are whole numbers up to the capacity, so the instance is its histogram: `capacity` counts at most,
however many documents there are. The driver fixes dominating sets and runs best-fit decreasing on counts;
the plan says, for each length, which ranks go to which sequences. Executors give every piece its rank (a
running count in each partition plus the counts of the partitions before it) and look its place up.

Defined cases: a null or empty text is one piece of the end id alone; an empty table gives no rows; repeated rows
are packed each on its own; a null doc_id stays null; columns other than the two named are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstline.llm.common import buffers, written
from burstline.llm.tokens import encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every whole text: `rank` counts pieces of that length within the partition `part`."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = encoder(tokenizer_path).encode, TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            rows: list[list] = [[] for _ in range(7)]
            for first, ids, at in encode(*buffers(batch.column(1))):
                data, at = ids.astype("<u4").tobytes(), at.tolist()
                for k, doc_id in enumerate(ids_of[first : first + len(at) - 1]):
                    a, n = at[k], at[k + 1] - at[k] + 1
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(data[4 * (a + start) : 4 * min(a + start + length, at[k + 1])])
                        crc = zlib.crc32(end, crc) if start + length == n else crc
                        for column, value in zip(rows, (doc_id, piece, start, length, crc, part, int(met[length])), strict=True):
                            column.append(value)
                        met[length] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


class Plan:
    """Where the pieces of each length go: rows (length, first rank, pieces, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.rows, self.fixed = capacity, 0, [], 0
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.given = dict.fromkeys(self.left, 0)
        if any(not 0 < n <= capacity for n in self.left):
            raise ValueError("lengths must be from 1 to the capacity")
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.given[length], count, sequence, each, offset))
        self.given[length] += count
        self.left[length] -= count

    def _fix(self, lengths: tuple[int, ...], times: int) -> None:
        """`times` sequences that hold just these lengths."""
        offset = 0
        if len(set(lengths)) == 1:
            self._place(lengths[0], len(lengths) * times, self.sequences, len(lengths), 0)
        else:
            for n in lengths:
                self._place(n, times, self.sequences, 1, offset)
                offset += n
        self.sequences += times
        for n in set(lengths):
            if not self.left[n]:
                del self.left[n]

    def _reduce(self) -> None:
        """Fix sets that dominate every other set with their longest member, until none is found.

        With the longest piece j and j* the longest that fits beside it: {j} if nothing fits; {j, j*} if they fill the
        sequence, if no two pieces fit beside j, or if no three do and j* is as long as the best two together.
        Taking pieces away keeps such a condition true, so it is applied as often as the counts allow.
        """
        changed = True
        while changed:
            changed = False
            for j in sorted(self.left, reverse=True):
                while j in self.left:
                    lengths = sorted(self.left)
                    room = self.capacity - j
                    own = lambda n, j=j: self.left[n] - (n == j)
                    at = bisect.bisect_right(lengths, room) - 1
                    while at >= 0 and not own(lengths[at]):
                        at -= 1
                    if at < 0:
                        # Nothing fits: each piece of this length is alone, if no second of its kind fits either.
                        self._fix((j,), self.left[j])
                        changed = True
                        break
                    best = lengths[at]
                    least = []
                    for n in lengths:
                        least += [n] * min(3 - len(least), own(n))
                        if len(least) == 3:
                            break
                    fits = sum(int(sum(least[: k + 1]) <= room) for k in range(len(least)))
                    if best == room or fits == 1 or fits == 2 and best >= self._best_two(lengths, room, j):
                        times = self.left[j] // 2 if best == j else min(self.left[j], self.left[best])
                        if times:
                            self._fix((j, best), times)
                            changed = True
                            continue
                    break

    def _best_two(self, lengths: list[int], room: int, j: int) -> int:
        best, a, b = 0, 0, len(lengths) - 1
        while a <= b:
            total = lengths[a] + lengths[b]
            need = {lengths[a]: 2} if a == b else {lengths[a]: 1, lengths[b]: 1}
            if total > room or any(self.left[n] - (n == j) < k for n, k in need.items()):
                if total <= room and self.left[lengths[a]] - (lengths[a] == j) < need[lengths[a]]:
                    a += 1
                else:
                    b -= 1
                continue
            best = max(best, total)
            a += 1
        # Two of one length may be better than what the two pointers met.
        return max([best, *(2 * n for n in lengths if 2 * n <= room and self.left[n] - (n == j) >= 2)])

    def _best_fit(self) -> None:
        """Best-fit decreasing on counts: open sequences are kept as runs of equal free room."""
        free: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def put(room: int, first: int, count: int) -> None:
            if room and count:
                if not free.get(room):
                    free[room] = []
                    bisect.insort(rooms, room)
                free[room].append((first, count))

        for n in sorted(self.left, reverse=True):
            while self.left[n]:
                at = bisect.bisect_left(rooms, n)
                if at == len(rooms):
                    count = -(-self.left[n] // (self.capacity // n))
                    put(self.capacity, self.sequences, count)
                    self.sequences += count
                    continue
                room = rooms[at]
                first, count = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
                each = min(room // n, self.left[n])
                used = min(count, self.left[n] // each)
                self._place(n, used * each, first, each, self.capacity - room)
                put(room - each * n, first, used)
                put(room, first + used, count - used)

    def table(self) -> np.ndarray:
        rows = np.asarray(self.rows, np.int64).reshape(-1, 6)
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """All pieces with sequence_id and offset; see the module."""
    cut = written(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return assign(cut, capacity)


def assign(cut: DataFrame, capacity: int) -> DataFrame:
    by_part = cut.groupBy("part", "length").count()
    # At most `capacity` rows come to the driver.
    counts = {r.length: r["sum(count)"] for r in by_part.groupBy("length").sum("count").collect()}
    table = Plan(counts, capacity).table()
    before = by_part.select("part", "length", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    keys = table[:, 0] * (1 << 44) + table[:, 1]

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            row = table[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1] if len(keys) else np.zeros((0, 6), np.int64)
            i = rank - row[:, 1]
            columns = [*batch.columns[:5], pa.array(row[:, 3] + i // np.maximum(row[:, 4], 1)), pa.array(row[:, 5] + i % np.maximum(row[:, 4], 1) * length)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
