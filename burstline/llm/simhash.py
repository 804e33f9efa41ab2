"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to reference fingerprints: the zero word, 32 words with one pair
of neighbouring bits each, and some random words. Two fingerprints within `radius` differ by at most `radius` in every
coordinate. The distances to the zero word and to a pair word give the weight of that pair of bits, so within the radius at most
`radius` of the 32 weights differ: with the weights dealt into radius + 4 groups, some choice of four groups agrees
in all its weights. Those agreements are the join keys. Within a key, pairs whose distance tables differ by more than the radius
in any coordinate are discarded and the rest verified; a key gives a forest of its links, never all pairs.

Keys with more than `most` fingerprints are not cut: their fingerprints are joined exactly through all words
at one bit's distance, up to 65 each, of which any two within two bits share one (radius 2 or less).

Defined cases: a null or empty text has fingerprint zero and is linked like any other; texts of one or two words are
one shingle; rows with a null doc_id take part and get the class of their links, whose id is the
smallest doc_id that is not null (null if there is none); repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.common import buffers, mix, written
from burstline.llm.components import components

_PAIRS = [3 << 2 * i for i in range(32)]
_RANDOM = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
REFERENCES = np.concatenate([np.asarray([0, *_PAIRS], np.uint64), _RANDOM])


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are those that over half of the hashes have set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, n: int = 3, seed: int = 42) -> int:
    """Fingerprint of one UTF-8 text: majority bits of the XXH64 of its n-word shingles, repeats included."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) < n:
        hashes = np.asarray([hashed(b" ".join(words), seed)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)[: len(words) - n + 1].tolist()
        hashes = np.fromiter([hashed(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], np.uint64, len(starts))
    return majority(hashes)


def fingerprints(docs: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw, at = buffers(batch.column(1))
            fp = np.fromiter((simhash(raw[a:b].tobytes(), n, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)), np.uint64, len(at) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None, :]).astype(np.int16)


def _keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint, a key for each choice of four of radius + 4 groups of pair weights."""
    table = distance_table(fp)
    weights = ((table[:, :1] + 2 - table[:, 1:33]) // 2).astype(np.uint64)
    groups = np.array_split(np.arange(32), radius + 4)
    packed = [(weights[:, g] << (2 * np.arange(len(g), dtype=np.uint64))).sum(axis=1, dtype=np.uint64) for g in groups]
    out = []
    for number, kept in enumerate(combinations(range(len(groups)), 4)):
        key = np.full(len(fp), number + 1, np.uint64)
        for g in kept:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + packed[g])
        out.append(key)
    return np.stack(out, axis=1)


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among the fingerprints of one key, as many as join what is within the radius."""
    table = distance_table(fp)
    order = np.argsort(table[:, 0], kind="stable")
    fp, table = fp[order], table[order]
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links = []
    stop = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    for i in range(len(fp)):
        near = np.arange(i + 1, stop[i])
        near = near[(np.abs(table[near] - table[i]) <= radius).all(axis=1)]
        for j in near[np.bitwise_count(fp[near] ^ fp[i]) <= radius].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((int(fp[i].view(np.int64)), int(fp[j].view(np.int64))))
    return links


def links(distinct: DataFrame, radius: int = 2, most: int = 512) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that join exactly those reachable in steps of `radius` bits."""
    if radius > 2:
        raise ValueError("large keys are joined through single flips, which reach two bits")

    def keyed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = _keys(fp, radius)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["key", "fp"])

    def forest(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [x for group in batch.column(0).to_pylist() for x in _forest(np.asarray(group, np.int64).view(np.uint64), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    keys = distinct.mapInArrow(keyed, "key long, fp long")
    # Written, so that both sides of the join are plain exchanges and the rows of a dense key can be split among tasks.
    size = written(keys.groupBy("key").count().where("count > 1"), "sizes")
    sized = keys.join(size, "key")
    few = sized.where(F.col("count") <= most).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    near = few.select("fps").mapInArrow(forest, "u long, v long").distinct()
    # Fingerprints of larger keys: each word at up to one bit's distance gathers at most 65 of them.
    dense = sized.where(F.col("count") > most).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in (1 << i for i in range(64))))
    words = dense.select("fp", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("word"))
    shared = words.groupBy("word").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if radius < 2:
        shared = shared.where("array_contains(fps, word)")
        through = shared.select(F.col("word").alias("u"), F.explode("fps").alias("v"))
    else:
        through = shared.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v"))
    return near.unionByName(through.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, radius: int = 2, n: int = 3, seed: int = 42, most: int = 512) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of docs."""
    fps = written(fingerprints(docs, n, seed), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius, most)).withColumnsRenamed({"v": "fp"})
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(component, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest doc_id, in all its columns.

    Rows of one doc_id count as one document and stay together; a null doc_id stays where its group has no other id.
    """
    classes = near_duplicates(docs, **options).select("doc_id", "component_id")
    kept = classes.where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]), "left_semi")
