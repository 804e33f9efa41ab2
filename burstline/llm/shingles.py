"""SimHash near-dedup for a given similarity of word shingles: candidates, each verified on its texts' shingles.

A text is its set of n-word shingles (words between ASCII white space, ASCII letters lower-cased), and texts of one set are one
class. Every class has a SimHash fingerprint of its shingles, and classes whose fingerprints are within two bits, found by pivot distance tables (simhash.py),
are candidates. A Jaccard similarity of 0.8 lies at about ten bits of 64, where no such search is both whole and cheap, so classes that the
fingerprints leave apart are searched by MinHash: 160 least hashes, dealt as 40 keys of four; classes that share a key and at least 88 of the 160 are
candidates too. Of two texts whose similarity is 0.8, the keys miss 0.59 ** 40 < 1e-9 and the count less than 1e-11; above 0.8 less still.
Candidates are gathered by their components, in which every pair not yet joined is verified. A key or component gives a forest of its
links, never all pairs; one of more than `most` classes is worked on in blocks, which together still compare or join every pair.

Defined cases: a text of fewer than n words is one shingle; null, empty and blank texts are one class; null and repeated ids as in simhash.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm import simhash
from burstline.llm.common import buffers, chunks, mix, windows, word_hashes, words, written
from burstline.llm.components import components

BANDS, ROWS, LEAST_EQUAL = 40, 4, 88
_SALT = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = mix(_SALT) | np.uint64(1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    low = raw.copy()
    low[(raw >= 0x41) & (raw <= 0x5A)] |= 0x20
    starts, ends, first = words(low, offsets)
    hashes = word_hashes(low, starts, ends)
    full = windows(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(full[a : b - n + 1] if b - a >= n else windows(hashes[a:b], b - a, 1 + b - a) if b > a else full[:0]))
    return out


def _name(own: np.ndarray) -> int:
    """One hash of a whole set."""
    return int(mix(np.asarray([mix(own).sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def _least(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, none of them empty, its least value under each of the hash functions."""
    flat, at = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat((flat ^ s) * f, at) for s, f in zip(_SALT, _FACTOR, strict=True)], axis=1)


def _keys(least: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS))
    for j in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least[:, j::ROWS])
    return out


def sketches(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, t (a hash of the text), fp (of the set), size, sim (SimHash of the set), keys and sketch (a byte of each least hash) of every row."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = ["doc_id", "t", "fp", "size", "sim", "keys", "sketch"]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            raw, at = buffers(batch.column(2))
            for i, j in chunks(at):
                sets = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], n)
                some = [k for k, s in enumerate(sets) if len(s)]
                keys, sketch = [None] * len(sets), [None] * len(sets)
                sims = np.asarray([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
                if some:
                    least = _least([sets[k] for k in some])
                    for k, key, small in zip(some, _keys(least).view(np.int64), (least >> np.uint64(24)).astype(np.uint8), strict=True):
                        keys[k], sketch[k] = key, small.tobytes()
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), [_name(s) for s in sets], [len(s) for s in sets], sims, keys, sketch]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, fp long, size long, sim long, keys array<long>, sketch binary")


def _forest(label: np.ndarray, near, first: int | None = None) -> list[tuple[int, int]]:
    """Links that join members of different labels of which near(i, others) says so, i being one of the first `first` (of all); a link makes two labels one."""
    out, count = [], len(label)
    for i in range(count if first is None else first):
        others = np.arange(i + 1, count)
        others = others[label[others] != label[i]]
        for j in near(i, others):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((i, int(j)))
    return out


def _agree(sketches: np.ndarray):
    return lambda i, others: others[(sketches[others] == sketches[i]).sum(axis=1) >= LEAST_EQUAL]


def _by_sketch(items: list[bytes]):
    return _agree(np.frombuffer(b"".join(items), np.uint8).reshape(len(items), -1))


def _by_text(n: int, similarity: float):
    def similar(items: list[str]):
        raw = [x.encode() for x in items]
        sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), n)
        agree = _agree((_least(sets) >> np.uint64(24)).astype(np.uint8))
        sizes = np.asarray([len(s) for s in sets])

        def near(i, others):
            a, b = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            for j in agree(i, others[a >= similarity * b - 1e-9]).tolist():
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9:
                    yield j

        return near

    return similar


def _found(similar):
    """Links of each row: members x (fp, root, item), of which the first `first` are compared with all, or all if it is null."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = []
            for x, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = x.as_py()
                fps, roots = [y["fp"] for y in x], np.asarray([y["root"] for y in x], np.int64)
                found += [(fps[i], fps[j]) for i, j in _forest(np.unique(roots, return_inverse=True)[1], similar([y["item"] for y in x]), first)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return run


def _linked(groups: DataFrame, items: DataFrame, similar, most: int) -> DataFrame:
    """Links (u, v) that join what is similar within a group; groups: g, fp, w; items: fp, item. A group may have any size.

    A group of weight over `most` is cut into blocks three times, each time otherwise, and every block gives a forest. Members that these
    leave out of the group's largest class are then compared with all members of other classes, a block of theirs with a block of the group at a
    time. So every pair is compared or known to be joined, and no task holds more than two blocks.
    """
    sizes = groups.groupBy("g").agg(F.sum("w").alias("n"), F.count("*").alias("c")).where("c > 1")
    # Powers of two, and blocks by the member alone: groups of about the same members have the same blocks, and their links are the same.
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(most)))).cast("int")
    sizes = written(sizes.select("g", F.expr("1L").alias("one"), power.alias("power")).select("g", F.call_function("shiftleft", "one", "power").alias("blocks")), "sizes")
    whole = groups.join(sizes, "g")
    times = F.when(F.col("blocks") > 1, F.array(*(F.lit(i) for i in range(3)))).otherwise(F.array(F.lit(0)))
    block = F.pmod(F.xxhash64("fp", "s"), F.col("blocks")).alias("b")
    member = F.sort_array(F.collect_list(F.struct("fp", "root", "item"))).alias("x")
    dealt = whole.select("g", "fp", "blocks", F.explode(times).alias("s")).select("g", "fp", "s", block).join(items, "fp").withColumn("root", F.col("fp"))
    alone = dealt.groupBy("g", "s", "b").agg(member).where(F.size("x") > 1).select("x", F.lit(None).cast("int").alias("first"))
    one = alone.mapInArrow(_found(similar), "u long, v long")
    if sizes.where("blocks > 1").isEmpty():
        return one
    one = written(one, "links")
    labels = components(one).withColumnRenamed("v", "fp")
    large = whole.where("blocks > 1").join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    large = written(large.select("g", "fp", "w", "blocks", "root"), "large")
    classes = large.groupBy("g", "root").agg(F.sum("w").alias("n"))
    rest = written(classes.groupBy("g").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("n")).where("n > 0"), "rest")
    if rest.isEmpty():
        return one
    left_out = large.join(rest, "g").where("root <> main").withColumn("q", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / F.lit(most)).cast("long")))
    asked = left_out.join(items, "fp").groupBy("g", "q", "blocks").agg(member).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = large.join(rest.select("g"), "g", "left_semi").join(items, "fp").withColumn("s", F.lit(0)).select("g", block, "fp", "root", "item").groupBy("g", "b").agg(member)
    pairs = asked.select("g", "b", F.col("x").alias("asked")).join(every, ["g", "b"])
    two = pairs.select(F.concat("asked", "x").alias("x"), F.size("asked").alias("first")).mapInArrow(_found(similar), "u long, v long")
    return one.unionByName(two)


def links(docs: DataFrame, classes: DataFrame, n: int = 5, similarity: float = 0.8, most: int = 512) -> DataFrame:
    """Links (u, v) between the sets of classes (fp, t, size, sim, keys, sketch) that join those reachable in steps of the similarity."""
    # By fingerprints: classes of one are a star around the least of them, and stars within two bits are linked.
    stars = written(classes.groupBy("sim").agg(F.min("fp").alias("one")), "stars")
    same = classes.select("sim", "fp").join(stars, "sim").where("fp <> one").select(F.col("one").alias("u"), F.col("fp").alias("v"))
    near = simhash.links(stars.select(F.col("sim").alias("fp")), most=most)
    for end in ("u", "v"):
        near = near.join(stars.select(F.col("sim").alias(end), F.col("one").alias(f"to_{end}")), end)
    by_sim = same.unionByName(near.select(F.col("to_u").alias("u"), F.col("to_v").alias("v")))
    keys = classes.select(F.explode("keys").alias("g"), "fp", F.lit(1).alias("w"))
    by_key = _linked(keys, classes.select("fp", F.col("sketch").alias("item")), _by_sketch, most)
    roots = components(by_key.unionByName(by_sim)).withColumnRenamed("v", "fp")
    # A member weighs more the longer its text is, so that blocks are bounded in bytes too.
    weight = (F.lit(1) + F.floor(F.col("size") / 8192)).cast("long").alias("w")
    roots = written(roots.join(classes.select("fp", "t", weight), "fp"), "candidates")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("item")).join(roots.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.min("item").alias("item"))
    texts = written(roots.select("fp", "t").join(texts, "t").select("fp", "item"), "texts")
    return _linked(roots.select(F.col("root").alias("g"), "fp", "w"), texts, _by_text(n, similarity), most).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, most: int = 512) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every row of docs."""
    if similarity < 0.8:
        raise ValueError("the odds of a miss are those of a similarity of 0.8 or more")
    rows = written(sketches(docs, n), "sketches")
    # Texts of one set have one sketch, so any of them stands for the class.
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("t").alias("t")), "classes")
    one = rows.where("size > 0").select("fp", "t", "size", "sim", "keys", "sketch").join(classes.select("fp", "t"), ["fp", "t"], "left_semi").dropDuplicates(["fp"])
    roots = components(links(docs, written(one, "sets"), n, similarity, most)).withColumnRenamed("v", "fp")
    rooted = classes.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "fp").join(rooted.join(component, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near-duplicates, as simhash.keep_one()."""
    classes = near_duplicates(docs, **options).select("doc_id", "component_id")
    kept = classes.where("doc_id <=> component_id").select(F.col("doc_id").alias("__kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept_id"]), "left_semi")
