import hashlib

from helpers import odd_texts, rng, table, words
from pyspark.sql import functions as F

from burstline.llm import fingerprint as fp


def test_edited_texts_against_a_loop(spark):
    draw = rng(5)
    texts = odd_texts(draw) + [(20 + i, " ".join(words(draw, int(draw.integers(0, 60)))) + ".") for i in range(40)]
    got = fp.compare_edited(table(spark, texts)).collect()
    order = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] is None, x[0] or 0, x[1].encode()))
    want = []
    for (i, t), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + other[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def one(spark, *texts):
    return [r.f for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fp.fingerprint(F.col("t")).alias("f")).orderBy("i").collect()]


def test_order_is_nothing_and_content_is_all(spark):
    a, b, c, d, e, f = one(spark, "p one.\np two.\np three.", "p three.\np one.\np two.", "p one.\np two.", None, "", "p one.\np two.\np three.\np three.")
    assert a == b and a != c and d == e and a != f and not any(d)


def test_insert_and_delete(spark):
    df = spark.createDataFrame([("p one. And so on!\np two.", "more?\nand more, yes.", "p one. And so on!\np two.\nmore?\nand more, yes.")], "a string, b string, ab string")
    own = lambda c: fp.fingerprint(F.col(c))
    made = df.select("*", own("a").alias("fa"), own("b").alias("fb"), own("ab").alias("fab"))
    r = made.select("fa", "fab", fp.insert(F.col("fa"), F.col("b")).alias("i"), fp.delete(F.col("fab"), F.col("b")).alias("d"), fp.combine(F.col("fa"), F.col("fb")).alias("c")).first()
    assert r.i == r.fab == r.c and r.d == r.fa


def test_likeness_follows_what_is_shared(spark):
    draw = rng(6)
    sentences = [" ".join(words(draw, 8)) + f" s{i}." for i in range(900)]
    base = " ".join(sentences[:300])
    others = [" ".join(sentences[k : 300 + k]) for k in (0, 30, 150, 300)]
    df = spark.createDataFrame([(base, o) for o in others], "a string, b string")
    got = [r[0] for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect()]
    assert got[0] == 1 and abs(got[1] - 0.9) < 0.1 and abs(got[2] - 0.5) < 0.25 and got[3] < 0.3


def test_one_document_follows_itself(spark):
    r = fp.compare_edited(table(spark, [(3, "abcd")])).first()
    assert (r.edited_sha256, r.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)
    assert fp.compare_edited(table(spark, [])).count() == 0


def test_likeness_of_very_long_texts(spark):
    """Texts of 60,000 phrases, over 3 MB: half and nothing shared, and a short one beside them."""
    draw = rng(25)
    phrases = [f"{' '.join(words(draw, 7, 10**9))} s{i}." for i in range(120_000)]
    base = " ".join(phrases[:60_000])
    assert len(base) > 3_000_000
    df = spark.createDataFrame([(0, base, " ".join(phrases[30_000:90_000])), (1, base, " ".join(phrases[60_000:])), (2, base, phrases[-1])], "i int, a string, b string")
    own = df.select("i", fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b"))
    got = [r[1] for r in own.select("i", fp.likeness(F.col("a"), F.col("b"))).orderBy("i").collect()]
    assert abs(got[0] - 0.5) < 0.25 and got[1] < 0.3 and got[2] < 0.3


def exact(a, b):
    """Likeness by the multisets of pairs themselves."""
    from collections import Counter

    def pairs(text):
        lines = [[w for w in line.split(" ") if w] for line in text.split("\n")]
        return Counter(p for own in lines for p in zip(own, [*own[1:], None], strict=True))

    one, two = pairs(a), pairs(b)
    return 1.0 if a == b else 2 * sum((one & two).values()) / max(1, sum(one.values()) + sum(two.values()))


def test_likeness_against_the_multisets(spark):
    draw = rng(31)
    made = []
    for i in range(120):
        lines = [words(draw, int(n), 3000) for n in draw.integers(1, (20, 120, 700, 3000)[i % 4], 3)]
        other = [[w for w in own if draw.random() > 0.15 * (i % 3)] for own in lines[: 1 + i % 3]] + [words(draw, 30, 3000)] * (i % 2)
        made.append(tuple("\n".join(" ".join(own) for own in x) for x in (lines, other)))
    got = [r[0] for r in spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "i int, a string, b string").select("i", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("x")).orderBy("i").select("x").collect()]
    apart = [abs(g - exact(*m)) for g, m in zip(got, made, strict=True)]
    assert sum(apart) / len(apart) < 0.06 and max(apart) < 0.35


def test_a_word_put_in_shifts_nothing(spark):
    draw = rng(32)
    base = words(draw, 3000, 10**6)
    moved = ["new", *base[:1500], "word", *base[1500:]]
    df = spark.createDataFrame([(" ".join(base), " ".join(moved)), (" ".join(base[:100]), " ".join(["new", *base[:100]]))], "a string, b string")
    assert all(r[0] > 0.93 for r in df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).collect())


def test_lanes_have_seeds_of_their_own(spark):
    """Lane i is XXH64 of the paragraph, seeded by the hash of i: equal values in one lane say nothing about the others."""
    import struct

    import xxhash

    seeds = [xxhash.xxh64_intdigest(struct.pack("<i", i), 42) for i in range(4)]
    for text in ("a paragraph", "é", "x" * 1000):
        (own,) = one(spark, text)
        assert own[:4] == [xxhash.xxh64_intdigest(text.encode(), s) & (1 << 56) - 1 for s in seeds]
