import hashlib
import re

import pytest
from helpers import odd_texts, rng, table, words

from burstline.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(texts, n=13):
    """(doc_id, words, removed, digest) by a table of every window."""
    last = 2**63 - 1
    cut = [(last if i is None else i, WORD.findall(t or "")) for i, t in texts]
    least = {}
    for i, w in cut:
        for a in range(len(w) - n + 1):
            key = tuple(w[a : a + n])
            least[key] = min(least.get(key, i), i)
    out = []
    for (doc_id, _), (i, w) in zip(texts, cut, strict=True):
        gone = {a + j for a in range(len(w) - n + 1) if least[tuple(w[a : a + n])] < i for j in range(n)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept)))
    return out


def made(seed):
    draw = rng(seed)
    shared = [" ".join(words(draw, int(n))) for n in (12, 13, 14, 30, 60)]
    texts = [(i, " ".join([*words(draw, int(draw.integers(0, 30)), 6), shared[int(draw.integers(5))], *words(draw, int(draw.integers(0, 40)), 6)])) for i in draw.permutation(60).tolist()]
    return texts + [(100, "a " * 50), (101, "a " * 40), (102, "b\x0bb\x1cb " * 9)]


@pytest.mark.parametrize("seed", [0, 1])
def test_against_every_window(spark, seed):
    texts = made(seed) + odd_texts(rng(seed))
    got = [tuple(r) for r in substring.remove_repeats(table(spark, texts)).collect()]
    assert sorted(got, key=repr) == sorted((x[:4] for x in slow(texts)), key=repr)


@pytest.mark.parametrize("window", [2, 5, 8])
def test_other_windows(spark, window):
    texts = made(3)
    got = [tuple(r) for r in substring.remove_repeats(table(spark, texts), window).collect()]
    assert sorted(got, key=repr) == sorted((x[:4] for x in slow(texts, window)), key=repr)


def test_stripped_documents(spark):
    texts = made(2) + odd_texts(rng(2))
    docs = table(spark, texts)
    out = substring.strip_repeats(docs)
    assert out.schema == docs.schema
    want = [(i, kept if gone else t, None if t is None and not gone else len(kept if gone else t)) for (i, t), (_, _, gone, _, kept) in zip(texts, slow(texts), strict=True)]
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert substring.strip_repeats(table(spark, [])).count() == 0


@pytest.mark.parametrize("window", [3, 13])
def test_doubled_until_none_is_left(spark, window):
    texts = [(i, t) for i, t in dict(made(4)).items()]
    cut = {i: WORD.findall(t) for i, t in texts}
    want, n = {}, window
    while True:
        seen = {}
        for i, w in cut.items():
            for a in range(len(w) - n + 1):
                seen.setdefault(tuple(w[a : a + n]), set()).add(i)
        hit = {i for own in seen.values() if len(own) > 1 for i in own}
        if not hit:
            break
        want |= dict.fromkeys(hit, n)
        n *= 2
    got = {r.doc_id: r.longest for r in substring.longest_repeats(table(spark, texts), window).collect()}
    assert got == want and len(set(want.values())) > 1
    assert substring.longest_repeats(table(spark, [])).count() == 0


def thue_morse(bits):
    """Two different words of 2**bits letters that polynomial hashes modulo powers of two take for one."""
    a = "a"
    for _ in range(bits):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [10, 11, 13])
def test_long_words_that_differ_are_kept(spark, bits):
    one, two = thue_morse(bits)
    head = [f"w{i}" for i in range(12)]
    got = substring.remove_repeats(table(spark, [(1, " ".join([*head, one])), (2, " ".join([*head, two])), (3, " ".join([*head, one]) + " x")])).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 13}


def test_columns_of_any_names(spark):
    texts = [(i, t, i, i, "x") for i, t in made(5)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, `__k` long, part long, `t.1` string")
    out = substring.strip_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert all(r["__k"] == r.doc_id == r.part and r["t.1"] == "x" for r in out.collect())


@pytest.mark.parametrize("window", [29, 50])
def test_several_levels(spark, window):
    draw = rng(8)
    shared = [" ".join(words(draw, int(n))) for n in (28, 49, 60, 120)]
    texts = [(i, " ".join([*words(draw, int(draw.integers(0, 30)), 4), shared[i % 4], *words(draw, 10, 4), shared[(i + 1) % 4]])) for i in range(20)]
    assert len(substring.lengths(window)) > 2
    got = [tuple(r) for r in substring.remove_repeats(table(spark, texts), window).collect()]
    assert sorted(got, key=repr) == sorted((x[:4] for x in slow(texts, window)), key=repr)
