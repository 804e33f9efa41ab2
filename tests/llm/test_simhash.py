import numpy as np
import pytest
import xxhash
from helpers import odd_texts, rng, table, words

from burstline.llm import simhash
from burstline.llm.components import components


def slow_fingerprint(text):
    own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + 3]) for i in range(max(len(own) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius=2):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def near_copies(draw, n):
    base = words(draw, 300)
    out = []
    for i in range(n):
        own = list(base)
        for j in draw.integers(0, 300, draw.integers(0, 3)):
            own[j] = f"new{i}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("most", [512, 3])
def test_against_all_pairs(spark, most):
    draw = rng(1)
    texts = odd_texts(draw) + [(100 + i, t) for i, t in enumerate(near_copies(draw, 40))] + [(200 + i, " ".join(words(draw, 50))) for i in range(30)]
    out = simhash.near_duplicates(table(spark, texts), most=most).collect()
    fps = [slow_fingerprint(t) for _, t in texts]
    want = [(i, f, c) for (i, _), f, c in zip(texts, fps, slow_components([i for i, _ in texts], fps), strict=True)]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("radius", "most"), [(2, 512), (2, 4), (1, 512), (1, 4), (0, 512)])
def test_dense_words(spark, radius, most):
    """Words within a few bits of two centres, far more than a key may hold."""
    draw = np.random.default_rng(radius)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in draw.integers(0, 64, draw.integers(0, 5))) for c in draw.integers(0, 2**63, 2) for _ in range(120)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    roots = {r.v % 2**64: r.root for r in components(simhash.links(df, radius, most)).collect()}
    got = [roots.get(f, f"own {f}") for f in fps]
    want = slow_components(list(range(len(fps))), fps, radius)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20] + [(5, 5)], "u long, v long")
    got = {r.v: r.root for r in components(links).collect()}
    assert [len({got[i] for i in range(a, a + 20)}) for a in (1, 21, 41)] == [1, 1, 1] and len(set(got.values())) == 3
    assert components(links.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    draw = rng(2)
    texts = [(i, t) for i, t in enumerate(near_copies(draw, 12))] + [(50, " ".join(words(draw, 80)))] + [(None, "only one of no id at all"), (60, "a"), (61, "a")]
    docs = table(spark, texts)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({0, 50, 60, None} | {c for c in slow_components([i for i, _ in texts], [slow_fingerprint(t) for _, t in texts])}, key=repr)
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_most_texts_are_empty(spark):
    """One fingerprint for most rows; words one and two bits from it are linked to it like any other."""
    texts = [(i, (None, "", "  ")[i % 3]) for i in range(5, 600)] + [(1, "a text of some words"), (2, "a text of some words")]
    out = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert all(out[i] == (0, 5) for i in range(5, 600)) and out[1] == out[2] and out[1][1] == 1
