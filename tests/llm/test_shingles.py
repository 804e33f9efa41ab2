import re

import corpus_pipeline
import numpy as np
import pytest
from helpers import odd_texts, rng, table, words

from burstline.llm import shingles


def slow_set(text):
    own = [w for w in re.split("[ \t\n\v\f\r]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(own[i : i + 5]) for i in range(max(len(own) - 4, 1))} if own else set()


def slow_components(texts):
    sets, parent = [slow_set(t) for _, t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(texts))]


def near_copies(draw, first):
    """Copies with words changed, put in and taken out, on both sides of the similarity, and chains of such copies."""
    out = []
    for n in (6, 9, 12, 25, 60, 150, 400, 1000):
        base = words(draw, n)
        for k in range(12):
            own = list(base)
            for at in draw.integers(0, len(own), int(draw.integers(0, max(2, n // 25)))).tolist():
                own[at : at + int(draw.integers(1, 3))] = [f"new{k}"] * int(draw.integers(0, 3))
            out.append(" ".join(own).upper() if k % 3 == 0 else "\n".join(own))
            base = own if k % 4 == 0 else base
    return [(first + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("most", [512, 8, 2])
def test_against_all_pairs(spark, most):
    draw = rng(21)
    texts = odd_texts(draw) + near_copies(draw, 100) + [(300 + i, " ".join(words(draw, 50))) for i in range(20)]
    want = slow_components(texts)
    assert 8 < sum(c != i for (i, _), c in zip(texts, want, strict=True)) < len(texts) - 40
    got = shingles.near_duplicates(table(spark, texts), most=most).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(((i, c) for (i, _), c in zip(texts, want, strict=True)), key=repr)


def test_one_large_group_of_near_copies(spark):
    """Copies of one text with a word or two changed, in a few blocks, some by way of another copy only, among texts that share half of it."""
    draw, texts = rng(24), []
    base = words(draw, 200)
    for i in range(150):
        own = list(base)
        own[int(draw.integers(200))] = f"new{i}"
        texts.append((i, " ".join(own)))
    for i in range(40):
        texts.append((500 + i, " ".join([*base[:100], *words(draw, 100)])))
    far = list(base)
    for k, at in enumerate((10, 60, 110, 160, 190)):  # each step is similar to the one before, the last ones not to the start
        far[at : at + 2] = [f"far{k}", f"off{k}"]
        texts.append((800 + k, " ".join(far)))
    want = slow_components(texts)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(table(spark, texts), most=16).collect()}
    assert got == {i: c for (i, _), c in zip(texts, want, strict=True)} and len(set(want)) > 30


def test_the_stage_drops_copies_of_changed_words(spark):
    """Each copy has three of 200 words changed: similarity 0.85 of five-word shingles, mostly more than two bits of simhash."""
    draw, texts = rng(22), []
    for i in range(30):
        own = words(draw, 200)
        texts.append((i, " ".join(own)))
        for at in (30, 100, 170):
            own[at] = "changed"
        texts.append((100 + i, " ".join(own)))
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_least_hashes_follow_the_similarity():
    draw = np.random.default_rng(23)
    flat = draw.integers(0, 2**63, 30_000).astype(np.uint64)
    sets = [flat[i : i + 180] for i in range(0, 15_000, 20)]  # neighbours share 160 of 200
    least = shingles._least(sets)
    equal, shared = (least[1:] == least[:-1]).sum(axis=1), (shingles._keys(least)[1:] == shingles._keys(least)[:-1]).any(axis=1)
    assert abs(equal.mean() / 160 - 0.8) < 0.01 and equal.std() < 1.3 * (160 * 0.8 * 0.2) ** 0.5 and shared.all()


def test_empty(spark):
    assert shingles.keep_one(table(spark, [])).count() == 0
    assert [r.doc_id for r in shingles.keep_one(table(spark, [(4, ""), (3, None)])).collect()] == [3]
    with pytest.raises(ValueError):
        shingles.near_duplicates(table(spark, []), similarity=0.7)
