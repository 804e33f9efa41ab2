import re

import numpy as np
import pytest
from helpers import odd_texts, rng, table, words

from burstline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def shingles(text):
    own = WORD.findall((text or "").lower())
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def slow(texts, items, threshold=0.8):
    out = []
    for d, t in texts:
        for i, q in sorted(set(items), key=repr):
            have, want = shingles(t), shingles(q)
            if want and len(have & want) >= threshold * len(want):
                out.append((d, i, len(have & want), len(want)))
    return sorted(out, key=repr)


def made():
    draw = rng(9)
    items = [(i, " ".join(words(draw, int(n)))) for i, n in enumerate([5, 6, 9, 20, 40, 75, 300])] + [(90, "four words are few"), (91, None), (None, " ".join(words(draw, 12)))]
    items += [items[3], (3, items[4][1])]
    texts = odd_texts(draw)
    for k, (_, q) in enumerate(items):
        if q:
            own = q.split()
            before, after = words(draw, int(draw.integers(0, 3000))), words(draw, 500)
            texts.append((100 + k, " ".join([*before, *own, *after])))
            texts.append((200 + k, ", ".join([*before[:50], *(w.upper() for w in own)]) + "!"))
            own[len(own) // 2] = "changed"
            texts.append((300 + k, " ".join([*before[:9], *own])))
            half = len(own) // 2
            texts.append((400 + k, " ".join([*own[:half], *after, *q.split()[half - 4 if half > 4 else 0 :]])))  # in two far places
    return texts, items


def test_against_every_pair(spark):
    texts, items = made()
    table_of_items = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 200):  # one block, many blocks
        got = decontaminate.contaminated(table(spark, texts), table_of_items, block_bytes=size).collect()
        assert sorted(((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got), key=repr) == slow(texts, items)


def test_clean_documents_stay(spark):
    texts, items = made()
    docs, table_of_items = table(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, *_ in slow(texts, items)}
    for size in (8 << 20, 500):
        kept = decontaminate.drop_contaminated(docs, table_of_items, block_bytes=size)
        assert kept.schema == docs.schema
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((d for d, _ in texts if d not in bad), key=repr)


def test_empty(spark):
    texts, items = made()
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, texts), none).count() == 0
    assert decontaminate.drop_contaminated(table(spark, texts), none).count() == len(texts)
    assert decontaminate.contaminated(table(spark, []), spark.createDataFrame(items, none.schema)).count() == 0


def test_short_items_in_long_documents(spark):
    """Items of one to a few shingles, each once at every place of texts that other shingles fill."""
    draw = rng(24)
    items = [(k, " ".join(f"q{k}x{i}" for i in range(n))) for k, n in enumerate([5, 5, 6, 7, 8, 12])]
    texts = [(i, " ".join([*words(draw, int(draw.integers(0, 300)), 10**6), items[i % 6][1], *words(draw, 300, 10**6)])) for i in range(600)]
    got = decontaminate.contaminated(table(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i % 6) for i in range(600)]


@pytest.mark.parametrize("n", range(5, 13))
def test_no_planted_item_is_missed(n):
    """300 items of each length, whole, and with as many of their words as reach the threshold, against brute force."""
    draw = rng(n)
    items = [(k, " ".join(f"i{x}" for x in draw.integers(0, 10**9, n))) for k in range(300)]
    searcher = decontaminate.Searcher([(k, q.encode()) for k, q in items], 5, 0.8)
    texts = []
    for k, q in items:
        own, fill = q.split(), words(draw, 400, 10**6)
        part = own[: 4 + int(np.ceil(0.8 * (n - 4) - 1e-9))]  # so many shingles that the threshold is just reached
        at = int(draw.integers(0, 400))
        texts.append((2 * k, " ".join([*fill[:at], *own, *fill[at:]])))
        texts.append((2 * k + 1, " ".join([*fill[:at], *part, *fill[at:]])))
    raw = [t.lower().encode() for _, t in texts]
    found = searcher.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert sorted((d, k) for d, k, _ in found) == [(d, d // 2) for d in range(600)]
    few = [(d, texts[d][1]) for d in range(0, 600, 60)]
    assert sorted((d, k, shared) for d, k, shared in found if d % 60 == 0) == sorted((d, k, shared) for d, k, shared, _ in slow(few, items))
