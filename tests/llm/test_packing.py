import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import odd_texts, rng, table
from hypothesis import given, settings
from hypothesis import strategies as st

from burstline.llm import packing, tokens

PATH = tokens.default_path()


def sequences(plan):
    """Sequence -> (offset, length) of all its pieces."""
    out = defaultdict(list)
    for length, _, count, first, each, offset in plan.rows:
        for i in range(count):
            out[first + i // each].append((offset + i % each * length, length))
    return out


def check(counts, capacity):
    plan = packing.Plan(counts, capacity)
    placed = sequences(plan)
    assert len(placed) == plan.sequences
    met = defaultdict(int)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
            met[length] += 1
        assert at <= capacity
    assert dict(met) == {n: c for n, c in counts.items() if c}
    for n, c in counts.items():  # ranks are covered once
        spans = sorted((r[1], r[1] + r[2]) for r in plan.rows if r[0] == n)
        assert not c or spans[0][0] == 0 and spans[-1][1] == c and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    return plan


def best(lengths, capacity):
    """Fewest sequences, by search."""
    lengths, least = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - lengths[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return least[0]


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=150, deadline=None)
def test_fixed_sets_never_lose(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = check(counts, 20)
    fixed = packing.Plan.__new__(packing.Plan)
    fixed.capacity, fixed.sequences, fixed.rows, fixed.fixed = 20, 0, [], 0
    fixed.left, fixed.given = dict(counts), dict.fromkeys(counts, 0)
    fixed._reduce()
    rest = [n for n, c in fixed.left.items() for _ in range(c)]
    # What was fixed is part of some best packing.
    assert fixed.sequences + best(rest, 20) == best(lengths, 20)
    assert plan.sequences <= fixed.sequences + best_fit(rest, 20)


def test_large_counts_stay_small():
    draw = rng(1)
    counts = {int(n): int(draw.integers(1, 10**9)) for n in draw.choice(np.arange(1, 4097), 1500, replace=False)}
    plan = packing.Plan(counts, 4096)
    assert len(plan.rows) < 40_000
    assert plan.sequences <= 1.02 * -(-sum(n * c for n, c in counts.items()) // 4096) + 1


@pytest.mark.parametrize("counts", [{}, {4096: 3}, {1: 10_000}, {4096: 1, 1: 1}, {2048: 5}, {3000: 2, 1096: 1}])
def test_edges(counts):
    check(counts, 4096)


def test_pieces_are_the_tokens(spark):
    texts = odd_texts(rng())
    out = packing.pack(table(spark, texts), PATH, 256).collect()
    tokenizer = tokens.encoder(PATH).tokenizer
    want = []
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 256):
            part = np.asarray(ids[p : p + 256], "<u4")
            want.append((i, p // 256, p, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    parts = defaultdict(list)
    for r in out:
        parts[r.sequence_id].append((r.offset, r.length))
    for own in parts.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False)) and min(own)[0] == 0 and sum(n for _, n in own) <= 256
    assert len(parts) <= best_fit([r.length for r in out], 256)


def test_empty_table(spark):
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_bulk_tokens_match_the_library():
    draw, encoder = rng(3), tokens.encoder(PATH)
    assert encoder.plain
    alphabet = list("abcXYZéÀßö019.,!?'&|<>$ \n\t") + ["<|endoftext|>", "we'll", "日", "\xa0", "\x1c", "́", "×"]
    texts = ["".join(draw.choice(alphabet, draw.integers(0, 80))) for _ in range(400)]
    raw = [t.encode() for t in texts]
    got = []
    for _, ids, at in encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])):
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [10, 11, 12, 13])
def test_long_runs_of_two_letters(bits):
    """Thue-Morse words, which polynomial hashes modulo powers of two take for one."""
    one = "a"
    for _ in range(bits):
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    encoder = tokens.Encoder(PATH)
    raw = [t.encode() for t in texts]
    (_, ids, at), = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_runs_that_collide_go_word_by_word(monkeypatch):
    texts = ["some words here, and more", "other words: 12 é", "<x> don't"]
    raw = [t.encode() for t in texts]
    encoder = tokens.Encoder(PATH)
    real = tokens.word_hashes
    monkeypatch.setattr(tokens, "word_hashes", lambda raw, a, b, seed=0: real(raw, a, b, seed) if seed else real(raw, a, b) % np.uint64(5))
    encoder._forget()
    (_, ids, at), = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_word_hashes():
    """Words of 0 to 200 bytes: equal for equal words wherever they stand, and the two seeds tell all others apart."""
    from burstline.llm.common import word_hashes

    draw = rng(4)
    words = list({draw.integers(0, 3, int(n)).astype(np.uint8).tobytes() for n in draw.integers(0, 200, 5000)})
    twice = [*words, *words[::-1]]
    ends = np.cumsum([len(w) for w in twice])
    raw = np.frombuffer(b"".join(twice), np.uint8)
    for seed in range(2):
        h = word_hashes(raw, ends - [len(w) for w in twice], ends, seed)
        assert (h[: len(words)] == h[len(words) :][::-1]).all() and len(np.unique(h)) == len(words)
    assert not set(word_hashes(raw, ends - [len(w) for w in twice], ends).tolist()) & set(h.tolist())
