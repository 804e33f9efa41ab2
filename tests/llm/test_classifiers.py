import os
import zlib

import numpy as np
import pytest
from helpers import odd_texts, rng, table, words

from burstline.llm import models, quality, queries, toxicity

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string"


def made(draw, n=600):
    texts, labels = [], []
    for i in range(n):
        own = words(draw, int(draw.integers(20, 200)))
        toxic, good = i % 4 == 0, i % 5 != 0
        if toxic:
            for j in draw.integers(0, len(own), 4):
                own[j] = ["you idiot", "m0ron", "TRASH", "pathetic loser"][int(draw.integers(4))]
        if not good:
            own = [w.upper() + "!!" for w in own] if i % 2 else [own[0]] * len(own)
        texts.append((i, " ".join(own)))
        labels.append((i, int(good), int(toxic), "clash"))
    return texts, labels


@pytest.mark.parametrize(("module", "label", "limit"), [(toxicity, 2, 0.5), (quality, 1, 0.3)])
def test_learns_and_scores_every_row(spark, module, label, limit):
    texts, labels = made(rng(1))
    texts += odd_texts(rng(2))[1:4] + [(None, "you idiot"), (5000, None)]
    docs, table_of_labels = table(spark, texts), spark.createDataFrame([*labels, (None, 1, 1, ""), (1, None, None, "")], LABELS)
    model = module.train(docs, table_of_labels)
    out = module.score(docs, model).collect()
    assert len(out) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = {row[0]: row[label] for row in labels}
    told = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert np.mean(told) > 0.95
    again = sorted((repr(r.doc_id), round(r.score, 9)) for r in module.score(docs, module.train(docs, table_of_labels)).collect())
    assert again == sorted((repr(r.doc_id), round(r.score, 9)) for r in out)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_both_labels(spark, module):
    texts, labels = made(rng(1), 40)
    docs = table(spark, texts)
    ones = spark.createDataFrame([(i, 1, 1, "") for i, *_ in labels], LABELS)
    assert {r.score for r in module.score(docs, module.train(docs, ones)).collect()} == {1.0}
    assert {r.score for r in module.score(docs, module.train(docs, ones.limit(0))).collect()} == {0.0}
    assert module.score(docs.limit(0), module.train(docs, ones)).count() == 0


def test_only_toxic_documents_go(spark):
    texts, labels = made(rng(3))
    docs = table(spark, texts)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.schema == docs.schema
    good = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in kept.collect()} == good


def test_isotonic():
    x, y = models.isotonic(np.array([3.0, 1, 2, 4, 5]), np.array([0.0, 0, 1, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and y.tolist() == [0.0, 0.5, 1.0]


def test_trees_find_an_interaction():
    x = rng(0).integers(0, 2, (2000, 3)).astype(float)
    y = np.logical_xor(x[:, 0], x[:, 1] * x[:, 2] > 0).astype(float)
    p = models.sigmoid(models.BoostedTrees(60).fit(x, y).margin(x))
    assert ((p > 0.5) == y).mean() > 0.99


def test_attention_gradients():
    draw = rng(5)
    x, begin, y = draw.normal(size=(40, 5)), np.array([0, 7, 8, 20, 40]), np.array([1.0, 0, 1, 0])
    model = quality.Attention(0.5, 6, 4)
    model.fit(x, begin, y, rounds=300)
    assert ((model.score(x, begin) > 0.5) == y).all()
    # Against differences of the loss.
    for k, g in model.gradients(x, begin, y).items():
        for at in ([()] if g.ndim == 0 else [(0,) * g.ndim, tuple(n - 1 for n in g.shape)]):
            kept, losses = model.weights[k], []
            for by in (1e-5, -1e-5):
                model.weights[k] = np.array(kept, float)
                model.weights[k][at] += by
                losses.append(model.loss(x, begin, y))
            model.weights[k] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - g[at]) < 1e-4


def test_attention_against_a_loop():
    """Scores of each document, passage by passage."""
    draw = rng(6)
    x, begin, y = draw.normal(size=(60, 5)), np.array([0, 1, 9, 30, 60]), np.array([1.0, 0, 1, 0])
    model = quality.Attention(0.5, 6, 4).fit(x, begin, y, rounds=5)
    w, want = model.weights, []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        encoded, gates = [], []
        for row in x[a:b]:
            h = np.tanh(np.clip((row - model.mean) / model.scale, -6, 6) @ w["e"] + w["eb"])
            encoded.append(h)
            gates.append(float(np.sum(np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"]))) * w["a"])))
        weight = np.exp(gates) / np.exp(gates).sum()
        want.append(1 / (1 + np.exp(-(sum(g * h for g, h in zip(weight, encoded, strict=True)) @ w["c"] + w["cb"]))))
    assert np.allclose(model.score(x, begin), want)


def test_trees_against_a_loop():
    """The first tree's first split has the greatest gain of all cuts, found one by one; margins are sums over the trees, row by row."""
    draw = rng(9)
    x = draw.normal(size=(300, 4)).round(1)
    y = (x[:, 2] + 0.3 * draw.normal(size=300) > 0.2).astype(float)
    trees = models.BoostedTrees(5)
    trees.fit(x, y)
    p = models.sigmoid(np.full(300, trees.base))
    g, h = y - p, p * (1 - p)

    def gain(f, c):
        left = x[:, f] <= c
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + trees.l2)
        return part(left) + part(~left) - part(left | ~left) if min(h[left].sum(), h[~left].sum()) >= trees.least else -1.0

    best = max(((gain(f, c), f, c) for f in range(4) for c in trees.cuts[f]), key=lambda z: z[0])
    feature, cut = trees.trees[0][0][0]
    assert (feature[0], cut[0]) == best[1:]
    want = []
    for row in x:
        total = trees.base
        for splits, value in trees.trees:
            node = 0
            for feature, cut in splits:
                node = 2 * node + int(feature[node] >= 0 and row[feature[node]] > cut[node])
            total += value[node]
        want.append(total)
    assert np.allclose(trees.margin(x), want)


@pytest.mark.parametrize("n", [4, 39, 40, 41, 500])
def test_letters_apart_of_any_length(n):
    """A run of single letters is one obfuscation however long it is, and an insult in it is found."""
    lexicon = toxicity.Lexicon(dict.fromkeys(toxicity.INSULTS, 1.0))
    filler = "qzx" * (n // 3 + 1)
    plain, insult = " ".join(filler[:n]), " ".join("moron" + filler[:n])
    raw = [f"{plain} word".encode(), f"{insult} word".encode(), b"a word of no letters"]
    x = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lexicon)
    assert np.allclose(x[:2, 12], [1 / (n + 1), 1 / (n + 6)]) and x[2, 12] == 0
    assert x[0, 10] == 0 and x[1, 10] > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize(("name", "label"), [("op4_toxicity", "toxic"), ("op9_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    out = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    y, order = out[label].to_numpy(), out["score"].rank().to_numpy()
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95 and (out["predicted"] == y).mean() > 0.95
