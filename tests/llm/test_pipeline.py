import zlib

import corpus_pipeline
import numpy as np
import pytest
import test_decontaminate
import test_shingles
import test_substring
from helpers import odd_texts, rng, table, words

from burstline.llm import tokens, toxicity


@pytest.fixture()
def folder(spark, tmp_path):
    draw = rng(11)
    item = " ".join(words(draw, 30))
    passage = " ".join(words(draw, 60))
    texts = odd_texts(draw) + [(100 + i, " ".join(words(draw, 120))) for i in range(120)]
    texts += [(300, texts[-1][1]), (301, texts[-2][1].upper().replace(" ", "\n ")), (302, " ".join([*words(draw, 90), passage])), (303, " ".join([passage, *words(draw, 90)]))]
    texts += [(310, " ".join([*words(draw, 50), item])), *[(400 + i, " ".join([*words(draw, 40), "you idiot", "you stupid trash", "moron"])) for i in range(60)]]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, int(i >= 400)) for i, _ in texts if i is not None and i >= 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), dict(texts)


def test_stages_take_effect(spark, folder):
    path, texts = folder
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == spark.read.parquet(f"{path}/documents.parquet").columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {i for i in seen["toxicity"] if i is not None and i >= 400} and set(range(100, 220)) <= set(seen["toxicity"])
    assert not {300, 301} & set(seen["near_duplicates"]) and {218, 219, 302, 303} <= set(seen["near_duplicates"])
    assert seen["repeated_passages"][302] == texts[302] and len(seen["repeated_passages"][303].split()) == 90
    assert 310 not in seen["decontamination"] and set(seen["decontamination"]) == set(seen["repeated_passages"]) - {310}
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == set(seen["decontamination"])


def test_all_rows_against_slow_stages(spark, folder):
    """run() against the stages done by loops: whatever the toxicity model keeps, near copies by all pairs, passages by every window, items by every pair."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    raw = [(t or "").encode() for _, t in rows]
    scores = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    rows = [r for r, c in zip(rows, test_shingles.slow_components(rows), strict=True) if r[0] == c]
    rows = [(i, kept if gone else t) for (i, t), (_, _, gone, _, kept) in zip(rows, test_substring.slow(rows), strict=True)]
    bad = {d for d, *_ in test_decontaminate.slow(rows, items)}
    want = []
    tokenizer = tokens.encoder(tokens.default_path()).tokenizer
    for i, t in rows:
        if i not in bad:
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
            want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.asarray(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    packed = corpus_pipeline.run(spark, path).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=repr) == sorted(want, key=repr)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0) and r.offset + r.length <= 4096
        ends[r.sequence_id] = r.offset + r.length


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
