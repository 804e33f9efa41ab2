"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a lexicon, its nearness to second-person words, capitals, punctuation and obfuscation. The lexicon is a short
fixed list and the words that mark toxic labels in one half of the sample; trees learn on the other half,
less a part that the calibration is fitted on. The sample of labelled rows is bounded by `most`; scoring reads every whole text.

Defined cases: null and empty texts are scored as texts of no words; without both labels in the sample every score is the share of
label 1 (0 without labels); rows are scored one by one; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.common import buffers, chunks, lowered, word_hashes, words
from burstline.llm.models import BoostedTrees, held_out, isotonic, labelled_sample, sigmoid

# Insults, and second-person words of four languages.
INSULTS = """arsehole asshole bastard bitch bullshit clown coward cretin crap cunt damn degenerate disgusting dumb dumbass dimwit fool
freak fuck fucking garbage hate idiot idiotic imbecile jerk kill liar loser lunatic maggot moron moronic nasty pathetic pervert pig prick
psycho rat retard scum scumbag shit shut slut stupid sucker swine trash ugly useless vermin vile whore worthless
arschloch dumm dreck hure idioten scheisse trottel connard conne con merde salope imbécile cabrón estúpido gilipollas idiota mierda puta""".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú usted ustedes vosotros".split()

_FOLD = bytes.maketrans(b"01345789@$!|+", b"oleastbgasilt")
_MASKS = np.zeros(256, bool)
_MASKS[[*b"0123456789@$*!|+#"]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CLASSES = [np.isin(np.arange(256), [*c]) for c in (range(65, 91), range(97, 123), b"!", b"?", b"@#$%^&*~|<>=+_", b".,;:'\"()-0123456789")]
FEATURES = 20


class Lexicon:
    """Weighted words, looked up by hash for all words of many texts at once."""

    def __init__(self, weights: dict[str, float]):
        self.weights = {w.encode(): v for w, v in weights.items()}
        self.hashes, self.values = _hashed([*self.weights], [*self.weights.values()])
        self.second, _ = _hashed([w.encode() for w in SECOND], [1.0] * len(SECOND))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of lexicon words among hashes, and which words they are."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        return hit, at[hit]

    def is_spelled(self, letters: bytes) -> bool:
        """Whether letters that stood apart hold a word of the lexicon of four letters or more."""
        return any(w in letters for w in self.weights if len(w) >= 4)

    def is_masked(self, word: bytes) -> bool:
        """Whether a word is in the lexicon once look-alike marks are letters, or marks are left out, or repeated letters single."""
        bare = word.translate(None, b"0123456789@$*!|+#.,;:_-'\"()?")
        return any(re.sub(rb"(.)\1+", rb"\1", w) in self.weights or w in self.weights for w in (word.translate(_FOLD, b"*#.,;:_-'\"()?"), bare))


def _hashed(words: list[bytes], values: list[float]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(w) for w in words])
    hashes = word_hashes(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends)
    order = np.argsort(hashes)
    return hashes[order], np.asarray(values)[order]


def features(raw: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """Measurements of each text, a row each."""
    texts = len(offsets) - 1
    low = lowered(raw)
    letter = _LETTERS[raw]
    starts, ends, first = words(low, offsets, ~_LETTERS)
    n = np.diff(first)
    doc = np.repeat(np.arange(texts), n)
    hashes = word_hashes(low, starts, ends)
    per = lambda d, w=None: np.bincount(d, w, texts).astype(float)
    every, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    x = np.zeros((texts, FEATURES))
    x[:, 0] = np.log1p(n)
    hit, word = lexicon.find(hashes)
    of, weight = doc[hit], lexicon.values[word]
    hits = per(of)
    x[:, 1], x[:, 2], x[:, 4] = hits / every, np.log1p(hits), per(of, weight) / every
    x[:, 3] = per(np.unique(of * len(lexicon.values) + word) // len(lexicon.values))
    np.maximum.at(x[:, 5], of, weight)
    # Places of words, with a gap between texts so that no two texts' words are near each other.
    place = np.arange(len(starts)) + 1000 * doc
    at = place[hit]
    np.maximum.at(x[:, 6], of, np.searchsorted(at, at + 20) - np.arange(len(at)))
    know = np.minimum(np.searchsorted(lexicon.second, hashes), len(lexicon.second) - 1)
    second = np.flatnonzero(lexicon.second[know] == hashes)
    x[:, 9] = per(doc[second]) / every
    beside = np.concatenate([[-(1 << 40)], place[second], [1 << 40]])
    i = np.searchsorted(place[second], at)
    gap = np.minimum(at - beside[i], beside[i + 1] - at)
    x[:, 7] = per(of[gap <= 5])
    np.maximum.at(x[:, 8], of, np.where(gap < 1000, 1 / (1 + gap), 0))
    # Obfuscation: marks inside words, letters spaced out, letters drawn out. Such words are few and looked at one by one.
    odd: list[tuple[int, bytes]] = []
    spelled: list[tuple[int, bytes]] = []
    inner = np.flatnonzero(_MASKS[raw[:-1]] & letter[1:]) if len(raw) else np.zeros(0, np.int64)
    if len(inner):
        s, e, f = words(raw, offsets)
        k = np.searchsorted(s, inner, side="right") - 1
        k = np.unique(k[inner < e[np.maximum(k, 0)] - 1])
        odd += zip((np.searchsorted(f, k, side="right") - 1).tolist(), [low[a:b].tobytes() for a, b in zip(s[k].tolist(), e[k].tolist(), strict=True)], strict=True)
    single = ends - starts == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    for a, b in edge.reshape(-1, 2).tolist():
        # Letters with one byte between them; a wider gap, or the next text, begins another run.
        cuts = np.flatnonzero((starts[a + 1 : b] - ends[a : b - 1] > 1) | (doc[a + 1 : b] != doc[a : b - 1])) + a + 1
        for i, j in zip([a, *cuts.tolist()], [*cuts.tolist(), b], strict=True):
            if j - i >= 4:
                spelled.append((int(doc[i]), low[starts[i:j]].tobytes()))
    drawn = np.flatnonzero((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & letter[2:]) if len(raw) > 2 else np.zeros(0, np.int64)
    k = np.unique(np.searchsorted(starts, drawn, side="right") - 1)
    k = k[k >= 0]
    x[:, 13] = per(doc[k]) / every
    odd += zip(doc[k].tolist(), [low[a:b].tobytes() for a, b in zip(starts[k].tolist(), ends[k].tolist(), strict=True)], strict=True)
    x[:, 12] = per(np.asarray([d for d, _ in odd + spelled], np.int64)) / every
    found = [d for d, w in odd if lexicon.is_masked(w)] + [d for d, w in spelled if lexicon.is_spelled(w)]
    masked = per(np.asarray(found, np.int64))
    x[:, 10], x[:, 11] = np.log1p(masked), masked / every
    upper, lower, shouts, asks, symbols, rest = (np.diff(np.searchsorted(np.flatnonzero(c[raw]), offsets)) for c in _CLASSES)
    capital = _CLASSES[0][raw]
    runs = np.flatnonzero(capital[2:] & capital[1:-1] & capital[:-2]) if len(raw) > 2 else np.zeros(0, np.int64)
    x[:, 14], x[:, 15] = upper / np.maximum(upper + lower, 1), np.diff(np.searchsorted(runs, offsets)) / size
    x[:, 16], x[:, 17], x[:, 18], x[:, 19] = shouts / size, asks / size, symbols / size, rest / size
    return x


def learned_lexicon(sample: DataFrame, most: int = 200) -> dict[str, float]:
    """The fixed list and up to `most` words whose documents are toxic far more often than others, with log odds."""
    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    lexicon = dict.fromkeys(INSULTS, 1.0)
    if not toxic or not clean:
        return lexicon
    words = sample.select("y", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("w"))
    counts = words.groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")).where(F.col("a") >= max(5, toxic // 50))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    top = counts.withColumn("o", odds).where("o > 1.5").orderBy(F.desc("o"), "w").limit(most).collect()
    return lexicon | {r.w: float(r.o) for r in top}


class Model:
    """score(bytes, offsets) -> a probability for each text."""

    def __init__(self, lexicon: dict[str, float], share: float):
        self.lexicon, self.share, self.trees = Lexicon(lexicon), share, None

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
        order = np.random.default_rng(seed).permutation(len(y))
        part = max(1, len(y) * 3 // 10)
        calibrate, learn = order[:part], order[part:]
        if len(set(y[learn].tolist())) == 2:
            self.trees = BoostedTrees().fit(x[learn], y[learn])
            self.knots = isotonic(self.trees.margin(x[calibrate]), y[calibrate])
        return self

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.share)
        out = [np.zeros(0)]
        for i, j in chunks(offsets):
            margin = self.trees.margin(features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.lexicon))
            # A little of the trees' own probability keeps the order within a pool.
            out.append(0.998 * np.interp(margin, *self.knots) + 0.002 * sigmoid(margin))
        return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Model:
    """A model of labels.toxic, learned from at most `most` rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", most)
    half = F.pmod(F.xxhash64(F.concat(F.lit("lexicon"), F.col("doc_id").cast("string"))), F.lit(2))
    lexicon = learned_lexicon(sample.where(half == 0))
    model_lexicon = Lexicon(lexicon)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            for i, j in chunks(offsets):
                rows = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model_lexicon)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    # At most `most` short rows come to the driver.
    rows = sample.where(half == 1).select("text", "y", "doc_id").sort("doc_id").select("text", "y").mapInArrow(measure, "y int, x array<double>").toPandas()
    y = rows["y"].to_numpy(float)
    model = Model(lexicon, float(y.mean()) if len(y) else 0.0)
    return model.fit(np.stack(rows["x"].to_list()), y) if len(y) else model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted (score 0.5 or more) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = model.score(*buffers(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs, in all its columns, without rows that score `limit` or more."""
    text = docs.columns.index("text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(model.score(*buffers(batch.column(text))) < limit))

    return docs.mapInArrow(run, docs.schema)
