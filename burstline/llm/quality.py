"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of up to 64 words. Every passage is encoded from its words (hashed into BUCKETS shares, whatever their case) and
dense measurements (letters, capitals, digits, marks by kind, word lengths, repetition within the passage and of what the document has said before); gated attention weights the
encoded passages, and the weighted sum is scored. Encoder, attention and score are learned together from document labels
alone, on a bounded sample of labelled rows; scoring reads every passage of every text.

Defined cases: a null or empty text is one passage of no words; without both labels in the sample every score is the share of label 1 (0 without labels);
rows are scored one by one; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstline.llm.common import buffers, chunks, lowered, mix, windows, word_hashes, words
from burstline.llm.models import held_out, labelled_sample, sigmoid

PASSAGE = 64  # words
BUCKETS = 64
_CLASSES = [bytes(range(65, 91)), bytes(range(48, 58)), b"!?", b"#$%&*@^~=+<>_\\/{}[]|", b".,;:", b"'\"()-", b"\n", bytes(range(128, 256))]
_TABLE = np.zeros((len(_CLASSES), 256), bool)
for _i, _c in enumerate(_CLASSES):
    _TABLE[_i, list(_c)] = True
_DENSE = len(_CLASSES) + 13
FEATURES = _DENSE + BUCKETS


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Measurements of all passages, and for each text the number of its first passage; every text has one at least."""
    starts, ends, first = words(raw, offsets)
    count = np.diff(first)
    bags = np.maximum(-(-count // PASSAGE), 1)
    begin = np.append(0, np.cumsum(bags))
    x = np.zeros((int(begin[-1]), FEATURES))
    if not len(starts):
        return x, begin
    doc = np.repeat(np.arange(len(count)), count)
    local = np.arange(len(starts)) - first[doc]
    owner = begin[doc] + local // PASSAGE
    n = np.bincount(owner, minlength=len(x)).astype(float)
    some = np.maximum(n, 1)
    add = lambda w: np.bincount(owner, w, len(x))
    size = (ends - starts).astype(float)
    letters = np.maximum(add(size), 1)
    # Bytes from a word's start to the next word's, so that marks between words count too.
    stop = np.append(starts[1:], len(raw))
    stop = np.minimum(stop, offsets[doc + 1])
    for f in range(len(_CLASSES)):
        sums = np.append(0, np.cumsum(_TABLE[f][raw], dtype=np.int64))
        x[:, f] = add((sums[stop] - sums[starts]).astype(float)) / letters
    f = len(_CLASSES)
    head, tail = raw[starts], raw[ends - 1]
    hashes = word_hashes(raw, starts, ends)
    x[:, f] = np.log1p(n)
    x[:, f + 1] = letters / some
    x[:, f + 2] = add(size**2) / some - (letters / some) ** 2
    x[:, f + 3] = add((size <= 3).astype(float)) / some
    x[:, f + 4] = add((size >= 14).astype(float)) / some
    x[:, f + 5] = add(_TABLE[0][head].astype(float)) / some
    x[:, f + 6] = add(_TABLE[2][tail].astype(float)) / some
    x[:, f + 7] = add(_TABLE[3][tail].astype(float)) / some
    x[:, f + 8] = add((_TABLE[2:7, head].any(axis=0) & (size == 1)).astype(float)) / some
    # Repetition: distinct words of a passage, its commonest word, and three-word runs said earlier in the document.
    key = mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    _, at, times = np.unique(key, return_index=True, return_counts=True)
    x[:, f + 9] = np.bincount(owner[at], minlength=len(x)) / some
    most = np.zeros(len(x))
    np.maximum.at(most, owner[at], times)
    x[:, f + 10] = most / some
    runs = windows(hashes, 3)
    inside = np.flatnonzero(doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, np.int64)
    if len(inside):
        run = mix(runs[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1)))
        _, at = np.unique(run, return_index=True)
        new = np.bincount(owner[inside[at]], minlength=len(x))
        total = np.bincount(owner[inside], minlength=len(x))
        x[:, f + 11] = (total - new) / np.maximum(total, 1)
    x[:, f + 12] = np.log1p(np.repeat(bags, bags))
    bucket = (word_hashes(lowered(raw), starts, ends, 1) >> np.uint64(40)).astype(np.int64) % BUCKETS
    x[:, _DENSE:] = np.bincount(owner * BUCKETS + bucket, minlength=len(x) * BUCKETS).reshape(-1, BUCKETS) / some[:, None]
    return x, begin


def _bags(x: np.ndarray, begin: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages of the chosen documents, and where each of these begins."""
    n = np.diff(begin)[chosen]
    to = np.append(0, np.cumsum(n))
    return x[np.repeat(begin[chosen] - to[:-1], n) + np.arange(to[-1])], to


class Attention:
    """tanh encoder, gated attention and a linear score, by gradient steps (Adam) on small batches of documents with all their passages.

    A tenth of the documents is not learned from: the weights that are best on it are kept, and learning stops when they have not got better for `patience` rounds.
    """

    def __init__(self, share: float, hidden: int = 24, gate: int = 12, seed: int = 11):
        self.share, self.hidden, self.gate, self.seed, self.weights = share, hidden, gate, seed, None

    def _forward(self, x, begin):
        w = self.weights
        h = np.tanh(x @ w["e"] + w["eb"])
        t, s = np.tanh(h @ w["v"]), sigmoid(h @ w["u"])
        e = (t * s) @ w["a"]
        first = begin[:-1]
        n = np.diff(begin)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return h, t, s, a, z, sigmoid(z @ w["c"] + w["cb"])

    def gradients(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, back through score, attention and encoder."""
        w, n = self.weights, np.diff(begin)
        h, t, s, a, z, p = self._forward(x, begin)
        d = (p - y) / len(y)
        dz = np.repeat(d[:, None] * w["c"], n, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, begin[:-1]), n))
        dg = de[:, None] * w["a"]
        dt, ds = dg * s * (1 - t**2), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["v"].T + ds @ w["u"].T) * (1 - h**2)
        return {"e": x.T @ dh, "eb": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ d, "cb": d.sum()}

    def loss(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> float:
        p = np.clip(self._forward(x, begin)[-1], 1e-7, 1 - 1e-7)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def fit(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, rounds: int = 40, batch: int = 128, rate: float = 0.01, l2: float = 1e-4, patience: int = 6) -> Attention:
        if len(set(y.tolist())) < 2:
            return self
        draw = np.random.default_rng(self.seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        shape = {"e": (x.shape[1], self.hidden), "eb": (self.hidden,), "v": (self.hidden, self.gate), "u": (self.hidden, self.gate), "a": (self.gate,), "c": (self.hidden,), "cb": ()}
        self.weights = {k: np.asarray(draw.normal(0, 1 / np.sqrt(s[0]) if len(s) == 2 else 0.3 if k in "ac" else 0, s)) for k, s in shape.items()}
        one, two = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        order = draw.permutation(len(y))
        apart = len(y) // 10
        check, learn = _bags(x, begin, order[:apart]), order[apart:]
        best, kept, since, step = np.inf, None, 0, 0
        for _ in range(rounds):
            learn = draw.permutation(learn)
            for i in range(0, len(learn), batch):
                chosen = learn[i : i + batch]
                step += 1
                for k, g in self.gradients(*_bags(x, begin, chosen), y[chosen]).items():
                    g = g + (l2 * self.weights[k] if k in "evuac" else 0)
                    one[k] = 0.9 * one[k] + 0.1 * g
                    two[k] = 0.999 * two[k] + 0.001 * g**2
                    self.weights[k] = self.weights[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
            if not apart:
                continue
            now = self.loss(*check, y[order[:apart]])
            if now < best - 1e-4:
                best, kept, since = now, dict(self.weights), 0
            else:
                since += 1
                if since == patience:
                    break
        self.weights = kept or self.weights
        return self

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if self.weights is None or len(begin) < 2:
            return np.full(len(begin) - 1, self.share)
        return self._forward(np.clip((x - self.mean) / self.scale, -6, 6), begin)[-1]


def train(docs: DataFrame, labels: DataFrame, most: int = 8_000) -> Attention:
    """A model of labels.quality, learned from at most `most` rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", most)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw, offsets = buffers(batch.column(0))
            y = batch.column(1)
            for i, j in chunks(offsets):
                x, begin = passages(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = [x[a:b].astype(np.float32).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([y.slice(i, j - i), pa.array(rows, pa.binary())], names=["y", "x"])

    # Passages of at most `most` documents come to the driver, some hundred bytes each.
    rows = sample.select("text", "y", "doc_id").sort("doc_id").select("text", "y").mapInArrow(measure, "y int, x binary").toPandas()
    y = rows["y"].to_numpy(float)
    model = Attention(float(y.mean()) if len(y) else 0.0)
    if not len(y):
        return model
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["x"]]
    return model.fit(np.concatenate(bags).astype(float), np.append(0, np.cumsum([len(b) for b in bags])), y)


def score(docs: DataFrame, model: Attention, limit: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score `limit` or more) of every row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw, offsets = buffers(batch.column(2))
            scores = [np.zeros(0)]
            for i, j in chunks(offsets):
                scores.append(model.score(*passages(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            told = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told), pa.array((told >= limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
