"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text: its 1- and 2-grams of words (ASCII lower-cased) and of word shapes, each hashed to
``BITS`` bits; the value is a damped count, and the vector has length one. Shape features (letter case,
punctuation, digits) and n-gram repetition buckets are hashed like any other n-gram. Training makes
``EPOCHS`` passes of FTRL-proximal updates with L1, so rare n-grams keep a weight of exactly zero; a text's
score is the logistic of a sparse dot product.

Defined cases: null and empty texts have only the bias; texts are read whole, however long; a score of exactly
``DECISION`` counts as good; repeated ids give a row each, their labels are taken once (the greatest); no documents give
no rows, and without labels of both classes every text gets about one score; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, held_out, map_arrow
from .toxicity import sample

BITS, EPOCHS = 20, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.1
#: Bound of the labelled sample per class.
SAMPLE_ROWS = 4000
DECISION = 0.3
#: N-gram hashes that one Python worker keeps at hand.
CACHE = 500_000
SHAPES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"9"))


@dataclass
class Model:
    weights: np.ndarray
    bias: float


_slots: dict[bytes, tuple[int, int]] = {}


def _slot(word: bytes) -> tuple[int, int]:
    """Hash slots of a word and of its shape."""
    found = _slots.get(word)
    if found is None:
        if len(_slots) > CACHE:
            _slots.clear()
        shape = word
        for pattern, mark in SHAPES:
            shape = pattern.sub(mark, shape)
        h = xxhash.xxh32_intdigest
        found = _slots[word] = (h(b"w" + word.lower(), 1), h(b"s" + shape, 2))
    return found


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots and values of a text's hashed n-grams."""
    words = (text or "").encode("utf-8", "replace").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    pair = np.array([_slot(w) for w in words], np.uint64)
    word, shape = pair[:, 0], pair[:, 1]
    grams = [word, shape]
    for a in (word, shape):
        grams.append((a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20))
    # how much of the text repeats earlier bigrams, and how long it is, as n-grams of their own
    n = len(grams[2])
    novel = int(10 * len(np.unique(grams[2])) / n) if n else 10
    extra = [xxhash.xxh32_intdigest(b"r%d" % novel, 3), xxhash.xxh32_intdigest(b"l%d" % int(math.log2(len(words))), 4)]
    slots = (np.concatenate(grams) & np.uint64((1 << BITS) - 1)).astype(np.int64)
    slots, counts = np.unique(slots, return_counts=True)
    values = np.log1p(counts)
    values = values / math.sqrt(float(values @ values))
    return (
        np.concatenate([slots, np.array(extra, np.int64) & ((1 << BITS) - 1)]),
        np.concatenate([values, [0.3, 0.3]]).astype(np.float32),
    )


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over the rows in the order given."""
    size = 1 << BITS
    z, n = np.zeros(size + 1, np.float64), np.zeros(size + 1, np.float64)
    for _ in range(epochs):
        for slots, values, y in rows:
            i = np.append(slots, size)
            x = np.append(values, 1.0)
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:size].astype(np.float32), float(w[size]))


def probability(model: Model, text: str | None) -> float:
    slots, values = features(text)
    s = model.bias + float(model.weights[slots] @ values)
    return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, s))))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows; the executors hash, the driver runs the updates.

    The sample is weighed back to the labels' shares by a shift of the bias.
    """
    chosen = sample(docs, labels, "quality", rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [features(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("y"), pa.array([s.astype(np.int32).tobytes() for s, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())],
            names=["y", "slots", "values"],
        )

    hashed = map_arrow(chosen, run, fields("y int, slots binary, values binary"))
    data = [
        (np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32), r["y"])
        for r in hashed.orderBy(F.xxhash64("slots", "values"), "y").toLocalIterator()
    ]
    model = fit(data)
    share = {
        r["y"]: r["n"]
        for r in labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy(F.col("quality").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()
    }
    got = Counter(y for *_, y in data)
    if all(share.get(y) and got.get(y) for y in (0, 1)):
        model.bias += math.log(share[1] / share[0]) - math.log(got[1] / got[0])
    return model


SCORE = fields("score double, predicted int")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.array([probability(shared.value, t) for t in batch.column("text").to_pylist()], np.float64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(p), pa.array((p >= DECISION).astype(np.int32))], names=["doc_id", *SCORE.names]
        )

    return map_arrow(ids, run, T.StructType([ids.schema["doc_id"], *SCORE.fields]))
