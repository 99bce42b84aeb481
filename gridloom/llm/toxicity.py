"""Toxicity by maximum-scoring segments of token log-odds.

Training: how many labelled texts of each class hold a token gives its log-odds under a hierarchical
Dirichlet prior (a word's prior is the log-odds of its first letters, theirs is neutral), moved back
toward the prior by the standard error. A constant drift makes an ordinary token score below zero, so that sums over clean text fall.

Scoring: one linear pass over a text's token scores finds all maximal scoring segments (every one is
disjoint from the others and none can be extended to score more). Extreme-value theory for such sums
gives P(best segment >= s) ~ 1 - exp(-K n exp(-lambda s)), with lambda the positive root of
E[exp(lambda X)] = 1 under clean tokens and K fitted to clean training texts. Segments whose calibrated
significance passes are reported; their calibrated scores are summed into the document's evidence, and
two logistic coefficients fitted on training rows turn that into a probability.

Defined cases: null and empty texts have no tokens and get the probability of no evidence; texts are read whole,
however long; a score of exactly 0.5 counts as toxic; repeated ids give a row each, their labels are taken once (the
greatest); no documents give no rows, and without labels of both classes every text gets one score; other columns
are not read, or kept as they are where documents are filtered.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fields, held_out, map_arrow

#: Bound of the labelled sample per class.
SAMPLE_ROWS = 3000
PRIOR, DRIFT, CLIP, STEMS, ERRORS = 0.5, 0.5, 6.0, (4, 6), 3.0
#: Word scores that one Python worker keeps at hand.
CACHE = 100_000
#: A segment is significant at this natural-log odds beyond what clean text of the length shows.
SIGNIFICANT = 3.0


@dataclass
class Model:
    weights: dict[bytes, float]
    lam: float
    log_k: float
    bias: float
    slope: float
    seen: dict[bytes, float] = field(default_factory=dict, repr=False)  # scores met so far

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def scores(self, tokens: list[bytes]) -> np.ndarray:
        seen, known = self.seen, self.weights
        if len(seen) > CACHE:
            seen.clear()
        out = np.empty(len(tokens))
        for i, t in enumerate(tokens):
            v = seen.get(t)
            if v is None:
                v = seen[t] = next((known[k] for k in chain(t) if k in known), -DRIFT)
            out[i] = v
        return out

    def evidence(self, tokens: list[bytes]) -> tuple[float, list[tuple[int, int, float]]]:
        """Calibrated evidence and the significant segments (start token, end token, calibrated score)."""
        chance = self.log_k + math.log(len(tokens) + 1)
        found = [(a, b, self.lam * s - chance) for a, b, s in segments(self.scores(tokens))]
        strong = [x for x in found if x[2] >= SIGNIFICANT]
        best = max((c for _, _, c in found), default=0.0)
        return (sum(c for _, _, c in strong) if strong else max(best, 0.0)), strong

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.bias + self.slope * math.log1p(max(0.0, evidence))))))


def tokenize(text: str | None) -> list[bytes]:
    """ASCII lower-cased words without surrounding punctuation."""
    return [w.strip(b".,;:!?\"'()[]|") for w in (text or "").encode("utf-8", "replace").lower().split()]


def chain(word: bytes) -> list[bytes]:
    """The word and its first letters by falling length, the latter marked so that no word equals them."""
    text = word.decode("utf-8", "replace")
    return [word, *(text[:n].encode() + b"*" for n in STEMS[::-1])]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score) in linear time.

    Keeps a list of disjoint candidates with the running totals before and after each. A new positive
    score either starts a candidate or is merged with the nearest earlier one whose left total is lower
    while its right total is not higher; earlier ones are reached by stored links, so each is looked at
    a bounded number of times.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    start: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    back: list[int] = []  # nearest earlier candidate with a lower left total

    for i in np.flatnonzero(scores > 0).tolist():
        s, e, lo, hi = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(start) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            s, lo = start[j], left[j]
            del start[j:], end[j:], left[j:], right[j:], back[j:]
        start.append(s), end.append(e), left.append(lo), right.append(hi), back.append(j)
    return [(a, b, r - l) for a, b, l, r in zip(start, end, left, right)]


def shrunk(y1: float, n1: float, y0: float, n0: float, prior: float, mean: float) -> float:
    """Log-odds under a Dirichlet prior of weight ``prior`` and log-odds ``mean``, drawn back to ``mean`` unless significant.

    Significance is the root of the likelihood ratio statistic of the counts against the prior mean; of the
    difference the share beyond ERRORS of it is kept.
    """
    a1, a0 = prior * math.exp(mean / 2), prior * math.exp(-mean / 2)
    d = math.log((y1 + a1) / (n1 + a1 + a0)) - math.log((y0 + a0) / (n0 + a1 + a0))
    n, p = y1 + y0, 1 / (1 + math.exp(-(mean + math.log(n1 / n0))))
    g = sum(y * math.log(y / (n * q)) for y, q in ((y1, p), (y0, 1 - p)) if y)
    z = math.sqrt(max(0.0, 2 * g))
    return mean + (d - mean) * max(0.0, 1 - ERRORS / z) if z else mean


def log_odds(toxic: Counter, clean: Counter, n1: int, n0: int) -> dict[bytes, float]:
    """Scores of first letters and words; each one's prior is the log-odds of the shorter beginning.

    Counts are numbers of texts, so a text that repeats a word counts once. An entry is kept if it says
    something else than the one above it.
    """
    levels = [(Counter(), Counter()) for _ in range(len(STEMS) + 1)]
    above: dict[bytes, bytes] = {}
    for c, counts in enumerate((clean, toxic)):
        for w, n in counts.items():
            links = chain(w)[::-1]
            for level, key in enumerate(links):
                levels[level][c][key] += n
            above.update(zip(links[1:], links))
    mean: dict[bytes, float] = {}
    out = {}
    for y0, y1 in levels:
        for key in y0.keys() | y1.keys():
            up = mean.get(above.get(key), 0.0)
            d = max(-CLIP, min(CLIP, shrunk(y1[key], n1, y0[key], n0, PRIOR, up)))
            mean[key] = d
            if abs(d - up) > 0.7:
                out[key] = d - DRIFT
    return out


def weigh(toxic: Counter, clean: Counter, often: Counter, n1: int, n0: int) -> Model:
    """Token scores and lambda from numbers of texts per token and class, and of occurrences in clean texts."""
    model = Model(log_odds(toxic, clean, n1, n0) if toxic and clean else {}, 1.0, 0.0, -4.0, 0.0)
    mass: Counter = Counter()
    words = list(often)
    for at in range(0, len(words), CACHE):
        part = words[at : at + CACHE]
        for w, s in zip(part, model.scores(part).round(3).tolist()):
            mass[s] += often[w]
    model.seen.clear()
    values, share = np.array(list(mass), float), np.array(list(mass.values()), float)
    share /= max(share.sum(), 1.0)
    if len(values) and values.max() > 0 and values @ share < 0:
        lo, hi = 1e-6, 50.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if share @ np.exp(np.minimum(mid * values, 700)) > 1 else (mid, hi)
        model.lam = lo
    return model


def calm(model: Model, tokens: list[bytes]) -> float:
    """What K would be if a text's best segment were the median: P(best < s) = exp(-K n exp(-lambda s)) = 1/2."""
    best = max((s for *_, s in segments(model.scores(tokens))), default=0.0)
    return model.lam * best - math.log(len(tokens) + 1) + math.log(math.log(2))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> None:
    """Sets the logistic coefficients by Newton steps from evidence ``x`` (its log1p) and labels ``y``."""
    if len(y) and 0 < y.sum() < len(y):
        b = np.array([0.0, 1.0])
        ridge = np.array([1e-3, 1.0])  # keeps the slope finite where classes separate
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(b[0] + b[1] * x, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-4)
            g = np.array([(p - y).sum(), ((p - y) * x).sum()]) + ridge * b
            h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]]) + np.diag(ridge)
            step = np.clip(np.linalg.solve(h, g), -1, 1)
            b = b - step
            if np.abs(step).max() < 1e-8:
                break
        model.bias, model.slope = float(b[0]), max(0.0, float(b[1]))
    elif len(y):
        model.bias = 4.0 if y.all() else -4.0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Up to ``rows`` labelled texts of each class that are not held out, by least hash of the id."""
    known = (
        labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    )
    picked = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)
    ]
    chosen = picked[0].union(picked[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")


COUNTS = fields("token binary, y int, half int, texts long, times long")
FOUND = fields("y int, half int, value double, other double")


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(token, y, half, texts, times) over a slice of texts."""
    n: dict[tuple, list[int]] = {}
    for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half"))):
        for token, times in Counter(tokenize(text)).items():
            held = n.setdefault((token, y, half), [0, 0])
            held[0] += 1
            held[1] += times
    cols = list(zip(*((*k, *v) for k, v in n.items()))) or [()] * 5
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=COUNTS.names)


def _told(texts: DataFrame, models: list[Model], value) -> list:
    """(y, half, value under the whole's model, value under a half's) of each text: ``value(models, half, tokens)``."""
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # scores met are kept for a slice alone, as there are three models
        rows, mine = [], [replace(m, seen={}) for m in shared.value]
        for text, y, half in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "half"))):
            rows.append((y, half, *value(mine, half, tokenize(text))))
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))], names=FOUND.names)

    return map_arrow(texts, run, FOUND).collect()


def fit(texts: DataFrame) -> Model:
    """A model of ``texts(text, y)``, distinct texts: weights from all, the calibration from texts scored by weights of the other half.

    Executors count and score; the driver gets the counts of distinct tokens and two numbers per text.
    """
    texts = cut(texts.select("text", "y", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2)).cast("int").alias("half")))
    n = {(r["y"], r["half"]): r["n"] for r in texts.groupBy("y", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    # toxic, clean, occurrences in clean, by half
    counts = [[Counter(), Counter(), Counter()] for _ in range(2)]
    rows = map_arrow(texts, _counts, COUNTS).groupBy("token", "y", "half").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times"))
    for r in rows.toLocalIterator():
        token, held = bytes(r["token"]), counts[r["half"]]
        held[0 if r["y"] else 1][token] += r["texts"]
        if not r["y"]:
            held[2][token] += r["times"]
    size = lambda y, *halves: sum(n.get((y, h), 0) for h in halves)
    models = [weigh(*counts[h], size(1, h), size(0, h)) for h in (0, 1)]
    for mine, more in zip(*counts):
        mine.update(more)
    models.append(weigh(*counts[0], size(1, 0, 1), size(0, 0, 1)))
    del counts
    found = [r for r in _told(texts.where("y = 0"), models, lambda m, half, t: (calm(m[2], t), calm(m[half], t)))]
    middle = lambda v: float(np.median(v)) if len(v) else 0.0
    models[2].log_k = middle([r["value"] for r in found])
    for h in (0, 1):
        models[h].log_k = middle([r["other"] for r in found if r["half"] == h])
    found = _told(texts, models, lambda m, half, t: (0.0, math.log1p(m[1 - half].evidence(t)[0])))
    calibrate(models[2], np.array([r["other"] for r in found]), np.array([r["y"] for r in found], float))
    return models[2]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """``fit`` on a bounded sample of labelled texts; a text under several ids counts once, as toxic if any of them is."""
    return fit(sample(docs, labels, "toxic", rows).groupBy("text").agg(F.max("y").alias("y")).where("text is not null"))


SCORE = fields("score double, predicted int, evidence double, n_segments int, segments string")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score, predicted, evidence, n_segments, segments (token spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ids = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, rows = shared.value, []
        for text in batch.column("text").to_pylist():
            evidence, strong = m.evidence(tokenize(text))
            p = m.probability(evidence)
            rows.append((p, int(p >= 0.5), evidence, len(strong), ",".join(f"{a}:{b}:{c:.3f}" for a, b, c in strong)))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", *SCORE.names])

    return map_arrow(ids, run, T.StructType([ids.schema["doc_id"], *SCORE.fields]))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those predicted toxic; all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        good = [m.probability(m.evidence(tokenize(t))[0]) < 0.5 for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(good, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
