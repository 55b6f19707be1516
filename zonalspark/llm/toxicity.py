"""Toxicity (operator 4): cumulative-link ordinal regression.

Grades 0 < 1 < ... < GRADES - 1 share one weight a word; ordered thresholds cut the common score, so
P(grade > k) = sigmoid(w . x - t_k). A document's severity is its expected grade.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import keyed_text, read, trimmed

#: Labelled documents that training uses at most, those of the least hash of their id.
SAMPLE = 4000
GRADES, STEPS, RATE, DECAY = 4, 400, 0.05, 0.1
#: A word or beginning of a word is a feature if at least so many documents of the sample hold it (and as many as a
#: fiftieth of the toxic ones), and the shares of
#: toxic and of clean documents with it differ by so many standard errors.
MIN_DOCS, ERRORS = 3, 5.0
BEGINNINGS = (3, 4, 5)
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """Words, and the beginnings of longer ones marked ^, with their counts."""
    found = Counter(WORD.findall(text.lower()))
    for w, n in list(found.items()):
        for k in BEGINNINGS:
            if len(w) > k:
                found["^" + w[:k]] += n
    return found


def value(n: int) -> float:
    return 1 + math.log(n)


#: Pieces of text between white space, and their characters, that a task keeps the features of before it starts anew; longer
#: pieces than LONG aren't kept. Labelled documents of more than LONGEST characters are not learned from.
MEMO, HELD, LONG, LONGEST = 1_000_000, 16 << 20, 256, 1_000_000


class Model:
    """Weights by feature, and the ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]):
        self.weights, self.thresholds, self.known, self.held = weights, thresholds, {}, 0

    def features(self, piece: str) -> tuple[str, ...]:
        """The features with a weight that a piece between white space holds, with repetitions."""
        out = tuple(f for f, n in words(piece).items() if f in self.weights for _ in range(n))
        if len(self.known) >= MEMO or self.held >= HELD:
            self.forget()
        if len(piece) <= LONG:
            self.known[piece] = out
            self.held += len(piece)
        return out

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def above(self, text: str) -> list[float]:
        """P(grade > k) for each threshold k; they fall as k grows."""
        known, found = self.known, Counter()
        for piece, n in Counter(text.lower().split()).items():
            if features := known[piece] if piece in known else self.features(piece):
                for f in features:
                    found[f] += n
        z = sum(self.weights[f] * value(n) for f, n in found.items())
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - z)))) for t in self.thresholds]


def chosen(found: list[Counter], toxic: list[int]) -> list[str]:
    """Features whose share differs between toxic and clean documents, by the two-proportion test."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for words_, y in zip(found, toxic, strict=True):
        seen[y].update(words_.keys())
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    out = []
    for f in sorted(seen[0].keys() | seen[1].keys()):
        a, b = seen[1][f], seen[0][f]
        p = (a + b) / (n1 + n0)
        if a + b >= max(MIN_DOCS, n1 // 50) and p < 1 and abs(a / n1 - b / n0) >= ERRORS * math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)):
            out.append(f)
    return out


def grades(found: list[Counter], toxic: list[int], features: list[str]) -> list[int]:
    """Grades of the sample: 0 for clean documents; toxic ones by how many features they hold that mark toxic
    documents, in thirds. The labels are 0 or 1 only, so the order among toxic documents comes from the texts."""
    seen = {y: Counter(f for x, z in zip(found, toxic, strict=True) if z == y for f in x) for y in (0, 1)}
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    marks = {f for f in features if seen[1][f] / n1 > seen[0][f] / n0}
    amount = [sum(value(n) for w, n in x.items() if w in marks) for x in found]
    own = [s for s, y in zip(amount, toxic, strict=True) if y]
    cuts = np.quantile(own, [k / (GRADES - 1) for k in range(1, GRADES - 1)]) if own else []
    return [1 + int(np.searchsorted(cuts, s, "left")) if y else 0 for s, y in zip(amount, toxic, strict=True)]


def gradient(at: np.ndarray, doc: np.ndarray, col: np.ndarray, x: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Slope of the thresholds' log losses and the penalty at the unknowns: weights, the first threshold, logarithms of the
    gaps to the next. doc, col, x: document, feature and value of each entry; above: whether a document is above each
    threshold."""
    n = len(at) - above.shape[1]
    w, gaps = at[:n], np.exp(at[n + 1 :])
    cuts = at[n] + np.concatenate([[0.0], np.cumsum(gaps)])
    z = np.bincount(doc, w[col] * x, len(above))
    wrong = 1 / (1 + np.exp(np.clip(cuts - z[:, None], -50, 50))) - above
    down = -wrong.sum(0)
    later = np.cumsum(down[::-1])[::-1]
    return np.concatenate([np.bincount(col, wrong.sum(1)[doc] * x, n) + DECAY * w, [later[0]], later[1:] * gaps])


def train(texts: list[str], toxic: list[int]) -> Model:
    """Gradient steps over the whole sample on the sum of the thresholds' log losses, with a small penalty on weights."""
    found = [words(t) for t in texts]
    if not any(toxic) or all(toxic):
        return Model({}, [(-4.0 if toxic and all(toxic) else 4.0) + k for k in range(GRADES - 1)])
    features = chosen(found, toxic)
    y = grades(found, toxic, features)
    number = {f: i for i, f in enumerate(features)}
    doc = np.array([i for i, x in enumerate(found) for f in x if f in number], np.int64)
    col = np.array([number[f] for x in found for f in x if f in number], np.int64)
    x = np.array([value(n) for w in found for f, n in w.items() if f in number], np.float64)
    # unknowns: weights, the first threshold, logarithms of the gaps to the next ones, so thresholds stay ordered
    at = np.concatenate([np.zeros(len(number)), [2.0], np.zeros(GRADES - 2)])
    mean, square = np.zeros_like(at), np.zeros_like(at)
    above = np.array(y)[:, None] > np.arange(GRADES - 1)
    for step in range(1, STEPS + 1):
        g = gradient(at, doc, col, x, above)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        at = at - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    cuts = at[len(number)] + np.concatenate([[0.0], np.cumsum(np.exp(at[len(number) + 1 :]))])
    weights = at[: len(number)]
    return Model({w: float(weights[i]) for w, i in number.items()}, cuts.tolist())


def held_out(key: str = "doc_id") -> F.Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 3) == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from at most `sample` labelled documents outside the held-out third, each of LONGEST characters at most; only
    these reach the driver.

    A label of null is none; several labels of one document count as their majority; without labels every weight is 0."""
    ids = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    some = ids.where(~held_out(key)).orderBy(F.xxhash64(key), key).limit(sample)
    taken = sorted({r[key]: r for r in keyed_text(docs, key, text).where(F.char_length("text") <= LONGEST).join(F.broadcast(some), key).collect()}.values(), key=lambda r: r[key])
    return train([r.text for r in taken], [r.label for r in taken])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity (expected grade), p_toxic, grade (the likeliest), toxic (p_toxic >= 0.5) of every row.

    Null and empty texts get the thresholds alone. One pass, no shuffle; the weights that are broadcast are bounded by
    the words of the sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [shared.value.above(t) for t in batch.column(1).to_pylist()]
            grade = [int(np.argmax(-np.diff([1.0, *p, 0.0]))) for p in above]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(sum, above), pa.float64()), pa.array([p[0] for p in above], pa.float64()), pa.array(grade, pa.int32()), pa.array([p[0] >= 0.5 for p in above], pa.bool_())], names=[key, "severity", "p_toxic", "grade", "toxic"])
        shared.value.forget()  # the broadcast outlives the task, what it remembers need not

    return keyed_text(docs, key, text).mapInArrow(trimmed(run), f"{key} long, severity double, p_toxic double, grade int, toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, fit(docs, read(spark, sf_dir, "labels")))
