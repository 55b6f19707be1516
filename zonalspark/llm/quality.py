"""Quality classifier (operator 6): supervised subword embeddings.

Words, pairs of neighbouring words and character n-grams are hashed into rows of a learned table; a document is the
mean of its rows, a softmax layer on it gives the class. Training is stochastic gradient descent in numpy on a bounded
sample of labelled documents. A mean and a linear layer commute, so scoring needs one number a table row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import keyed_text, read, trimmed

#: Labelled documents that training uses at most, those of the least hash of their id, and the characters of one at most.
SAMPLE, LONGEST = 2500, 1_000_000
BUCKETS, DIM, STEPS, RATE, SEED = 1 << 18, 16, 12_500, 0.5, 11
GRAMS = (2, 3, 4)
#: Words, and characters of them, that a task keeps the sums of before it starts anew.
MEMO, HELD = 1_000_000, 32 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Hashed rows of texts."""

    def __init__(self, buckets: int = BUCKETS, grams: tuple[int, ...] = GRAMS):
        self.buckets, self.grams = buckets, grams

    def place(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = hashes * MIX
        return ((mixed >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each word; rows of all words (themselves and the n-grams of their bytes between bounds) and the
        number of the word that each row belongs to."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        marked = [b"<" + w.encode() + b">" for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(words))
        of = np.repeat(np.arange(len(words)), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(of))  # bytes up to the word's end
        letters = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
        rows, owners = [self.place(hashes)], [np.arange(len(words))]
        h = np.zeros(len(letters), np.uint64)
        with np.errstate(over="ignore"):
            for n in range(1, max(self.grams) + 1):
                h = h[: len(letters) - n + 1] * np.uint64(257) + letters[n - 1 :]
                if n in self.grams:
                    inside = left[: len(h)] >= n
                    rows.append(self.place((h[inside] + np.uint64(n)) * MIX))
                    owners.append(of[: len(h)][inside])
        return hashes, np.concatenate(rows), np.concatenate(owners)

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of neighbouring words, from the words' hashes. A word after itself counts as a repetition, whichever
        word it is."""
        with np.errstate(over="ignore"):
            mixed = hashes[:-1] * MIX + hashes[1:]
        return self.place(np.where(hashes[:-1] == hashes[1:], np.uint64(1), mixed))

    def rows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct rows of a text and how often each occurs."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        distinct, at, n = np.unique(np.array(words, dtype=object), return_inverse=True, return_counts=True)
        hashes, rows, owners = self.words(distinct.tolist())
        every, back = np.unique(np.concatenate([rows, self.pairs(hashes[at])]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([n[owners], np.ones(len(words) - 1)]), minlength=len(every))
        return every, counts


def train(texts: list[str], labels: list[int], features: Features, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """The learned score of each table row (logit of class 1 over class 0), and the bias."""
    rng = np.random.default_rng(seed)
    docs = [features.rows(t) for t in texts]
    table = rng.uniform(-1 / dim, 1 / dim, (features.buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    done = 0
    while done < steps and docs:
        for i in rng.permutation(len(docs)):
            rows, n = docs[i]
            lr = rate * max(0.0, 1 - done / steps)
            done += 1
            if not len(rows):
                continue
            share = (n / n.sum()).astype(np.float32)
            mean = share @ table[rows]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1  # gradient of the logits
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            # rows of a document share its gradient; scaled up, as each holds a small share of the mean
            table[rows] -= (lr * np.minimum(1.0, share * 20))[:, None] * back
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts with one number a row of the table."""

    def __init__(self, table: np.ndarray, bias: float, features: Features):
        self.table, self.bias, self.features = table, bias, features
        self.start()

    def start(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.sums, self.counts, self.hashes = (np.zeros(1024, k) for k in (np.float64, np.float64, np.uint64))

    def learn(self, words: set[str]) -> None:
        words = list(words)
        at, need = len(self.at), len(self.at) + len(words)
        self.held += sum(map(len, words))
        if need > len(self.sums):
            self.sums, self.counts, self.hashes = (np.concatenate([x, np.zeros(max(need, len(x)), x.dtype)]) for x in (self.sums, self.counts, self.hashes))
        self.hashes[at:need], rows, owners = self.features.words(words)
        self.sums[at:need] = np.bincount(owners, self.table[rows], len(words))
        self.counts[at:need] = np.bincount(owners, minlength=len(words))
        self.at.update(zip(words, range(at, need), strict=True))

    def score(self, text: str) -> float:
        words = text.split()
        z = self.bias
        if words:
            distinct = set(words)
            if new := distinct.difference(self.at):
                if len(self.at) + len(new) > MEMO or self.held > HELD:
                    self.start()
                    new = distinct
                self.learn(new)
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
            pairs = self.features.pairs(self.hashes[at])
            z += (self.sums[at].sum() + self.table[pairs].sum(dtype=np.float64)) / (self.counts[at].sum() + len(pairs))
        return 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))


def held_out(key: str = "doc_id") -> F.Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % 3) == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scorer:
    """Learn from at most `sample` labelled documents outside the held-out third (crc32 of the id mod 3 is 1).

    The sample is the labelled ids of least hash, found with a top-k, so it depends on nothing else; only these
    documents, of LONGEST characters at most, reach the driver. A label of null is none; a document with several labels has their majority."""
    ids = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias(key)).agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    some = ids.where(~held_out(key)).orderBy(F.xxhash64(key), key).limit(sample)
    taken = keyed_text(docs, key, text).where(F.char_length("text") <= LONGEST).join(F.broadcast(some), key).collect()
    features = Features()
    if not taken:
        return Scorer(np.zeros(features.buckets, np.float32), 0.0, features)
    taken = sorted({r[key]: r for r in taken}.values(), key=lambda r: r[key])
    return Scorer(*train([r.text for r in taken], [r.label for r in taken], features), features)


def score(docs: DataFrame, scorer: Scorer, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """Columns keep and the score (0 to 1) of every row; null and empty texts get the bias alone. One pass, no shuffle;
    the table that is broadcast has a fixed size (1 MB). Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer.table, scorer.bias, scorer.features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(map(own.score, batch.column(0).to_pylist()), pa.float64())], names=[*keep, name])

    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")), *keep)
    return rows.mapInArrow(trimmed(run), docs.select(*keep).schema.add(name, "double"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
