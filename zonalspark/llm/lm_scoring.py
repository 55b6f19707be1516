"""LM scoring (operator 10): cross-entropy difference.

A target and a background model, both word bigrams interpolated with unigrams, count the same vocabulary over the target
documents and over all documents; the background's counts are scaled to the target's size, so the two are matched. A
document's score is the mean over its tokens of background loss less target loss: above 0 it is more like the target. A
document's own counts are taken out of both models before it is scored.

Words and bigrams are counted by 64-bit keys, so the models grow with the corpus. Tasks cut their documents into chunks
and send each part of the keys the chunk's distinct keys with their counts; a range of keys adds them up and answers each
chunk with the sums of its keys. The answers meet the chunk's documents, which take the same way. A chunk sends PARTS rows at
most, however large the corpus is: where there are more ranges than that, relays between chunks and ranges add up what a
group of chunks sends to a part, ask the part's ranges for it and answer the chunks, so rows grow with the corpus and not
with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import keyed_text, pack, read, stored, unpack

#: Bytes of text of a chunk, and of the corpus for each range of keys; fewest ranges; most rows of keys that a chunk sends.
CHUNK, RANGES, PARTS = 16 << 20, 16, 256
#: Weight of the unigrams.
KAPPA = 4.0
#: Target ids up to this number are broadcast (8 MB), beyond it they are joined by a shuffle.
BROADCAST = 1_000_000
#: Words, and their bytes, that a task keeps the hashes of before it starts anew.
MEMO, HELD = 1_000_000, 32 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0x5851F42D4C957F2D)
ONE = np.uint64(1)
SENT = "chunk long, part int, docs boolean, data binary"


class Keys:
    """Keys of the words of texts and of their bigrams: words are even, bigrams odd."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.held = 0

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.lower().split()
        known = self.known
        if len(known) > MEMO or self.held > HELD:
            known.clear()
            self.held = 0
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
            self.held += len(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            before = np.concatenate([[START], h[:-1]]) if len(h) else h
            return h & ~ONE, ((before * MIX + h) * MIX) | ONE

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the place among them of each word, then of each bigram, and words of each text."""
        both = [self.of(t) for t in texts]
        sizes = np.array([len(one) for one, _ in both], np.int64)
        keys, at = np.unique(np.concatenate([x[k] for k in (0, 1) for x in both]), return_inverse=True)
        return keys, at, sizes


def rows_of(chunks: list, parts: list, docs: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(parts, pa.int32()), pa.array(docs, pa.bool_()), pa.array(data, pa.binary())], names=["chunk", "part", "docs", "data"])


def dealt(docs: DataFrame, ranges: int, size: int) -> DataFrame:
    """One row for each chunk with its documents, and one for each chunk and range of keys with the chunk's distinct keys
    in it (none too) and their counts among targets and all."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = Keys(), TaskContext.get().partitionId() << 32

        def sent(held: pa.Table) -> pa.RecordBatch:
            target = np.array(held.column(2).to_pylist(), bool)
            keys, at, sizes = own.chunk(held.column(1).to_pylist())
            marks = np.tile(np.repeat(target, sizes), 2)
            among, every = np.bincount(at[marks], minlength=len(keys)).astype(np.uint32), np.bincount(at, minlength=len(keys)).astype(np.uint32)
            part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            ends = np.searchsorted(part, np.arange(ranges + 1).astype(np.uint64))
            data = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                data.append(pack(np.diff(keys[a:b], prepend=np.uint64(0)), among[a:b], every[a:b]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held.schema) as out:
                out.write_table(held)
            data.append(zstandard.compress(sink.getvalue(), 1))
            return rows_of([number] * (ranges + 1), [*range(ranges), ((number >> 32) + (number & 0xFFFFFFFF)) % ranges], [False] * ranges + [True], data)

        held, weight = [], 0
        for batch in batches:
            ends = np.cumsum([len(t) for t in batch.column(1).to_pylist()])
            begin = 0
            while begin < batch.num_rows:
                done = int(ends[begin - 1]) if begin else 0
                stop = min(batch.num_rows, int(np.searchsorted(ends, done + size - weight)) + 1)
                held.append(batch.slice(begin, stop - begin))
                weight += int(ends[stop - 1]) - done
                begin = stop
                if weight >= size:
                    yield sent(pa.Table.from_batches(held))
                    held, weight, number = [], 0, number + 1
        if held:
            yield sent(pa.Table.from_batches(held))

    return docs.mapInArrow(cut, SENT)


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents as they are; for each chunk's keys of a range, the range's sums of them, after the range's number of
    distinct words and its sums of words."""
    chunks, parts, keys, counts = [], [], [], []
    for batch in batches:
        for chunk, part, docs, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if docs:
                yield rows_of([chunk], [part], [True], [data])
                continue
            step, among, every = unpack(data, np.uint64, np.uint32, np.uint32)
            chunks.append(chunk)
            parts.append(part)
            keys.append(np.cumsum(step, dtype=np.uint64))
            counts.append((among, every))
    if not chunks:
        return
    ends = np.cumsum([0, *map(len, keys)])
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    # float sums of whole numbers are exact to 2^53
    sums = [np.bincount(at, np.concatenate([c[k] for c in counts]), len(found)).astype(np.int64) for k in (0, 1)]
    word = found & ONE == 0
    head = np.array([word.sum(), sums[0][word].sum(), sums[1][word].sum()], np.int64).tobytes()
    for a in range(0, len(chunks), 500):
        some = range(a, min(a + 500, len(chunks)))
        data = [head + pack(*(s[at[ends[i] : ends[i + 1]]] for s in sums)) for i in some]
        yield rows_of([chunks[i] for i in some], [parts[i] for i in some], [False] * len(some), data)


def summed(pieces: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys of several chunks' pieces in order, the sums of their counts, and the place of each piece's keys."""
    own = [unpack(data, np.uint64, np.uint32, np.uint32) for data in pieces]
    keys = [np.cumsum(x[0], dtype=np.uint64) for x in own]
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([x[k] for x in own]), len(found)).astype(np.int64) for k in (1, 2)]
    return found, sums, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def by_node(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each node, the first column, which come side by side."""
    node, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:width]), strict=True):
            if row[0] != node:
                if held:
                    yield node, held
                node, held = row[0], []
            held.append(row)
    if held:
        yield node, held


def at_relays(sent: DataFrame, parts: int) -> DataFrame:
    """Rows of keys with the relay (node) that each goes to: one for each part and group of chunks, of which there are as many
    as parts."""
    node = (F.col("part") * F.lit(parts) + F.pmod(F.xxhash64("chunk"), F.lit(parts))).cast("long").alias("node")
    return sent.where("not docs").select(node, "chunk", "part", "data")


def asked(pieces: DataFrame, parts: int, fan: int, tasks: int) -> DataFrame:
    """One row for each relay and range of its part: the keys of all its chunks with the sums of their counts."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pack(np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))
        for number, rows in by_node(batches, 4):
            found, sums, _ = summed([r[3] for r in rows])
            at = (found >> np.uint64(32)) * np.uint64(parts * fan) >> np.uint64(32)
            used, first = np.unique(at, return_index=True)
            cuts = [*first.tolist(), len(found)]
            of = {r: pack(np.diff(found[a:b], prepend=np.uint64(0)), *(x[a:b].astype(np.uint32) for x in sums)) for r, a, b in zip(used.tolist(), cuts[:-1], cuts[1:], strict=True)}
            every = range(rows[0][2] * fan, (rows[0][2] + 1) * fan)  # ranges without a key of the relay still say what they hold
            yield rows_of([number] * fan, [*every], [False] * fan, [of.get(r, empty) for r in every])

    return pieces.repartition(tasks, "node").sortWithinPartitions("node").mapInArrow(up, SENT)


def relayed(sent: DataFrame, parts: int, fan: int) -> DataFrame:
    """What answered() gives for rows of keys in parts, by way of relays: each adds up what a group of chunks sends to a part
    and asks the `fan` ranges of the part."""
    pieces, tasks = at_relays(sent, parts), max(32, parts * parts // 64)
    told = asked(pieces, parts, fan, tasks).repartitionById(parts * fan, F.col("part")).mapInArrow(answered, SENT)
    both = pieces.select("node", "chunk", "part", "data", F.lit(True).alias("piece")).unionByName(told.select(F.col("chunk").alias("node"), F.lit(0).cast("long").alias("chunk"), "part", "data", F.lit(False).alias("piece")))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_node(batches, 5):
            answers = [r[3] for r in sorted((r for r in rows if not r[4]), key=lambda r: r[2])]
            own = [r for r in rows if r[4]]
            head = np.sum([np.frombuffer(a, np.int64, 3) for a in answers], 0).astype(np.int64).tobytes()
            sums = [np.concatenate(x) for x in zip(*(unpack(a[24:], np.int64, np.int64) for a in answers), strict=True)]
            _, _, places = summed([r[3] for r in own])
            yield rows_of([r[1] for r in own], [r[2] for r in own], [False] * len(own), [head + pack(*(x[at] for x in sums)) for at in places])

    return both.repartition(tasks, "node").sortWithinPartitions("node").mapInArrow(down, SENT)


def marked(docs: DataFrame, target_ids: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, target: whether the key is among target_ids (distinct)."""
    ids = target_ids.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key)).distinct().withColumn("target", F.lit(True))
    few = ids.count() <= BROADCAST
    rows = keyed_text(docs, key, text).join(F.broadcast(ids) if few else ids, key, "left").withColumn("target", F.coalesce("target", F.lit(False)))
    # chunks must be the same when a lost task runs again, so the order of a shuffle is fixed
    return rows if few else stored(rows, "lm-marked")


def score(docs: DataFrame, target_ids: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, most_parts: int = PARTS) -> DataFrame:
    """key, n_tokens, target_loss, background_loss (nats a token), score (their difference) of every row.

    Null, empty and blank texts have no tokens, losses and a score of 0; without target documents all scores are those
    of even unigrams against the background; repeated rows stay and count as often as they are there. Other columns are not
    read, so they may have any names; key is cast to long, and one that is no whole number is an error or null as the
    session's casts are."""
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    ranges = max(RANGES, -(-size // chunk))
    fan = -(-ranges // most_parts)  # ranges that a relay asks; 1: chunks ask them themselves
    ranges = min(ranges, most_parts)

    def scored(data: bytes, answers: dict[int, bytes], own: Keys) -> pa.RecordBatch:
        held = pa.ipc.open_stream(zstandard.decompress(data)).read_all()
        in_target = held.column(2).to_pylist()
        keys, at, sizes = own.chunk(held.column(1).to_pylist())
        heads = np.array([np.frombuffer(answers[r], np.int64, 3) for r in range(ranges)])
        v, *totals = (int(x) for x in heads.sum(0))
        packed = [unpack(answers[r][24:], np.int64, np.int64) for r in range(ranges)]
        counts = [np.concatenate([p[k] for p in packed]).astype(np.float64) for k in (0, 1)]
        if len(counts[0]) != len(keys):
            raise RuntimeError("the keys of a chunk have changed between two reads of its documents")
        scale = totals[0] / totals[1] if totals[1] else 1.0

        def loss(k: int, mine: bool, one, two, ones, pres, twos) -> float:
            c2 = np.maximum(0.0, counts[k][two] - mine * twos)
            c1 = np.maximum(0.0, counts[k][one] - mine * ones)
            # the context's count; a document's start counts as often as documents do, and its share is left to unigrams
            c0 = np.concatenate([c2[:1], np.maximum(0.0, counts[k][one[:-1]] - mine * pres[1:])])
            n = max(0.0, totals[k] - mine * len(one))
            if k:
                c2, c1, c0, n = c2 * scale, c1 * scale, c0 * scale, n * scale
            p1 = (c1 + 1) / (n + v)
            return float(-np.log((c2 + KAPPA * p1) / (np.maximum(c0, c2) + KAPPA)).mean())

        ends, losses = np.concatenate([[0], np.cumsum(sizes)]), []
        for i, n in enumerate(sizes.tolist()):
            if not n:
                losses.append((0.0, 0.0))
                continue
            one, two = at[ends[i] : ends[i + 1]], at[ends[-1] + ends[i] : ends[-1] + ends[i + 1]]
            _, at1, k1 = np.unique(one, return_inverse=True, return_counts=True)
            _, at2, k2 = np.unique(two, return_inverse=True, return_counts=True)
            ones = k1[at1]
            pres = np.concatenate([[0], ones[:-1]])
            losses.append(tuple(loss(k, bool(k) or in_target[i], one, two, ones, pres, k2[at2]) for k in (0, 1)))
        ids = held.column(0).combine_chunks()
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *(pa.array([x[k] for x in losses], pa.float64()) for k in (0, 1)), pa.array([b - a for a, b in losses], pa.float64())], names=[key, "n_tokens", "target_loss", "background_loss", "score"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, texts, answers = Keys(), {}, {}
        for batch in batches:
            for number, part, is_docs, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if is_docs:
                    texts[number] = data
                else:
                    answers.setdefault(number, {})[part] = data
                if number in texts and len(answers.get(number, ())) == ranges:
                    yield scored(texts.pop(number), answers.pop(number), own)
        if texts or answers:
            raise RuntimeError("a chunk lacks its documents or an answer")

    sent = dealt(marked(docs, target_ids, key, text).select(key, "text", "target"), ranges, chunk)
    if fan > 1:
        sent = stored(sent, "lm-sent")
        sums = sent.where("docs").unionByName(relayed(sent, ranges, fan))
    else:
        sums = sent.repartitionById(ranges, F.col("part")).mapInArrow(answered, SENT)
    return sums.repartition(ranges, "chunk").mapInArrow(met, f"{key} long, n_tokens long, target_loss double, background_loss double, score double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that labels mark as good and clean."""
    labels = read(spark, sf_dir, "labels")
    return score(read(spark, sf_dir, "documents"), labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)))
