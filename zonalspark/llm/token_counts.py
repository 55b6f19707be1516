"""Token counts (operator 1): whole-token shortcut.

Offline, on the driver, every string of the vocabulary is merged from its bytes; those that end as the one token
they are may be counted without merging. In the tasks, a pre-token among them counts as one; only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from zonalspark.llm.bpe import JsonVocabulary, Pretokens
from zonalspark.llm.common import keyed_text, read

#: Entries, and characters of chunks, that a task keeps of what it has counted before it starts anew; pre-tokens of more
#: characters than LONG aren't kept.
MEMO, HELD, LONG = 800_000, 32 << 20, 64


class Counter:
    """Counts tokens of texts exactly as the tokenizers library, added tokens matched in the text first."""

    def __init__(self, vocabulary: JsonVocabulary, whole: set[str]):
        self.v, self.whole, self.split = vocabulary, whole, Pretokens()
        self.pieces: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.held = 0

    def piece(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            n = len(self.v.encode(piece.encode()))
            if len(piece) <= LONG:
                self.pieces[piece] = n
        return n

    def plain(self, text: str) -> int:
        chunks = self.split.chunks(text)
        if chunks is None:
            return sum(map(self.piece, self.split.find(text)))
        known = self.known
        if len(known) >= MEMO or self.held >= HELD:
            known.clear()
            self.held = 0
        first = sum(map(self.piece, self.split.find(chunks[0])))
        rest = chunks[1:]
        for c in set(rest).difference(known):
            known[c] = sum(map(self.piece, self.split.find(" " + c)))
            self.held += len(c)
        return first + sum(map(known.__getitem__, rest))

    def count(self, text: str) -> int:
        parts, n = [text], 0
        for token in self.v.added:
            cut = [p.split(token) for p in parts]
            n += sum(len(c) - 1 for c in cut)
            parts = [p for c in cut for p in c]
        return n + sum(map(self.plain, parts))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; a null text counts as empty (0 tokens).

    Repeated rows stay repeated. Other columns are not read. One pass, no shuffle; the proven strings are broadcast,
    bounded by the vocabulary (about 1 MB)."""
    spark = docs.sparkSession
    vocabulary = JsonVocabulary(path)
    shared = spark.sparkContext.broadcast((vocabulary, vocabulary.whole()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return keyed_text(docs, key, text).mapInArrow(run, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
