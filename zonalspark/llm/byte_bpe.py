"""Byte-level BPE encoding and decoding (operator 5): two-tier lookup.

A minimal perfect hash, built on the driver and broadcast (bounded by the vocabulary), resolves pre-tokens that are
tokens themselves; misses are merged with a heap over linked bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.bpe import PATTERN, PerfectHash, Pretokens, merge, tiktoken_pairs, tiktoken_ranks
from zonalspark.llm.common import keyed_text, read, trimmed

#: Entries, and bytes of chunks, that a task keeps of what it has encoded before it starts anew; pre-tokens of more characters
#: than LONG aren't kept.
MEMO, HELD, LONG = 600_000, 32 << 20, 64


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.tokens = sorted(ranks, key=ranks.get)
        self.ids = [ranks[t] for t in self.tokens]
        self.pairs = tiktoken_pairs(ranks)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.bytes_of = dict(zip(self.ids, self.tokens, strict=True))
        self.hash = PerfectHash(self.tokens)
        self.pattern = pattern
        self.start()

    def start(self) -> None:
        self.split = Pretokens(self.pattern)
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.held = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "pieces", "known", "held")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.start()

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token as little-endian unsigned 32-bit integers."""
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            raw = piece.encode()
            i = self.hash.index(raw)
            if self.tokens[i] == raw:
                out = struct.pack("<I", self.ids[i])
            else:
                got = merge([self.byte_ids[b] for b in raw], self.pairs)
                out = struct.pack(f"<{len(got)}I", *got)
            if len(piece) <= LONG:
                self.pieces[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        chunks = self.split.chunks(text)
        if chunks is None:
            return b"".join(map(self.piece, self.split.find(text)))
        known, rest = self.known, chunks[1:]
        if len(known) >= MEMO or self.held >= HELD:
            known.clear()
            self.held = 0
        for c in set(rest).difference(known):
            known[c] = b"".join(map(self.piece, self.split.find(" " + c)))
            self.held += len(c)
        return b"".join([*map(self.piece, self.split.find(chunks[0])), *map(known.__getitem__, rest)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit token ids), decoded (binary: the bytes they stand for).

    Every row of docs gives one; a null text is an empty one and gives empty ids. Special strings are ordinary text.
    Other columns are not read. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(tiktoken_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is held of ids and bytes
                part = batch.slice(at, 256)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.binary())], names=[key, "ids", "decoded"])
        codec.start()  # the broadcast outlives the task, what it remembers need not

    return keyed_text(docs, key, text).mapInArrow(trimmed(run), f"{key} long, ids binary, decoded binary")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and digests of encode()'s rows."""
    return encoded.select(key, F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
