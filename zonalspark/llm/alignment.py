"""Cross-tokenizer alignment (operator 13): group dictionary.

A text's tokens by two tokenizers are cut into groups where both end at the same byte. Tasks intern the groups of a chunk
of texts, so each distinct group is a row with its number of occurrences. The dictionary of all distinct groups is expanded
into links once a group, links count as often as their groups occur, and the results go back to the chunks by group.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.bpe import byte_letters
from zonalspark.llm.common import keyed_text, read, stored, trimmed

#: Characters of texts after which a task closes its chunk, and distinct groups after which it also numbers them anew;
#: characters of words, and words, that it remembers before it starts anew; longer words aren't remembered.
CHUNK, GROUPS, HELD, MEMO, LONG = 16 << 20, 400_000, 16 << 20, 500_000, 256
#: A space that both tokenizers begin a token with, if no piece of the second holds a space after something else.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"[^\S \n]| [ \n]|\n |^ | $").search


class Aligner:
    """Groups of words or whole texts by a tokenizers file (a) and a sentencepiece model (b)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: b for b, c in byte_letters().items()}
        self.bytes_a = {i: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode() for s, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.size_b = np.array(list(map(len, self.bytes_b)))
        # a space begins a piece of its own word only, so texts may be cut there; the first tokenizer never crosses one
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)

    def words(self, text: str) -> list[str]:
        """The text cut where both tokenizers start anew: before each single space between two other characters."""
        if not self.cuttable:
            return [text]
        return BETWEEN.split(text) if ODD(text) else text.split(" ")

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a and b of words joined by spaces and led by one; None where the bytes of either aren't the text's."""
        text = " ".join(words)
        a, b, raw = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class Chunks:
    """Interns groups of a task's texts: a group has a number in the task, and a chunk counts how often it occurs there."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.number = aligner, 0
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.known: dict[str, tuple | None] = {}
        self.held = 0
        self.begin()

    def begin(self) -> None:
        self.counts, self.chars = np.zeros(1024, np.int64), 0

    def intern(self, group: str) -> int:
        number = self.ids.setdefault(group, len(self.names))
        if number == len(self.names):
            self.names.append(group)
        return number

    def entries(self, words: list[str]) -> list[tuple | None]:
        """For each word, led by a space, the numbers of its groups (packed), their texts, and how many tokens a and b give;
        None where bytes differ. Words are encoded side by side, which gives the same as one by one."""
        found = self.aligner.encode(words)
        if found is None:
            half = len(words) // 2
            return [*self.entries(words[:half]), *self.entries(words[half:])] if half else [None]
        a, b = found
        ends_a, ends_b = np.cumsum(self.aligner.size_a[a]), np.cumsum(self.aligner.size_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        to_a, to_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
        from_a, from_b = (np.concatenate([[0], x[:-1] + 1]) for x in (to_a, to_b))
        single = (from_a == to_a) & (from_b == to_b)
        numbers = np.empty(len(shared), np.uint32)
        pairs, back = np.unique(a[to_a[single]] << 32 | b[to_b[single]], return_inverse=True)
        numbers[single] = np.array([self.intern(f"{p >> 32}|{p & 0xFFFFFFFF}") for p in pairs.tolist()], np.uint32)[back]
        own_a, own_b = a.tolist(), b.tolist()
        for k in np.flatnonzero(~single).tolist():
            numbers[k] = self.intern(f"{','.join(map(str, own_a[from_a[k] : to_a[k] + 1]))}|{','.join(map(str, own_b[from_b[k] : to_b[k] + 1]))}")
        ends = np.cumsum(np.fromiter((1 + len(w.encode()) for w in words), np.int64, len(words)))
        cuts, n_a, n_b = (np.diff(np.searchsorted(x, ends) + 1, prepend=0).tolist() for x in (shared, ends_a, ends_b))
        names, listed, out, at = self.names, numbers.tolist(), [], 0
        for n, x, y in zip(cuts, n_a, n_b, strict=True):
            out.append((numbers[at : at + n].tobytes(), ";".join([names[g] for g in listed[at : at + n]]), x, y))
            at += n
        return out

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        """Entries of new words; those of over LONG characters aren't remembered, but returned."""
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        odd, fresh = set(words).difference(plain), {}
        parts = [*(plain[i : i + 2048] for i in range(0, len(plain), 2048)), *([w] for w in odd)]
        for part in parts:
            for w, entry in zip(part, self.entries(part), strict=True):
                if len(w) <= LONG:
                    self.known[w] = entry
                    self.held += len(w)
                else:
                    fresh[w] = entry
        return fresh

    def add(self, text: str) -> tuple[int, int, int, str, bytes | None]:
        """n_a, n_b, n_groups, digest, and the numbers and counts of the text's distinct groups."""
        self.chars += len(text)
        if not text:
            return 0, 0, 0, "", None
        words, known = self.aligner.words(text), self.known
        if len(known) >= MEMO or self.held >= HELD:
            known.clear()
            self.held = 0
        new = list(set(words).difference(known))
        fresh = self.learn(new) if new else None
        get = known.__getitem__ if not fresh else lambda w: known[w] if w in known else fresh[w]
        entries = list(map(get, words))
        if None in entries:  # the words' bytes differ, the whole text's may still not
            entries = self.entries([text]) if len(words) > 1 else [None]
            if entries[0] is None:
                return 0, 0, 0, "", None
        numbers, texts, n_a, n_b = zip(*entries, strict=True)
        numbers = np.frombuffer(b"".join(numbers), np.uint32)
        distinct, n = np.unique(numbers, return_counts=True)
        if len(self.counts) < len(self.names):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.names), np.int64)])
        self.counts[distinct] += n
        return sum(n_a), sum(n_b), len(numbers), hashlib.sha256(";".join(texts).encode()).hexdigest(), np.stack([distinct, n.astype(np.uint32)]).tobytes()

    def full(self) -> bool:
        return self.chars >= CHUNK or len(self.names) >= GROUPS


DOC = "n_a long, n_b long, n_groups long, groups_sha256 string, held binary"
GROUP = "grp string, at int, n long"


def interned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass: chunk, and either a document (key, n_a, n_b, n_groups, groups_sha256, held: numbers and counts of its
    distinct groups) or a distinct group of the chunk (grp, its number at, its occurrences n)."""
    names = ["chunk", "row_key", "n_a", "n_b", "n_groups", "groups_sha256", "held", "grp", "at", "n"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, part, tasks = Chunks(Aligner(path_a, path_b)), TaskContext.get().partitionId(), 1 << 20

        def closed() -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(chunks.counts)
            for i in range(0, len(used), 50_000):
                own = used[i : i + 50_000]
                columns = [pa.array(np.full(len(own), chunks.number * tasks + part)), *(pa.nulls(len(own), t) for t in types[1:7]), pa.array([chunks.names[g] for g in own.tolist()]), pa.array(own.astype(np.int32)), pa.array(chunks.counts[own])]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            chunks.number += 1
            if len(chunks.names) >= GROUPS:
                chunks.forget()
            else:
                chunks.begin()

        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for k, t in zip(keys, batch.column(1).to_pylist(), strict=True):
                rows.append((chunks.number * tasks + part, k, *chunks.add(t)))
                if chunks.full() or len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=False)), *(pa.nulls(len(rows), x) for x in types[7:])], names=names)
                    rows = []
                    if chunks.full():
                        yield from closed()
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, x) for c, x in zip(zip(*rows, strict=True), types, strict=False)), *(pa.nulls(len(rows), x) for x in types[7:])], names=names)
        yield from closed()

    return keyed_text(docs, key, text).mapInArrow(trimmed(run), f"chunk long, row_key long, {DOC}, {GROUP}")


def links(groups: DataFrame) -> DataFrame:
    """groups with a and b: ids of the tokens that are linked in it. Groups end at every byte where tokens of both end, so
    in each only its last two tokens end together."""
    last = lambda side: F.substring_index(F.substring_index("grp", "|", side), ",", -1).cast("int")
    return groups.withColumns({"a": last(1), "b": last(-1)})


def dictionary(interns: DataFrame) -> DataFrame:
    """grp, freq: all distinct groups and how often they occur."""
    return interns.where("grp is not null").groupBy("grp").agg(F.sum("n").alias("freq"))


def pair_counts(expanded: DataFrame) -> DataFrame:
    """a, b, links (how many links of all texts hold the pair), best (whether no pair of b has more)."""
    counted = stored(expanded.groupBy("a", "b").agg(F.sum("freq").alias("links")), "align-pairs")
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best (links whose pair is their b's most frequent one, ties included), count_sum
    (frequencies of the pairs of all links) and groups_sha256 of every row.

    A null, empty, or not exactly reproduced text has no tokens: zeros and an empty digest. Rows with a null or repeated key
    stay; an empty table gives no rows; other columns are not read; key is cast to long. Memory of a task is bounded by CHUNK,
    but one text is encoded at once where it has no single spaces to cut it at."""
    interns = stored(interned(docs, path_a, path_b, key, text), "align-interned")
    expanded = stored(links(dictionary(interns)), "align-dictionary")
    found = expanded.select("grp", "a", "b").join(pair_counts(expanded), ["a", "b"]).select("grp", "links", "best")
    back = interns.where("grp is not null").select("chunk", "grp", "at").join(found, "grp").select("chunk", "at", "links", "best")
    own = interns.where("grp is null").select("chunk", "row_key", "n_a", "n_b", "n_groups", "groups_sha256", "held")
    both = back.unionByName(own, allowMissingColumns=True).select("chunk", "at", "links", "best", "row_key", "n_a", "n_b", "n_groups", "groups_sha256", "held", F.col("at").isNull().alias("is_doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, at, count, best, table = None, [], [], [], None
        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1
            for i, j in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(i, j - i)
                if part.num_rows and part.column(0)[0].as_py() != chunk:
                    chunk, at, count, best, table = part.column(0)[0].as_py(), [], [], [], None
                doc = part.column(10).to_numpy(zero_copy_only=False).astype(bool)
                groups = part.filter(pa.array(~doc))
                if groups.num_rows:  # they come before the documents
                    at.append(groups.column(1).to_numpy())
                    count.append(groups.column(2).to_numpy())
                    best.append(groups.column(3).to_numpy(zero_copy_only=False).astype(np.int64))
                rows = part.filter(pa.array(doc))
                if not rows.num_rows:
                    continue
                if table is None and at:
                    order = np.concatenate(at)
                    table = np.zeros((2, int(order.max()) + 1), np.int64)
                    table[0, order], table[1, order] = np.concatenate(count), np.concatenate(best)
                n_best, sums = [], []
                for held in rows.column(9).to_pylist():
                    ids, n = np.frombuffer(held or b"", np.uint32).reshape(2, -1).astype(np.int64)
                    n_best.append(int(table[1, ids] @ n) if len(ids) else 0)
                    sums.append(int(table[0, ids] @ n) if len(ids) else 0)
                n_groups = rows.column(7)
                yield pa.RecordBatch.from_arrays([rows.column(4), rows.column(5), rows.column(6), n_groups, n_groups, pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), rows.column(8)], names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = both.repartitionById(n, F.pmod(F.col("chunk"), F.lit(n)).cast("int")).sortWithinPartitions("chunk", "is_doc")
    return spread.mapInArrow(trimmed(run), f"{key} long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
