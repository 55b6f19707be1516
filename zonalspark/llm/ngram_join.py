"""N-gram Jaccard join (operator 2): T-occurrence search by DivideSkip.

Texts are sets of hashed word n-grams; two link when they share at least SIMILARITY of their union. Documents are
brought together by exact prefix filtering (the rarest grams first), then in each group an inverted index is searched:
of a document's lists the long ones are set aside, the short ones merged with a heap, and what occurs often enough is
probed in the long lists by binary search until the required overlap is reached or out of reach.

Equal sets are one class from the start and pairs of them are never made. Grams are compared as 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm.common import keyed_text, pack, read, stored, trimmed, unpack
from zonalspark.llm.components import connected_components

WORDS, SIMILARITY = 5, 80  # words a gram, per cent
#: Cells of the sketch that tells common grams from others (8 MB), and how many times the mean of a cell a gram must
#: reach, and how often it must be there at least, to count as common.
CELLS, TIMES, COMMON = 1 << 20, 20, 200
#: Grams of a bucket, which a task counts at once; grams that a task holds before it packs them; documents that are searched in one task; documents of a large group that go to each
#: of its parts first; ids up to which a side is broadcast.
TOKENS, FLUSH, PART, LEADERS, BROADCAST = 2_500_000, 2_000_000, 100, 3, 1_000_000
#: Parts of a gram's list, and guests that a task holds beside a part of a large group.
SALTS, GUESTS = 16, 2000
DROPPED = 24  # bits of a gram's hash that only choose its bucket
#: What merging an entry costs against probing for one, from which DivideSkip takes how many long lists to set aside;
#: and the bands of partners' sizes, as shares of a set's own, that are searched one by one, each with its own overlap.
MERGE_COST, BANDS = 0.0005, (0.8, 0.85, 0.9, 0.95, 1.0)
#: Bytes of text that are hashed at once, and what white space is.
PIECE, SPACE = 1 << 20, re.compile(rb"[\x09-\x0D\x20]")
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
#: Of each byte: 0 for white space, else the lower-cased byte and 1.
CODES = np.array([0 if b == 32 or 9 <= b <= 13 else 1 + (b + 32 if 65 <= b <= 90 else b) for b in range(256)], np.uint64)


class Grams:
    """Sorted distinct gram hashes of texts. A word's hash is the sum of its lower-cased bytes times powers of BASE, from the
    start of the word on; sums over all bytes of a piece of text give those of its words at once."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of BASE and of its inverse; more than PIECE are not kept."""
        up, down = self.up, self.down
        if len(up) < n:
            with np.errstate(over="ignore"):
                both = []
                for base in (BASE, pow(BASE, -1, 1 << 64)):
                    steps = np.full(max(n, 1 << 16), base, np.uint64)
                    steps[0] = 1
                    both.append(np.multiply.accumulate(steps))
            up, down = both
            if n <= PIECE:
                self.up, self.down = up, down
        return up[:n], down[:n]

    def hashes(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of a piece that no word crosses the ends of."""
        codes = CODES[np.frombuffer(raw, np.uint8)]
        inside = np.zeros(len(codes) + 2, np.int8)
        inside[1:-1] = codes > 0
        step = np.diff(inside)
        first, last = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
        if not len(first):
            return np.zeros(0, np.uint64)
        up, down = self.powers(len(codes))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(codes * up, out=sums[1:])
            h = (sums[last] - sums[first]) * down[first]
            h = (h ^ (h >> np.uint64(31))) * MIX
        return h ^ (h >> np.uint64(29))

    def words(self, text: str) -> np.ndarray:
        raw = text.encode()
        if len(raw) <= PIECE:
            return self.hashes(raw)
        out, at = [], 0
        while at < len(raw):  # pieces end before the first white space after PIECE bytes
            cut = SPACE.search(raw, at + PIECE)
            end = cut.start() if cut else len(raw)
            out.append(self.hashes(raw[at:end]))
            at = end
        return np.concatenate(out)

    def of(self, text: str) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = min(self.n, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                out = (out ^ (out >> np.uint64(29))) * MIX + h[i : len(h) - n + 1 + i]
            out = (out ^ (out >> np.uint64(32))) * MIX
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def node_of(mark: bytes) -> int:
    """Number of a class in the candidate graph; classes that share one are only compared once more."""
    return int.from_bytes(mark[:8], "little", signed=True)


def required(a: int, b: int) -> int:
    """Least overlap of sets of a and b grams that link."""
    return -(-SIMILARITY * (a + b) // (100 + SIMILARITY))


def scan(docs: DataFrame, key: str) -> DataFrame:
    """One pass: for each document key, n, mark (digest of its set) and node; for each task a row of counts of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, cells, seen = Grams(), np.zeros(CELLS, np.int64), set()
        names = ["part", "counts", key, "n", "mark", "node"]
        for batch in batches:
            n, marks = [], []
            for text in batch.column(1).to_pylist():
                g = grams.of(text)
                n.append(len(g))
                marks.append(mark := digest(g))
                if mark not in seen:  # equal sets count once a task
                    seen.add(mark)
                    np.add.at(cells, (g % np.uint64(CELLS)).astype(np.int64), 1)
            size = len(n)
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary()), batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(map(node_of, marks), pa.int64())], names=names)
        if seen:
            for part, own in enumerate(np.split(cells, 64)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.compress(own.astype(np.uint32).tobytes(), 1)], pa.binary()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=names)

    return docs.mapInArrow(trimmed(run), f"part int, counts binary, {key} long, n long, mark binary, node long")


def sketch(scanned: DataFrame) -> tuple[np.ndarray, int]:
    """Which cells of the sketch are common, and how many grams there are."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zstandard.decompress(counts), np.uint32)
                sums[part] = sums[part] + own if part in sums else own.astype(np.int64)
        for part, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "counts"])

    cells = np.zeros(CELLS, np.int64)
    width = CELLS // 64
    for r in scanned.where("part is not null").select("part", "counts").repartition(64, "part").mapInArrow(trimmed(add), "part int, counts binary").toLocalIterator():
        cells[r.part * width : (r.part + 1) * width] = np.frombuffer(r.counts, np.int64)
    return cells > max(COMMON, TIMES * cells.mean()), int(cells.sum())


def dealt_grams(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """bucket, kind, data: packed rows of a task. Kind 0: grams that aren't common, by gram (40 bits of its hash and its
    bucket: what collides is only compared once more) and its class. Kind 1: for each class its n,
    and kind 2 its common grams."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(), set()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            nodes = np.array([x[0] for x in held], np.int64)
            sizes = np.array([len(x[1]) for x in held], np.int64)
            tokens = np.concatenate([x[1] for x in held])
            at = np.repeat(np.arange(len(held), dtype=np.uint32), sizes)
            bucket = ((tokens & np.uint64((1 << DROPPED) - 1)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket.astype(np.uint64) << np.uint64(64 - DROPPED) | tokens >> np.uint64(DROPPED))
            tokens, at = tokens[order] >> np.uint64(DROPPED), at[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out: list[tuple[int, int, bytes]] = []
            for b in range(buckets):
                if (own := slice(cuts[b], cuts[b + 1])).start < own.stop:
                    used, local = np.unique(at[own], return_inverse=True)
                    out.append((b, 0, pack(tokens[own], local.astype(np.uint32)) + nodes[used].tobytes() + len(used).to_bytes(8, "little")))
            which = (nodes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            lengths = np.array([len(x[2]) for x in held], np.int64)
            for b in np.unique(which):
                own = np.flatnonzero(which == b)
                out.append((int(b), 1, pack(nodes[own], sizes[own] + lengths[own])))
                if lengths[own].sum():
                    out.append((int(b), 2, pack(np.repeat(nodes[own], lengths[own]), np.concatenate([held[i][2] for i in own]))))
            held.clear()
            for i in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[i : i + 64]], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])

        n = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                g = grams.of(text)
                if len(g) and (mark := digest(g)) not in seen:
                    seen.add(mark)
                    hot = shared.value[(g % np.uint64(CELLS)).astype(np.int64)]
                    held.append((node_of(mark), g[~hot], g[hot]))
                    n += len(g)
                    if n >= FLUSH:
                        yield from flush()
                        n = 0
        yield from flush()

    return docs.mapInArrow(trimmed(run), "bucket int, kind int, data binary")


def shared_grams(dealt: DataFrame, buckets: int) -> DataFrame:
    """bucket, kind, data: kinds 1 and 2 as they come; kind 3, by class: class, gram and document frequency of grams that
    aren't common and are in two classes or more. Buckets of a task are worked out one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> pa.RecordBatch:
            tokens, nodes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((nodes, tokens))
            tokens, nodes = tokens[order], nodes[order]
            new = np.ones(len(tokens), bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
            tokens, nodes = tokens[new], nodes[new]
            first = np.ones(len(tokens), bool)
            first[1:] = tokens[1:] != tokens[:-1]
            df = np.diff(np.concatenate([np.flatnonzero(first), [len(tokens)]]))
            df = np.repeat(df, df)
            keep = df > 1
            tokens, nodes, df = tokens[keep], nodes[keep], df[keep]
            which = (nodes.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((nodes, which))
            cuts = np.searchsorted(which[order], np.arange(buckets + 1))
            out = [(b, pack(nodes[i], (tokens[i] * np.uint64(buckets) + np.uint64(at)).view(np.int64), df[i])) for b in range(buckets) if len(i := order[cuts[b] : cuts[b + 1]])]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([3] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "kind", "data"])

        for batch in batches:
            passed = []
            for b, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    passed.append((b, kind, data))
                    continue
                if b != at and held:
                    yield found()
                at = b
                n = int.from_bytes(data[-8:], "little")
                tokens, local = unpack(data[: -8 - 8 * n], np.uint64, np.uint32)
                held.append((tokens, np.frombuffer(data[-8 - 8 * n : -8], np.int64)[local]))
            if passed:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in passed], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "data"])
        if held:
            yield found()

    return dealt.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(trimmed(run), "bucket int, kind int, data binary")


def prefixes(rows: DataFrame, buckets: int) -> DataFrame:
    """gram, node: the grams of each class's prefix that others hold too. Grams of one class only come first in the
    order, then by document frequency, common ones last; a set that lacks a shared one among its first
    n - ceil(0.8 n) + 1 links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sizes, rest = None, [], []

        for batch in batches:
            for b, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at and at is not None:
                    yield from of_bucket(sizes, rest)
                    sizes, rest = [], []
                at = b
                if kind == 1:
                    sizes.append(np.stack(unpack(data, np.int64, np.int64)))
                elif kind == 2:
                    nodes, grams = unpack(data, np.int64, np.int64)
                    rest.append(np.stack([nodes, grams, np.full(len(nodes), 1 << 60)]))
                else:
                    rest.append(np.stack(unpack(data, np.int64, np.int64, np.int64)))
        if at is not None:
            yield from of_bucket(sizes, rest)

    def of_bucket(sizes: list[np.ndarray], rest: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not rest:
            return
        size, found = np.concatenate(sizes, 1), np.concatenate(rest, 1)
        nodes, first = np.unique(size[0], return_index=True)
        n = size[1][first]
        found = found[:, np.lexsort((found[1], found[2], found[0]))]
        new = np.ones(found.shape[1], bool)  # a class that several tasks met sent its common grams each time
        new[1:] = (found[:2, 1:] != found[:2, :-1]).any(0)
        found = found[:, new]
        own, start, count = np.unique(found[0], return_index=True, return_counts=True)
        of = np.searchsorted(nodes, own)
        prefix = n[of] + 1 - -(-SIMILARITY * n[of] // 100)
        alone = n[of] - count
        take = np.clip(prefix - alone, 0, count)
        keep = np.arange(found.shape[1]) - np.repeat(start, count) < np.repeat(take, count)
        yield pa.RecordBatch.from_arrays([pa.array(found[1][keep]), pa.array(found[0][keep])], names=["gram", "node"])

    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(trimmed(run), "gram long, node long")


def star_edges(listed: DataFrame) -> DataFrame:
    """a, b: edges that join all classes of a gram's list: each with the first of its part of the list, and those firsts
    with the first of them. Lists are dealt into SALTS parts, so a long one isn't read in one task."""
    parts = listed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    found = stored(stars(parts, "gram", "salt"), "ngram-stars")
    firsts = found.where("b is null").select("gram", F.col("a").alias("node"))
    return found.where("b is not null").select("a", "b").union(stars(firsts, "gram").where("b is not null").select("a", "b")).distinct()


def stars(listed: DataFrame, *keys: str) -> DataFrame:
    """gram, a, b: each class of a list with the first of it, and the first with a null b. Lists are read in order, as a
    stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first = None, 0
        for batch in batches:
            *lists, v = (c.to_numpy() for c in batch.columns)
            if not len(v):
                continue
            new = np.ones(len(v), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in lists], 0)
            heads = v[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))].copy()
            if tuple(x[0] for x in lists) == at:
                heads[: np.argmax(new[1:]) + 1 if new[1:].any() else len(v)] = first
                new[0] = False
            at, first = tuple(x[-1] for x in lists), heads[-1]
            keep = (heads != v) | new
            yield pa.RecordBatch.from_arrays([pa.array(lists[0][keep]), pa.array(heads[keep]), pa.array(v[keep], mask=new[keep])], names=["gram", "a", "b"])

    return listed.select(*keys, "node").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(trimmed(run), "gram long, a long, b long")


class Union:
    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        own = self.members.pop(b)
        self.label[own] = a
        self.members[a] += own
        return True


def divide_skip(lists: list[np.ndarray], needed: int) -> list[int]:
    """Members of at least `needed` of the sorted lists: heap-merge the short ones, probe the long ones."""
    lists = sorted(lists, key=len)
    if len(lists) < needed:
        return []
    longest = len(lists[-1])
    aside = min(needed - 1, int(needed / (MERGE_COST * math.log(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    out, at, n = [], -1, 0

    def probe(member: int, count: int) -> None:
        if count < needed - len(long):
            return
        for left, own in enumerate(reversed(long)):
            if count >= needed or count + len(long) - left < needed:
                break
            i = int(np.searchsorted(own, member))
            count += i < len(own) and own[i] == member
        if count >= needed:
            out.append(member)

    for member in heapq.merge(*(x.tolist() for x in short)):
        if member != at:
            if n:
                probe(at, n)
            at, n = member, 0
        n += 1
    if n:
        probe(at, n)
    return out


def links(sets: list[np.ndarray], group: list[int], guests: list[bool]) -> tuple[list[tuple[int, int]], tuple[int, float]]:
    """Links that join what isn't joined yet (indices of sets that link and whose groups, and links so far, differ),
    and the set that has most in common with the others, with how many of them hold one of its grams on average.

    group: sets of one number are joined already; guests, if there are any, pair with others only, and others with them."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    union, first = Union(len(order)), {}
    for k, i in enumerate(order):
        union.join(k, first.setdefault(group[i], k))
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), sizes)
    by = np.argsort(tokens, kind="stable")  # owners stay in order within a list
    listed, back, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    guest = np.array([guests[i] for i in order])
    sides = []
    for side in (True, False) if guest.any() else (None, None):  # the lists that a guest and that another searches
        own = by if side is None else by[guest[owner[by]] != side]
        held = np.bincount(back[own], minlength=len(listed))
        sides.append((owner[own], held, np.cumsum(held) - held))
    likeness = np.bincount(owner, counts[back], len(order)) / np.maximum(1, sizes)
    ends, out = np.cumsum(sizes), []
    for q in range(len(order)):
        n = int(sizes[q])
        low = int(np.searchsorted(sizes, -(-SIMILARITY * n // 100)))  # partners before q, so no larger
        if low >= q:
            continue
        owners, held, starts = sides[0 if guest[q] else 1]
        at = back[ends[q] - n : ends[q]]
        at = at[held[at] > 0]
        c = held[at]
        if len(at) < required(n, int(sizes[low])):
            continue
        lists = np.repeat(np.arange(len(at)), c)
        entries = owners[np.repeat(starts[at] - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())]
        keep = (entries >= low) & (entries < q) & (union.label[entries] != union.label[q])
        lists, entries = lists[keep], entries[keep]
        for k in range(len(BANDS) - 1):
            least = max(math.ceil(BANDS[k] * n), int(sizes[low]))
            needed = required(n, least)
            band = (sizes[entries] >= least) & (sizes[entries] < BANDS[k + 1] * n) if k < len(BANDS) - 2 else sizes[entries] >= least
            in_band = lists[band]
            if len(in_band) < needed:
                continue
            cuts = np.flatnonzero(np.diff(in_band)) + 1
            if len(cuts) + 1 < needed:
                continue
            for j in divide_skip(np.split(entries[band], cuts), needed):
                if union.label[j] != union.label[q]:
                    a, b = sets[order[q]], sets[order[j]]
                    if len(np.intersect1d(a, b, assume_unique=True)) >= required(n, len(b)):
                        union.join(q, j)
                        out.append((order[q], order[j]))
    best = int(np.argmax(likeness))
    return out, (order[best], float(likeness[best]))


def searched(rows: DataFrame, tasks: int) -> DataFrame:
    """a, b: links found in each group (grp, part, slice) of rows(grp, part, slice, id, piece, guest, grams); and for each
    group a row without b that names the set most like the others, with grp and likeness. tasks: how many share the work,
    which is more than its bytes tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def found() -> pa.RecordBatch:
            distinct = list({r[3]: r for r in sorted(held, key=lambda r: r[5])}.values())
            ids = [r[3] for r in distinct]
            pairs, (best, like) = links([np.frombuffer(r[6], np.uint64) for r in distinct], [r[4] for r in distinct], [r[5] for r in distinct])
            a, b = [*(ids[x] for x, _ in pairs), ids[best]], [*(ids[y] for _, y in pairs), None]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([at[0]] * len(a), pa.int64()), pa.array([like] * len(a), pa.float64())], names=["a", "b", "grp", "like"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != at:
                    if len(held) > 1:
                        yield found()
                    at, held = r[:3], []
                held.append(r)
        if len(held) > 1:
            yield found()

    keys = ("grp", "part", "slice")
    return rows.select(*keys, "id", "piece", "guest", "grams").repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), "a long, b long, grp long, like double")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id of every row: the smallest key reachable by links of SIMILARITY or more.

    Null, empty and blank texts have no grams and link with nothing; texts of fewer words than WORDS are one gram;
    equal sets are one class; repeated rows stay; an empty table gives no rows. Rows with a null key link as others do:
    if there are any, rows are numbered first; a component of null keys only has a null component_id. Other columns are
    not read."""
    if not docs.where(F.col(key).isNull()).limit(1).count():
        return similar_keyed(docs, key, text)
    rows = stored(keyed_text(docs, key, text).withColumn("row_no", F.monotonically_increasing_id()), "ngram-numbered")
    found = stored(similar_keyed(rows, "row_no", "text").join(rows.select("row_no", key), "row_no"), "ngram-found")
    least = found.groupBy("component_id").agg(F.min(key).alias("least"))
    return found.join(least, "component_id").select(key, "n_shingles", F.col("least").alias("component_id"))


def similar_keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """similar() of rows that all have a key."""
    texts = keyed_text(docs, key, text)
    scanned = stored(scan(texts, key), "ngram-scan")
    common, total = sketch(scanned)
    buckets = max(4, -(-total // TOKENS))
    own = scanned.where("part is null").select(key, "n", "mark", "node")
    classes = stored(own.where("n > 0").groupBy("mark").agg(F.min(key).alias("id"), F.first("n").alias("n"), F.first("node").alias("node")), "ngram-classes")
    rows = shared_grams(dealt_grams(texts, common, buckets), buckets)
    groups = connected_components(star_edges(prefixes(rows, buckets)))
    named = classes.join(groups, "node").select("id", "component")
    sizes = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("grp"))
    members = stored(named.join(sizes.where("size > 1"), "component").select("id", "grp", "size"), "ngram-members")
    n_members = members.count()
    few, tasks = n_members <= BROADCAST, max(32, -(-n_members // (5 * PART)))
    grams = Grams()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([grams.of(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())], names=["id", "grp", "size", "grams"])

    wanted = members.withColumnRenamed("id", key)
    chosen = texts.join(F.broadcast(wanted) if few else wanted, key).select(key, "grp", "size", "text").mapInArrow(trimmed(sets), "id long, grp long, size long, grams binary")
    chosen = stored(chosen, "ngram-sets")
    parts = F.ceil(F.col("size") / PART)
    part = F.pmod(F.xxhash64("id"), parts)

    def to_others(rows: DataFrame) -> DataFrame:
        """rows as guests of all parts but their own."""
        return rows.withColumn("own", part).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1))).where("part <> own").drop("own").withColumn("guest", F.lit(True))

    first = stored(searched(chosen.withColumn("part", part).withColumn("piece", F.col("id")).withColumn("guest", F.lit(False)).withColumn("slice", F.lit(0)), tasks), "ngram-links")
    edges = first.where("b is not null").select("a", "b")
    large = chosen.where(F.col("size") > PART)
    # of a large group, the sets most like the others meet all its parts, so that most of it is joined at once
    leaders = first.where("b is null").groupBy("grp").agg(F.slice(F.sort_array(F.collect_set(F.struct("like", "a")), False), 1, LEADERS).alias("best")).select("grp", F.explode("best.a").alias("id"))
    leading = to_others(large.join(leaders, ["grp", "id"]))
    met = large.withColumn("part", part).withColumn("guest", F.lit(False)).unionByName(leading).withColumn("piece", F.col("id")).withColumn("slice", F.lit(0))
    edges = edges.union(stored(searched(met, tasks), "ngram-links").where("b is not null").select("a", "b"))
    pieces = connected_components(edges)
    # what a large group has outside its largest piece is searched in all its parts
    large = large.join(pieces.withColumnRenamed("node", "id"), "id", "left").withColumn("piece", F.coalesce("component", "id")).drop("component")
    main = large.groupBy("grp", "piece").agg(F.count(F.lit(1)).alias("k")).groupBy("grp").agg(F.max_by("piece", F.struct("k", "piece")).alias("main"), F.count(F.lit(1)).alias("pieces"), F.sum("k").alias("all"), F.max("k").alias("most")).where("pieces > 1")
    main = main.select("grp", "main", F.ceil((F.col("all") - F.col("most")) / GUESTS).cast("int").alias("slices"))
    main = stored(main, "ngram-main")
    if main.limit(1).count():
        # a task holds a part of PART members and a slice of GUESTS guests
        rest = large.join(main, "grp")
        guests = to_others(rest.where("piece <> main")).withColumn("slice", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("slices")).cast("int"))
        members_ = rest.withColumn("part", part).withColumn("guest", F.lit(False)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        again = members_.unionByName(guests).drop("main", "slices")
        pieces = connected_components(edges.union(stored(searched(again, 4 * tasks), "ngram-links").where("b is not null").select("a", "b")))
    linked = classes.join(pieces.withColumnRenamed("node", "id"), "id", "left").select("mark", F.coalesce("component", "id").alias("component_id"))
    full = own.where("n > 0").join(linked, "mark").select(key, F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(own.where("n = 0").select(key, F.col("n").alias("n_shingles"), F.col(key).alias("component_id")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
