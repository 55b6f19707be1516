"""Dedup of repeated strings (operator 8): shards' Burrows-Wheeler transforms, merged by interleave refinement.

A byte goes if a string of LENGTH bytes that covers it begins anywhere else too. Each such string has an anchor, its
leftmost least gram hash, so equal strings have equal anchors at equal places, and only strings whose anchor is there
twice have to be ordered: they and the bytes around them, a run of one anchor each, are the collections below.

Every task sorts the suffixes of its own runs, a shard, once and sends each bucket of anchors the shard's transform: the
byte before each suffix, in order. A bucket inverts its shards' transforms by walking them backwards, which gives texts and
suffix orders again, and merges the orders by refining how they interleave: at first by the first bytes of the suffixes;
then each round splits the intervals that are still open by where the suffixes come that begin as many bytes later as are
compared so far, which doubles what is compared. Suffixes of one shard never change their order among themselves, settled
intervals are not touched again, and neighbours that part in a round have a common prefix of what was compared before.
What has not parted when LENGTH bytes are compared, or nothing changes any more, is a repeated interval.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalspark.llm.common import pack, read, stored, trimmed, unpack

LENGTH, GRAM = 200, 64
WIDTH = LENGTH - GRAM + 1  # grams in a string
#: Anchors that a task counts at once, bits of the filter of repeated anchors (64 MB at most), bytes of a shard, suffixes that
#: are merged at once, bytes of text for each bucket, buckets that are sent together, and bytes of text for each task of the
#: merge. Shards have fewer than 2^21 suffixes.
ANCHORS, LARGEST_FILTER, SHARD, ITEMS, BUCKET, TOGETHER, SHARE = 1_500_000, 1 << 29, 1_900_000, 1_400_000, 4 << 20, 16, 256 << 20
#: Places of an anchor from which its runs are dealt into parts of about so many, and how many such anchors the driver holds
#: (the most frequent ones; less frequent ones stay whole).
GROUP, HOT = 2000, 1_000_000
PLACE = 20  # bits of a place in a chunk
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
LOW, BITS = np.uint64(0xFFFFFFFF), np.uint64(21)
WORD = (1 << 21) - 1


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as are needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                    steps = np.full(n, base % (1 << 64), np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def gram_hashes(raw: np.ndarray, powers: Powers) -> np.ndarray:
    up, down = powers.of(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(raw) - GRAM + 1]
        h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of strings with one anchor: the hash and place of the anchor, first and last start of a string."""
    keys, places, firsts, lasts = [], [], [], []
    strings = len(raw) - LENGTH + 1
    chunk = (1 << PLACE) - 2 * LENGTH
    for begin in range(0, max(0, strings), chunk):
        part = raw[begin : begin + chunk + LENGTH - 1]
        h = gram_hashes(part, powers)
        n = len(part) - LENGTH + 1
        v = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(v) // WIDTH)
        padded = np.full(rows * WIDTH, ~np.uint64(0), np.uint64)
        padded[: len(v)] = v
        blocks = padded.reshape(rows, WIDTH)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:n], ahead[WIDTH - 1 : WIDTH - 1 + n]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        keys.append(h[at[first]])
        places.append(at[first] + begin)
        firsts.append(first + begin)
        lasts.append(np.concatenate([first[1:], [n]]) - 1 + begin)
    if not keys:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    return tuple(np.concatenate(x) for x in (keys, places, firsts, lasts))


def repeated_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, bits, filter, hot: a bit map of the anchors of a bucket that are in two places or more, and those that are in
    GROUP places or more, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen, held, n = Powers(), set(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                if not len(keys):
                    return
                bucket = (keys % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                used, cuts = np.unique(bucket[order], return_index=True)
                data = [pack(keys[own], counts[own].astype(np.uint32)) for own in np.split(order, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "keys"])

        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True):
                if mark not in seen:
                    seen.add(mark)
                    held.append(anchors(np.frombuffer(text.encode(), np.uint8), powers)[0])
                    n += len(held[-1])
                    if n >= ANCHORS:
                        yield from flush()
                        n = 0
        yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def counted() -> pa.RecordBatch:
            keys, places = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keys, back = np.unique(keys, return_inverse=True)
            n = np.bincount(back, places).astype(np.int64)
            keys, n = keys[n > 1], n[n > 1]
            bits = min(LARGEST_FILTER // buckets, 1 << int(max(64, 16 * len(keys))).bit_length())
            bits = max(64, 1 << (bits.bit_length() - 1))
            flags = np.zeros(bits, bool)
            flags[((keys >> np.uint64(24)) % np.uint64(bits)).astype(np.int64)] = True
            often = n >= GROUP
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.int64()), pa.array([np.packbits(flags).tobytes()], pa.binary()), pa.array([pack(keys[often], n[often])], pa.binary())], names=["bucket", "bits", "filter", "hot"])

        for batch in batches:
            for b, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != at and held:
                    yield counted()
                at = b
                held.append(unpack(keys, np.uint64, np.uint32))
        if held:
            yield counted()

    counts = docs.select("text", "d1", "d2").mapInArrow(trimmed(run), "bucket int, keys binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return counts.mapInArrow(trimmed(count), "bucket int, bits long, filter binary, hot binary")


class Repeated:
    """Which anchors are in several places (some others pass too), and into how many parts those of very many are dealt."""

    def __init__(self, rows: Iterator, buckets: int):
        self.buckets = np.uint64(buckets)
        self.bits, self.begin = np.ones(buckets, np.uint64), np.zeros(buckets, np.uint64)
        maps, keys, n, at = [np.zeros(8, np.uint8)], [], [], 64
        for r in rows:
            self.bits[r.bucket], self.begin[r.bucket] = r.bits, at
            maps.append(np.frombuffer(bytes(r["filter"]), np.uint8))
            at += 8 * len(maps[-1])
            own = unpack(bytes(r.hot), np.uint64, np.int64)
            keys.append(own[0])
            n.append(own[1])
        self.map = np.concatenate(maps)
        keys, n = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, n))
        most = np.argsort(n)[::-1][:HOT]
        most = most[np.argsort(keys[most])]
        self.hot, self.parts = keys[most], -(-n[most].astype(np.int64) // GROUP)

    def several(self, keys: np.ndarray) -> np.ndarray:
        bucket = (keys % self.buckets).astype(np.int64)
        bit = self.begin[bucket] + (keys >> np.uint64(24)) % self.bits[bucket]
        return (self.map[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1

    def dealt(self, keys: np.ndarray) -> np.ndarray:
        """Parts of each anchor; 0 for those that stay whole."""
        if not len(self.hot):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
        return np.where(self.hot[at] == keys, self.parts[at], 0)


#: What is known of a run beside its bytes: halves of its signature, anchor, lo and hi (strings begin lo down to hi bytes
#: before the anchor), places, bytes, and whether its anchor is dealt into parts.
META = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("anchor", "<u8"), ("lo", "<i4"), ("hi", "<i4"), ("n", "<i8"), ("size", "<i4"), ("hot", "<i4")])


def sorted_by(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sorted keys of two numbers and a place, of 21 bits each."""
    key = (first.astype(np.uint64) << BITS) | second.astype(np.uint64)
    key = (key << BITS) | np.arange(len(key), dtype=np.uint64)
    key.sort()
    return key


def transforms(contexts: list[bytes], bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """bucket, its contexts (their numbers) and its transform, for each bucket: the byte before each suffix, empty ones too,
    and 1 (0: there is none), by the order of suffixes; equal ones are in the order of contexts. Suffixes are sorted by
    prefix doubling, all buckets at once."""
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    sizes = np.array([len(contexts[i]) + 1 for i in order.tolist()], np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    text = np.frombuffer(b"\xff".join([contexts[i] for i in order.tolist()]) + b"\xff", np.uint8) + np.uint8(1)  # 0 ends a context; no byte of UTF-8 is 255
    left = (np.repeat(ends, sizes) - np.arange(total) - 1).astype(np.int32)  # bytes up to the end
    # at first buckets, 3 bytes (no more after an end) and places, of 16, 24 and 24 bits
    key = np.repeat((np.searchsorted(first, np.arange(len(order)), "right") - 1).astype(np.uint64), sizes)
    byte = text
    for k in range(3):
        if k:
            byte = np.where(byte > 0, np.append(text[k:], np.zeros(k, np.uint8)), 0)
        key = (key << np.uint64(8)) | byte
    key = (key << np.uint64(24)) | np.arange(total, dtype=np.uint64)
    key.sort()
    rows = (key & np.uint64((1 << 24) - 1)).astype(np.int32)
    key >>= np.uint64(24)
    new = np.ones(total, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(total, np.int32)  # 1 + the place of the first of its interval
    depth = 3
    while True:
        starts = np.flatnonzero(new)
        sizes_of = np.diff(np.append(starts, total))
        rank[rows] = np.repeat(starts, sizes_of) + 1
        alive = np.flatnonzero(np.repeat(sizes_of > 1, sizes_of))
        if not len(alive):
            break
        at = rows[alive]
        done = depth > LENGTH + WIDTH  # longer than any context
        later = at if done else np.where(left[at] >= depth, rank[np.minimum(at + depth, total - 1)], 0)
        key = sorted_by(rank[at], later)
        rows[alive] = at[(key & np.uint64(WORD)).astype(np.int64)]
        if done:
            break
        key >>= BITS
        new[alive[1:]] |= key[1:] != key[:-1]
        depth *= 2
    before = text[rows - 1]  # the end of the context before is 0, as wanted; so is the last byte of all
    bounds = np.append(first, len(order))
    cuts = np.concatenate([[0], ends])[bounds]
    for b, i, j, x, y in zip(used.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield b, order[i:j], before[x:y]


def packed(some: list[tuple[int, np.ndarray, np.ndarray]]) -> bytes:
    """A shard's part of a group of buckets: number in the group, META and transform of each bucket."""
    counts = np.zeros((TOGETHER, 2), np.int32)
    for b, meta, before in some:
        counts[b] = len(meta), len(before)
    return counts.tobytes() + b"".join(meta.tobytes() for _, meta, _ in some) + pack(np.concatenate([before for *_, before in some]))


def unpacked(rows: list[bytes]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """META and transform of each shard, bucket by bucket."""
    parts = []
    for data in rows:
        ends = np.cumsum(np.concatenate([np.zeros((1, 2), np.int64), np.frombuffer(data, np.int32, 2 * TOGETHER).reshape(-1, 2)]), 0)
        head = 8 * TOGETHER
        n = int(ends[-1, 0])
        parts.append((ends, np.frombuffer(data, META, n, head), unpack(data[head + n * META.itemsize :], np.uint8)[0]))
    for b in range(TOGETHER):
        found = [(meta[e[b, 0] : e[b + 1, 0]], before[e[b, 1] : e[b + 1, 1]]) for e, meta, before in parts if e[b, 0] < e[b + 1, 0]]
        if found:
            yield found


def runs(docs: DataFrame, repeated: Repeated, buckets: int) -> DataFrame:
    """Rows of two kinds. Places: sig, d1, d2, place (of the anchor): where a run with a repeated anchor is. Transforms of
    shards: bucket (the number of a group of them), data."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    names = ["sig", "d1", "d2", "place", "bucket", "data"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, powers, seen = shared.value, Powers(), set()
        held: dict[bytes, list] = {}
        weight = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def shard() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            contexts = [own[4] for own in held.values()]
            meta = np.zeros(len(held), META)
            sigs = np.frombuffer(b"".join(held), "<u8").reshape(-1, 2)
            meta["s1"], meta["s2"] = sigs[:, 0], sigs[:, 1]
            for k, name in enumerate(("anchor", "lo", "hi", "n")):
                meta[name] = [own[k] for own in held.values()]
            meta["size"] = [len(c) for c in contexts]
            parts = repeated.dealt(meta["anchor"])
            meta["hot"] = parts > 0
            with np.errstate(over="ignore"):
                mixed = (meta["anchor"] + (meta["s1"] % np.maximum(parts, 1).astype(np.uint64)) * np.uint64(BASE % (1 << 64))) * MIX
            held.clear()
            out, found = [], transforms(contexts, ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32))
            for group, some in groupby(found, lambda x: x[0] // TOGETHER):
                out.append((None, None, None, None, group, packed([(b % TOGETHER, meta[own], before) for b, own, before in some])))
                if len(out) == 500:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        for batch in batches:
            places = []
            for text, mark in zip(batch.column(0).to_pylist(), zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True):
                if mark in seen:
                    continue
                seen.add(mark)
                data = text.encode()
                keys, at, first, last = anchors(np.frombuffer(data, np.uint8), powers)
                for k in np.flatnonzero(repeated.several(keys)).tolist():
                    p, s, e = int(at[k]), int(first[k]), int(last[k])
                    own = data[s : e + LENGTH]
                    sig = xxhash.xxh3_128_digest(own + struct.pack("<II", p - s, p - e))
                    places.append((sig, *mark, p, None, None))
                    if sig in held:
                        held[sig][3] += 1
                    else:
                        held[sig] = [int(keys[k]), p - s, p - e, 1, own]
                        weight += len(own)
                        if weight >= SHARD:
                            yield from shard()
                            weight = 0
                if len(places) >= 10_000:
                    yield batch_of(places)
                    places = []
            if places:
                yield batch_of(places)
        yield from shard()

    return docs.select("text", "d1", "d2").mapInArrow(trimmed(run), "sig binary, d1 long, d2 long, place long, bucket int, data binary")


class Collection:
    """The runs of a bucket: META of all, shard of each, their bytes, and the suffix order of each shard, got by walking the
    shards' transforms backwards from the ends of their runs, all runs at once."""

    def __init__(self, shards: list[tuple[np.ndarray, np.ndarray]]):
        metas, befores = ([x[k] for x in shards] for k in (0, 1))
        self.meta = np.concatenate(metas)
        self.shard = np.repeat(np.arange(len(metas)), [len(m) for m in metas])
        before, bounds = np.concatenate(befores), np.cumsum([0, *map(len, befores)])
        size = self.meta["size"].astype(np.int64)
        self.begin = np.cumsum(size) - size
        total = len(before)
        key = (np.repeat(np.arange(len(metas), dtype=np.uint64), np.diff(bounds)) << np.uint64(40)) | (before.astype(np.uint64) << np.uint64(32)) | np.arange(total, dtype=np.uint64)
        key.sort()
        to = np.empty(total, np.int32)  # from a suffix to the one that is a byte longer
        to[(key & LOW).astype(np.int64)] = np.arange(total, dtype=np.int32)
        del key
        self.text = np.zeros(int(size.sum()), np.uint8)
        self.place = np.full(total, -1, np.int32)  # where in the text the suffix of a row begins; -1: it is empty
        number = np.arange(len(size)) - np.repeat(np.cumsum([0, *(len(m) for m in metas[:-1])]), [len(m) for m in metas])
        by = np.argsort(-size, kind="stable")  # the longest first
        row, at, ends = (bounds[self.shard] + number)[by], (self.begin + size)[by], np.cumsum(np.bincount(size, minlength=2)[::-1])[::-1]
        for step in range(1, int(size.max()) + 1):
            n = int(ends[step])  # runs of so many bytes or more
            row, at = row[:n], at[:n] - 1
            self.text[at] = before[row] - np.uint8(1)
            row = to[row]
            self.place[row] = at


def interleaved(text: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges shards' orders of the suffixes of runs (text, where each begins, its size): order has the places of all
    suffixes, shard after shard. Returns the merged order, which of its places begin an interval, that is, differ from the
    one before in the first LENGTH bytes, and how many bytes at least each was found to have in common with the one before."""
    n = len(text)
    left = np.repeat(begin + size, size) - np.arange(n)
    key, depth = np.zeros(n, np.uint64), 5  # 5 bytes and places, of 40 and 24 bits
    for k in range(depth):
        key <<= np.uint64(8)
        own = np.flatnonzero(left > k)
        key[own] |= text[own + k].astype(np.uint64) + np.uint64(1)
    by, key = merged_by(key[order])
    merged = order[by]
    starts = np.ones(n, bool)
    starts[1:] = key[1:] != key[:-1]
    del key, by
    common, interval = np.zeros(n, np.int16), np.empty(n, np.int32)
    while True:
        first = np.flatnonzero(starts)
        sizes = np.diff(np.append(first, n))
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))
        common[~starts] = depth
        if depth == LENGTH or not len(open_):
            return merged, starts, common
        interval[merged] = np.repeat(first, sizes)
        step = min(depth, LENGTH - depth)
        at = merged[open_]
        later = np.where(left[at] > step, interval[np.minimum(at + step, n - 1)] + 1, 0)
        if n < WORD:
            key = sorted_by(interval[at], later)
            by = (key & np.uint64(WORD)).astype(np.int64)
            key >>= BITS
        else:
            by = np.lexsort((later, interval[at]))
            key = (interval[at].astype(np.uint64) << np.uint64(32) | later.astype(np.uint64))[by]
        merged[open_] = at[by]
        starts[open_[1:]] |= key[1:] != key[:-1]
        depth += step


def merged_by(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of words of 40 bits, and the words in it."""
    if len(words) >= 1 << 24:
        by = np.argsort(words, kind="stable")
        return by, words[by]
    key = (words << np.uint64(24)) | np.arange(len(words), dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << 24) - 1)).astype(np.int64), key >> np.uint64(24)


def settled(shards: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """sig, a, b, w1, w2, k of a bucket, see merged()."""
    held = Collection(shards)
    meta, shard = held.meta, held.shard
    # equal runs of several shards become one
    order = np.lexsort((shard, meta["s2"], meta["s1"]))
    new = np.ones(len(meta), bool)
    new[1:] = (meta["s1"][order][1:] != meta["s1"][order][:-1]) | (meta["s2"][order][1:] != meta["s2"][order][:-1])
    kept = order[new]
    n = np.add.reduceat(meta["n"][order], np.flatnonzero(new))
    kept, n = kept[by := np.argsort(meta["anchor"][kept], kind="stable")], n[by]
    key = meta["anchor"][kept]
    group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
    hot = meta["hot"][kept] > 0
    several = (np.bincount(group)[group] > 1) & (np.bincount(group, n == 1)[group] > 0)
    whole = np.flatnonzero((n > 1) & ~hot)
    if len(whole):
        own = meta[kept[whole]]
        yield found_rows(own, own["hi"], own["lo"])
    asked = np.flatnonzero(several | hot)
    if not len(asked):
        return
    sizes = np.cumsum(meta["size"][kept[asked]], dtype=np.int64)
    # anchors that together have ITEMS suffixes are merged at once
    share = (sizes - meta["size"][kept[asked]]) // ITEMS
    share = share[np.searchsorted(group[asked], group[asked], "left")]
    string = np.repeat(np.arange(len(meta), dtype=np.int32), meta["size"])[held.place]  # of each row
    for s in np.unique(share).tolist():
        own = asked[share == s]
        yield from repeats(held, string, kept[own], n[own], hot[own])


def found_rows(meta: np.ndarray, a: np.ndarray, b: np.ndarray, words: tuple[list, list, list] | None = None) -> pa.RecordBatch:
    sig = np.ascontiguousarray(np.stack([meta["s1"], meta["s2"]], 1)).view("V16")[:, 0].tolist()
    rest = [pa.array(w, t) for w, t in zip(words, SAID, strict=True)] if words else [pa.nulls(len(sig), t) for t in SAID]
    return pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), *rest], names=["sig", "a", "b", "w1", "w2", "k"])


SAID = (pa.int64(), pa.int64(), pa.int32())


def repeats(held: Collection, string: np.ndarray, kept: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What is found among the runs kept of a bucket (their numbers, places and whether their anchors are dealt)."""
    meta = held.meta[kept]
    size = meta["size"].astype(np.int64)
    begin = np.cumsum(size) - size
    number = np.full(len(held.meta), -1, np.int64)
    number[kept] = np.arange(len(kept))
    rows = np.flatnonzero((held.place >= 0) & (number[string] >= 0))
    shift = begin - held.begin[kept]
    order = (held.place[rows] + shift[number[string[rows]]]).astype(np.int32)
    text = held.text[np.repeat(held.begin[kept] - begin, size) + np.arange(int(size.sum()))]
    merged, starts, _ = interleaved(text, begin, size, order)
    interval = np.empty(len(text), np.int32)
    interval[merged] = np.cumsum(starts, dtype=np.int32) - 1
    owner = np.repeat(np.arange(len(kept)), size)
    place = np.arange(len(text)) - begin[owner]
    begins = place <= size[owner] - LENGTH  # a string begins here
    owner, interval, place = owner[begins], interval[begins], place[begins]
    distance = meta["lo"][owner] - place
    copied = (n > 1)[owner]
    single = np.bincount(interval)[interval] == 1
    found = np.flatnonzero(np.where(hot[owner], copied | ~single, ~single & ~copied))
    if len(found):
        cut = np.concatenate([[0], np.flatnonzero((np.diff(found) > 1) | (np.diff(owner[found]) != 0)) + 1, [len(found)]])
        first, last = found[cut[:-1]], found[cut[1:] - 1]
        yield found_rows(meta[owner[first]], distance[last], distance[first])
    # strings of dealt anchors are told once a part
    dealt = np.flatnonzero(hot[owner])
    told = dealt[np.unique(interval[dealt], return_index=True)[1]]
    often = np.where(single[told], 1 + copied[told], 2)
    raw = text.tobytes()
    for at in range(0, len(told), 20_000):
        part = told[at : at + 20_000]
        own = meta[owner[part]]
        words = [struct.unpack("<qq", xxhash.xxh3_128_digest(raw[i : i + LENGTH] + struct.pack("<QI", a, d))) for i, a, d in zip((begin[owner[part]] + place[part]).tolist(), own["anchor"].tolist(), distance[part].tolist(), strict=True)]
        yield found_rows(own, distance[part], distance[part], ([w[0] for w in words], [w[1] for w in words], often[at : at + 20_000].tolist()))


def merged(shards: DataFrame, tasks: int) -> DataFrame:
    """sig, a, b: runs of repeated strings, b down to a bytes before the anchor. Of anchors that are dealt into parts also rows
    with a word (two halves of a hash of anchor, distance and string) and k, how often it is there (2: or more), to be
    counted by it: one for each string of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and held:
                    yield from chain.from_iterable(map(settled, unpacked(held)))
                    held = []
                at = bucket
                held.append(data)
        yield from chain.from_iterable(map(settled, unpacked(held)))

    return shards.select("bucket", "data").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), "sig binary, a int, b int, w1 long, w2 long, k int")


def cut_out(rows: DataFrame) -> DataFrame:
    """rows(text, whole, spans, own) as own's columns, n_bytes, n_removed, n_spans and kept (binary)."""
    schema = rows.select("own").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode()
                ends, kept, spans = 0, [], [(0, len(data))] if whole and len(data) >= LENGTH else sorted((x["a"], x["b"]) for x in spans or ())
                removed = n = 0
                for a, b in spans:
                    if a > ends or not n:
                        kept.append(data[ends:a])
                        n += 1
                        removed += b - a
                    else:
                        removed += max(0, b - ends)
                    ends = max(ends, b)
                kept.append(data[ends:])
                out.append((len(data), removed, n, b"".join(kept)))
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary())))], names=schema.names)

    return rows.select("text", "whole", "spans", "own").mapInArrow(trimmed(run), schema).select("own.*", *schema.names[1:])


def stretches(repeats: DataFrame) -> DataFrame:
    """repeats(sig, a, b) with those of a run that touch or overlap as one, so a run that is in very many places meets them with
    few rows. A run has WIDTH of them at most."""
    own = Window.partitionBy("sig").orderBy("a", "b")
    reach = F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = repeats.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    return marked.withColumn("stretch", F.sum("new").over(own)).groupBy("sig", "stretch").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("stretch")


def dedup(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left) of every row.

    Null texts are empty; texts under LENGTH bytes keep all; a text that is there twice (repeated rows too) goes whole
    if it has LENGTH bytes; matches never cross rows; an empty table gives no rows. keep may name any columns of docs
    that aren't called like the results."""
    whole_text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("own"), whole_text.alias("text")).withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(3), "text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = max(1, -(-size // (WIDTH // 2 * ANCHORS)))
    repeated = Repeated(repeated_anchors(rows, buckets).toLocalIterator(), buckets)
    tasks = max(32, -(-size // SHARE))
    found = stored(runs(rows, repeated, TOGETHER * max(tasks, -(-size // (TOGETHER * BUCKET)))), "suffix-runs")
    verdicts = stored(merged(found.where("place is null"), tasks), "suffix-repeats")
    spread = verdicts.where("w1 is not null").select("sig", "a", "w1", "w2", "k")
    often = spread.groupBy("w1", "w2").agg(F.sum("k").alias("n")).where("n > 1").select("w1", "w2")
    repeats = verdicts.where("w1 is null").select("sig", "a", "b").unionByName(spread.join(often, ["w1", "w2"]).select("sig", "a", F.col("a").alias("b")))
    places = found.where("place is not null").select("sig", "d1", "d2", "place").distinct()
    spans = places.join(stretches(repeats.distinct()), "sig").groupBy("d1", "d2").agg(F.collect_list(F.struct((F.col("place") - F.col("b")).alias("a"), (F.col("place") - F.col("a") + LENGTH).alias("b"))).alias("spans"))
    copies = rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", F.lit(True).alias("whole"))
    marks = spans.join(copies, ["d1", "d2"], "full").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return cut_out(rows.join(marks, ["d1", "d2"], "left"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
