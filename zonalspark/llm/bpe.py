"""Byte-pair encoding of pre-tokens: exact merging with a heap over linked symbols, whole-token shortcuts,
and a minimal perfect hash of a vocabulary. Plain helpers that run inside Spark tasks."""

from __future__ import annotations

import base64
import heapq
import json
import re

import regex
import xxhash

#: The pattern of byte-level BPE, fixed by the vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the files of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bits of a token id in the key of a pair.
ID_BITS = 24


def pair(a: int, b: int) -> int:
    return a << ID_BITS | b


def merge(parts: list[int], ranks: dict[int, int], merged: list[int] | None = None) -> list[int]:
    """Merge the pair of least rank, the leftmost of equals, until none is left.

    ranks: by pair(a, b); merged: the id that a merge of each rank makes (None: the rank itself). A heap holds rank
    and place of the pairs, links join the living; entries whose pair has changed since are passed over."""
    n = len(parts)
    if n < 2:
        return parts
    get, bits, end = ranks.get, n.bit_length(), n
    heap = [r << bits | i for i in range(n - 1) if (r := get(parts[i] << ID_BITS | parts[i + 1])) is not None]
    if not heap:
        return parts
    parts, after, before = [*parts, -1], list(range(1, n + 1)), list(range(-1, n))
    mask = (1 << bits) - 1
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        top = pop(heap)
        i, r = top & mask, top >> bits
        a, j = parts[i], after[i]
        if a < 0 or j == end or get(a << ID_BITS | parts[j]) != r:
            continue
        new = parts[i] = r if merged is None else merged[r]
        parts[j] = -1
        k = after[i] = after[j]
        before[k] = i
        if k != end and (r := get(new << ID_BITS | parts[k])) is not None:
            push(heap, r << bits | i)
        h = before[i]
        if h >= 0 and (r := get(parts[h] << ID_BITS | new)) is not None:
            push(heap, r << bits | h)
    return [p for p in parts if p >= 0]


class Pretokens:
    """Splits a text into pre-tokens, through chunks that can be cut apart safely.

    A single space between two characters that aren't white space always begins a pre-token and none crosses it,
    so such texts fall into chunks that repeat often and are worked out once. Other texts are matched whole."""

    def __init__(self, pattern: str = PATTERN):
        self.pattern = pattern
        self.find = regex.compile(pattern).findall
        self.space_runs = re.compile(r"[^\S \n]| [ \n]|\n |^ | $").search if pattern == PATTERN else lambda text: True

    def chunks(self, text: str) -> list[str] | None:
        """Chunks, each to be led by a space but for the first; None: match the text whole."""
        return None if self.space_runs(text) else text.split(" ")


class JsonVocabulary:
    """Vocabulary and merges of a byte-level BPE tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {pair(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.byte_ids = [self.vocab[c] for _, c in sorted(byte_letters().items())]
        self.added = [t["content"] for t in whole["added_tokens"]]

    def encode(self, piece: bytes) -> list[int]:
        return merge([self.byte_ids[b] for b in piece], self.ranks, self.merged)

    def whole(self) -> set[str]:
        """Proof for each vocabulary string that is text: merging it from its bytes gives one token, itself."""
        byte_of, found = {c: b for b, c in byte_letters().items()}, set()
        for s, i in self.vocab.items():
            if all(c in byte_of for c in s):
                raw = bytes(byte_of[c] for c in s)
                if self.encode(raw) == [i]:
                    found.add(raw.decode(errors="surrogateescape"))
        return found


def tiktoken_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tiktoken_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each pair of tokens whose bytes together are a token; that token is the merged one."""
    return {pair(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n slots for n keys, one number a bucket.

    A bucket of several keys keeps the seed that places them all in free slots, a bucket of one its slot itself."""

    MASK = (1 << 64) - 1

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // per_bucket)
        self.seeds = [0] * self.buckets
        self.slots = [-1] * self.n
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, h in enumerate(map(xxhash.xxh3_64_intdigest, keys)):
            groups.setdefault(h % self.buckets, []).append((h, i))
        free = None
        for b, own in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:
                free = free or [s for s, i in enumerate(self.slots) if i < 0]
                at = [free.pop()]
                self.seeds[b] = -1 - at[0]
            else:
                while len(set(at := [self.place(h, self.seeds[b]) for h, _ in own])) < len(at) or any(self.slots[s] >= 0 for s in at):
                    self.seeds[b] += 1
            for s, (_, i) in zip(at, own, strict=True):
                self.slots[s] = i

    def place(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & self.MASK
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) & self.MASK
        return (x ^ (x >> 32)) % self.n

    def index(self, key: bytes) -> int:
        """The index of the only key that can equal this one (-1: none can); the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.buckets]
        return self.slots[-1 - seed if seed < 0 else self.place(h, seed)]
