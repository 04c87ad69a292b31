"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry is resolved whole by a minimal perfect hash. Others
are merged: pieces are linked over the bytes, and a heap yields the pair of lowest rank,
leftmost first. Pre-tokens repeat a lot, so a worker keeps the ids of those it met, in a
store of bounded size that only saves time.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.llm.common import by_bytes, int_lists, texts_of

LOAD = 4  # mean number of keys of a bucket of the perfect hash
WORDS, BARE, PARTS = 600_000, 150_000, 100_000  # entries of a worker's stores
HOT, FIRST_TEXTS = 8_192, 300  # a smaller store, filled from the first texts
LONGEST = 64  # longer texts are not kept
MASK = (1 << 64) - 1
GAP = re.compile(r"\s\s")
SIGNS = "\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
NEW_LETTERS = "\u2000"  # below it, all versions of Unicode agree on what a letter is


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of fixed keys by hash, displace and direct slots for lone keys."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.n, self.buckets = n, max(1, n // LOAD)
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        if len(set(hashes)) < n:
            raise ValueError("keys repeat")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.slots: list[int] = [-1] * n  # key number in each slot
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                break
            mine, d = [hashes[i] for i in members[b]], 0
            while True:
                at = [self._slot(h, d) for h in mine]
                if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                    break
                d += 1
            self.shift[b] = d
            for i, a in zip(members[b], at, strict=True):
                self.slots[a] = i
        free = (a for a in range(n) if self.slots[a] < 0)
        for b in range(self.buckets):
            if len(members[b]) == 1:
                a = next(free)
                self.shift[b], self.slots[a] = -a - 1, members[b][0]

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15)) & MASK) * 0xD6E8FEB86659FD93 & MASK) % self.n

    def find(self, key: bytes) -> int:
        """Number of the only key that ``key`` can be."""
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        return self.slots[-d - 1 if d < 0 else self._slot(h, d)]


class Coder:
    """Encoder and decoder of one vocabulary; sent to the workers, its size is the vocabulary's."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens, self.pattern = tokens, pattern
        self.whole = PerfectHash(tokens)
        self._ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("tokens", "pattern", "whole")} | {"_ready": False}

    def _start(self) -> None:
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(self.pattern).findall
        self.learning, self.counts = FIRST_TEXTS, Counter()
        self.hot: dict[str, bytes] = {}  # ids of a blank and the most frequent parts
        self.words: dict[str, bytes] = {}  # ids of a blank and a run of letters
        self.bare: dict[str, bytes] = {}  # ids of a run of letters without a blank
        self.parts: dict[str, bytes] = {}  # ids of a blank and what follows up to the next
        self.pieces: dict[str, bytes] = {}  # ids of other pre-tokens
        self.signs = {sign: self._piece(sign) for sign in SIGNS}
        self._ready = True

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no vocabulary entry."""
        ranks, n = self.ranks.get, len(word)
        end = list(range(1, n + 1))  # where the piece that starts here ends; 0: no piece starts here
        left = list(range(-1, n))
        pair = [ranks(word[i : i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [rank << 32 | i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            low = heapq.heappop(heap)
            i = low & 0xFFFFFFFF
            if not end[i] or pair[i] != low >> 32:
                continue
            middle = end[i]
            stop = end[i] = end[middle]
            end[middle], pair[middle] = 0, -1
            left[stop] = i
            pair[i] = ranks(word[i : end[stop]], -1) if stop < n else -1
            if pair[i] >= 0:
                heapq.heappush(heap, pair[i] << 32 | i)
            before = left[i]
            if before >= 0:
                pair[before] = ranks(word[before:stop], -1)
                if pair[before] >= 0:
                    heapq.heappush(heap, pair[before] << 32 | before)
        found, i = [], 0
        while i < n:
            found.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return found

    def _piece(self, token: str) -> bytes:
        ids = self.pieces.get(token)
        if ids is None:
            ids = self._ids(token)
            _keep(self.pieces, PARTS, token, ids)
        return ids

    def _ids(self, token: str) -> bytes:
        word = token.encode()
        number = self.whole.find(word)
        found = [number] if self.tokens[number] == word else self.merge(word)
        return pack(f"<{len(found)}i", *found)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers.

        No match of the pattern goes on over a blank or line break that stands alone, so the
        text from one of them to the next can be looked up by itself.
        """
        if not self._ready:
            self._start()
        if GAP.search(text):
            return b"".join([self._piece(t) for t in self.split(text)])
        first, *rest = text.replace("\n", " \n").split(" ")  # no blank comes before a line break here
        row = list(map(self.hot.get, rest))
        if None in row:
            for i in [i for i, ids in enumerate(row) if ids is None]:
                row[i] = self._part(rest[i])
        if self.learning:
            self._count(rest)
        return b"".join([*map(self._piece, self.split(first)), *row])

    def _part(self, part: str) -> bytes:
        """Ids of a blank and ``part``; a part that begins with a line break has no blank."""
        lead, word, before, store, most = b"", part, " ", self.words, WORDS
        if part[:1] == "\n":
            lead, word, before, store, most = self.signs["\n"], part[1:], "", self.bare, BARE
        ids = store.get(word)
        if ids is not None:
            return lead + ids
        sign = self.signs.get(word[-1:])
        ids = store.get(word[:-1]) if sign else None
        if ids is not None:  # a word met before and one sign
            return lead + ids + sign
        ids = self.parts.get(part)
        if ids is not None:
            return ids
        if word.isalpha() and max(word) < NEW_LETTERS:
            ids = self._ids(before + word)
            _keep(store, most, word, ids)
            return lead + ids
        tokens = self.split(before + word)
        if tokens:
            run = tokens[0][len(before) :]
            if run.isalpha() and max(run) < NEW_LETTERS and run not in store:
                _keep(store, most, run, self._ids(tokens[0]))
            tokens[0] = store.get(run) or self._ids(tokens[0])
        ids = lead + b"".join([*tokens[:1], *map(self._piece, tokens[1:])])
        if len(tokens) > 2:
            _keep(self.parts, PARTS, part, ids)
        return ids

    def _count(self, parts: list[str]) -> None:
        """After the first texts, their most frequent parts go to a small store that is asked first."""
        self.learning -= 1
        self.counts.update(parts)
        if not self.learning:
            often = [part for part, _ in self.counts.most_common(HOT)]
            self.hot = {part: self._part(part) for part in often}
            self.counts = Counter()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _keep(store: dict[str, bytes], most: int, text: str, ids: bytes) -> None:
    if len(text) <= LONGEST:
        if len(store) >= most:
            store.clear()
        store[text] = ids


def encode(docs: DataFrame, coder: Coder, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``ids`` (array of int) of every whole text next to the columns ``keep``.

    A null text is an empty one, and an empty text has an empty array. Special tokens are
    ordinary text. Rows are independent of each other; repeated rows stay repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "_text"):
                ids = int_lists([shared.value.encode(t) for t in texts_of(batch.column("_text"))])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, "ids"])

    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kept}, ids array<int>")


def decode(encoded: DataFrame, coder: Coder, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``decoded`` (binary) of every row's ids next to the columns ``keep``; null ids give null.

    An id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "_ids", 2 << 20):
                lists = batch.column("_ids")
                flat = np.asarray(lists.flatten()).tolist()
                ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0))).tolist()
                rows = zip(lists.is_valid().to_pylist(), [0, *ends[:-1]], ends, strict=True)
                texts = [shared.value.decode(flat[a:b]) if known else None for known, a, b in rows]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.binary())], names=[*keep, "decoded"])

    kept = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in keep)
    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, f"{kept}, decoded binary")
