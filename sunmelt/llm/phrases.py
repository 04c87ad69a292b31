"""Collocations: phrases of two to four words that occur together more often than their parts.

Texts are cut into slices, and each slice is stored with its own dictionary (words, counts and
one local code a word). Only those dictionaries are shuffled to count words and to number the
frequent ones; a phrase of ``least`` occurrences has no rarer word in it, so no other word can
take part. Phrases are counted in counting quotient filters: the word numbers of a phrase are
packed and permuted invertibly, the first bits of the result choose a block and a quotient in
it, and the rest is kept in full as the remainder, so that a filter is lossless: no two phrases
share a counter, and the numbers can be read back. A task fills sorted filters, and those of
all tasks are merged by block. The number of blocks grows with the corpus, and a phrase that
is everywhere arrives as one counter a task. Pairs are counted first; longer phrases with a
pair that is too rare are left out by a bitmap of fixed size, which spares counters and
decides nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmelt.llm.common import by_bytes
from sunmelt.runtime import attach, checkpoint_dir, delete_table, number_rows, written_table

LONGEST = 4  # words of a phrase
LEAST = 30  # occurrences of a phrase
INSIDE = 80  # percent of a phrase's occurrences that may lie inside a longer one
BEST = 2_000  # phrases of a language
SCALE = 2_000_000
SLICE = 1 << 20  # bytes of text that share a dictionary
FILTER = 1 << 19  # occurrences, of phrases of one length, that a task collects before it writes a filter
BLOCK = 1 << 19  # words of the corpus for each block of the merged filter
BITMAP = 27  # the bitmap of frequent pairs has 2 ** BITMAP bits
PARTS = 64  # parts of a language's candidates, each sorted by itself

BREAKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")
KEYS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
MULTIPLIER = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(first: np.ndarray, second: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of pairs of numbers of so many bits: rounds that change one half by the other."""
    for key in KEYS:
        first = first ^ (_mixed(second + key) & _mask(bits[0]))
        second = second ^ (_mixed(first ^ key) & _mask(bits[1]))
    return first, second


def restore(first: np.ndarray, second: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(KEYS):
        second = second ^ (_mixed(first ^ key) & _mask(bits[1]))
        first = first ^ (_mixed(second + key) & _mask(bits[0]))
    return first, second


class Layout:
    """How ``n`` word numbers of ``word_bits`` bits are packed: in one number if it fits, else in two."""

    def __init__(self, n: int, word_bits: int) -> None:
        self.n, self.word_bits = n, word_bits
        self.halves = (-(-n // 2) * word_bits, n // 2 * word_bits)
        self.whole = sum(self.halves) <= 64
        self.bits = (sum(self.halves), 0) if self.whole else self.halves

    def encode(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        shift, half = np.uint64(self.word_bits), -(-self.n // 2)
        join = lambda part: reduce(lambda a, w: (a << shift) | w, part)
        first, second = permute(join(words[:half]), join(words[half:]), self.halves)
        if self.whole:
            return (first << np.uint64(self.halves[1])) | second, np.zeros(len(first), np.uint64)
        return first, second

    def decode(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if self.whole:
            first, second = first >> np.uint64(self.halves[1]), first & _mask(self.halves[1])
        first, second = restore(first, second, self.halves)
        part = lambda v, k: [(v >> np.uint64(self.word_bits * i)) & _mask(self.word_bits) for i in reversed(range(k))]
        return np.stack([*part(first, -(-self.n // 2)), *part(second, self.n // 2)], axis=1).astype(np.int64)


@dataclass
class QuotientFilter:
    """Counters of distinct pairs of numbers of so many ``bits`` (none for the second one if
    the first holds all), in order of the pair.

    Stored, the first number is split into a quotient of about as many bits as there are
    counters and the rest. Quotients are a bit string (a one for each counter, a zero after
    the run of each quotient); the remainder is the rest of the first number and all of the
    second; a count is one byte, and those above 254 follow in full.
    """

    bits: tuple[int, int]
    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, bits: tuple[int, int], first: np.ndarray, second: np.ndarray, counts: np.ndarray | None = None) -> QuotientFilter:
        """From pairs in any order that may repeat; sorted runs are merged."""
        order = np.lexsort((second, first)) if bits[1] else np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        starts = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.zeros(0, np.int64)
        if counts is None:
            total = np.diff(np.r_[starts, len(first)])
        else:
            total = np.add.reduceat(counts[order], starts) if len(starts) else np.zeros(0, np.int64)
        return cls(bits, first[starts], second[starts], total.astype(np.int64))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        join = lambda part: np.concatenate([getattr(f, part) for f in filters])
        return cls.of(filters[0].bits, join("first"), join("second"), join("counts"))

    def block(self, low: int, high: int) -> QuotientFilter:
        return QuotientFilter(self.bits, self.first[low:high], self.second[low:high], self.counts[low:high])

    def pack(self, shared: int) -> bytes:
        """Bytes of a filter whose first numbers share their first ``shared`` bits (not stored)."""
        n, free = len(self.first), self.bits[0] - shared
        q = min(free, max(n.bit_length() - 1, 0))
        first = self.first & _mask(free)
        quotient = (first >> np.uint64(free - q)).astype(np.int64) if q else np.zeros(n, np.int64)
        runs = np.zeros(n + (1 << q), dtype=np.uint8)
        runs[quotient + np.arange(n)] = 1
        large = self.counts >= 255
        return b"".join([
            np.array([n], dtype="<u4").tobytes(), np.packbits(runs).tobytes(),
            _bytes(first & _mask(free - q), free - q), _bytes(self.second, self.bits[1]),
            np.where(large, 255, self.counts).astype(np.uint8).tobytes(), self.counts[large].astype("<i8").tobytes(),
        ])

    @classmethod
    def unpack(cls, data: bytes, bits: tuple[int, int], shared: int, block: int) -> QuotientFilter:
        n, free = int(np.frombuffer(data, "<u4", 1)[0]), bits[0] - shared
        q = min(free, max(n.bit_length() - 1, 0))
        at, size = 4, -(-(n + (1 << q)) // 8)
        runs = np.unpackbits(np.frombuffer(data, np.uint8, size, at))[: n + (1 << q)]
        quotient = (np.flatnonzero(runs) - np.arange(n)).astype(np.uint64)
        at += size
        rest, at = _numbers(data, n, free - q, at)
        second, at = _numbers(data, n, bits[1], at)
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        large = counts == 255
        counts[large] = np.frombuffer(data, "<i8", int(large.sum()), at + n)
        first = rest | (quotient << np.uint64(free - q)) if q else rest
        if shared:
            first = first | np.uint64(block << free)
        return cls(bits, first, second, counts)


def _bytes(values: np.ndarray, bits: int) -> bytes:
    width = -(-bits // 8)
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(data: bytes, n: int, bits: int, at: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return wide.reshape(-1).view("<u8"), at + n * width


def grams(ids: np.ndarray, follows: np.ndarray, n: int) -> list[np.ndarray]:
    """The first, second, ... of all runs of ``n`` numbers in which each but the last ``follows``
    (has a next one that may come after it)."""
    last = len(ids) - n + 1
    if last < 1:
        return [ids[:0]] * n
    at = np.flatnonzero(np.logical_and.reduce([follows[i : i + last] for i in range(n - 1)]))
    return [ids[at + i] for i in range(n)]


def _chunks(blob: bytes, limit: int) -> Iterator[bytes]:
    """Parts of about ``limit`` bytes at most, cut at breaks, which no phrase crosses."""
    start = 0
    while len(blob) - start > limit:
        cut = blob.rfind(b"\n", start + 1, start + limit)
        cut = blob.find(b"\n", start + limit) if cut < 0 else cut
        if cut < 0:
            break
        yield blob[start:cut]
        start = cut
    yield blob[start:]


def slices(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Texts as slices of one language: ``words`` and their ``counts``, ``n`` words, and
    ``codes``: numbers of ``width`` bytes, places in ``words`` from 1, 0 for the end of a piece."""

    def encode(name: str, blob: bytes, number: int) -> dict | None:
        tokens = pc.split_pattern(pa.array([blob.replace(b"\n", b" \n ")], pa.large_binary()), pattern=b" ").flatten()
        coded = tokens.dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        place, real = np.zeros(len(words), np.int32), []
        for i, w in enumerate(words):
            if w == b"":
                place[i] = -1
            elif w != b"\n":
                real.append(w)
                place[i] = len(real)
        codes = place[coded.indices.to_numpy()]
        codes = codes[codes >= 0]
        if not real:
            return None
        counts = np.bincount(codes, minlength=len(real) + 1)[1:]
        context, width = TaskContext.get(), 2 if len(real) < 1 << 16 else 4
        return {
            "lang": name, "slice": f"{context.partitionId() if context else 0}-{number}", "n": int(counts.sum()),
            "words": real, "counts": counts.tolist(), "width": width, "codes": codes.astype(f"<u{width}").tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept, size = 0, {}, 0
        layout = pa.schema([("lang", pa.string()), ("slice", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32())), ("width", pa.int32()), ("codes", pa.binary())])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, kept, size
            for name, blobs in kept.items():
                for part in _chunks(b"\n".join(blobs), SLICE):
                    row = encode(name, part, number)
                    number += 1
                    if row:
                        yield pa.RecordBatch.from_pylist([row], schema=layout)
            kept, size = {}, 0

        for whole in batches:
            for batch in by_bytes(whole, "text", SLICE):
                for name, blob in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                    if blob:
                        kept.setdefault(name, []).append(blob.lower().translate(BREAKS))
                        size += len(blob)
                        if size >= 2 * SLICE:
                            yield from flush()
        yield from flush()

    chosen = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "lang string, slice string, n long, words array<binary>, counts array<int>, width int, codes binary")


def _written(df: DataFrame) -> DataFrame:
    """A written table of large rows, read a few at a time."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _numbered(cut: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Each slice's ``ids``: the numbers of its words, 0 for rare words and ends of pieces."""
    words = cut.select("lang", "slice", F.posexplode("words").alias("place", "word"))
    known = attach(words, dictionary.select("lang", "word", "id"), ["lang", "word"], "inner", spread_by=["slice"])
    pair = F.shiftleft((F.col("place") + 1).cast("long"), 32).bitwiseOR(F.col("id"))
    ids = known.groupBy("slice", "lang").agg(F.collect_list(pair).alias("pairs"))
    small = dictionary_bytes(dictionary.count())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[i].as_py(), f"<u{batch.column('width')[i].as_py()}")
                pairs = batch.column("pairs")[i].values.to_numpy()
                ids = np.zeros(int(codes.max()) + 1, dtype=f"<u{small}")
                ids[pairs >> 32] = pairs & 0xFFFFFFFF
                out.append(ids[codes].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return cut.select("slice", "lang", "width", "codes").join(ids, ["slice", "lang"]).select("width", "codes", "pairs").mapInArrow(number, "ids binary")


def dictionary_bytes(words: int) -> int:
    """Bytes of a word's number."""
    return 2 if words < 1 << 16 else 4


def counters(numbered: DataFrame, lengths: Sequence[int], words: int, occurrences: int, least: int, known: Bitmap | None = None) -> DataFrame:
    """``ids`` (word numbers) and ``f`` of all phrases of so many words with ``least`` occurrences.

    Phrases with a pair of neighbours that is not in ``known``, if given, are not counted.
    """
    layouts = {n: Layout(n, max(words.bit_length(), 1)) for n in lengths}
    shared = min(min(layout.bits[0] for layout in layouts.values()), (occurrences // BLOCK).bit_length())
    size, pair = dictionary_bytes(words), Layout(2, max(words.bit_length(), 1))
    shipped = numbered.sparkSession.sparkContext.broadcast(known)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {n: [] for n in layouts}

        def flush(n: int) -> Iterator[pa.RecordBatch]:
            if not held[n]:
                return
            bits = layouts[n].bits
            found = QuotientFilter.of(bits, *(np.concatenate(h) for h in zip(*held[n])))
            held[n].clear()
            of = (found.first >> np.uint64(bits[0] - shared)).astype(np.int64) if shared else np.zeros(len(found.first), np.int64)
            blocks, starts = np.unique(of, return_index=True)
            ends = np.r_[starts[1:], len(of)]
            packed = [found.block(a, b).pack(shared) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), n, np.int32)), pa.array(blocks), pa.array(packed, pa.binary())], names=["n", "block", "packed"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_py(), f"<u{size}").astype(np.uint64)
                follows = np.concatenate([ids[:-1] * ids[1:] > 0, [False]])
                if shipped.value is not None:
                    at = np.flatnonzero(follows)
                    follows[at] = shipped.value.holds(pair.encode([ids[at], ids[at + 1]])[0])
                for n, layout in layouts.items():
                    held[n].append(layout.encode(grams(ids, follows, n)))
                    if sum(len(h[0]) for h in held[n]) >= FILTER:
                        yield from flush(n)
        for n in layouts:
            yield from flush(n)

    def merge(filters: pa.Table) -> pa.Table:
        block, layout = filters.column("block")[0].as_py(), layouts[filters.column("n")[0].as_py()]
        parts = [QuotientFilter.unpack(p.as_py(), layout.bits, shared, block) for p in filters.column("packed")]
        found = QuotientFilter.merged(parts)
        often = found.counts >= least
        lists = layout.decode(found.first[often], found.second[often]).tolist()
        return pa.table({"ids": pa.array(lists, pa.list_(pa.int64())), "f": pa.array(found.counts[often])})

    filled = numbered.mapInArrow(fill, "n int, block long, packed binary")
    return filled.groupBy("n", "block").applyInArrow(merge, "ids array<bigint>, f bigint")


@dataclass
class Bitmap:
    """A set of pairs of words as a bit string of fixed size: it may hold pairs that were not
    put in, never fewer. Pairs beyond its capacity only make it less selective."""

    bits: np.ndarray  # bytes

    def holds(self, packed: np.ndarray) -> np.ndarray:
        at = _places(packed)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _places(packed: np.ndarray) -> np.ndarray:
    return (_mixed(packed) & _mask(BITMAP)).astype(np.int64)


def bitmap(pairs: DataFrame, words: int) -> Bitmap:
    """Of a table of pairs. Only chunks of bits reach the driver, at most ``2 ** BITMAP`` bits."""
    layout, chunk = Layout(2, max(words.bit_length(), 1)), 1 << 15

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().reshape(-1, 2).astype(np.uint64)
            at = np.unique(_places(layout.encode([ids[:, 0], ids[:, 1]])[0]))
            for c in np.unique(at // chunk).tolist():
                bits = np.zeros(chunk, dtype=np.uint8)
                bits[at[at // chunk == c] % chunk] = 1
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    def either(chunks: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), np.uint8) for b in chunks.column("bits")]
        return pa.table({"chunk": chunks.column("chunk")[:1], "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    found = pairs.select("ids").mapInArrow(mark, "chunk long, bits binary").groupBy("chunk").applyInArrow(either, "chunk long, bits binary")
    out = np.zeros(1 << (BITMAP - 3), dtype=np.uint8)
    for row in found.toLocalIterator():
        out[row["chunk"] * chunk // 8 : (row["chunk"] + 1) * chunk // 8] = np.frombuffer(row["bits"], np.uint8)
    return Bitmap(out)


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, best: int = BEST, longest: int = LONGEST) -> DataFrame:
    """The first ``best`` phrases of each language: lang, rank, phrase, a, l, r, n and score.

    Texts are lower-cased (A to Z) and cut into pieces at ``.,;:!?`` and line ends, and pieces
    into words at blanks and tabs; a phrase lies in one piece. ``n`` counts all words of the
    language, ``a`` all occurrences of the phrase. Its score is ``SCALE * a / (l + r)``, rounded
    down, for the cut into two parts that makes it lowest (ties: the earliest), of ``l`` and
    ``r`` occurrences. A phrase goes if a longer candidate that holds it has at least ``inside``
    percent of its occurrences. Order: score and a descending, then the phrase's UTF-8 bytes.

    A null language is ``und``; null, empty and wordless texts add nothing; repeated rows count
    as often as they come; without any candidate there are no rows. Runs jobs when called.
    """
    cut = _written(slices(docs))
    counted = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    often = counted.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f")).where(F.col("f") >= least)
    dictionary = written_table(number_rows(often, ["lang", "word"], "id", start=1))
    totals = written_table(cut.groupBy("lang").agg(F.sum("n").alias("n")))
    words, occurrences = dictionary.count(), totals.agg(F.sum("n")).first()[0] or 0
    numbered = _written(_numbered(cut, dictionary))
    delete_table(cut)
    pairs = written_table(counters(numbered, [2], words, occurrences, least))
    phrases = pairs
    if longest > 2:
        more = counters(numbered, range(3, longest + 1), words, occurrences, least, bitmap(pairs, words))
        phrases = written_table(more.unionByName(pairs))
    delete_table(numbered)
    counts = phrases.unionByName(dictionary.select(F.array("id").alias("ids"), "f"))

    scored = written_table(_scored(phrases, counts))
    longer = scored.where(F.size("ids") > 2).select("a", F.explode(_shorter(F.col("ids"))).alias("ids"))
    around = written_table(longer.groupBy("ids").agg(F.max("a").alias("_around")))
    covered = _exact(F.col("_around")) * F.lit(100) >= _exact(F.col("a")) * F.lit(inside)
    kept = attach(scored, around, ["ids"]).where(~F.coalesce(covered, F.lit(False))).drop("_around")
    named = written_table(_spelled(written_table(kept), dictionary))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = named.withColumn("_part", part).withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    top = first.where(F.col("_place") <= best).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return attach(top.where(F.col("rank") <= best), totals, ["lang"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase with ``a``, and ``l``, ``r`` and ``score`` of its lowest-scoring cut."""
    ids = F.col("ids")
    cuts = F.flatten(
        F.transform(F.sequence(F.lit(1), F.size(ids) - 1), lambda k: F.array(
            F.struct(k.alias("k"), F.lit(True).alias("head"), F.slice(ids, F.lit(1), k).alias("part")),
            F.struct(k.alias("k"), F.lit(False).alias("head"), F.slice(ids, k + 1, F.size(ids) - k).alias("part")),
        ))
    )
    parts = written_table(phrases.select("ids", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("ids", "a", "c.*"))
    found = attach(parts, written_table(counts.select(F.col("ids").alias("part"), "f")), ["part"], "inner", spread_by=["ids", "k"])
    sides = found.groupBy("ids", "a", "k").agg(F.max(F.when(F.col("head"), F.col("f"))).alias("l"), F.max(F.when(~F.col("head"), F.col("f"))).alias("r"))
    score = F.expr(f"cast((cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return sides.groupBy("ids", "a").agg(lowest.alias("c")).select("ids", "a", "c.l", "c.r", "c.score")


def _shorter(ids: Column) -> Column:
    """All contiguous parts of at least two words, without the whole."""
    part = lambda size: F.transform(F.sequence(F.lit(1), F.size(ids) - size + 1), lambda at: F.slice(ids, at, size))
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(ids) - 1), part))


def _spelled(kept: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``phrase`` and ``lang`` instead of the word numbers."""
    each = written_table(kept.select("*", F.posexplode("ids").alias("place", "id")))
    words = dictionary.select("id", "lang", F.col("word").cast("string").alias("word"))
    spelled = attach(each, words, ["id"], "inner", spread_by=["ids", "place"])
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ")
    return spelled.groupBy("ids", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), ordered.alias("phrase"))
