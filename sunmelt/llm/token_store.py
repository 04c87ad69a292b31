"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are range-partitioned and sorted by id before they are encoded, so file after file
and row after row ascend. Readers split files by stripe, and a search for an id is pruned by
file, stripe and row-group statistics and by the Bloom filter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunmelt.llm.common import by_bytes
from sunmelt.runtime import written_table

END = 2
WORDS, PARTS = 900_000, 150_000  # entries of a worker's stores
LONGEST = 64  # longer texts are not kept
SCHEMA = "doc_id {kind}, shard int, ids array<int>"
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# A run of letters and signs after it. An apostrophe may start a contraction, and other signs
# may combine with a letter, so those are left to the tokenizer.
SPLIT = re.compile(rf"([^\W\d_]+)([{re.escape(SIGNS)}]+)")


class WordEncoder:
    """Encodes with a tokenizer file of the tokenizers library whose model works word by word.

    The tokenizer drops white space, splits off signs and merges inside words only, and it
    marks the last id of a word. So a text's ids are those of its blank-separated parts; the
    different parts of a batch are looked up once, and its new words are encoded as one text.
    """

    def __init__(self, content: str) -> None:
        self.content, self._tokenizer = content, None

    def __getstate__(self) -> dict:
        return {"content": self.content, "_tokenizer": None}

    def _start(self) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(self.content)
        self.last = np.zeros(self._tokenizer.get_vocab_size(), dtype=bool)
        self.last[[i for token, i in self._tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}  # ids of runs of letters
        self.signs = {s: ids for s, ids in zip(SIGNS, self._each(list(SIGNS)), strict=True)}
        self.parts: dict[str, bytes] = {"": b""}  # ids of other parts

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype="<i4").tobytes() for f in found]

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of different parts that are not stored, found for all of them together."""
        two = {p: m.groups() for p in parts if not p.isalpha() and (m := SPLIT.fullmatch(p))}
        words = {p for p in parts if p.isalpha()}.union([w for w, _ in two.values()])
        fresh = {w: self.words[w] for w in words if w in self.words}
        unknown = [w for w in words if w not in fresh]
        for i in range(0, len(unknown), 2_000):
            some = unknown[i : i + 2_000]
            (encoded,) = self._tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, dtype="<i4")
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw, starts = ids.tobytes(), [0, *cuts[:-1].tolist()]
                fresh |= {w: raw[4 * a : 4 * b] for w, a, b in zip(some, starts, cuts.tolist(), strict=True)}
            else:  # a letter that the tokenizer takes for several words
                fresh |= dict(zip(some, self._each(some), strict=True))
        _keep(self.words, WORDS, {w: fresh[w] for w in unknown})
        ends = list({e for _, e in two.values()})
        signs = dict(zip(ends, self._each(ends), strict=True))
        others = [p for p in parts if p not in two and p not in fresh]
        rest = dict(zip(others, self._each(others), strict=True))
        rest |= {p: fresh[w] + signs[e] for p, (w, e) in two.items()}
        _keep(self.parts, PARTS, {p: ids for p, ids in rest.items() if p not in two or len(two[p][1]) > 1})
        return fresh | rest

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        lists = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = np.asarray(lists.values, dtype="<i4").tobytes(), lists.offsets.to_pylist()
        return [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:])]

    def encode_column(self, texts: pa.Array, end: Sequence[int] = ()) -> pa.ListArray:
        """Ids of whole texts, each followed by ``end``; a null text is an empty one.

        The texts are cut at blanks and their parts told apart by Arrow, so that each different
        part is looked up once; the ids are then gathered for all places together.
        """
        if self._tokenizer is None:
            self._start()
        cut = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        parts = cut.flatten().dictionary_encode()
        found = self._parts_of(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        found.append(np.array(end, dtype="<i4").tobytes())  # one more part, at the end of each text
        counts = np.asarray(cut.value_lengths(), dtype=np.int64)
        last = np.cumsum(counts + 1) - 1
        codes = np.full(len(parts) + len(texts), len(found) - 1, dtype=np.int64)
        own = np.ones(len(codes), dtype=bool)
        own[last] = False
        codes[own] = np.asarray(parts.indices)
        lengths = np.array([len(ids) // 4 for ids in found], dtype=np.int64)
        starts, size = np.cumsum(lengths) - lengths, lengths[codes]
        ends = np.cumsum(size)
        at = np.repeat(starts[codes] - (ends - size), size) + np.arange(size.sum())
        ids = np.frombuffer(b"".join(found), dtype="<i4")[at]
        offsets = np.r_[0, ends[last]].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))

    def _parts_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of different parts, from the stores or, all together, from the tokenizer."""
        words, signs, parts = self.words.get, self.signs.get, self.parts.get
        row, missing = list(map(words, pieces)), []
        for i in [i for i, ids in enumerate(row) if ids is None]:
            part = pieces[i]
            sign = signs(part[-1:])
            ids = None if sign is None else words(part[:-1])
            row[i] = ids = parts(part) if ids is None else ids + sign
            if ids is None:
                missing.append(i)
        if missing:
            learned = self._learn([pieces[i] for i in missing])
            for i in missing:
                row[i] = learned[pieces[i]]
        return row


def _keep(store: dict[str, bytes], most: int, fresh: dict[str, bytes]) -> None:
    if len(store) + len(fresh) > most:
        store.clear()
        store[""] = b""
    store.update((text, ids) for text, ids in fresh.items() if len(text) <= LONGEST)


def write_ids(docs: DataFrame, tokenizer: str, path: str, text: str = "text", end: int = END) -> None:
    """Encode every whole text of ``docs`` and write ``path`` in ascending order of doc_id.

    A null text is an empty one; every document ends with the id ``end``. A null doc_id comes
    first. Equal doc_ids stay next to each other, in no fixed order. An empty table gives a
    folder with no rows.
    """
    with open(tokenizer, encoding="utf-8") as source:
        shared = docs.sparkSession.sparkContext.broadcast(WordEncoder(source.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 8 << 20):
                ids = shared.value.encode_column(batch.column("text"), [end])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), ids], names=["doc_id", "shard", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    (
        docs.select("doc_id", F.col(text).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id")
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(run, SCHEMA.format(kind=kind))
        .write.option("compression", "snappy")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true").option("orc.row.index.stride", "10000").option("orc.stripe.size", str(64 << 20))
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """doc_id, shard and ids of a folder of token files."""
    return spark.read.schema(SCHEMA.format(kind=kind)).orc(path)


def find_ids(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """Rows of the given documents; other stripes are skipped by their metadata."""
    return read_ids(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def describe(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document.

    start counts the ids of all documents before. The running sum is one of each file's rows
    plus one over the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<i4")
            ends = np.cumsum(np.asarray(lists.value_lengths().fill_null(0)), dtype=np.int64)
            raw, starts = memoryview(values).cast("B"), np.r_[0, ends[:-1]]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "shard", "n_tokens", "ids_crc32"]
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    rows = written_table(stored.select("doc_id", "shard", "ids").mapInArrow(run, f"doc_id {kind}, shard int, n_tokens long, ids_crc32 long"))
    # One row a file: the files' own totals are summed up in order.
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("_all"))
    files = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("shard"), F.coalesce(F.sum("_all").over(files), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("shard").orderBy("doc_id", "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
