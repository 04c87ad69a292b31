"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are made by tasks and summed by Spark; the matrix of log probabilities has
``BUCKETS`` rows and one column per language, so its size is known before it is broadcast.
Scoring is done for many texts at once: all n-grams of a batch are hashed by array
arithmetic, their rows are gathered and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.llm.common import by_bytes, texts_of

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
MAX_DOCS = 20_000  # expected number of training texts at most
MAX_LANGS = 500
SCORED = 1 << 18  # bytes of text scored together, about; its n-grams take a hundred times as much
UNKNOWN = "und"
BLANK = 0x20


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter and a blank otherwise."""
    points = np.full(0x110000, BLANK, dtype=np.uint32)
    # Surrogates are no characters; letters end with the third supplementary plane.
    letters = [c for c in range(0x40000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    points[letters] = letters
    return points


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts: bucket and text number of each, and letters per text.

    Texts are lower-cased, runs of anything but letters count as one blank, and n-grams
    without a letter are left out. No n-gram reaches over the end of a text.
    """
    joined = np.frombuffer("".join(f" {t.lower()} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter((len(t.lower()) + 2 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    chars = _letters()[joined]
    blank = chars == BLANK
    letters = np.bincount(owner[~blank], minlength=len(texts))
    single = np.ones(len(chars), dtype=bool)
    single[1:] = ~(blank[1:] & blank[:-1] & (owner[1:] == owner[:-1]))
    chars, owner, blank = chars[single], owner[single], blank[single]
    buckets, owners = [], []
    rolled = np.zeros(len(chars), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :] * np.uint32(0x9E3779B1)
        if n not in ORDERS:
            continue
        inside = owner[: len(rolled)] == owner[n - 1 :]
        if n == 1:
            inside &= ~blank
        mixed = rolled[inside] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        buckets.append((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS))
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(buckets), np.concatenate(owners), letters


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # language x bucket

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior probability (equal priors; ties to the first name)."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        buckets, owner, letters = ngrams(texts)
        total = np.stack([np.bincount(owner, weights=row[buckets], minlength=len(texts)) for row in self.log_prob])
        best = total.argmax(axis=0)
        odds = np.exp(total - total.max(axis=0))
        score = odds.max(axis=0) / odds.sum(axis=0)
        known = letters > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
        return names, np.where(known, score, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = MAX_DOCS, key: str = "doc_id") -> Model:
    """Learn from the rows of ``labelled`` with a language, about ``max_docs`` of them.

    Larger tables are thinned by a hash of ``key``, so a rerun learns from the same rows.
    Null texts and null languages teach nothing. Without any row the model knows no
    language, and everything is ``und``.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        "text is not null and lang is not null"
    )
    n = rows.count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(n)) < F.lit(max_docs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                names, codes = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                buckets, owner, _ = ngrams(texts_of(batch.column("text")))
                found, times = np.unique(codes[owner].astype(np.int64) * BUCKETS + buckets, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[found // BUCKETS].astype(object), pa.string()), pa.array((found % BUCKETS).astype(np.int32)), pa.array(times)],
                    names=["lang", "bucket", "n"],
                )

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(languages) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    table = counts.toPandas()  # BUCKETS rows a language at most
    matrix = np.full((len(languages), BUCKETS), 0.5)
    matrix[table["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64), table["bucket"].to_numpy(dtype=np.int64)] += table["n"].to_numpy(dtype=float)
    return Model(languages, np.log(matrix / matrix.sum(axis=1, keepdims=True)) if languages else matrix)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lang_pred`` and ``score`` of every whole text after the columns ``keep``.

    A null text and one without letters are ``und`` with score 0. A text in an unknown script
    gets the language that is nearest. A kept column of the name of a new one is dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    inner = [f"c{i}" for i in range(len(kept))]  # names that no column can clash with
    body = inner[kept.index(text)] if text in kept else "text"  # a kept text is sent once

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, body, SCORED):
                names, values = shared.value.predict(texts_of(batch.column(body)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in inner), pa.array(names, pa.string()), pa.array(values)], names=[*inner, "lang_pred", "score"])

    kinds = "".join(f"{i} {docs.schema[c].dataType.simpleString()}, " for i, c in zip(inner, kept, strict=True))
    source = docs.select(*(F.col(f"`{c}`").alias(i) for i, c in zip(inner, kept, strict=True)), *([F.col(text).alias("text")] if body == "text" else []))
    return source.mapInArrow(score, f"{kinds}lang_pred string, score double").toDF(*kept, "lang_pred", "score")


def known_language(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text has no language; a null ``lang`` takes the predicted one.

    A model that knows no language tells only texts without letters: others stay, and a null
    ``lang`` stays null.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = dict(zip(docs.columns, names, strict=True))
    if not model.languages:
        # Any model of one language calls a text without letters unknown, and no other one.
        model = Model([""], np.zeros((1, BUCKETS)))
    found = identify(docs.toDF(*names), model, renamed[text], tuple(names)).where(F.col("lang_pred") != UNKNOWN)
    filled = found.withColumn(renamed[lang], F.coalesce(F.col(renamed[lang]), F.nullif("lang_pred", F.lit(""))))
    return filled.select(*names).toDF(*docs.columns)
