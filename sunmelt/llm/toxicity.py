"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(bias + sum of weights + sum over pairs of terms of <v_i, v_j>), over the
distinct terms of the whole text, so that two terms can count together what neither counts
alone. Terms are hashed to ``BUCKETS``; those whose texts are labelled 1 clearly more or less
often than others take part (at most ``TERMS``, the clearest), and so do those of pairs whose
texts are, other than their single terms explain (at most ``TERMS`` more). The rest count
nothing. So a long text does not add up chance, and the model has a bounded size.
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
from sunmelt.runtime import attach, cut_lineage

BITS = 20
BUCKETS = 1 << BITS
TERMS = 2_048
MIN_TEXTS = 8  # training texts that a term must occur in
MIN_ODD = 5.0  # deviations from the expected share of ones: chance in a million buckets
MIN_PAIR = 20.0  # of a pair, texts times divergence of the share of ones: exp(-20) by chance at most
FACTORS = 4
MAX_DOCS = 20_000  # expected number of training texts at most
EPOCHS = 60
BATCH = 256
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    flags = np.zeros(0x110000, dtype=bool)
    flags[[c for c in range(0x40000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
    return flags


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every distinct term of each text, in order of text.

    Terms are runs of letters of the lower-cased text. They are hashed together: with
    H the running sum of char * P**place, a run's hash is its part of H times P**-start.
    """
    lowered = [t.lower() + " " for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _letters()[chars]
    edges = np.diff(np.r_[False, inside, False].astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    running = np.r_[np.uint64(0), np.cumsum(chars * _powers(PRIME, len(chars)), dtype=np.uint64)]
    hashed = (running[end] - running[start]) * _powers(INVERSE, len(chars))[start]
    bucket = ((hashed ^ (hashed >> np.uint64(31))) * PRIME >> np.uint64(64 - BITS)).astype(np.int64)
    last = np.cumsum([len(t) for t in lowered])
    owner = np.searchsorted(last, start, side="right")
    found = np.unique(owner * BUCKETS + bucket)
    return found % BUCKETS, found // BUCKETS


@dataclass
class Model:
    buckets: np.ndarray  # those that take part, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        bucket, owner = terms(texts)
        at = np.minimum(np.searchsorted(self.buckets, bucket), max(len(self.buckets) - 1, 0))
        known = self.buckets[at] == bucket if len(self.buckets) else np.zeros(len(bucket), bool)
        return _sigmoid(_raw(at[known], owner[known], len(texts), self.bias, self.weights, self.factors)[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _raw(at: np.ndarray, owner: np.ndarray, n: int, bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores, and the sums of the factors that the gradient needs."""
    add = lambda v: np.bincount(owner, weights=v, minlength=n)
    sums = np.stack([add(column[at]) for column in factors.T], axis=1) if len(at) else np.zeros((n, factors.shape[1]))
    squares = add((factors[at] ** 2).sum(axis=1)) if len(at) else np.zeros(n)
    linear = add(weights[at]) if len(at) else np.zeros(n)
    return bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def train(rows: list[np.ndarray], labels: np.ndarray, n_terms: int, seed: int = 3, decay: float = 2e-4, rate: float = 0.2) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit bias, weights and factors by AdaGrad on log loss over mini-batches."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    bias, weights, factors = float(np.log(share / (1 - share))), np.zeros(n_terms), rng.normal(0, 0.02, (n_terms, FACTORS))
    seen = [1e-6, np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            at = np.concatenate([rows[j] for j in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[j]) for j in pick])
            raw, sums = _raw(at, owner, len(pick), bias, weights, factors)
            wrong = (_sigmoid(raw) - labels[pick]) / len(pick)
            slope = wrong.sum()
            seen[0] += slope**2
            bias -= rate * slope / seen[0] ** 0.5
            if not len(at):
                continue
            used, place = np.unique(at, return_inverse=True)
            for k, values, pull in (
                (1, weights, np.bincount(place, weights=wrong[owner], minlength=len(used))),
                (2, factors, np.stack([np.bincount(place, weights=wrong[owner] * (sums[owner, f] - factors[at, f]), minlength=len(used)) for f in range(FACTORS)], axis=1)),
            ):
                pull = pull + decay * values[used]
                seen[k][used] += pull**2
                values[used] -= rate * pull / np.sqrt(seen[k][used])
    return bias, weights, factors


def pair_terms(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Buckets of pairs whose share of ones is neither that of one term nor of both added up.

    ``flat`` are the buckets of all texts, ``sizes`` their number in each. One of a pair is
    among the ``TERMS`` terms of oddest share, clear or not; the other is any term. Both occur
    together in ``MIN_TEXTS`` texts. The clearest pairs choose first.
    """
    often = np.bincount(flat, minlength=BUCKETS) >= MIN_TEXTS
    buckets = np.flatnonzero(often)
    if not len(buckets):
        return np.zeros(0, np.int64)
    keep = often[flat]
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[keep]
    codes = (np.cumsum(often, dtype=np.int32) - 1)[flat[keep]]
    count, prior = np.bincount(codes, minlength=len(buckets)), labels.mean()
    share = np.bincount(codes, weights=labels[owner], minlength=len(buckets)) / count
    odd = np.abs(share - prior) * np.sqrt(count)
    anchors = np.lexsort((buckets, -odd))[:TERMS]
    share = (share * count + prior) / (count + 1)  # no share is 0 or 1
    logit = np.log(share / (1 - share))
    ends = np.searchsorted(owner, np.arange(len(sizes) + 1))
    by_term = owner[np.argsort(codes, kind="stable")]
    firsts = np.r_[0, np.cumsum(count)]
    found = []
    for a in anchors:
        texts = by_term[firsts[a] : firsts[a + 1]]
        words = ends[texts + 1] - ends[texts]
        at = np.concatenate([codes[ends[t] : ends[t + 1]] for t in texts])
        both = np.bincount(at, minlength=len(buckets))
        near = np.flatnonzero(both >= MIN_TEXTS)
        near = near[near != a]
        n = both[near]
        seen = np.bincount(at, weights=np.repeat(labels[texts], words), minlength=len(buckets))[near] / n
        added = _sigmoid(logit[a] + logit[near] - np.log(prior / (1 - prior)))
        clear = n * np.min([_divergence(seen, e) for e in (np.full(len(near), share[a]), share[near], added)], axis=0)
        found += [(-c, buckets[a], buckets[b]) for c, b in zip(clear.tolist(), near.tolist(), strict=True) if c >= MIN_PAIR]
    chosen: dict[int, None] = {}
    for _, a, b in sorted(found):
        if len(chosen) > TERMS - 2:
            break
        chosen |= {int(a): None, int(b): None}
    return np.array(sorted(chosen), dtype=np.int64)


def _divergence(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Of a share of ones from another one that is neither 0 nor 1."""
    part = lambda p, q: p * np.log(np.maximum(p, 1e-300) / q)
    return part(seen, expected) + part(1 - seen, np.maximum(1 - expected, 1e-300))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", max_docs: int = MAX_DOCS) -> Model:
    """Learn from the texts of about ``max_docs`` rows of ``labels`` (doc_id and ``label``).

    More labels are thinned by a hash of the doc_id before the texts are looked up, so a rerun
    learns from the same rows. Labels other than 0 and 1 and those of unknown documents teach
    nothing; a null text is an empty one. Without both labels the model is a constant that
    gives everything the only label, or 0 where there are no rows.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    n = chosen.count()
    if n > max_docs:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(n)) < F.lit(max_docs))
    rows = attach(docs.select("doc_id", F.col(text).alias("text")), cut_lineage(chosen), ["doc_id"], "inner")
    ones, zeros = rows.agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1))).first()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                bucket, owner = terms(texts_of(batch.column("text")))
                ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))], names=["label", "buckets"])

    if not ones or not zeros:
        return Model(np.zeros(0, np.int64), 40.0 if ones else -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    found = cut_lineage(rows.select("label", "text").mapInArrow(hashed, "label int, buckets array<int>"))
    all_ = F.count(F.lit(1))
    prior = ones / (ones + zeros)
    # How many deviations the share of ones lies from its expected value.
    odd = F.abs(F.avg("label") - F.lit(prior)) * F.sqrt(all_ / F.lit(prior * (1 - prior)))
    clear = (
        found.withColumn("bucket", F.explode("buckets")).groupBy("bucket").agg(all_.alias("n"), odd.alias("z"))
        .where((F.col("n") >= MIN_TEXTS) & (F.col("z") >= MIN_ODD))
        .orderBy(F.desc("z"), "bucket").limit(TERMS)
    )
    buckets = np.sort(np.array([r[0] for r in clear.select("bucket").collect()], dtype=np.int64))
    sample = found.toArrow()  # about max_docs rows of distinct terms
    lists = sample.column("buckets").combine_chunks()
    flat, sizes, labels = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), sample.column("label").to_numpy().astype(float)
    buckets = np.union1d(buckets, pair_terms(flat, sizes, labels))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[buckets] = np.arange(len(buckets))
    at, ends = place[flat], np.r_[0, np.cumsum(sizes)]
    sets = [known[known >= 0].astype(np.int64) for known in (at[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))]
    order = sorted(range(len(sets)), key=lambda i: (sets[i].tobytes(), labels[i]))
    return Model(buckets, *train([sets[i] for i in order], labels[order], len(buckets)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1) of every whole text; other columns are dropped.

    A null text is an empty one; an empty text gets the score of having no terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(texts_of(batch.column("text"))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
