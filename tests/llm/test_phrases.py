import random
import re
from collections import Counter

import numpy as np
import pytest
from edge import documents, empty

from sunmelt.llm import oracle, phrases, queries
from sunmelt.workload.check import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bits", [(2, 0), (7, 0), (31, 31), (64, 0), (34, 34), (64, 64)])
def test_filters_are_lossless(bits):
    rnd = np.random.default_rng(sum(bits))
    for shared in {0, 1, min(bits[0], 5)}:
        for size in (0, 1, 2, 900):
            pairs = [tuple(int(v) % (1 << b) for v, b in zip(rnd.integers(0, 1 << 62, 2), bits)) for _ in range(size)]
            pairs += [p for p in pairs[:3] for _ in range(400)]
            free = bits[0] - shared
            pairs = [((1 << free if shared else 0) | (a & ((1 << free) - 1)), b) for a, b in pairs]
            first, second = (np.array([p[i] for p in pairs], dtype=np.uint64) for i in (0, 1))
            found = phrases.QuotientFilter.of(bits, first, second)
            back = phrases.QuotientFilter.unpack(found.pack(shared), bits, shared, 1 if shared else 0)
            assert dict(zip(zip(back.first.tolist(), back.second.tolist()), back.counts.tolist())) == Counter(pairs)
            halves = [phrases.QuotientFilter.of(bits, first[i::2], second[i::2]) for i in (0, 1)]
            merged = phrases.QuotientFilter.merged(halves)
            assert (merged.first == found.first).all() and (merged.counts == found.counts).all()


@pytest.mark.parametrize("word_bits", [1, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_word_numbers_are_packed_invertibly(n, word_bits):
    rnd = np.random.default_rng(n)
    words = [rnd.integers(0, 1 << word_bits, 500).astype(np.uint64) for _ in range(n)]
    layout = phrases.Layout(n, word_bits)
    first, second = layout.encode(words)
    assert int(first.max()) < 1 << layout.bits[0] and int(second.max()) < max(1 << layout.bits[1], 1)
    assert (layout.decode(first, second) == np.stack(words, axis=1).astype(np.int64)).all()
    if word_bits == 1:
        every = [np.array([i >> k & 1 for i in range(1 << n)], dtype=np.uint64) for k in range(n)]
        assert len(set(zip(*(v.tolist() for v in layout.encode(every))))) == 1 << n


def brute(rows, least, inside, best):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in kept.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in kept.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= inside * a for b in longer):
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, text, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, text.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def rows_of(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, inside, best, slice_bytes", [(3, 80, 2000, 1 << 20), (2, 50, 15, 300)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, inside, best, slice_bytes):
    monkeypatch.setattr(phrases, "SLICE", slice_bytes)
    monkeypatch.setattr(phrases, "FILTER", 50 if slice_bytes == 300 else 1 << 19)
    monkeypatch.setattr(phrases, "BLOCK", 64 if slice_bytes == 300 else 1 << 19)
    rnd = random.Random(least)
    words = ["a", "A", "b", "b\x01", "É", "é", "New", "york", "the", "x-y", "中文", "b'", "\x85"]
    rows = []
    for i in range(150):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\x0b"]) for _ in range(rnd.randrange(0, 40)))
        rows.append((text, rnd.choice(["en", "en", "en", "fr", None, "und"])))
    rows += [("the big apple pie is here", "en")] * 9 + [("big apple pie", "en"), (None, "en"), ("", "fr"), ("...", None), ("solo", "de")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    got = rows_of(phrases.collocations(df, least, inside, best))
    assert got == brute(rows, least, inside, best) and len(got) > 20


def test_registered_query_equals_its_sql(spark):
    assert compare(queries.op12_phrases(spark, SF), oracle.oracle_sql()["op12_phrases"], SF) is None


def test_odd_documents(spark):
    docs = documents(spark)
    got = rows_of(phrases.collocations(docs, least=2))
    assert got == brute([(r["text"], r["lang"]) for r in docs.collect()], 2, 80, 2000)
    assert any(p == "wort wort wort wort" for _, _, p, *_ in got)
    assert phrases.collocations(docs, least=10**6).count() == 0
    assert phrases.collocations(empty(spark)).count() == 0
