import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edge import documents, empty
from pyspark.sql import functions as F

from sunmelt.llm import lattice, simhash, substring
from sunmelt.runtime import checkpoint_dir, scratch


def groups(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_golay_keys_meet_at_two_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.int64)
    flips = [np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64) for _ in range(2)]
    near = (fps.view(np.uint64) ^ flips[0] ^ flips[1]).view(np.int64)
    a, b = (set(zip(*(x.tolist() for x in simhash.keys(f)), strict=True)) for f in (fps, near))
    assert {row for _, row in a & b} == set(range(3000))
    leader, around = simhash._leaders()
    assert len(set(leader.tolist())) == 2048 and around.shape[1] == 5


@pytest.mark.parametrize("paired", [2, 24])
def test_links_join_what_brute_force_joins(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    fps = {int(f) for f in base.view(np.int64)}
    for f in base[:12]:
        for _ in range(30):
            g = f
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                g = g ^ (np.uint64(1) << np.uint64(bit))
            fps.add(int(np.array([g]).view(np.int64)[0]))
    links = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2]
    assert groups(fps, [(r["a"], r["b"]) for r in links]) == groups(fps, near)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)


def words_of(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def jaccard(a, b, k=5):
    x, y = ({tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_similar_documents_equal_brute_force(spark):
    rnd = random.Random(7)
    texts = []
    for _ in range(25):
        base = words_of(rnd, rnd.randrange(60, 300))
        texts.append(base)
        for edits in (0, 1, 1, 2, 3, 6, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = "changed"
            texts.append(copy)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    near = [(i, j) for i in range(len(texts)) for j in range(i) if i // 8 == j // 8 and jaccard(texts[i], texts[j]) >= 0.8]
    assert got == groups(range(len(texts)), near)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got.values())


@pytest.mark.parametrize("turns", [0, 3])
def test_crowded_sample_keys_lose_no_link(spark, monkeypatch, turns):
    monkeypatch.setattr(simhash, "TURNS", turns)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rnd = random.Random(11)
    texts = []
    for _ in range(2):
        base = words_of(rnd, 300)
        for _ in range(150):
            copy = list(base)
            for at in rnd.sample(range(300), rnd.randrange(4, 12)):
                copy[at] = f"x{rnd.randrange(100_000)}"
            texts.append(copy)
    line = words_of(rnd, 40)  # in many texts that are not alike
    texts += [line + words_of(rnd, 20) for _ in range(100)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if len(x & y) >= 0.8 * len(x | y)]
    assert got == groups(range(len(texts)), near)


def test_fingerprints_of_odd_documents(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    named = {r["doc_id"]: r for r in got}
    assert named[1]["fingerprint"] == "0" * 16 and named[3]["component_id"] == 1
    assert named[6]["component_id"] == 5
    one = xxhash.xxh64_hexdigest(b"1234 5678 !!", 42)
    assert named[7]["fingerprint"] == one
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 4, 5, 7, 8] and ids.count(None) == 2
    assert simhash.one_of_each(empty(spark)).count() == 0


def brute_passages(docs, least=50):
    """Documents that share ``least`` words in a row with another one."""
    seen = {}
    for i, words in docs.items():
        for k in range(len(words) - least + 1):
            seen.setdefault(tuple(words[k : k + least]), set()).add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def test_passages_are_found_and_clean_documents_are_not(spark):
    rnd = random.Random(9)
    docs = {i: words_of(rnd, rnd.randrange(20, 400)) for i in range(120)}
    passage, fuzzy = words_of(rnd, 55), words_of(rnd, 80)
    for i in range(0, 30):
        docs[i] = docs[i][:10] + passage + docs[i][10:]
    for i in range(40, 50):
        copy = list(fuzzy)
        copy[rnd.randrange(20, 60)] = "odd"
        docs[i] = docs[i] + copy
    docs[60] = list(docs[61])
    docs[61] = docs[61] if len(docs[61]) >= 50 else docs[61] + words_of(rnd, 60)
    docs[60] = list(docs[61])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = substring.repeated_passages(df).collect()
    found = {r["doc_id"] for r in got} | {r["partner_id"] for r in got}
    assert found == brute_passages(docs, 45) | set(range(40, 50))
    for r in got:
        a, b = docs[r["doc_id"]][r["start"] : r["end"]], docs[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        assert min(len(a), len(b)) >= 50 and r["similarity"] >= 0.8
        assert sum(x in b for x in a) >= 0.75 * len(a)
    assert {(r["start"], r["end"]) for r in got if r["doc_id"] in range(1, 30)} == {(10, 65)}


def test_chains_equal_a_quadratic_search():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        a, b = rng.integers(0, 60, n), rng.integers(0, 60, n)
        best = [float(substring.K)] * n
        order = np.lexsort((b, a))
        for i, x in enumerate(order):
            for j, y in enumerate(order[:i]):
                if a[y] < a[x] and b[y] < b[x]:
                    best[i] = max(best[i], best[j] + substring.K - substring.GAP_COST * (a[x] - a[y] + b[x] - b[y]))
        chains = substring.chains(a, b)
        top = 0.0
        for chain in chains:
            p, q = a[chain], b[chain]
            assert (np.diff(p) > 0).all() and (np.diff(q) > 0).all()
            top = max(top, substring.K * len(chain) - substring.GAP_COST * (p[-1] - p[0] + q[-1] - q[0]))
        assert top == pytest.approx(max(best)) or (not chains and max(best) == substring.K)


def test_chains_within_the_span_equal_a_quadratic_search():
    rng, span = np.random.default_rng(1), substring.SPAN
    for _ in range(120):
        points = np.unique(rng.integers(0, int(rng.choice([40, 150, 400])), (int(rng.integers(1, 60)), 2)), axis=0)
        a, b = rng.permutation(points).T
        order, best = np.lexsort((b, a)), []
        for i in order:
            near = [best[k] - substring.GAP_COST * (a[i] - a[j] + b[i] - b[j]) for k, j in enumerate(order[: len(best)]) if 0 < a[i] - a[j] <= span and 0 < b[i] - b[j] <= span]
            best.append(substring.K + max([0.0, *near]))
        top = float(substring.K)
        for chain in substring.chains(a, b):
            steps = np.r_[np.diff(a[chain]), np.diff(b[chain])]
            assert steps.min() > 0 and steps.max() <= span
            top = max(top, substring.K * len(chain) - substring.GAP_COST * steps.sum())
        assert top == pytest.approx(max(best))


def test_chains_of_a_dense_grid_of_matches_take_little_time():
    x, y = np.divmod(np.arange(150 * 150), 150)
    start = time.perf_counter()
    assert max(len(c) for c in substring.chains(x, y)) == 150
    assert time.perf_counter() - start < 10


def two_passages(rnd, first, gap, second):
    """Two texts that share two passages with other words between them."""
    one, two = words_of(rnd, first), words_of(rnd, second)
    other = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    return [other(20) + one + other(gap) + two + other(20) for _ in range(2)]


@pytest.mark.parametrize("gap", [30, 70, 100, 150, 500])
def test_matches_beyond_a_gap_start_a_chain(gap):
    a, b = (substring.word_hashes(" ".join(w).encode()) for w in two_passages(random.Random(gap), 120, gap, 60))
    (x, p), (y, q) = substring.seeds(a), substring.seeds(b)
    pairs = np.array([(p[i], q[j]) for i in range(len(x)) for j in np.flatnonzero(y == x[i])])
    found = substring.chains(pairs[:, 0], pairs[:, 1])
    assert sum(len(c) for c in found) == len(pairs)
    assert len(found) == (1 if gap == 30 else 2)


def test_two_passages_of_a_pair_are_both_found(spark):
    rnd, docs = random.Random(21), {}
    cases = [(120, 30, 60), (60, 40, 60), (60, 60, 60), (120, 70, 60), (120, 150, 60), (120, 500, 60), (5, 20, 55), (55, 20, 5)]
    for i, case in enumerate(cases):
        docs[2 * i], docs[2 * i + 1] = two_passages(rnd, *case)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = substring.repeated_passages(df).collect()
    for i, (first, gap, second) in enumerate(cases):
        rows = [r for r in got if r["doc_id"] == 2 * i + 1]
        assert all(r["partner_id"] == 2 * i for r in rows)
        covered = {p for r in rows for p in range(r["start"], r["end"])}
        ends = [(20, 20 + first), (20 + first + gap, 20 + first + gap + second)]
        assert all(set(range(s, e)) <= covered for s, e in ends if e - s >= 50)
        assert len({(r["start"], r["end"]) for r in rows}) == len(rows)


@pytest.mark.parametrize("hot", [3, 2_000])
def test_passages_whose_seeds_occur_earlier_elsewhere(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rnd = random.Random(31)
    passage = words_of(rnd, 60)
    # Each seed of the passage lies alone in some earlier document, in another order.
    runs = [passage[i : i + 6] for i in range(55)]
    rnd.shuffle(runs)
    docs = {i: words_of(rnd, 30) + run + words_of(rnd, 30) for i, run in enumerate(runs)}
    docs |= {i: words_of(rnd, 40) + passage + words_of(rnd, 40) for i in (100, 101)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["partner_id"], r["start"], r["end"]) for r in substring.repeated_passages(df).collect()}
    assert got == {(101, 100, 40, 100)}


@pytest.mark.parametrize("hot", [3, 100, 2_000])
def test_passages_whose_seeds_occur_elsewhere_first_and_between(spark, monkeypatch, hot):
    """Neither the first document of a seed nor the one before holds the passage, of which they have pieces."""
    monkeypatch.setattr(substring, "HOT", hot)
    rnd = random.Random(32)
    passage, docs = words_of(rnd, 60), {}
    for begin in (0, 200, 400):  # before, between and after the two that hold it
        runs = [passage[i : i + 6] for i in range(55)]
        rnd.shuffle(runs)
        docs |= {begin + i: words_of(rnd, 30) + run + words_of(rnd, 30) for i, run in enumerate(runs)}
    docs |= {i: words_of(rnd, 40) + passage + words_of(rnd, 40) for i in (100, 101, 300)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = sorted((r["doc_id"], r["partner_id"], r["start"], r["end"]) for r in substring.repeated_passages(df).collect())
    assert got == [(101, 100, 40, 100), (300, 100, 40, 100), (300, 101, 40, 100)]


@pytest.mark.parametrize("hot", [2, 7, 1_000])
def test_every_two_documents_of_a_seed_are_matched(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "ASKING", 5)
    rng = random.Random(hot)
    rows = sorted((rng.randrange(9), f"d{rng.randrange(15)}", rng.randrange(4)) for _ in range(200))
    names = "seed long, doc_id string, place int"
    many = {s for s in range(9) if sum(r[0] == s for r in rows) > hot}
    few = pa.RecordBatch.from_pylist([{"seed": s, "doc_id": d, "place": p} for s, d, p in rows], pa.schema([("seed", pa.int64()), ("doc_id", pa.string()), ("place", pa.int32())]))
    got = [r for b in substring._match_rows(hot, every=True)([few]) for r in b.to_pylist() if r["partner_id"] is not None]
    got = [(r["doc_id"], r["partner_id"], r["place"], r["partner_place"]) for r in got]
    got += [tuple(r) for r in substring._of_hot_seeds(spark.createDataFrame([r for r in rows if r[0] in many], names)).collect()]
    assert sorted(got) == sorted((d, e, p, q) for s, d, p in set(rows) for t, e, q in set(rows) if s == t and e < d)


def test_recall_of_passages_with_many_edits(spark):
    rnd, docs = random.Random(41), {}
    other = lambda n: [f"x{rnd.randrange(10**9)}" for _ in range(n)]
    cases = [(n, every) for n, every in ((60, 6), (60, 7), (56, 8), (80, 7), (70, None)) for _ in range(40)]
    for i, (n, every) in enumerate(cases):
        words = words_of(rnd, n)
        places = range(every - 1, n - 1, every) if every else rnd.sample(range(1, n - 1), n * 15 // 100)
        copy = list(words)
        for at in places:
            copy[at] = f"y{rnd.randrange(10**9)}"
        docs[2 * i], docs[2 * i + 1] = other(30) + words + other(30), other(40) + copy + other(20)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = {(r["doc_id"], r["partner_id"]) for r in substring.repeated_passages(df).collect()}
    by_case = {}
    for i, case in enumerate(cases):
        by_case.setdefault(case, []).append((2 * i + 1, 2 * i) in found)
    recall = {case: sum(hits) / len(hits) for case, hits in by_case.items()}
    print(recall)
    assert min(recall.values()) >= 0.95


def test_passages_of_odd_documents(spark):
    docs = documents(spark).unionByName(documents(spark).where("doc_id = 4").withColumn("doc_id", F.lit(11).cast("long")))
    got = substring.repeated_passages(docs).collect()
    assert [(r["doc_id"], r["partner_id"], r["start"], r["end"]) for r in got] == [(11, 4, 0, 40_000)]
    assert substring.repeated_passages(empty(spark)).count() == 0


def brute_cosine(vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def test_lattice_links_equal_brute_force_for_close_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    rows = [c + rng.normal(scale=s, size=32) for c, s in zip(centres, rng.choice([0.02, 0.1, 0.15], 60), strict=True) for _ in range(6)]
    rows += [centres[0] + rng.normal(scale=0.12, size=32) for _ in range(150)]
    vectors = np.array(rows)
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, row string")
    got = lattice.near_duplicates(df).toPandas().sort_values("vec_id")
    near = brute_cosine(vectors)
    assert (got["n_links"].to_numpy() <= near.sum(axis=1)).all()
    assert got["n_links"].sum() >= 0.98 * near.sum()
    want = groups(range(len(vectors)), zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    assert (got["component_id"] == [want[i] for i in range(len(vectors))]).mean() > 0.98
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_lattice_recall_at_the_limit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = rng.normal(size=x.shape)
    g -= (g * x).sum(axis=1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1)[:, None]
    hit = np.zeros(len(x), bool)
    for t in range(lattice.TABLES):
        a, b = lattice.cells(x, t), lattice.cells(y, t)
        hit |= (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)
    assert hit.mean() >= 0.9


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(6)
    x = rng.normal(scale=2, size=(200, 8))
    p = lattice.decode(x)
    twice = np.rint(2 * p).astype(int)
    assert (np.ptp(twice % 2, axis=1) == 0).all() and (twice.sum(axis=1) % 4 == 0).all()
    own = ((x - p) ** 2).sum(axis=1)
    assert all((own <= ((x - p - root) ** 2).sum(axis=1) + 1e-9).all() for root in lattice._roots())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]),
            (8, [3.0, 3.0]), (None, [1.0, 1.1]), (9, [1.0, 1.0, 0.0]), (10, [-1.0, -1.0]), (11, [1e200, 1e200])]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    links = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"]) for r in got)
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 9, 10)]
    assert links == sorted([*alone, (0, 4, 7), (7, 4, 7), (8, 4, 7), (8, 4, 7), (11, 4, 7)])
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passages_whose_seeds_stand_elsewhere_in_the_same_partner(spark):
    """Pieces of a passage before and after it in the partner, and texts that repeat themselves."""
    rng = random.Random(11)
    fresh = lambda n: [f"{rng.randrange(16**9):x}" for _ in range(n)]
    passage = fresh(60)
    pieces = [w for i in range(0, 60, 6) for w in [*passage[i : i + 6], *fresh(20)]]
    first = [*pieces, *fresh(30), *passage, *fresh(30), *pieces]
    turning = ["tick", "tock"] * 2_990
    texts = {1: first, 2: [*fresh(40), *passage, *fresh(40)], 3: [*fresh(50), *turning], 4: [*turning, *fresh(70)]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["partner_id"]): r for r in substring.repeated_passages(df).collect() if r["end"] - r["start"] >= 60}
    at = 10 * 26 + 30
    assert (got[2, 1]["start"], got[2, 1]["end"], got[2, 1]["partner_start"], got[2, 1]["partner_end"]) == (40, 100, at, at + 60)
    assert got[4, 3]["end"] - got[4, 3]["start"] >= 5_970 and got[4, 3]["similarity"] > 0.99


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_seeds_that_occur_once_are_left_out(size):
    seed = sorted([1, 2, 2, 3, 4, 4, 4, 4, 5, 6, 7, 7])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(seed))), "seed": seed, "place": [0] * len(seed)})
    kept = substring._repeated_seeds(batch.slice(i, size) for i in range(0, len(seed), size))
    assert [d for b in kept for d in b.column("doc_id").to_pylist()] == [i for i, s in enumerate(seed) if seed.count(s) > 1]


def test_blocks_bounded_by_hashes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_HASHES", 500)
    rnd, hashes = random.Random(3), []
    for i in range(40):
        base = set(hashes[i - 1]) if i % 2 else {rnd.randrange(10**6) for _ in range(rnd.choice([20, 300]))}
        hashes.append(sorted(base | {10**7 + i}))
    sets = spark.createDataFrame(list(enumerate(hashes)), "set long, hashes array<bigint>")
    found = spark.createDataFrame([(1, i, min(i, 36), len(h)) for i, h in enumerate(hashes)], "token long, set long, to long, size int")
    got = {tuple(sorted(r)) for r in simhash._in_blocks(found, sets, 0.8).collect()}
    alike = lambda x, y: len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))
    want = {(i, j) for j in range(40) for i in range(j) if min(i, 36) != min(j, 36) and alike(hashes[i], hashes[j])}
    assert got == want and len(got) >= 18


def test_tables_of_seeds_are_deleted_when_passages_are_chained(spark):
    rnd = random.Random(8)
    line = words_of(rnd, 80)
    df = spark.createDataFrame([(i, " ".join(words_of(rnd, 20) + line)) for i in range(5)], "doc_id long, text string")
    with scratch(spark):
        found = substring.repeated_passages(df)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/tables")
        left = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        assert len(left) == 1  # the chains
        assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, 4}


def test_chains_that_stay_short_are_not_aligned(spark):
    """Of texts that share seven words only nothing goes to the alignment; a passage around as few seeds does."""
    rnd = random.Random(17)
    line, passage = words_of(rnd, 7), words_of(rnd, 60)
    docs = {i: words_of(rnd, 60) + line + words_of(rnd, 60) for i in range(6)}
    # Other documents before have most seeds of the passage, so few are matched in the two that hold it.
    docs |= {10 + i: words_of(rnd, 20) + passage[i : i + 6] + words_of(rnd, 20) for i in range(40)}
    docs |= {i: words_of(rnd, 50) + passage + words_of(rnd, 50) for i in (100, 101)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    with scratch(spark):
        found = substring.repeated_passages(df)
        (table,) = os.listdir(f"{checkpoint_dir(spark).removeprefix('file:')}/tables")
        aligned = spark.read.parquet(f"{checkpoint_dir(spark)}/tables/{table}")
        assert {(r["doc_id"], r["partner_id"]) for r in aligned.collect()} == {(101, 100)}
        assert [(r["doc_id"], r["partner_id"], r["start"], r["end"]) for r in found.collect()] == [(101, 100, 50, 110)]


def test_chains_that_are_left_out_give_no_passage():
    rnd, tried, dropped = random.Random(23), 0, 0
    for turn in range(400):
        words = [f"w{rnd.randrange(6 if turn % 3 else 3000)}" for _ in range(rnd.choice([20, 45, 70, 130]))]
        other = [w if rnd.random() > 0.08 else "x" for w in words]
        texts = words_of(rnd, rnd.choice([0, 5, 60])) + words + words_of(rnd, 60), words_of(rnd, rnd.choice([0, 9, 60])) + other + words_of(rnd, rnd.choice([0, 60]))
        a, b = (substring.word_hashes(" ".join(t).encode()) for t in texts)
        (s, p), (t, q) = substring.seeds(a), substring.seeds(b)
        pairs = np.array([(p[i], q[j]) for i in range(len(s)) for j in np.flatnonzero(t == s[i])]).reshape(-1, 2)
        picked = pairs[rnd.sample(range(len(pairs)), min(len(pairs), rnd.choice([2, 2, 4])))]
        for chain in substring.chains(picked[:, 0], picked[:, 1]):
            x, y = picked[chain].T
            if len(chain) > 2 and len(set(x - y)) > 1:
                continue
            sides = []
            for text, at in ((a, x), (b, y)):
                offset = max(0, at[0] - substring.NEAR)
                piece = text[offset : at[-1] + substring.K + substring.NEAR].astype(np.uint8)
                sides.append({k: np.array([v]) for k, v in (("start", at[0]), ("end", at[-1] + substring.K), ("offset", offset), ("begin", 0), ("size", len(piece)))} | {"words": piece})
            kept = substring._can_pass(*sides, 50, 0.8)[0]
            found = substring.passages(a, b, x.tolist(), y.tolist(), 50, 0.8)
            assert kept or not found
            tried, dropped = tried + 1, dropped + (not kept)
    assert tried > 150 and dropped > 50


def test_ways_to_score_chains_agree():
    rng = np.random.default_rng(3)
    for turn in range(200):
        n = int(rng.integers(2, 60))
        points = np.unique(rng.integers(0, 150, (n, 2)), axis=0) if turn % 2 else np.repeat(np.unique(rng.integers(0, 400, n))[:, None], 2, axis=1) + [0, 7]
        x, y = points[np.lexsort((points[:, 1], points[:, 0]))].T.tolist()
        want = substring._reached(x, y)
        assert (substring._compared(x, y) or want) == want
        assert turn % 2 or substring._linked(x, y) == want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_matches_of_seeds_in_order(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(12), f"d{rng.randrange(6)}", rng.randrange(4)) for _ in range(150))
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[1] for r in rows], "seed": [r[0] for r in rows], "place": pa.array([r[2] for r in rows], pa.int32())})
    hot = 13
    got = [r for b in substring._match_rows(hot)(batch.slice(i, size) for i in range(0, len(rows), size)) for r in b.to_pylist()]
    want, passed = [], []
    for seed in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == seed]
        if len(own) > hot:
            passed += own
            continue
        docs = sorted({r[1] for r in own})
        pairs = {(d, e) for i, d in enumerate(docs) for e in (docs[0], docs[i - 1]) if i and d != e}
        want += [(d, e, p, q) for d, e in pairs for p in {r[2] for r in own if r[1] == d} for q in {r[2] for r in own if r[1] == e}]
    assert passed and want
    assert sorted((r["seed"], r["doc_id"], r["place"]) for r in got if r["partner_id"] is None) == passed
    assert sorted((r["doc_id"], r["partner_id"], r["place"], r["partner_place"]) for r in got if r["partner_id"] is not None) == sorted(want)


def test_workers_get_few_texts_at_a_time(spark, monkeypatch):
    sizes, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    real = simhash.written_table
    monkeypatch.setattr(simhash, "written_table", lambda df: sizes.append(int(spark.conf.get(name))) or real(df))
    before = spark.conf.get(name)
    assert int(before) > 1_000
    df = spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(9)], "doc_id long, text string")
    assert simhash.one_of_each(df).count() == 3
    assert sizes[0] == 1_000 and spark.conf.get(name) == before
