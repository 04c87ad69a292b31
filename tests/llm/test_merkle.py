import hashlib
import zlib

import pytest
from edge import documents, empty
from pyspark.sql import functions as F

from sunmelt.llm import merkle, oracle, queries
from sunmelt.workload.check import compare

SF = "/root/testdata/sf0.01"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, arity):
    """Top of a tree, and for each leaf the (left, right) digests of every level."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, above = [], []
        for i in range(0, len(nodes), arity):
            run = nodes[i : i + arity]
            for j in range(len(run)):
                for leaf in owners[i + j]:
                    proofs[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
            ups.append(h(*run))
            above.append([leaf for o in owners[i : i + arity] for leaf in o])
        nodes, owners = ups, above
    return nodes[0], proofs


def brute(rows, arity):
    """(doc_id, leaf): (subroot, root, proof) of rows (doc_id, lang, leaf)."""
    groups = {}
    for doc_id, lang, leaf in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(lang, []).append((doc_id, leaf))
    tops = {g: tree([x for _, x in members], arity) for g, members in groups.items()}
    root, over = tree([t for t, _ in tops.values()], arity)
    return root, sorted(
        (str(d), x, tops[g][0], tuple(p + q))
        for (g, members), q in zip(groups.items(), over) for (d, x), p in zip(members, tops[g][1])
    )


@pytest.mark.parametrize("arity, levels", [(2, 2), (2, 10), (3, 1), (4, 2)])
def test_manifest_equals_brute_force(spark, arity, levels):
    rows = [(i, f"l{i % 3}" if i % 50 else None, h(str(i))) for i in range(151)] + [(1000 + i, "big", h(f"b{i}")) for i in range(130)]
    rows += [(7, "one", h("one")), (None, "l1", h("n")), (5, "twice", h("t")), (5, "twice", h("t")), (5, "twice", h("u")), (1, "é", h("e"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5)
    got = merkle.manifest(df, ["doc_id"], arity=arity, levels=levels).collect()
    root, want = brute(rows, arity)
    assert {r["root"] for r in got} == {root}
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], tuple(tuple(s) for s in r["proof"])) for r in got) == want
    folded = merkle.manifest(df, ["doc_id"], arity=arity, levels=levels).where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root"))
    assert folded.count() == 0


def test_registered_query_equals_its_sql(spark):
    assert compare(queries.op13_merkle(spark, SF), oracle.oracle_sql()["op13_merkle"], SF) is None


def test_tampered_rows_and_only_they_fail(spark):
    got = queries.op13_merkle(spark, SF).collect()
    assert {r["doc_id"] for r in got if not r["verified"]} == {i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_odd_documents(spark, tmp_path):
    documents(spark).withColumns({c: F.lit("clash") for c in ("leaf", "root", "proof", "_group", "_at", "_h", "_n")}).write.parquet(str(tmp_path / "documents.parquet"))
    docs = documents(spark).collect()
    got = queries.op13_merkle(spark, str(tmp_path)).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"])])
    root, want = brute([(r["doc_id"], r["lang"], leaf(r)) for r in docs], 2)
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"]) for r in got) == [w[:3] for w in want] and {r["root"] for r in got} == {root}
    proofs = {(w[0], w[1]): h(*[a + b for a, b in w[3]]) for w in want}
    for r in got:
        if r["doc_id"] != 6:  # the two rows that are alike have two places
            assert r["proof_sha256"] == proofs[str(r["doc_id"]), r["leaf"]]
    forged = {r["doc_id"] for r in docs if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None}
    assert {r["doc_id"] for r in got if not r["verified"]} == forged
    (tmp_path / "none").mkdir()
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_merkle(spark, str(tmp_path / "none")).count() == 0
