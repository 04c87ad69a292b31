import random

import duckdb
import pytest
from edge import documents, empty
from pyspark.sql import functions as F

from sunmelt.llm import quality, queries

SF = "/root/testdata/sf0.1"


def test_quality_of_held_out_documents(spark):
    got = queries.op11_quality(spark, SF).toPandas()
    labels = duckdb.connect().execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert len(got) == 10_000 and (held["predicted"] == held["quality"]).mean() > 0.98
    assert (held.query("quality == 0")["predicted"] == 0).mean() > 0.95
    assert (got["predicted"] == (got["score"] >= 0.5)).all() and got["score"].between(0, 1).all()


def test_statistics_equal_brute_force(spark):
    rows = {r["doc_id"]: r for r in quality.statistics(spark.createDataFrame([
        (1, "The THE the cat sat. The cat!\nThe THE the cat sat. The cat!\nx1 %% É"), (2, None), (3, ""), (4, " \n\t"),
    ], "doc_id long, text string")).collect()}
    for odd in (2, 3, 4):
        assert all(rows[odd][s] == 0.0 for s in quality.STATISTICS)
    got, words = rows[1], "The THE the cat sat. The cat! The THE the cat sat. The cat! x1 %% É".split()
    n, solid = len(words), sum(map(len, words))
    pairs = list(zip(words, words[1:])) + [(words[-1], None)]
    want = {
        "word_length": solid / n, "short_words": 3 / n, "distinct_words": len(set(words)) / n,
        "distinct_pairs": len(set(pairs)) / n, "repeated_words": 0.0, "digits": 1 / solid, "symbols": 2 / solid,
        "capitals": (2 * (1 + 3 + 1) + 1) / (solid - 4 - 3), "ended_words": 4 / n, "odd_words": 2 / n,  # x1 and %%
        "shouted_words": 2 / n, "distinct_lines": 2 / 3, "punctuation": 4 / solid,
    }
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_words_are_counted_in_whole_texts_as_one_by_one(spark):
    rnd = random.Random(5)
    some = ["a", "B", "ß", "É", "ǅ", "𝐀", "٣", "Ⅷ", "1", ".", "!", "?", ",", "’", "-", " ", "  ", "\n", "\t", "\x0b", "\x85", "\u2028", "\u3000", "́", "😀", "%", "NASA", "x. "]
    docs = spark.createDataFrame([(i, "".join(rnd.choice(some) for _ in range(rnd.randrange(30)))) for i in range(2000)], "doc_id long, text string")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    one_by_one = {
        "ended_words": lambda w: w.rlike("[.!?]$"),
        "odd_words": lambda w: w.rlike(r"[^\p{L}\p{M}.,;:!?'’()-]"),
        "shouted_words": lambda w: (F.length(w) > 1) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"),
    }
    want = docs.select("doc_id", *[F.when(F.size(words) > 0, F.size(F.filter(words, f)) / F.size(words)).otherwise(F.lit(0.0)).alias(s) for s, f in one_by_one.items()])
    found = quality.statistics(docs)
    assert found.select(want.columns).exceptAll(want).isEmpty() and want.where("shouted_words > 0 and odd_words > 0 and ended_words > 0").count() > 100
    # Six lambdas: sizes, short words, repeated words, pairs, lines and, for rare line breaks only, ended words.
    assert found._jdf.queryExecution().analyzed().toString().count("lambdafunction(") <= 6


def test_paths_of_a_tree_become_rules():
    text = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 0.5)
   If (feature 0 <= 0.25)
    Predict: 0.0
   Else (feature 0 > 0.25)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 1 <= 3.0)
    Predict: 0.0
   Else (feature 1 > 3.0)
    Predict: 1.0
"""
    inf = float("inf")
    assert quality.tree_rules(text, ["a", "b"]) == [
        (("a", (-inf, 0.5)),), (("a", (-inf, 0.25)),), (("a", (0.25, 0.5)),), (("a", (0.5, inf)),),
        (("a", (0.5, inf)), ("b", (-inf, 3.0))), (("a", (0.5, inf)), ("b", (3.0, inf))),
    ]


def test_compiled_score_equals_the_sum_of_its_rules(spark):
    inf = float("inf")
    model = quality.Model(0.25, [((("a", (0.0, 1.0)), ("b", (-inf, 2.0))), 1.5), ((("b", (2.0, inf)),), -2.0)], [("a", (0.0, 3.0), 0.5)])
    rnd = random.Random(1)
    rows = [(rnd.uniform(-1, 4), rnd.uniform(0, 4)) for _ in range(200)] + [(0.0, 2.0), (1.0, 2.0)]
    got = spark.createDataFrame(rows, "a double, b double").select("a", "b", model.column().alias("s")).collect()
    for a, b, s in got:
        raw = 0.25 + 1.5 * (0 < a <= 1 and b <= 2) - 2.0 * (b > 2) + 0.5 * min(max(a, 0.0), 3.0)
        assert s == pytest.approx(1 / (1 + 2.718281828459045**-raw))


def test_a_rule_of_two_statistics_is_learned(spark):
    rnd, rows = random.Random(4), []
    for i in range(600):
        loud, short = rnd.random() < 0.5, rnd.random() < 0.5
        word = "ab" if short else "abcdefgh"
        rows.append((i, " ".join([word.upper() if loud else word] * rnd.randrange(20, 40)), int(loud != short)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(df, df)
    got = quality.score(df, model).join(df, "doc_id").select(((F.col("score") >= 0.5).cast("int") == F.col("label")).alias("ok"))
    assert got.where("ok").count() > 590 and any(len(rule) > 1 for rule, _ in model.rules)


def test_odd_documents(spark):
    docs = documents(spark)
    rows = [(i, i % 2) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8)] + [(5, 1), (99, 1), (0, None), (None, 1), (7, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1  # null as empty
    assert quality.score(empty(spark), model).count() == 0
    only = quality.fit(docs, labels.where("label = 1"))
    assert {r["score"] > 0.99 for r in quality.score(docs, only).collect()} == {True}
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] < 0.01 for r in quality.score(docs, none).collect()} == {True}
