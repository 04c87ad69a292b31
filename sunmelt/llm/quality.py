"""Text quality: a sparse ensemble of rules over statistics of the text, as column expressions.

Shallow trees are grown on a sample of labelled texts. Every path from a root to a node, leaf
or not, is a rule: a conjunction of intervals of statistics. A logistic model with an L1
penalty weighs the rules and the statistics themselves; most weights become zero. What is left
is compiled into one Spark expression, so that scoring stays in the JVM and needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.runtime import attach, cut_lineage, delete_table, written_table

MAX_DOCS = 20_000  # expected number of training texts at most
TREES = 24
DEPTH = 3
PENALTY = 2e-3
SEED = 7

#: Bounds of one statistic in a rule: above the first, at most the second.
Bounds = tuple[float, float]
Rule = tuple[tuple[str, Bounds], ...]
EDGE = float("inf")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


#: Blanks between words, as in a class of a pattern; of no letter, digit, mark or sign counted here.
BLANKS = r"\x20\x09-\x0D"
#: The first character of a word that is neither letter nor mark nor punctuation, and the word's rest.
ODD = rf"[^\p{{L}}\p{{M}}.,;:!?'’(){BLANKS}-][^{BLANKS}]*+"
#: A word of two characters or more without small letters, up to its first capital.
SHOUTED = rf"(?<![^{BLANKS}])(?=[^\p{{Ll}}{BLANKS}]{{2,}}+(?![^{BLANKS}]))[^\p{{Lu}}{BLANKS}]*+\p{{Lu}}"


def _left(text: Column | str, removed: str) -> Column:
    """Characters that stay when runs of ``removed`` go."""
    return F.length(F.regexp_replace(text, removed, ""))


def _ended(words: Column) -> Column:
    """Words that end with a mark, or with one and a line break that is no blank (as ``$`` allows)."""
    spaced = F.concat(F.array_join(words, " "), F.lit(" "))
    cut = lambda mark: F.length(spaced) - F.length(F.replace(spaced, F.lit(f"{mark} "), F.lit(" ")))
    breaks = [F.contains(spaced, F.lit(c)) for c in "\u0085\u2028\u2029"]
    one_by_one = F.size(F.filter(words, lambda w: w.rlike("[.!?]$")))
    return F.when(breaks[0] | breaks[1] | breaks[2], one_by_one).otherwise(cut(".") + cut("!") + cut("?"))


def _parts() -> dict[str, Column]:
    """What several statistics share; ``_text`` is the text, ``_words`` and ``_lines`` its parts,
    ``_joined`` the words without blanks and ``_signs`` what is no letter in them."""
    words, joined, signs = F.col("_words"), F.col("_joined"), F.col("_signs")
    return {
        "_n": F.size(words).cast("double"),
        "_letters": (F.length(joined) - F.length(signs)).cast("double"),
        "_solid": F.length(joined).cast("double"),
        "_pairs": F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)),
        "_sizes": F.transform(words, F.length),
    }


def _statistics() -> dict[str, Column]:
    text, words, lines, n, solid, signs = (F.col(c) for c in ("_text", "_words", "_lines", "_n", "_solid", "_signs"))
    return {
        "log_words": F.log1p(n),
        "word_length": _share(solid, n),
        "longest_word": F.log1p(F.coalesce(F.array_max("_sizes"), F.lit(0))),
        "short_words": _share(F.size(F.filter("_sizes", lambda s: s <= 2)), n),
        "distinct_words": _share(F.size(F.array_distinct(words)), n),
        "distinct_pairs": _share(F.size(F.array_distinct("_pairs")), n),
        "repeated_words": _share(F.size(F.filter(F.slice(words, 2, F.size(words)), lambda w, i: w == F.get(words, i))), n),
        "letters": _share(F.col("_letters"), solid),
        "capitals": _share(_left("_joined", r"\P{Lu}+"), F.col("_letters")),
        "digits": _share(_left(signs, r"\P{Nd}+"), solid),
        "symbols": _share(_left(signs, r"[\p{N}.,;:!?'()-]+"), solid),
        "punctuation": _share(_left(signs, r"[^.,;:!?]+"), solid),
        "ended_words": _share(_ended(words), n),
        "odd_words": _share(F.regexp_count(text, F.lit(ODD)), n),
        "shouted_words": _share(F.regexp_count(text, F.lit(SHOUTED)), n),
        "log_lines": F.log1p(F.size(lines).cast("double")),
        "distinct_lines": _share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": F.log1p(_share(n, F.size(lines))),
    }


STATISTICS = (
    "log_words", "word_length", "longest_word", "short_words", "distinct_words", "distinct_pairs", "repeated_words", "letters",
    "capitals", "digits", "symbols", "punctuation", "ended_words", "odd_words", "shouted_words", "log_lines", "distinct_lines", "line_words",
)


def statistics(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of every whole text. A null text is an empty one, whose
    statistics are all 0; no statistic is ever null or NaN."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    held = [f"_keep{i}" for i in range(len(keep))]
    df = docs.select(*kept, whole.alias("_text"))
    lines = F.filter(F.split("_text", r"[\x0A-\x0D]+"), lambda line: line.rlike(r"[^\x20\x09]"))
    df = df.select(*held, "_text", F.array_remove(F.split("_text", f"[{BLANKS}]+"), "").alias("_words"), lines.alias("_lines"))
    df = df.withColumn("_joined", F.array_join("_words", "")).withColumn("_signs", F.regexp_replace("_joined", r"\p{L}+", ""))
    df = df.withColumns(_parts())
    found = _statistics()
    df = df.select(*held, *[found[s].cast("double").alias(s) for s in STATISTICS])
    return df.withColumnsRenamed(dict(zip(held, keep, strict=True)))


@dataclass
class Model:
    """Weights of rules and of statistics (centred and scaled to the sample's quantiles)."""

    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    linear: list[tuple[str, Bounds, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        for name, bounds, weight in self.linear:
            total = total + _clipped(name, bounds) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(total, F.lit(40.0)), F.lit(-40.0))))


def holds(rule: Rule) -> Column:
    """A rule as a condition."""
    condition = F.lit(True)
    for name, (low, high) in rule:
        if low > -EDGE:
            condition = condition & (F.col(name) > F.lit(low))
        if high < EDGE:
            condition = condition & (F.col(name) <= F.lit(high))
    return condition


def _clipped(name: str, bounds: Bounds) -> Column:
    return F.least(F.greatest(F.col(name), F.lit(bounds[0])), F.lit(bounds[1]))


def tree_rules(described: str, names: Sequence[str]) -> list[Rule]:
    """The paths of described trees (``toDebugString``) as distinct rules, in order of appearance.

    Conditions on the same statistic are merged to one interval.
    """
    path: list[tuple[int, str, str, float]] = []
    found: dict[Rule, None] = {}
    for line in described.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m is None:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, Bounds] = {}
        for _, name, sign, at in path:
            low, high = bounds.get(name, (-EDGE, EDGE))
            bounds[name] = (low, min(high, at)) if sign == "<=" else (max(low, at), high)
        found[tuple(sorted(bounds.items()))] = None
    return list(found)


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", max_docs: int = MAX_DOCS,
    trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY,
) -> Model:
    """Learn from the texts of about ``max_docs`` rows of ``labels`` (doc_id and ``label``).

    More labels are thinned by a hash of the doc_id before the texts are looked up, so a rerun
    learns from the same rows. Labels other than 0 and 1 and those of unknown documents teach
    nothing. Without both labels the model is a constant that gives everything the only label,
    or 0 where there are no rows. Both labels weigh alike in the trees, and as often as they
    come in the weights. Runs jobs when called.
    """
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("_label in (0, 1) and doc_id is not null")
    n = chosen.count()
    if n > max_docs:
        chosen = chosen.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(n)) < F.lit(max_docs))
    rows = attach(docs.select("doc_id", F.col(text).alias("_body")), cut_lineage(chosen), ["doc_id"], "inner")
    sample = written_table(statistics(rows, "_body", ["_label"]).coalesce(8))
    facts = sample.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_label").alias("ones"),
        *[F.percentile_approx(s, [0.025, 0.975], 1000).alias(s) for s in STATISTICS],
    ).first()
    ones, zeros = facts["ones"] or 0, facts["rows"] - (facts["ones"] or 0)
    if not ones or not zeros:
        return Model(40.0 if ones else -40.0)
    weight = F.when(F.col("_label") == 1, F.lit(0.5 / ones)).otherwise(F.lit(0.5 / zeros)) * F.lit(facts["rows"])
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="_x").transform(sample.withColumn("_weight", weight))
    forest = RandomForestClassifier(
        featuresCol="_x", labelCol="_label", weightCol="_weight", numTrees=trees, maxDepth=depth,
        featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=SEED,
    ).fit(vectors)
    rules = tree_rules(forest.toDebugString, STATISTICS)
    spans = {s: tuple(facts[s]) for s in STATISTICS if facts[s][1] > facts[s][0]}
    terms = {f"_r{i}": holds(r).cast("double") for i, r in enumerate(rules)} | {f"_l_{s}": _clipped(s, b) for s, b in spans.items()}
    table = sample.select("_label", F.array(*terms.values()).alias("_terms"))
    table = table.select("_label", array_to_vector("_terms").alias("_x"))
    lasso = LogisticRegression(featuresCol="_x", labelCol="_label", elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(table)
    weights = lasso.coefficients.toArray().tolist()
    delete_table(sample)
    return Model(
        float(lasso.intercept),
        [(r, w) for r, w in zip(rules, weights) if w],
        [(s, b, w) for (s, b), w in zip(spans.items(), weights[len(rules):], strict=True) if w],
    )


def score(docs: DataFrame, model: Model, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``score`` (0 to 1) of every whole text, a null text as an empty one."""
    return statistics(docs, text, keep).select(*keep, model.column().alias("score"))
