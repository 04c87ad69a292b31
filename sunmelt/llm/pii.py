"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Three labelers vote on each: the strict rules of its kind, a
gazetteer (top-level domains, calling codes, card issuers, reserved addresses) and the words
before it. Expectation-maximisation over the counts of vote patterns estimates how often each
labeler is right, and its beliefs train a logistic span classifier. Spans that pass the
strict rules are always reported; the classifier adds others that it believes in.

Only counts by vote pattern and shape reach the driver: their number is bounded by the
number of possible patterns, whatever the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "gazetteer", "context")
SPAN = "struct<start:int,end:int,m:string>"
CUE_CHARS = 24

# The patterns of the four kinds. Those for email and card are written so that no match is
# tried twice from the same run of characters and no repetition needs a stack: the part
# before @ cannot hold an @, and a run of it starts where the character before it does not
# belong to it, or where the last match ended.
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What the classifier may add: addresses spelled out, and numbers without a calling code.
SPELLED_EMAIL = rf"(?<!{LOCAL}){LOCAL}++ ?[\[(] ?at ?[\])] ?{LABEL}++(?: ?[\[(] ?dot ?[\])] ?{LABEL}++)++"
LOCAL_PHONE = r"(?<![0-9.+()-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"

# Gazetteers.
DOMAINS = "com org net edu gov mil int info biz io eu us uk de fr es it nl be ch at pl pt se no fi dk ie ca au nz jp cn in br mx ar ru"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 351 352 353 354 358 420"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|35|6011|65|62)"
RESERVED = r"^(?:0|127|255|22[4-9]|23[0-9])\."
CUES = {
    "email": r"mail|contact|write to|reply|correo|courriel",
    "ip": r"\bip\b|host|server|addr|login|client|ping",
    "card": r"card|visa|master|credit|debit|pay|tarjeta|carte|karte",
    "phone": r"phone|tel\b|tel[.:]|call|fax|mobil|cell|whatsapp|ruf",
}
DOUBTS = r"version|\bv\.?\s*$|isbn|issn|order|invoice|serial|page|\bid\b|token|ref\b|\bno\.\s*$|hash|doi"


def spans(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """Leftmost matches that do not overlap, with start and end in code points.

    The text between the matches and the matches themselves add up to the positions.
    """
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        a = state["at"] + F.length(piece["gap"])
        b = a + F.coalesce(F.length(piece["m"]), F.lit(0))
        add = F.array(F.struct(a.alias("start"), b.alias("end"), piece["m"].alias("m")))
        keep = piece["m"].isNotNull() & wanted(piece["m"])
        return F.struct(b.alias("at"), F.when(keep, F.concat(state["found"], add)).otherwise(state["found"]).alias("found"))

    return F.aggregate(pieces, start, step)["found"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True for a string of digits whose Luhn sum is a multiple of ten."""
    def value(i: Column) -> Column:
        d = F.substr(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(number) - i) % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1)))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def candidates(text: Column) -> Column:
    """Proposed spans with their kind (number in KINDS), whether they are base spans, votes and shape."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    n_digits = lambda m: F.length(digits(m))
    anything = lambda m: F.lit(True)
    has_digits = text.rlike("[0-9]")
    part_ok = lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4
    octet = lambda p: part_ok(p) & (F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255)
    rules: list[tuple[int, Column, str, Callable, Callable]] = [
        (0, F.contains(text, F.lit("@")), EMAIL, anything, lambda m: F.lit(True)),
        (1, has_digits, IP, anything, lambda m: F.forall(F.split(m, r"\."), octet)),
        (2, has_digits, CARD, lambda m: n_digits(m).between(13, 19), lambda m: luhn(digits(m))),
        (3, F.contains(text, F.lit("+")), PHONE, anything, lambda m: n_digits(m).between(9, 15)),
    ]
    strict = [
        F.transform(F.when(possible, spans(text, pattern, wanted)).otherwise(none), _proposal(kind, valid))
        for kind, possible, pattern, wanted, valid in rules
    ]
    loose = [
        F.transform(F.when(text.rlike(sign), spans(text, pattern, anything)).otherwise(none), _proposal(kind, None))
        for kind, sign, pattern in ((0, r"[\[(] ?at ?[\])]", SPELLED_EMAIL), (3, r"[0-9][ .-][0-9]{4}", LOCAL_PHONE))
    ]
    return F.transform(F.concat(*strict, *loose), lambda c: _voted(text, c))


def _proposal(kind: int, valid: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    """A match as a proposed span; without ``valid`` it is one that only the classifier can accept."""

    def make(s: Column) -> Column:
        base = F.coalesce(valid(s["m"]), F.lit(False)) if valid else F.lit(False)
        return F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"),
            base.alias("base"), F.lit(valid is None).alias("loose"),
        )

    return make


def _voted(text: Column, c: Column) -> Column:
    m, kind = c["m"], c["kind"]
    start = F.greatest(c["start"] - CUE_CHARS, F.lit(0))
    before = F.lower(F.substr(text, start + 1, c["start"] - start))
    known = lambda words, value: F.lit(f" {words} ").contains(F.concat(F.lit(" "), value, F.lit(" ")))
    call = F.regexp_extract(m, r"^\+(\d{1,3})", 1)
    prefix = known(CALLING, F.substr(call, F.lit(1), F.lit(1))) | known(CALLING, F.substr(call, F.lit(1), F.lit(2))) | known(CALLING, call)
    area = digits(m).rlike("^[2-9][0-9]{2}[2-9]")
    last = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind == 0, F.when(known(DOMAINS, last), 1).otherwise(0))
        .when(kind == 1, F.when(m.rlike(RESERVED), -1).otherwise(0))
        .when(kind == 2, F.when(digits(m).rlike(ISSUERS), 1).otherwise(-1))
        .when(c["loose"], F.when(area, 1).otherwise(-1))
        .otherwise(F.when(prefix, 1).otherwise(-1))
    )
    cue = F.lit(False)
    for i, name in enumerate(KINDS):
        cue = cue | ((kind == i) & before.rlike(CUES[name]))
    inside = before.rlike("[A-Za-z0-9]$") | F.substr(text, c["end"] + 1, F.lit(1)).rlike("[A-Za-z0-9]")
    context = F.when(inside, -1).when(cue, 1).when(before.rlike(DOUBTS), -1).otherwise(0)
    rule = F.when(c["base"], 1).when(c["loose"], 0).otherwise(-1)
    spaced = m.rlike("[^A-Za-z0-9@.]").cast("int")
    return F.struct(
        kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"),
        rule.alias("rule"), gazetteer.alias("gazetteer"), context.alias("context"), spaced.alias("spaced"),
    )


@dataclass
class Model:
    """Reliabilities of the labelers and the weights of the span classifier."""

    reliability: dict[tuple[int, str], tuple[float, float]]  # right if the span is one, if it is not
    weights: dict[str, float]

    def belief(self, c: Column) -> Column:
        raw = F.lit(self.weights["bias"]) + sum(
            (F.when(c["kind"] == k, F.lit(self.weights[name])).otherwise(F.lit(0.0)) for k, name in enumerate(KINDS)), F.lit(0.0)
        )
        for name in (*LABELERS, "spaced"):
            raw = raw + c[name] * F.lit(self.weights[name])
        return 1 / (1 + F.exp(-raw))


def reliabilities(rows: Sequence[Row], rounds: int = 50) -> tuple[dict, dict]:
    """Expectation-maximisation for two classes: how often each labeler's vote is right, by kind.

    ``rows`` are counts by kind and votes; 0 is no vote. Labelers start, and are held, near
    being mostly right by ten imagined votes each. Also gives the belief of each pattern.
    """
    right = {(k, name): (0.8, 0.8) for k in range(len(KINDS)) for name in LABELERS}
    prior = {k: 0.5 for k in range(len(KINDS))}
    belief: dict[tuple, float] = {}
    for _ in range(rounds):
        for r in rows:
            yes, no = prior[r["kind"]], 1 - prior[r["kind"]]
            for name in LABELERS:
                a, b = right[r["kind"], name]
                yes, no = (yes * a, no * (1 - b)) if r[name] > 0 else (yes * (1 - a), no * b) if r[name] < 0 else (yes, no)
            belief[_pattern(r)] = yes / (yes + no)
        for k in range(len(KINDS)):
            mine = [r for r in rows if r["kind"] == k]
            total = sum(r["n"] for r in mine)
            prior[k] = (sum(r["n"] * belief[_pattern(r)] for r in mine) + 1) / (total + 2)
            for name in LABELERS:
                voted = [r for r in mine if r[name]]
                yes = sum(r["n"] * belief[_pattern(r)] for r in voted)
                yes_right = sum(r["n"] * belief[_pattern(r)] for r in voted if r[name] > 0)
                no = sum(r["n"] * (1 - belief[_pattern(r)]) for r in voted)
                no_right = sum(r["n"] * (1 - belief[_pattern(r)]) for r in voted if r[name] < 0)
                right[k, name] = ((yes_right + 8) / (yes + 10), (no_right + 8) / (no + 10))
    return right, belief


def _pattern(r: Row) -> tuple:
    return (r["kind"], *(r[name] for name in LABELERS))


def fit(proposed: DataFrame, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Train on the column ``spans`` of proposed spans. Without spans all weights are 0."""
    shapes = proposed.select(F.explode("spans").alias("s")).select("s.*")
    counts = shapes.groupBy("kind", *LABELERS, "spaced").agg(F.count(F.lit(1)).alias("n")).collect()  # 4 * 27 * 2 rows at most
    rows = sorted(counts, key=lambda r: tuple(r[:-1]))
    right, belief = reliabilities(rows)
    weights = dict.fromkeys(("bias", *KINDS, *LABELERS, "spaced"), 0.0)
    total = sum(math.sqrt(r["n"]) for r in rows) or 1.0
    for _ in range(rounds):
        slope = {name: decay * w for name, w in weights.items()}
        for r in rows:
            x = {"bias": 1.0, KINDS[r["kind"]]: 1.0, "spaced": float(r["spaced"])} | {name: float(r[name]) for name in LABELERS}
            raw = sum(weights[name] * v for name, v in x.items())
            wrong = math.sqrt(r["n"]) / total * (1 / (1 + math.exp(-max(-40.0, min(40.0, raw)))) - belief[_pattern(r)])
            for name, v in x.items():
                slope[name] += wrong * v
        weights = {name: w - rate * slope[name] for name, w in weights.items()}
    return Model(right, weights)


def decide(proposed: Column, model: Model, least: float = 0.5) -> Column:
    """Base spans and those added, by kind and start. Added ones overlap no base span."""
    base = F.filter(proposed, lambda c: c["base"])
    free = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter(proposed, lambda c: ~c["base"] & (model.belief(c) > least) & free(c))
    short = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))
    return F.array_sort(F.transform(F.concat(base, added), short))


def find(docs: DataFrame, model: Model | None = None, text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base) of every whole text.

    A null text is an empty one and has no spans. Rows are independent but for the model,
    which is trained on all of ``docs`` if it is not given. Other columns are dropped.
    """
    from sunmelt.runtime import written_table

    proposed = written_table(docs.select("doc_id", candidates(F.col(text)).alias("spans")))
    model = model or fit(proposed)
    return proposed.select("doc_id", decide(F.col("spans"), model).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind, as in ``<EMAIL>``.

    Spans that overlap are replaced together, under the kind of the first. A null text stays
    null; all other columns stay as they are.
    """
    from sunmelt.runtime import written_table

    whole = F.col(text)
    model = fit(written_table(docs.select(candidates(whole).alias("spans"))))
    tag = lambda kind: F.element_at(F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]), kind + 1)

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        out = F.concat(state["out"], F.substr(whole, state["at"] + 1, s["start"] - state["at"]), tag(s["kind"]))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(state["out"]).alias("out"))

    by_start = lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(b["end"] - a["end"]).cast("int"))
    found = F.array_sort(decide(candidates(whole), model), by_start)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(found, start, step, lambda s: F.concat(s["out"], F.substr(whole, s["at"] + 1, F.length(whole))))
    return docs.withColumn(text, F.when(whole.isNotNull(), cleaned))
