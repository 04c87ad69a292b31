import hashlib
import random
import re
import struct

import duckdb
from edge import LONG, documents, empty
from pyspark.sql import functions as F

from sunmelt.llm import langid, media, pii, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = queries.op4_language_id(spark, SF).toPandas()
    known = duckdb.connect().execute(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").df()
    held = got.merge(known, on="doc_id").query("held_out")
    assert len(got) == len(known) and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_language_of_odd_documents(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert {got[i] for i in (1, 2, 3, 7)} == {"und"} and got[4] == "de"
    kept = langid.known_language(docs, model)
    assert kept.columns == docs.columns and kept.where("lang is null").count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {0, 4, 5, 6, 8, None}
    none = langid.fit(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def test_without_any_known_language_only_texts_without_letters_go(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    kept = langid.known_language(docs, langid.fit(docs))
    assert kept.columns == docs.columns and kept.where("lang is not null").count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {0, 4, 5, 6, 8, None}


def test_toxicity_of_held_out_documents(spark):
    got = queries.op8_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = duckdb.connect().execute("SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").df()
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    assert held.query("predicted == 1")["toxic"].mean() > 0.9
    assert (got["predicted"] == (got["score"] >= 0.5)).all()


def test_factors_learn_a_pair_that_neither_term_shows(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(1200):
        a, b = rnd.random() < 0.3, rnd.random() < 0.3
        text = " ".join(["filler"] * 3 + ["insult"] * a + ["group"] * b)
        rows.append((i, text, int(a and b)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df)
    both, one, other, neither = model.score(["insult group", "insult", "group", ""])
    assert both > 0.9 and max(one, other, neither) < 0.2


def test_a_pair_whose_single_words_are_not_clearly_off_is_learned(spark):
    rnd, rows = random.Random(5), []
    for i in range(8000):
        words = {f"w{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for _ in range(30)}
        # 2 % toxic: other insults, and 12 texts with both words; each word in 200 texts.
        pair = ["mild", "group"] if i < 12 else ["mild"] if i < 200 else ["group"] if i < 388 else []
        toxic = i < 12 or 1000 <= i < 1140
        rows.append((i, " ".join([*words, *pair, *(["insult"] if 1000 <= i < 1140 else [])]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df, df)
    both, mild, group, insult, neither = model.score(["some mild group", "some mild", "some group", "some insult", "some"])
    assert min(both, insult) > 0.8 and max(mild, group, neither) < 0.2


def test_toxicity_of_odd_documents(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, None), (5, 7), (None, 1), (99, 1)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.fit(docs, labels.limit(0))
    assert max(r["score"] for r in toxicity.score(docs, none).collect()) < 0.01
    assert toxicity.score(empty(spark), model).count() == 0


def test_containers_keep_every_byte(spark):
    docs = documents(spark)
    stored = media.mux(docs)
    got = media.probe(stored, keep=("doc_id", "n_bytes")).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["payload_bytes"] == len(payload)
        assert r["error"] is None and r["codec"] == "raw " and r["samples"] == len(payload)
        assert [(k["end"] - k["start"]) for k in r["key_frames"]] == [len(payload)]
    assert media.mux(empty(spark)).count() == 0 and len(got) == len(list(docs.collect()))


def test_key_frames_of_a_track_with_sizes_chunks_and_sync_samples():
    sizes, chunks = [10, 20, 30, 40, 50], [100, 200]
    table = media.box(
        b"stbl",
        media.full_box(b"stsd", 0, struct.pack(">I", 1), media.box(b"avc1", bytes(8))),
        media.full_box(b"stts", 0, struct.pack(">III", 1, 5, 2)),
        media.full_box(b"stsc", 0, struct.pack(">I", 2), struct.pack(">6I", 1, 2, 1, 2, 3, 1)),
        media.full_box(b"stsz", 0, struct.pack(">II", 0, 5), struct.pack(">5I", *sizes)),
        media.full_box(b"co64", 0, struct.pack(">I", 2), struct.pack(">2Q", *chunks)),
        media.full_box(b"stss", 0, struct.pack(">I", 3), struct.pack(">3I", 1, 2, 4)),
    )
    head = media.full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, 50, 10, 0, 0))
    movie = media.box(b"moov", media.box(b"trak", media.box(b"mdia", head, media.box(b"minf", table))))
    (track,) = media.read_tracks(movie + bytes(400))
    assert track.codec == "avc1" and track.duration / track.scale == 0.2
    assert track.offsets.tolist() == [100, 110, 200, 230, 270]
    assert track.ranges(only_keys=True) == [(100, 130), (230, 270)]
    assert track.ranges(only_keys=False) == [(100, 130), (200, 320)]


def test_broken_containers_are_told_apart(spark):
    whole = media.container(b"x" * 64)
    rows = [(1, bytearray(whole[:200])), (2, None), (3, bytearray(b"")), (4, bytearray(b"\0\0\0\4junk")), (5, bytearray(whole))]
    got = {r["doc_id"]: r for r in media.probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1]["error"] and got[4]["error"] and got[2]["media_bytes"] is None
    assert got[3]["samples"] == 0 and got[5]["samples"] == 64


def luhn(number):
    total = 0
    for place, digit in enumerate(map(int, reversed(number))):
        total += digit if place % 2 == 0 else sum(divmod(2 * digit, 10))
    return total % 10 == 0


def base_spans(text):
    """The four kinds by their patterns, one after the other."""
    plain = lambda m: re.sub("[^0-9]", "", m[0])
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(plain(m)) <= 19 and luhn(plain(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(plain(m)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m)]


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(8)
    pieces = ["4111111111111111", "4111 1111 1111 1111", "+1 (523) 555-1055", "10.0.0.1", "999.1.1.1", "0010.1.2.3", "a.b@c.d", "a@b.c_d@e.f", "@", ".", "+", "-",
              " ", "x", "é", "12", "7", "😀", "a@b", "%", "+49 30 1234567", "call ", "1.2.3.4.5.6.7.8.9", "--", "call (212) 555-1234", "me [at] mail [dot] com"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14))) for _ in range(1500)] + ["9" * 4000, "a" * 20000 + "@b.c", LONG, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    got = pii.find(df).select("doc_id", F.transform("spans", lambda s: F.struct(F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")).alias("t"), s["base"].alias("base"))).alias("s"))
    for r in got.collect():
        assert [s["t"] for s in r["s"] if s["base"]] == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_reliabilities_find_the_better_labeler(spark):
    from pyspark.sql import Row

    rows = []
    for truth, n in ((1, 400), (-1, 600)):
        for wrong in (False, True):
            share = 0.1 if wrong else 0.9
            for context in (1, -1, 0):
                rows.append(Row(kind=0, rule=-truth if wrong else truth, gazetteer=truth, context=context, spaced=0, n=int(n * share / 3)))
    right, belief = pii.reliabilities(rows)
    assert right[0, "gazetteer"][0] > 0.9 and right[0, "gazetteer"][0] > right[0, "context"][0]
    assert belief[(0, 1, 1, 1)] > 0.9 > 0.2 > belief[(0, -1, -1, -1)]


def test_redaction_of_odd_documents(spark):
    docs = documents(spark)
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {r["doc_id"]: r["text"] for r in got.collect()}
    assert rows[0] == "The quick brown fox, write to <EMAIL> or <PHONE> now."
    assert rows[1] is None and rows[2] == "" and rows[4] == LONG
    assert pii.redact(empty(spark)).count() == 0 and pii.find(empty(spark)).count() == 0


def test_a_kept_text_is_sent_once_to_be_identified(spark):
    docs = spark.createDataFrame([(1, "der Hund und die Katze"), (2, None), (3, "the dog and the cat")], "doc_id long, text string")
    model = langid.fit(docs.selectExpr("*", "if(doc_id = 1, 'de', 'en') AS lang"))
    kept, plain = (langid.identify(docs, model, keep=k) for k in (("doc_id", "text"), ("doc_id",)))
    assert "AS text#" not in kept._jdf.queryExecution().analyzed().toString().split("MapInArrow", 1)[1]
    assert sorted(map(tuple, kept.drop("text").collect())) == sorted(map(tuple, plain.collect()))
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {r["doc_id"]: r["text"] for r in docs.collect()}
