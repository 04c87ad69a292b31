"""Registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmelt.llm import bpe, langid, lattice, media, merkle, mixing, oracle, phrases, pii, quality, simhash, substring, token_store, toxicity
from sunmelt.llm.common import fold, table
from sunmelt.runtime import attach, checkpoint_dir, written_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written_table(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")))
    draws, targets = mixing.mix(sized)
    uses = draws.groupBy("doc_id").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key")
    by_source = targets.select(key, "source_size", "target")
    return (
        attach(sized.select("doc_id", "size", key), by_source, ["_key"])
        .join(uses, "doc_id", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold("doc_id", 4) != 2))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/tokens/{uuid.uuid4().hex}"
    token_store.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_store.describe(token_store.read_ids(spark, path))


def byte_coder() -> bpe.Coder:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Coder(ranks, public_tokenizers.PATTERN)


def token_digests(docs: DataFrame, coder: bpe.Coder) -> DataFrame:
    encoded = bpe.encode(docs, coder).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    decoded = bpe.decode(encoded, coder, keep=("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), byte_coder())


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", predicted)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.mux(table(spark, sf_dir, "documents"))
    facts = media.probe(stored, keep=("doc_id", "n_bytes"))
    ranges = F.array_join(F.transform("key_frames", lambda r: F.concat_ws("-", r["start"], r["end"])), "+")
    feature = F.concat_ws(";", "codec", F.col("duration").cast("string"), F.col("samples").cast("string"), ranges)
    return facts.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs, labels)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return quality.score(docs, model).select("doc_id", held_out, "score", predicted)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    forged = [c if i != 3 else F.col("n_chars").cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)") for i, c in enumerate(columns)]
    tampered = fold("doc_id", 7) == 0
    leaves = written_table(docs.select("doc_id", "lang", merkle.leaf(*columns).alias("leaf"), F.when(tampered, merkle.leaf(*forged)).alias("forged")))
    proofs = merkle.manifest(leaves, ["doc_id"])
    folded = proofs.withColumn("folded_root", merkle.fold(F.coalesce("forged", "leaf"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_simhash": op2_simhash,
        "op3_passages": op3_passages,
        "op4_language_id": op4_language_id,
        "op5_token_ids": op5_token_ids,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_embeddings": op7_embeddings,
        "op8_toxicity": op8_toxicity,
        "op9_media": op9_media,
        "op10_pii": op10_pii,
        "op11_quality": op11_quality,
        "op12_phrases": op12_phrases,
        "op13_merkle": op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
