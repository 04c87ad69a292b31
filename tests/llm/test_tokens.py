import base64
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from edge import documents, empty
from tokenizers import Tokenizer

from sunmelt.llm import bpe, token_store
from sunmelt.runtime import checkpoint_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "the", "The", "é", "ñ", "1", "42", " ", "  ", "\n", "\t", ".", ",", "'", "'s", "!!", "中", "😀", "\x1c", "́", "_", "-", "<|endoftext|>"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def model():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(25))) for _ in range(n)]


def test_perfect_hash_is_minimal(coder):
    hashed = coder.whole
    assert sorted(hashed.slots) == list(range(len(coder.tokens)))
    assert all(hashed.find(t) == i for i, t in enumerate(coder.tokens))


def test_codes_equal_the_library(coder, model):
    for text in [*random_texts(4000, 1), "x" * 500, "ab" * 3000]:
        raw = coder.encode(text)
        ids = list(struct.unpack(f"<{len(raw) // 4}i", raw))
        assert ids == model.encode_ordinary(text), text
        assert coder.decode(ids) == text.encode()


def test_encoding_and_decoding_of_odd_documents(spark, coder, model):
    docs = documents(spark)
    encoded = bpe.encode(docs, coder, keep=("doc_id", "text"))
    decoded = bpe.decode(encoded, coder, keep=("text",)).collect()
    assert len(decoded) == docs.count()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in decoded)
    assert all(r["ids"] == model.encode_ordinary(r["text"] or "") for r in encoded.collect())
    assert bpe.encode(empty(spark), coder).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bpe.decode(null, coder).first()["decoded"] is None


def test_word_encoder_equals_the_library():
    plain, mine = Tokenizer.from_file(WORDS), token_store.WordEncoder(open(WORDS, encoding="utf-8").read())
    texts = random_texts(3000, 2)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<i4").tobytes() for t in texts]
    assert mine.encode(texts) == want and mine.encode(texts) == want


def test_each_different_part_of_a_batch_is_looked_up_once():
    plain, mine = Tokenizer.from_file(WORDS), token_store.WordEncoder(open(WORDS, encoding="utf-8").read())
    asked, own = [], mine._parts_of
    mine._parts_of = lambda parts: asked.extend(parts) or own(parts)
    texts = ["the cat and the cat.", None, "", "the\ncat and\tthe  cat"] * 50
    got = mine.encode_column(pa.array(texts, pa.string()), [2])
    assert got.to_pylist() == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert sorted(asked) == sorted({"", "the", "cat", "cat.", "and", "and\tthe"})
    assert mine.encode_column(pa.array([], pa.string()), [2]).to_pylist() == []
    assert mine.encode_column(pa.array(texts, pa.string()).slice(1, 2), [2]).to_pylist() == [[2], [2]]


def test_token_files_of_odd_documents(spark):
    path = f"{checkpoint_dir(spark)}/odd-tokens"
    docs = documents(spark)
    token_store.write_ids(docs, WORDS, path)
    got = token_store.describe(token_store.read_ids(spark, path)).orderBy("start").collect()
    assert len(got) == docs.count() and [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert {r["doc_id"]: r["n_tokens"] for r in got}[1] == 1
    (found,) = token_store.find_ids(spark, path, [7]).collect()
    assert found["ids"] == [*Tokenizer.from_file(WORDS).encode("1234 5678 !!", add_special_tokens=False).ids, 2]
    token_store.write_ids(empty(spark), WORDS, f"{path}-none")
    assert token_store.describe(token_store.read_ids(spark, f"{path}-none")).count() == 0
