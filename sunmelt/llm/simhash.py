"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most two
bits, some segment is equal in both while the one after it differs in at most one bit: so a
key made of a segment's bits and of codewords near the next segment meets its partner. The
perfect Golay code (23, 12) gives the codewords: every word lies within distance 3 of one
codeword. A word nearer than that keeps its codeword when one bit changes; a word at
distance 3 may not, and takes the five codewords at distance 4 as well. Up to 18 keys a
fingerprint are joined and the pairs verified.

A key shared by more than ``PAIRED`` fingerprints is not paired. Its fingerprints are linked
exactly in another way: two fingerprints differ in at most two bits if and only if one bit
changed (or none) in each can make them equal, so all those with the same changed form are
linked to the smallest of them. That takes 65 rows a fingerprint, whatever the group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.llm.common import by_bytes, short_batches
from sunmelt.llm.graph import components
from sunmelt.runtime import cut_lineage, written_table

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: First bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRED = 24
TURNS = 3  # rounds of representatives before what is still apart is compared in blocks
BLOCK = 256  # sets of each side of a block, about
BLOCK_HASHES = 1 << 17  # hashes in them, about
BAND_BITS, SAMPLED = 4, 3
# Fixed value: the generator polynomial of the (23, 12) Golay code.
GENERATOR = 0xAE3
LENGTH, DATA = 23, 12


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words modulo the generator."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DATA - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - (LENGTH - DATA))), left)
    return left


@cache
def _leaders() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of weight 3 at most, and the errors of weight 4 that have it.

    A syndrome of weight 3 has exactly five such errors on 23 places that share no bit with
    the leader's; others are filled up with the leader itself.
    """
    from itertools import combinations

    ones = 1 << np.arange(LENGTH, dtype=np.int64)
    leader = np.zeros(1 << (LENGTH - DATA), dtype=np.int64)
    weight = np.zeros(len(leader), dtype=np.int64)
    for w in (1, 2, 3):
        errors = np.array([sum(c) for c in combinations(ones.tolist(), w)], dtype=np.int64)
        at = _remainders(errors)
        leader[at], weight[at] = errors, w
    near = np.repeat(leader[:, None], 5, axis=1)
    errors = np.array([sum(c) for c in combinations(ones.tolist(), 4)], dtype=np.int64)
    at = _remainders(errors)
    keep = weight[at] == 3
    order = np.argsort(at[keep], kind="stable")
    at, errors = at[keep][order], errors[keep][order]
    first = np.searchsorted(at, np.flatnonzero(weight == 3))
    place = np.arange(len(at)) - np.repeat(first, np.bincount(at, minlength=len(leader))[weight == 3])
    near[at, place] = errors
    return leader, near


def codewords(words: np.ndarray) -> np.ndarray:
    """One row a word: indices of its codeword and, for words at distance 3, of those at 4.

    Two words that differ in at most one bit share an index. Rows repeat indices.
    """
    leader, near = _leaders()
    syndrome = _remainders(words)
    found = np.concatenate([(words ^ leader[syndrome])[:, None], words[:, None] ^ near[syndrome]], axis=1)
    return found >> (LENGTH - DATA)  # a codeword's upper bits are its data


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of every key of the fingerprints (signed 64-bit), each once a row."""
    bits = fingerprints.astype(np.uint64)
    cut = [((bits >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64) for start, width in SEGMENTS]
    rows = np.arange(len(bits), dtype=np.int64)
    found = []
    for i, exact in enumerate(cut):
        index = np.sort(codewords(cut[(i + 1) % len(cut)]), axis=1)
        fresh = np.concatenate([np.ones((len(index), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
        key = (np.int64(i) << 40) | (exact[:, None] << DATA) | index
        found.append((key[fresh], np.repeat(rows, index.shape[1]).reshape(index.shape)[fresh]))
    return np.concatenate([k for k, _ in found]), np.concatenate([r for _, r in found])


def shingles(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; none without words."""
    words = text.lower().split()  # of bytes: A-Z only, and the blanks of ASCII only
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)] if words else [], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-width].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def samples(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band and fingerprint of the smallest hashes of each band that has any.

    ``hashes`` ascend without repeats. A band holds the hashes with the same upper bits; texts
    of similarity J have the same ``SAMPLED`` smallest of them with a chance of about
    J**SAMPLED.
    """
    band = hashes >> np.uint64(64 - BAND_BITS)
    start = np.flatnonzero(np.diff(band, prepend=np.uint64(1 << BAND_BITS)))
    ends = np.append(start[1:], len(band))
    found = [majority(hashes[a : min(a + SAMPLED, b)]) for a, b in zip(start, ends, strict=True)] if len(band) else []
    return band[start].astype(np.int32), np.array(found, dtype=np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long) of every whole text.

    A null text has no words and so the fingerprint 0. Other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "raw"):
                found = np.array([majority(shingles(r or b"", width)) for r in batch.column("raw").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode(F.col(text), "UTF-8").alias("raw")).mapInArrow(run, f"doc_id {kind}, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints (column ``fp``, each once) at two or
    fewer differing bits, directly or through others at that distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 4096):
                key, row = keys(fp[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i : i + 4096][row])], names=["key", "fp"])

    keyed = written_table(distinct.select("fp").mapInArrow(run, "key long, fp long"))
    shared = cut_lineage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = cut_lineage(keyed.join(shared, "key"))
    few = members.where(F.col("n") <= PAIRED)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    near = pairs.where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    crowded = members.where(F.col("n") > PAIRED).select("fp").distinct()
    changed = crowded.withColumn("form", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")))
    smallest = changed.groupBy("form").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    star = changed.join(smallest, "form").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    component_id is the smallest doc_id reachable over links, the document's own included.
    Exact copies and all texts without words are linked. Null doc_ids take part like others
    but name no component (null where all members are null). Rows stay as many as they were.
    """
    marked = written_table(fingerprints(docs, text))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct)).withColumnRenamed("node", "fp")
    joined = cut_lineage(distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    roots = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(roots, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``doc_id`` and ``component_id`` by similarity of the texts' sets of word shingles.

    Two texts are linked if the Jaccard similarity of their sets is at least ``least``, which
    is verified on the whole sets. Fingerprints of whole texts as alike as that differ in 4 to
    14 bits of 64, too many for keys that stay selective; so candidates also come from
    fingerprints of samples: in each of 16 bands of the hash values, the smallest ones. A key
    of more than ``PAIRED`` different sets pairs each with the smallest first; where that leaves
    its sets in several groups, :func:`_joined` finds all links between them exactly. Texts with
    equal sets are one class and always linked; texts without words are one class too. Null
    doc_ids are as in :func:`near_duplicates`.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "raw"):
                sets, fps, bands = [], [], []
                for raw in batch.column("raw").to_pylist():
                    hashes = shingles(raw or b"", width)
                    distinct = np.unique(hashes)
                    fps.append(majority(hashes))
                    sets.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
                    band, sample = samples(distinct)
                    bands.append([{"band": b, "key": k} for b, k in zip(band.tolist(), sample.view(np.int64).tolist(), strict=True)])
                signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sets, fps)]
                kind = pa.list_(pa.struct([("band", pa.int32()), ("key", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *signed, pa.array(bands, kind)], names=["doc_id", "set", "fp", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.encode(F.col(text), "UTF-8").alias("raw"))
    with short_batches(docs.sparkSession):
        marked = written_table(source.mapInArrow(sketch, f"doc_id {kind}, set long, fp long, bands array<struct<band:int,key:long>>"))
    # One class for each set of shingles, with one document that stands for it.
    classes = cut_lineage(marked.groupBy("set").agg(F.min("doc_id").alias("first"), F.max("fp").alias("fp"), F.max("bands").alias("bands")))
    keyed = classes.select("set", F.explode("bands").alias("b")).select("set", "b.band", "b.key")
    by_key = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("set").alias("low")).where("n > 1")
    members = cut_lineage(keyed.join(by_key, ["band", "key"]))
    few = members.where(F.col("n") <= PAIRED)
    pairs = few.select("band", "key", F.col("set").alias("a")).join(few.select("band", "key", F.col("set").alias("b")), ["band", "key"]).where("a > b").select("a", "b")
    star = members.where((F.col("n") > PAIRED) & (F.col("set") != F.col("low"))).select(F.col("set").alias("a"), F.col("low").alias("b"))
    fps = classes.groupBy("fp").agg(F.min("set").alias("s"))
    of_a, of_b = fps.select(F.col("fp").alias("a"), F.col("s").alias("sa")), fps.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    alike = links(fps.select("fp")).join(of_a, "a").join(of_b, "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    same = classes.join(fps, "fp").where("set <> s").select(F.col("set").alias("a"), F.col("s").alias("b"))
    candidates = cut_lineage(pairs.unionByName(star).unionByName(alike).unionByName(same).distinct())
    found = cut_lineage(components(_verified(source, classes, candidates, width, least)).select(F.col("node").alias("set"), "root"))
    crowded = members.where(F.col("n") > PAIRED).select("band", "key", "set").join(found, "set", "left").withColumn("root", F.coalesce("root", "set"))
    apart = crowded.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band", "key")
    rest = cut_lineage(crowded.join(apart, ["band", "key"]).select("set", "root").distinct())
    if not rest.isEmpty():
        merged = _joined(rest, _hash_sets(source, classes, rest.select("set"), width), least)
        every = found.unionByName(rest).select("set", "root").distinct()
        found = cut_lineage(every.join(merged, "root", "left").select("set", F.coalesce("to", "root").alias("root")))
    joined = cut_lineage(classes.select("set", "first").join(found, "set", "left").withColumn("root", F.coalesce("root", "set")))
    roots = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.select("doc_id", "set").join(joined.join(roots, "root").select("set", "component_id"), "set").select("doc_id", "component_id")


def _hash_sets(source: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``set`` and ``hashes`` (its distinct shingle hashes) of the sets in ``wanted``, each once."""

    def hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "raw"):
                sets = [np.unique(shingles(raw or b"", width)).view(np.int64) for raw in batch.column("raw").to_pylist()]
                # A doc_id that repeats with other texts would stand for its class with each of them.
                own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                right = np.flatnonzero(own == batch.column("set").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column("set").take(pa.array(right)), pa.array([sets[i] for i in right], pa.list_(pa.int64()))], names=["set", "hashes"])

    standing = classes.join(wanted.select("set").distinct(), "set").select("set", F.col("first").alias("doc_id"))
    texts = source.join(standing, "doc_id")
    with short_batches(source.sparkSession):
        return cut_lineage(texts.select("set", "raw").mapInArrow(hash_sets, "set long, hashes array<bigint>").dropDuplicates(["set"]))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    left, right = sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("set").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(both >= F.lit(least) * (F.size("x") + F.size("y") - both)).select("a", "b")


def _verified(source: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs of sets whose Jaccard similarity is at least ``least``."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("set"))
    return _alike(pairs, _hash_sets(source, classes, asked, width), least)


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """``token``, ``set`` and ``size``: the rarest hashes of each set that another one has too.

    Two sets of similarity ``least`` share one of their first size - least * size + 1 hashes in
    any common order; in that of rarity, hashes that many unlike texts have come last. Those of
    one set only fill places but meet nothing.
    """
    hashed = sets.select("set", F.size("hashes").alias("size"), F.explode("hashes").alias("token"))
    shared = written_table(hashed.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    ranked = hashed.join(shared, "token").groupBy("set", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("t"))
    room = F.col("size") - F.ceil(F.lit(least) * F.col("size") - F.lit(1e-6)) + 1 - (F.col("size") - F.size("t"))
    kept = ranked.withColumn("room", room.cast("int")).where("room > 0")
    return written_table(kept.select("set", "size", F.explode(F.slice("t", F.lit(1), F.col("room"))).alias("t")).select("t.token", "set", "size"))


def _joined(rest: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``root`` and ``to``: the groups of ``rest`` (``set``, ``root``) that links between their sets join.

    Candidates meet by a hash of their prefixes, which loses none. In ``TURNS`` rounds the
    sets of a hash meet one of them, which joins what belongs together in few rows. Then all
    pairs of a hash that are in different groups are compared: up to ``PAIRED`` sets as rows,
    more in blocks.
    """
    prefixes = _prefixes(sets, least)
    now = rest.select("set", "root", F.col("root").alias("to"))
    turn = 0
    fits = (F.col("size") >= F.lit(least) * F.col("other") - F.lit(1e-6)) & (F.col("other") >= F.lit(least) * F.col("size") - F.lit(1e-6))

    def placed() -> tuple[DataFrame, DataFrame]:
        found = prefixes.join(now.select("set", "to"), "set")
        tokens = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("lo"), F.max("to").alias("hi"), F.min(F.struct(F.xxhash64("set", F.lit(turn)), "set", "to", "size")).alias("rep"))
        return found, written_table(tokens.where("lo <> hi").drop("lo", "hi"))

    def merge(links: DataFrame) -> bool:
        nonlocal now
        at = now.select("set", "to")
        groups = cut_lineage(
            links.join(at.toDF("a", "ga"), "a").join(at.toDF("b", "gb"), "b").where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
        )
        if groups.isEmpty():
            return False
        roots = components(groups).select(F.col("node").alias("to"), F.col("root").alias("_new"))
        now = cut_lineage(now.join(roots, "to", "left").select("set", "root", F.coalesce("_new", "to").alias("to")))
        return True

    for turn in range(TURNS):
        found, tokens = placed()
        tokens = tokens.where(F.col("n") > PAIRED)
        if tokens.isEmpty():
            break
        star = found.join(tokens.select("token", "rep"), "token").withColumn("other", F.col("rep.size")).where((F.col("to") != F.col("rep.to")) & fits)
        merge(_alike(cut_lineage(star.select(F.col("set").alias("a"), F.col("rep.set").alias("b")).distinct()), sets, least))
    found, tokens = placed()
    few = found.join(tokens.where(F.col("n") <= PAIRED).select("token"), "token")
    pairs = few.select("token", F.col("set").alias("a"), "size", F.col("to").alias("ga")).join(few.select("token", F.col("set").alias("b"), F.col("size").alias("other"), F.col("to").alias("gb")), "token")
    merge(_alike(cut_lineage(pairs.where(F.col("a") > F.col("b")).where((F.col("ga") != F.col("gb")) & fits).select("a", "b").distinct()), sets, least))
    found, tokens = placed()
    many = tokens.where(F.col("n") > PAIRED)
    if not many.isEmpty():
        merge(_in_blocks(found.join(many.select("token"), "token"), sets, least))
    return now.where("root <> to").select("root", "to").distinct()


def _in_blocks(found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``a``, ``b`` of the sets of a ``token`` that are in different groups ``to``.

    Every set outside the token's largest group meets every set of the token, in blocks of
    bounded size.
    """
    groups = found.groupBy("token", "to").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes"))
    of_most = F.max_by(F.struct("to", "n", "hashes"), F.struct("n", "to")).alias("most")
    largest = groups.groupBy("token").agg(of_most, F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
    blocks = lambda n, hashes: F.greatest(F.ceil(n / BLOCK), F.ceil(hashes / BLOCK_HASHES))
    rows, columns = blocks(F.col("n") - F.col("most.n"), F.col("hashes") - F.col("most.hashes")), blocks(F.col("n"), F.col("hashes"))
    sized = largest.select("token", F.col("most.to").alias("most"), rows.alias("rows"), columns.alias("columns"))
    dealt = found.join(sized, "token")
    asking = dealt.where("to <> most").select("token", F.pmod(F.xxhash64("set"), "rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"), F.lit(True).alias("asks"), "set", "to")
    asked = dealt.select("token", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(F.xxhash64("set"), "columns").alias("column"), F.lit(False).alias("asks"), "set", "to")
    blocks = asking.unionByName(asked.select(asking.columns)).join(sets, "set")

    def compare(frame):
        import pandas as pd

        hashes, group, name = frame["hashes"].tolist(), frame["to"].to_numpy(), frame["set"].to_numpy()
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        mark, links = np.zeros(len(words), dtype=np.int64), []
        for i in np.flatnonzero(frame["asks"].to_numpy()):
            own = codes[starts[i] : starts[i] + sizes[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[codes], starts)
            mark[own] = 0
            for j in np.flatnonzero((both >= least * (sizes + sizes[i] - both)) & (group != group[i])):
                links.append((name[i], name[j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64").drop_duplicates()

    return blocks.groupBy("token", "row", "column").applyInPandas(compare, "a long, b long").distinct()


def one_of_each(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of :func:`similar_documents`: the smallest id.

    Rows of one id count as copies of each other if they are in one group. Rows without an id
    cannot be told apart and all stay.
    """
    groups = similar_documents(docs.where("doc_id is not null"), text, **options)
    kept = cut_lineage(groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    stay = docs.join(kept.where("rows = 1"), "doc_id", "left_semi")
    if not kept.where("rows > 1").isEmpty():
        stay = stay.unionByName(docs.join(kept.where("rows > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return stay.unionByName(docs.where("doc_id is null"))
