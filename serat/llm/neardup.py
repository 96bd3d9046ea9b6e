"""Near-duplicate texts: pairs whose sets of word shingles are similar, by covering locality-sensitive hashing.

A text's sketch has COORDINATES minhash values in blocks of BLOCK.  A table's bit mask keeps KEEP coordinates of one
block and clears the rest, and there is a table for each such choice within a block.  Any pair of sketches that agrees
in more than COORDINATES * (KEEP - 1) / BLOCK coordinates agrees, by the pigeonhole principle, KEEP times within some
block and so collides in some table: no pair within that Hamming radius can be missed.  Every collision is checked
exactly on the whole texts.

Shingles that stand in a large share of all texts (stock phrases, site lines) get a sixteenth of the others' weight
in the sketch, so that texts sharing only these don't collide.  They are found over all texts by lossy counting; there
are at most ``1 / (0.75 * COMMON_SHARE)`` of them, which bounds what is broadcast.  A text of which more than PLAIN_FROM
is common also stands in tables without weights.  Let a pair of similarity 0.5 have the part c of what it shares in
common shingles.  Above c = 2 * PLAIN_FROM both texts are in these tables, as what they share is at least half of
either, and they miss each other with probability (11/16)**16 = 0.0025.  Up to it their weighted similarity is 0.347 at
least (c = 0.5 and all else rare: probability 0.015 of a miss) and 0.5 without common shingles (0.00001).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serat.llm.exchange import Postings, semi, send
from serat.llm.words import Words, chunks, distinct, mix, signed, words
from serat.operators.components import connected_components
from serat.session import durable

U = np.uint64
COORDINATES, BLOCK, KEEP = 128, 4, 3
#: The covering masks: KEEP coordinates of one block.
MASKS = [p for b in range(0, COORDINATES, BLOCK) for p in itertools.combinations(range(b, b + BLOCK), KEEP)]
#: Those of the tables without weights.
PLAIN_MASKS = MASKS[: len(MASKS) // 2]
COMMON_SHARE = 1e-5
COMMON_LEAST = 64
#: Common shingles weigh 2 ** -COMMON_BITS.
COMMON_BITS = 4
#: Share of common shingles above which a text also stands in the tables without weights.
PLAIN_FROM = 0.25
#: Shingles counted exactly at a time by the lossy count: 32 MB in a worker.
COUNT_CHUNK = 4_000_000
ODD_BITS = 512
_ODD = (mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0xA24BAED4963EE407)) >> U(32)).astype(np.uint32) | np.uint32(1)


def common_shingles(docs: DataFrame, width: int, share: float = COMMON_SHARE, least: int = COMMON_LEAST) -> np.ndarray:
    """Hashes of the shingles that make up at least ``share`` of all shingle occurrences and ``least`` of them, sorted."""
    return shingle_counts(docs, width, share, least)[0]


def shingle_counts(docs: DataFrame, width: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles' hashes, sorted, and their counts.

    Lossy counting: each task counts COUNT_CHUNK shingles exactly and passes on those above half the share of the
    chunk; undercounts are below half the share in total, and above 0.75 of it a shingle counts as common.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            total = np.concatenate(held) if held else np.zeros(0, U)
            value, n = np.unique(total, return_counts=True)
            keep = n >= max(2, share / 2 * len(total))
            # the total of the chunk travels as a row with a null shingle
            h = pa.array([None, *signed(value[keep]).tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([h, pa.array([len(total), *n[keep].tolist()], pa.int64())], ["h", "n"])

        for batch in batches:
            for _, _, w in chunks(batch.column(1).to_pylist()):
                held.append(w.grams(width)[0])
                size += len(held[-1])
                if size >= COUNT_CHUNK:
                    yield out()
                    held, size = [], 0
        yield out()

    counts = docs.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = durable(counts)
    total = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
    floor = max(least, 0.75 * share * total)
    found = counts.where(F.col("h").isNotNull() & (F.col("n") >= floor)).select("h", F.least("n", F.lit(2**31 - 1)).cast("int")).toArrow()
    h, n = (found.column(i).to_numpy() for i in (0, 1)) if len(found) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    at = np.argsort(h.view(U))
    return h.view(U)[at], n[at]


def _minima(base: np.ndarray, first: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """COORDINATES minhash values for each document (each has at least one shingle); a shift of b bits is a weight of 2**b."""
    low = (base >> U(32)).astype(np.uint32)
    out = np.empty((COORDINATES, len(first) - 1), np.uint32)
    v = np.empty_like(low)
    for k in range(COORDINATES):
        np.multiply(low, _ODD[k], out=v)
        np.right_shift(v, shift, out=v)
        np.minimum.reduceat(v, first[:-1], out=out[k])
    return out.T


def _odd(base: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Odd sketch: bit h mod ODD_BITS is the parity of the shingles that fall there; ODD_BITS / 64 longs a document."""
    docs = len(first) - 1
    at = np.repeat(np.arange(docs), np.diff(first)) * ODD_BITS + (base & U(ODD_BITS - 1)).astype(np.int64)
    bits = (np.bincount(at, minlength=docs * ODD_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).reshape(docs, -1)


def sketch(w: Words, width: int, common: np.ndarray):
    """(documents with a shingle, their numbers of distinct shingles, sketches, which have one without weights, these)."""
    base, first = distinct(*w.grams(width))
    some = np.flatnonzero(np.diff(first))
    first = np.concatenate((first[some], [first[-1]]))
    n = np.diff(first)
    if not len(some):
        return some, n, np.zeros((0, COORDINATES), np.uint32), some, np.zeros((0, COORDINATES), np.uint32)
    is_common = np.zeros(len(base), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, base), len(common) - 1)
        is_common = common[at] == base
    # the weights are relative: rare shingles' values are the smaller ones
    weighted = _minima(base, first, np.where(is_common, 0, COMMON_BITS).astype(np.uint32))
    much = np.flatnonzero(np.add.reduceat(is_common, first[:-1], dtype=np.int64) > PLAIN_FROM * n)
    of = np.repeat(np.isin(np.arange(len(n)), much), n)
    plain = _minima(base[of], np.concatenate(([0], np.cumsum(n[much]))), np.uint32(0)) if len(much) else weighted[:0]
    return some, n, weighted, much, plain


CLASS = ["word_a", "word_b", "rec_a", "rec_b"]


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(id, the columns after the second, hashes of words and canonical record, fields, n, odd) of (id BIGINT, text STRING, ...).

    ``n`` is the number of distinct shingles, ``odd`` their odd sketch, ``fields`` the number of the record's fields.
    """
    more = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in chunks(batch.column(1).to_pylist()):
                g, first = distinct(*w.grams(width))
                (ra, rb), fields = w.records()
                kept = [batch.column(c).slice(i, j - i) for c in (0, *range(2, batch.num_columns))]
                cols = [pa.array(signed(x)) for x in (*w.sequences(), ra, rb)]
                cols += [pa.array(fields, pa.int32()), pa.array(np.diff(first), pa.int32()), pa.array(list(_odd(g, first)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *cols], ["id", *more, *CLASS, "fields", "n", "odd"])

    extra = [F.lit(0).cast("long").alias(c) for c in CLASS] + [F.lit(0).alias("fields"), F.lit(0).alias("n"), F.lit(None).cast("array<long>").alias("odd")]
    schema = docs.toDF("id", "text", *more).select("id", *more, *extra).schema
    return docs.mapInArrow(run, schema)


def _collisions(docs: DataFrame, width: int, common: np.ndarray) -> DataFrame:
    """(bucket, id, n): the members of each bucket of any table that has several, of (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def keys(m: np.ndarray, masks: list[tuple[int, ...]], tag: int) -> np.ndarray:
        out = np.empty((len(m), len(masks)), U)
        for t, mask in enumerate(masks):
            h = np.full(len(m), (t + tag) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, U)
            for i in mask:
                h = (h ^ m[:, i]) * U(0xD6E8FEB86659FD93)
                h ^= h >> U(32)
            out[:, t] = mix(h)
        return out.ravel()

    def make(batch: pa.RecordBatch) -> Iterator[Postings]:
        ids = batch.column(0).to_numpy()
        for i, j, w in chunks(batch.column(1).to_pylist()):
            some, n, weighted, much, plain = sketch(w, width, shared.value)
            of, n = ids[i:j][some], n.astype(np.uint32)
            for at, m, masks, tag in ((slice(None), weighted, MASKS, 0), (much, plain, PLAIN_MASKS, len(MASKS))):
                if len(m):
                    yield Postings(of[at], n[at], np.full(len(m), len(masks)), keys(m, masks, tag), None)

    def receive(key, ids, n, _) -> Iterator[pa.RecordBatch]:
        at = np.argsort(key, kind="stable")
        key = key[at]
        same = np.concatenate(([False], key[1:] == key[:-1], [False]))
        several = np.flatnonzero(same[:-1] | same[1:])
        for i in range(0, len(several), 1_000_000):
            x = several[i : i + 1_000_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[x]), pa.array(ids[at[x]]), pa.array(n[at[x]].astype(np.int32))], ["bucket", "id", "n"])

    return send(docs, make, receive, "bucket long, id long, n int")


def _likely(rows: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Drop pairs whose odd sketches lie further apart than those of any pair of that similarity by four deviations.

    Sets of a and b elements and similarity s differ in at most d = (a + b)(1 - s)/(1 + s) elements, and odd sketches
    of sets that differ in d elements in about m(1 - exp(-2d/m))/2 of m bits, with a variance below m/4.
    """
    few = rows.select("id", "n", "odd")
    both = pairs.join(few.toDF("a", "na", "oa"), "a").join(few.toDF("b", "nb", "ob"), "b")
    apart = sum(F.bit_count(F.col("oa")[k].bitwiseXOR(F.col("ob")[k])) for k in range(ODD_BITS // 64))
    d = (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity))
    mean = (1 - F.exp(d * (-2 / ODD_BITS))) * (ODD_BITS / 2)
    # the variance of the number of odd bins among m with d balls thrown
    var = (1 - F.exp(d * (-4 / ODD_BITS))) * (ODD_BITS / 4)
    return both.where(apart <= mean + 4 * F.sqrt(var) + 2).select("a", "b")


def check_pairs(pairs: DataFrame, docs: DataFrame, width: int, similarity: float, same: str) -> DataFrame:
    """(a, b, similarity, coverage): the pairs (a, b) of which the exact similarity of the shingle sets is at least ``similarity``.

    ``coverage`` is the share of a's words that lie in runs of at least ``width`` words which b has too.

    ``same``: what happens to two texts with one canonical record: "drop" drops the pair, "keep" keeps it whatever
    its similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                a, b = (words(part.column(c).to_pylist()) for c in ("text_a", "text_b"))
                (ga, fa), (gb, fb) = a.grams(width), b.grams(width)
                (ra, na), (rb, _) = a.records(), b.records()
                one = (ra[0] == rb[0]) & (ra[1] == rb[1]) & (na > 0)
                keep = np.zeros(part.num_rows, bool)
                shared, union = np.zeros((2, part.num_rows), np.int64)
                covered = np.zeros(part.num_rows)
                for k in range(part.num_rows):
                    x, y = np.unique(ga[fa[k] : fa[k + 1]]), np.unique(gb[fb[k] : fb[k + 1]])
                    shared[k] = len(np.intersect1d(x, y, assume_unique=True))
                    union[k] = len(x) + len(y) - shared[k]
                    inside = np.convolve(np.isin(ga[fa[k] : fa[k + 1]], y), np.ones(width)) > 0  # words of a in spans of both
                    covered[k] = inside.mean() if len(x) else 0.0
                near = (union > 0) & (shared >= similarity * union - 1e-9)
                keep = near & ~one if same == "drop" else near | one
                at = pa.array(np.flatnonzero(keep))
                sim = pa.array(shared[keep] / np.maximum(union[keep], 1), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column("a").take(at), part.column("b").take(at), sim, pa.array(covered[keep])], ["a", "b", "similarity", "coverage"])

    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = semi(docs.toDF("id", "text"), wanted, "id")
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double, coverage double")


def _prepared(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, rows: sketches of all, copies: id, rep, members: of buckets with several representatives)."""
    docs = docs.toDF("id", "text").where("text is not null")
    common = common_shingles(docs, width)
    rows = durable(signatures(docs, width).where("n > 0"))
    classes = rows.groupBy(*CLASS).agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    copies = durable(rows.select("id", *CLASS).join(classes, CLASS).where("id <> rep").select("id", "rep"))
    members = durable(_collisions(docs.join(copies.select("id"), "id", "left_anti"), width, common))
    return docs, rows, copies, members


def _meet(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of two sides (bucket, id, n, ...) of one bucket whose sizes allow the similarity."""
    a, b = a.withColumnsRenamed({"id": "a", "n": "na"}), b.withColumnsRenamed({"id": "b", "n": "nb"})
    sizes = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    return a.join(b, "bucket").where(sizes)


def near_duplicate_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: every document with a shingle; copies: id, rep; pairs: a, b, similarity between representatives).

    ``docs``: (id BIGINT unique, text STRING).  Texts with the same words and the same canonical record form a class,
    whose representative is the smallest id; ``copies`` has the other members.  Pairs join representatives, so that a
    group of copies, however large, costs one comparison.  Null texts and texts of fewer than ``width`` words have no
    shingles and are in no pair.  Pairs with one canonical record are left out: they are the same record.
    """
    docs, rows, copies, members = _prepared(docs, width)
    pairs = _meet(members, members, similarity).where("a < b").select("a", "b").distinct()
    likely = durable(_likely(rows, pairs, similarity))
    return rows, copies, durable(check_pairs(likely, docs, width, similarity, "drop").drop("coverage"))


#: Rounds in which a bucket's members are linked to one of them, before what is left is paired in full.
STARS = 4


def near_duplicate_families(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, rep, group_id): one row for each document with a shingle, ``group_id`` that of its connected component.

    The components of ``near_duplicate_groups`` without its pairs: in each of STARS rounds every bucket links one member
    to those of other components than its own, so that a family of any size costs a pair a member; what has not come
    together by then is paired across components, in full.  No link between components is lost.
    """
    docs, rows, copies, members = _prepared(docs, width)
    edges, tried = None, None
    label = None
    for turn in range(STARS + 1):
        if label is None:
            labelled = members.withColumn("label", F.col("id"))
        else:
            labelled = members.join(label.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_ = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        labelled = durable(labelled.join(open_, "bucket", "left_semi"))
        one = labelled
        if turn < STARS:
            pick = F.min_by(F.struct("id", "n", "label"), F.xxhash64("id", F.lit(turn)))
            one = labelled.groupBy("bucket").agg(pick.alias("m")).select("bucket", "m.*")
        pairs = _meet(one.withColumnRenamed("label", "la"), labelled.withColumnRenamed("label", "lb"), similarity).where("la <> lb")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = durable(pairs)
        if pairs.isEmpty():
            if turn < STARS:
                continue
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        hit = durable(check_pairs(durable(_likely(rows, pairs, similarity)), docs, width, similarity, "drop").select("a", "b"))
        edges = hit if label is None else edges.unionByName(hit)
        label = durable(connected_components(edges))
    member = rows.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    if label is None:
        return member.withColumn("group_id", F.col("rep"))
    return member.join(label.toDF("rep", "group_id"), "rep", "left").select("id", "rep", F.coalesce("group_id", "rep").alias("group_id"))


def expand(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs of representatives as pairs of rows (id_a < id_b)."""
    a = pairs.join(copies.toDF("id_a", "a"), "a").select("id_a", "b", "similarity")
    pairs = pairs.withColumnRenamed("a", "id_a").select("id_a", "b", "similarity").unionByName(a)
    b = pairs.join(copies.toDF("id_b", "b"), "b").select("id_a", "id_b", "similarity")
    pairs = pairs.withColumnRenamed("b", "id_b").select("id_a", "id_b", "similarity").unionByName(b)
    return pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "similarity")


def near_duplicate_pairs(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """All pairs of rows (id_a < id_b) that are near-duplicates and not the same record."""
    _, copies, pairs = near_duplicate_classes(docs, width, similarity)
    return expand(pairs, copies)


def near_duplicate_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each document with a shingle: id, rep, links (near-duplicate classes of its class), group_id.

    ``rep`` is the smallest id with the same words and record, ``group_id`` that of the connected component.
    """
    rows, copies, pairs = near_duplicate_classes(docs, width, similarity)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    groups = connected_components(pairs.select("a", "b")).toDF("rep", "group_id").join(ends, "rep")
    member = rows.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    return member.join(groups, "rep", "left").select(
        "id", "rep", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group_id", "rep").alias("group_id")
    )
