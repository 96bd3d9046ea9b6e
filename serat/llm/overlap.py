"""Records of evaluation splits that stand in the training split too, by a sparse suffix array over the texts' words.

The suffixes of a text are sorted by their words: first by the shingle they begin with, whose hash is also the
partition they go to, then by the words that follow.  Of each text only those suffixes are taken that begin with one
of its n - s n + REPEATS rarest distinct shingles, in one order for all texts (prefix filter): two texts of similarity
s share at least REPEATS of them, wherever the edits are, so that nothing is lost by leaving out the rest.  Neighbours
of the sorted array with a common prefix of at least a shingle form an interval; one with suffixes of both splits
reveals spans that both have.  The spans of a pair are merged into its coverage, the number of chosen suffixes the two
share, and a pair below REPEATS is no overlap.  The rest is narrowed by sketches and checked exactly.

An interval of more than BLOCK cross-split pairs (stock phrases, a family of retellings of any size) isn't multiplied
out: each evaluation suffix meets its nearest training suffixes on both sides, with which it has the longest common
prefix.  That settles nearly all records of a family in linear time; for records it doesn't settle, and only these,
the interval is joined in full, so that no partner is lost.

Texts with the same words are one representative on either side before they are joined; records with the same
canonical form meet by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serat.llm.exchange import Postings, send
from serat.llm.neardup import CLASS, ODD_BITS, check_pairs, shingle_counts, signatures
from serat.llm.words import Words, chunks, signed
from serat.session import durable

U = np.uint64
#: Share of all occurrences from which a shingle's count is known for the order; at most 1 / (0.75 * ORDER_SHARE) are broadcast.
ORDER_SHARE = 5e-7
#: Chosen suffixes that an overlapping pair shares at least, if it shares that many shingles.
REPEATS = 4
#: Cross-split pairs of one interval that are listed at once.
BLOCK = 4096
#: Postings of a shingle known to be frequent that are sorted in one task.
SHARD = 2_000_000
#: Words after the shingle by which suffixes are sorted, at four bits each.
FURTHER = 3
#: Bit of a suffix that marks its interval as divided into shards.
DIVIDED = 0x8000


def _needed(n, similarity: float):
    """Shared elements that two sets of n elements in all have at least, at that similarity."""
    return F.ceil(n * (similarity / (1 + similarity)) - 1e-9)


WORDS, RECORD = CLASS[:2], CLASS[2:]


def chosen_suffixes(w: Words, width: int, similarity: float, often: np.ndarray, times: np.ndarray):
    """(shingle, the words after it, count of the shingle or 0, suffixes of each document, distinct shingles of each document)."""
    g, first = w.grams(width)
    per = np.diff(first)
    doc = np.repeat(np.arange(w.docs), per)
    count = np.zeros(len(g), np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, g), len(often) - 1)
        count = np.where(often[at] == g, times[at], 0)
    # the order: octave of the count, then the hash
    rank = (np.log2(count + 1).astype(np.uint64) << U(58)) | (g >> U(6))
    at = np.lexsort((rank, doc))
    new = np.ones(len(at), bool)
    new[1:] = (g[at[1:]] != g[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    at = at[new]
    n = np.bincount(doc[at], minlength=w.docs)
    place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    take = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + REPEATS
    at = at[place < np.repeat(take, n)]
    of = doc[at]
    word = w.first[of] + at - first[of] + width
    rest = np.zeros(len(at), np.uint16)
    for j in range(FURTHER):
        here = word + j
        nibble = np.where(here < w.first[of + 1], np.maximum(w.hashes[np.minimum(here, len(w.hashes) - 1)] >> U(60), U(1)), U(0)) if len(at) else rest
        rest = (rest << np.uint16(4)) | nibble.astype(np.uint16)
    return g[at], rest, count[at], np.bincount(of, minlength=w.docs), n


def _intervals(similarity: float):
    """What a task does with its suffixes: sorts them and lists the pairs of each interval with both splits."""

    def pairs(ea, tb, want) -> pa.RecordBatch:
        none = pa.nulls(len(ea), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(ea), pa.array(tb), pa.array(want, pa.int32()), none], ["a", "b", "want", "key"])

    def run(key, ids, info, rest) -> Iterator[pa.RecordBatch]:
        at = np.lexsort((rest, key))
        key, ids, info = key[at], ids[at], info[at]
        side, n = (info & 1).astype(np.int64), (info >> 1).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        n_train = np.add.reduceat(side, start)
        n_eval = size - n_train
        least = lambda e, t: np.minimum(np.ceil((n[e] + n[t]) * (similarity / (1 + similarity)) - 1e-9), REPEATS).astype(np.int32)
        alike = lambda e, t: np.minimum(n[e], n[t]) >= similarity * np.maximum(n[e], n[t]) - 1e-9
        product = n_eval * n_train
        of = np.repeat(np.arange(len(start)), size)
        # intervals of bounded size: all cross-split pairs
        divided = rest[at[start]] >= DIVIDED
        some = (product > 0) & (product <= BLOCK) & ~divided
        train = np.flatnonzero((side == 1) & some[of])
        head = np.cumsum(np.where(some, n_train, 0)) - np.where(some, n_train, 0)
        ev = np.flatnonzero((side == 0) & some[of])
        each = n_train[of[ev]]
        ends = np.cumsum(each)
        lo = 0
        while lo < len(ev):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000)))
            k = each[lo:hi]
            e = np.repeat(ev[lo:hi], k)
            t = train[np.repeat(head[of[ev[lo:hi]]], k) + np.arange(len(e)) - np.repeat(np.cumsum(k) - k, k)]
            ok = alike(e, t)
            yield pairs(ids[e[ok]], ids[t[ok]], least(e[ok], t[ok]))
            lo = hi
        # larger ones: the nearest training suffix on both sides, and the suffixes themselves for the full join
        many = (product > 0) & ~some
        if many.any():
            ev = np.flatnonzero((side == 0) & many[of])
            train = np.flatnonzero((side == 1) & many[of])
            after = np.searchsorted(train, ev)
            for t in (after - 1, after):
                ok = (t >= 0) & (t < len(train))
                e, t = ev[ok], train[t[ok]]
                ok = (of[e] == of[t]) & alike(e, t)
                yield pairs(ids[e[ok]], ids[t[ok]], np.zeros(ok.sum(), np.int32))
            all_ = np.flatnonzero((many & ~divided)[of])
            for i in range(0, len(all_), 1_000_000):
                x = all_[i : i + 1_000_000]
                none = pa.nulls(len(x), pa.int64())
                a = pa.array(ids[x], mask=side[x] == 1)
                b = pa.array(ids[x], mask=side[x] == 0)
                yield pa.RecordBatch.from_arrays([a, b, pa.array(n[x], pa.int32()), pa.array(key[x])], ["a", "b", "want", "key"])

    return run


def suffix_pairs(docs: DataFrame, width: int, similarity: float, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The sorted suffixes' cross-split pairs of (id, text, side): rows (a, b, want, null), one for each chosen suffix they share.

    ``want`` is how many a pair has to share, 0 for neighbours in an interval that isn't listed in full.  Of such an
    interval there is also a row for each suffix: (a or b, shingles of its text, interval).
    """
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def make(batch: pa.RecordBatch) -> Iterator[Postings]:
        ids, side = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for i, j, w in chunks(batch.column(1).to_pylist()):
            key, rest, count, per, n = chosen_suffixes(w, width, similarity, *shared.value)
            shards = count // SHARD + 1
            if (shards > 1).any():
                # a frequent shingle's suffixes are sorted in shards, none of which has the whole interval
                doc = np.repeat(ids[i:j], per).view(U)
                key = key + ((doc * U(0x9E3779B97F4A7C15) >> U(20)) % shards.astype(U)) * U(0xD6E8FEB86659FD93)
                rest = rest | np.where(shards > 1, DIVIDED, 0).astype(np.uint16)
            yield Postings(ids[i:j], (n << 1 | side[i:j]).astype(np.uint32), per, key, rest)

    return send(docs, make, _intervals(similarity), "a long, b long, want int, key long")


def divided_suffixes(docs: DataFrame, width: int, similarity: float, counts: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The chosen suffixes of shingles so frequent that their intervals are divided, as rows like those of ``suffix_pairs``."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, side = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for i, j, w in chunks(batch.column(1).to_pylist()):
                key, _, count, per, n = chosen_suffixes(w, width, similarity, *shared.value)
                doc = np.repeat(np.arange(j - i), per)[count >= SHARD]
                of, train = ids[i:j][doc], side[i:j][doc] == 1
                # all bits of the hash; those of the other intervals are at most 40 and their task
                cols = [pa.array(of, mask=train), pa.array(of, mask=~train), pa.array(n[doc], pa.int32()), pa.array(signed(key[count >= SHARD] | U(1 << 63)))]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "want", "key"])

    return docs.mapInArrow(run, "a long, b long, want int, key long")


def _possible(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Drop pairs whose odd sketches differ in more bits than sets of that similarity have elements of their own.

    An element changes one bit, so no pair of that similarity is dropped.
    """
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a")
    both = both.join(rows.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
    apart = sum(F.bit_count(F.col("oa")[k].bitwiseXOR(F.col("ob")[k])) for k in range(ODD_BITS // 64))
    own = F.col("na") + F.col("nb") - 2 * _needed(F.col("na") + F.col("nb"), similarity)
    return both.where(apart <= own).select("a", "b")


def cross_split_pairs(evaluation: DataFrame, training: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a: evaluation id, b: training id, similarity, coverage) of overlapping records, training texts as one representative.

    Both inputs are (id BIGINT, text STRING), ids unique over both.  Two records overlap if they are the same
    canonical record or their sets of ``width``-word shingles have at least that similarity.  Each overlapping
    evaluation record has at least one row; of the training records it overlaps with, those behind an interval larger
    than BLOCK may be left out once one is found.  ``coverage`` is the share of the evaluation record's words that lie
    in spans of ``width`` words or more which the training record has too.  Null texts and texts without a letter or
    digit overlap with nothing.  Of training partners with the same words, or the same record, the one of the smallest
    id comes out.
    """
    sides = [d.toDF("id", "text").where("text is not null").withColumn("side", F.lit(k)) for k, d in enumerate((evaluation, training))]
    docs = sides[0].unionByName(sides[1])
    counts = shingle_counts(docs, width, ORDER_SHARE, 2)
    rows = durable(signatures(docs, width))
    known = rows.where("n > 0")
    classes = known.groupBy("side", *WORDS).agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    copies = durable(known.select("id", "side", *WORDS).join(classes, ["side", *WORDS]).where("id <> rep").select("id", "rep"))
    firsts = docs.join(copies.select("id"), "id", "left_anti").select("id", "text", "side")
    listed = durable(suffix_pairs(firsts, width, similarity, counts))
    pairs = listed.where("key is null").groupBy("a", "b").agg(F.count("*").alias("covered"), F.min("want").alias("want"))
    near = durable(_possible(pairs.where("covered >= want").select("a", "b"), rows, similarity))
    same = rows.where("fields > 0 and side = 1").groupBy(*RECORD).agg(F.min("id").alias("b"))
    same = rows.where("fields > 0 and side = 0").select(F.col("id").alias("a"), *RECORD).join(same, RECORD).select("a", "b")
    texts = docs.select("id", "text")
    found = durable(check_pairs(durable(near.unionByName(same).distinct()), texts, width, similarity, "keep"))
    large = listed.where("key is not null")
    if (counts[1] >= SHARD).any():
        large = large.unionByName(divided_suffixes(firsts, width, similarity, counts))
    if not large.isEmpty():
        # the exact way for what the neighbours in large intervals didn't settle
        open_ = large.where("a is not null").select("a", "key", F.col("want").alias("na")).join(found.select("a").distinct(), "a", "left_anti")
        more = open_.join(large.where("b is not null").select("b", "key", F.col("want").alias("nb")), "key")
        alike = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
        more = more.where(alike).select("a", "b", F.least(_needed(F.col("na") + F.col("nb"), similarity), F.lit(REPEATS)).cast("int").alias("want"))
        fewer = listed.where("key is null and want > 0").select("a", "b", "want").join(found.select("a").distinct(), "a", "left_anti")
        more = more.unionByName(fewer).groupBy("a", "b").agg(F.count("*").alias("covered"), F.max("want").alias("want")).where("covered >= want")
        more = durable(_possible(more.select("a", "b").join(near, ["a", "b"], "left_anti"), rows, similarity))
        found = found.unionByName(durable(check_pairs(more, texts, width, similarity, "keep")))
    # what holds for the shingles of a representative holds for its copies
    alike = found.where(F.col("similarity") >= similarity - 1e-9).withColumnRenamed("a", "rep")
    alike = alike.join(copies.withColumnRenamed("id", "a"), "rep").select("a", "b", "similarity", "coverage")
    return found.unionByName(alike).distinct()


def overlapping_records(rows: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, partner, similarity, coverage): each validation or test record of (id, text, split) that also stands in train.

    ``partner`` is, of the training records found, the one most like it, the smallest id among equals.
    """
    rows = rows.toDF("id", "text", "split")
    found = cross_split_pairs(
        rows.where("split in ('validation', 'test')").select("id", "text"), rows.where("split = 'train'").select("id", "text"), width, similarity
    )
    best = F.max(F.struct("similarity", (-F.col("b")).alias("b"), "coverage")).alias("best")
    best = found.groupBy("a").agg(best)
    return best.select(F.col("a").alias("id"), (-F.col("best.b")).alias("partner"), F.col("best.similarity").alias("similarity"), F.col("best.coverage").alias("coverage"))
