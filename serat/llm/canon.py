"""Records that are the same but for white space, letter case, punctuation or field order, by progressive refinement.

First all rows are divided by cheap invariants (number of letters and digits, histogram of some letters), which every
form of a record shares.  Classes of several members are noted in a bit map of fixed size; only rows whose class is in
it get the costlier key, the digest of their sorted fields, where they are read.  Hashes and ids travel, texts never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serat.llm.words import chunks, mix, signed
from serat.session import durable

#: Letters whose counts enter the cheap invariant.
HISTOGRAM = "aeiuknrt"


def solid(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


#: Bits of the map of classes with several members, in words of 64: at most BITS / 64 rows are broadcast.
BITS = 1 << 26


def _invariants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each text's number of letters and digits and of its histogram of some letters."""
    for batch in batches:
        for i, j, w in chunks(batch.column(2).to_pylist()):
            cp, good, begin = w.raw
            k = np.zeros(j - i, np.uint64)
            for flags in (good, *(cp == ord(c) for c in HISTOGRAM)):
                sums = np.concatenate(([0], np.cumsum(flags)))
                k = mix(k + (sums[begin[1:]] - sums[begin[:-1]]).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(signed(k))], ["tbl", "id", "text", "k"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128 bits of each text's fields, of letters and digits in lower case, whatever their order; none for no field."""
    for batch in batches:
        for i, j, w in chunks(batch.column(2).to_pylist()):
            two, fields = w.records()
            at = pa.array(np.flatnonzero(fields))
            key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), j - i, [None, pa.py_buffer(np.stack(two, 1).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i).take(at) for c in (0, 1)), key.take(at)], ["tbl", "id", "key"])


def _several(rows: DataFrame) -> DataFrame:
    """(tbl, id, key) of rows whose cheap class has several members, and of some others, whose bit is the same."""
    rows = rows.select("tbl", F.col("id").cast("long").alias("id"), "text").where("text is not null")
    classed = rows.mapInArrow(_invariants, "tbl string, id long, text string, k long").withColumn("k", F.xxhash64("tbl", "k"))
    classes = classed.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    place = F.pmod("k", F.lit(BITS))
    word, bit = (place / 64).cast("int"), (place % 64).cast("int")
    words = classes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    left = classed.withColumn("word", word).join(F.broadcast(words), "word")
    left = left.where(F.call_function("shiftright", "bits", bit).bitwiseAND(F.lit(1)) == 1)
    return left.select("tbl", "id", "text").mapInArrow(_digests, "tbl string, id long, key binary")


def copy_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies: tbl, keep_id, copy_id; sizes: tbl, keep_id, copies) of (tbl STRING, id BIGINT, text STRING).

    Two rows of a table are the same record if the letters and digits of their bar-separated fields are, without empty
    fields and whatever the order.  ``keep_id`` is the smallest id.  Rows with null text or without a letter or digit
    are in no group; groups of one are left out.  An empty table gives none.
    """
    keyed = durable(_several(rows.toDF("tbl", "id", "text")))
    groups = keyed.groupBy("tbl", "key").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
    copies = keyed.join(groups, ["tbl", "key"]).where("id <> keep_id").select("tbl", "keep_id", F.col("id").alias("copy_id"))
    return copies, groups.select("tbl", "keep_id", "copies")


def distinct_records(rows: DataFrame) -> DataFrame:
    """(tbl, keep_id, copies): every record once, with the number of rows that hold it (1 if there is no copy).

    Rows with null text or without a letter or digit are no record.
    """
    rows = rows.toDF("tbl", "id", "text")
    copies, sizes = copy_groups(rows)
    kept = rows.where(F.coalesce(solid(F.col("text")) != "", F.lit(False))).select("tbl", F.col("id").alias("keep_id"))
    kept = kept.join(copies.select("tbl", F.col("copy_id").alias("keep_id")), ["tbl", "keep_id"], "left_anti")
    return kept.join(sizes, ["tbl", "keep_id"], "left").select("tbl", "keep_id", F.coalesce("copies", F.lit(1)).alias("copies"))
