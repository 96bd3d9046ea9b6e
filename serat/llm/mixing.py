"""Mixing sources to target shares of all tokens, by systematic sampling of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serat.session import durable

#: Documents of one cell on average; cells divide a source by length and a hash, so that no task holds a hot source.
CELL = 50_000
#: Length classes of a source: powers of 2**(1/16).
PER_DOUBLING = 16


def expected_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats, tokens, docs, rate, u): how often each token of a source is to be used.

    The mixture is the largest that keeps all shares with no source above its ``max_repeats``.  Sources without tokens
    can't have a share: those of the others are scaled up to 1.  Null and non-positive targets take no part.
    """
    t = targets.toDF("source", "share", "max_repeats").where("source is not null and share > 0 and max_repeats > 0")
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    t = t.join(have, "source")
    one = Window.partitionBy()  # over the targets only, a handful of rows
    t = t.withColumn("share", F.col("share") / F.sum("share").over(one))
    total = F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).over(one)
    return t.withColumn("rate", F.least(total * F.col("share") / F.col("tokens"), F.col("max_repeats").cast("double")))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(id, source, n_tokens, copies): the documents of the mixture and how often each is used.

    ``sized``: (id BIGINT unique, source STRING, n_tokens BIGINT).  Within a source the documents stand in order of
    length class, and in a class's cells of length; a prefix sum of their expected copies plus one random offset passes whole numbers, and a document is
    used once for each that it passes: floor(rate) or ceil(rate) times, never above ``max_repeats``.  As neighbours are
    alike in length, the tokens follow the counts.  Documents without tokens, of null or of other sources aren't used.
    """
    sized = sized.toDF("id", "source", "n_tokens").where("n_tokens > 0 and source is not null")
    rates = durable(expected_copies(sized, targets))
    n = sized.count()
    length = F.floor(F.log2(F.col("n_tokens")) * PER_DOUBLING).cast("int")
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, n // CELL))).cast("int")
    # the targets are a handful of rows, the table of cells their number times a few dozen lengths times n / CELL
    docs = durable(sized.join(F.broadcast(rates.select("source", "rate")), "source").select("*", length.alias("len"), part.alias("part")))
    cells = docs.groupBy("source", "len", "part").agg(F.count("*").alias("docs"))
    before = Window.partitionBy("source").orderBy("len", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "len", "part", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("offset"))
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("source", "len", "part").orderBy("n_tokens", F.xxhash64("id", F.lit(seed)), "id")))
    placed = ranked.join(cells, ["source", "len", "part"]).withColumn("at", F.col("offset") + F.col("rank"))
    # one random offset a source
    u = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return placed.select("id", "source", "n_tokens", _crossed(u).alias("copies")).where("copies > 0")


def _crossed(u: Column) -> Column:
    """Whole numbers passed by a document's stretch of the prefix sum."""
    return F.floor(F.col("at") * F.col("rate") + u) - F.floor((F.col("at") - 1) * F.col("rate") + u)


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, docs, copies, tokens, most): what the mixture has of each source."""
    t = targets.toDF("source", "target_share", "max_repeats").select("source", "target_share")
    got = mixed.groupBy("source").agg(F.count("*").alias("docs"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("docs", "copies", "tokens", "most")}
    all_ = F.sum("tokens").over(Window.partitionBy())  # over one row a target
    return t.join(got, "source", "left").withColumns(zero).withColumn("actual_share", F.coalesce(F.try_divide("tokens", all_), F.lit(0.0)))
