"""Lines repeated across one source's documents: legal notices, share prompts, bylines.

Lines are found by the rule, which asks for a number and a share of the source's records, or by the ratio: each line's
share of the source's records is compared with its share of all others by the log-likelihood ratio, with the
false-discovery rate held by Benjamini and Hochberg's rule.  Lines are counted by the hash of their comparison form,
once a record and before the shuffle, so neither a source nor a line that a third of all rows share is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serat.session import durable

#: Bins of the log-likelihood ratio for the false-discovery rule: width, and the value from which all share one bin.
BIN, TOP = 0.25, 1000.0


def comparison_form(line: Column) -> Column:
    """Lower case, digit runs as 0, other runs without letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{Nd}+", "0"), r"[^\p{L}\p{N}]+", " "))


def _hashes(form: Column) -> Column:
    """128 bits of a comparison form, null for an empty one."""
    return F.when(form != "", F.struct(F.xxhash64(form).alias("h1"), F.xxhash64(form, F.lit(7)).alias("h2")))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: _hashes(comparison_form(x)))


def _cross_entropy(k: Column, n: Column) -> Column:
    """Maximum log-likelihood of k of n, 0 for k = 0 and k = n."""
    p = k / n
    return F.when((k <= 0) | (k >= n), F.lit(0.0)).otherwise(k * F.log(p) + (n - k) * F.log1p(-p))


def _counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, h1, h2, records), (source, size): records with each line, and all records, null texts included."""
    rows = rows.toDF("id", "text", "source").where("source is not null")
    sizes = rows.groupBy("source").agg(F.count("*").alias("size"))
    each = rows.where("text is not null").select("source", F.explode(F.array_distinct(_lines(F.col("text")))).alias("h"))
    return each.where("h is not null").groupBy("source", "h.h1", "h.h2").agg(F.count("*").alias("records")), sizes


def line_statistics(rows: DataFrame, least_records: int = 6) -> tuple[DataFrame, DataFrame]:
    """(statistics, counts of all lines).  Statistics: (source, h1, h2, records, share, outside, llr): lines of at least ``least_records`` records of one source.

    ``rows``: (id, text, source).  ``share`` is of all the source's records, null texts included; ``outside`` counts
    the records of other sources with the line; ``llr`` is 0 unless the share within is the larger one.
    """
    counts, sizes = _counts(rows)
    total = sizes.agg(F.sum("size").alias("total"))
    counts = durable(counts)
    often = counts.where(F.col("records") >= least_records)
    everywhere = counts.join(often.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.sum("records").alias("all"))
    s = often.join(everywhere, ["h1", "h2"]).join(sizes, "source").crossJoin(F.broadcast(total))  # total is one row
    k1, n1, k2, n2 = F.col("records"), F.col("size"), F.col("all") - F.col("records"), F.col("total") - F.col("size")
    ratio = 2 * (_cross_entropy(k1, n1) + _cross_entropy(k2, n2) - _cross_entropy(k1 + k2, n1 + n2))
    ratio = F.when(n2 == 0, 0.0).when(k1 * n2 > k2 * n1, ratio).otherwise(0.0)
    out = s.select("source", "h1", "h2", "records", (k1 / n1).alias("share"), k2.alias("outside"), ratio.alias("llr"))
    return out, counts


def significant_ratio(stats: DataFrame, tests: int, rate: float) -> float:
    """The least log-likelihood ratio at which the share of false discoveries among ``tests`` lines stays below ``rate``.

    Reads at most TOP / BIN + 1 counts: the ratios are put in bins, and a bin counts by its lower end.
    """
    level = F.least(F.floor(F.col("llr") / BIN), F.lit(int(TOP / BIN)))
    counts = {int(r[0]): r[1] for r in stats.where("llr > 0").groupBy(level.alias("bin")).count().collect()}
    above, best = 0, math.inf
    for b in sorted(counts, reverse=True):
        above += counts[b]
        if math.erfc(math.sqrt(b * BIN / 2)) * tests / above <= rate:
            best = b * BIN
    return best


def repeated_lines(rows: DataFrame, least_records: int = 6, least_share: float = 0.05, rate: float = 0.01) -> DataFrame:
    """``line_statistics`` with ``significant`` (excess over other sources) and ``repeated``.

    A line is ``repeated`` in a source if it stands in at least ``least_records`` records and ``least_share`` of all
    records of the source.  A line as frequent elsewhere isn't ``significant`` but may be ``repeated``.  An empty table
    gives no rows; rows with null source or text and lines without letter or digit never count.
    """
    stats, counts = line_statistics(rows, least_records)
    stats = durable(stats)
    ratio = significant_ratio(stats, counts.count(), rate)
    return stats.withColumns({"significant": F.col("llr") >= F.lit(ratio), "repeated": F.col("share") >= least_share})


def excess_lines(rows: DataFrame, by: str = "rule", least_records: int = 6, least_share: float = 0.05, **how) -> DataFrame:
    """(source, h1, h2): the lines to remove from a source's records.

    ``by`` "rule": the ``repeated`` ones; the ratio has no say in them and isn't computed.  ``by`` "ratio": of these only
    the ``significant`` ones, so lines as frequent in other sources stay, and all lines if there is no other source.
    """
    if by == "ratio":
        marks = repeated_lines(rows, least_records, least_share, **how).where("repeated and significant")
    elif by == "rule" and not how:
        counts, sizes = _counts(rows)
        marks = counts.where(F.col("records") >= least_records).join(sizes, "source").where(F.col("records") / F.col("size") >= least_share)
    else:
        raise ValueError(f"by {by!r} with {how}")
    return marks.select("source", "h1", "h2")


def branches(rows: DataFrame, **how) -> DataFrame:
    """(branch, lines, sources): how many of the rule's lines are in excess over other sources ("ratio"), and how many only repeated ("share")."""
    marks = repeated_lines(rows, **how).where("repeated").withColumn("branch", F.when(F.col("significant"), "ratio").otherwise("share"))
    return marks.groupBy("branch").agg(F.count("*").alias("lines"), F.count_distinct("source").alias("sources"))


def found_lines(rows: DataFrame, **how) -> DataFrame:
    """(id, line_no): every line of every record that ``excess_lines`` marks, lines numbered from 1."""
    marks = durable(excess_lines(rows, **how))
    rows = rows.toDF("id", "text", "source").where("source is not null and text is not null")
    each = rows.select("id", "source", F.posexplode(_lines(F.col("text"))).alias("pos", "h")).where("h is not null")
    each = each.select("id", "source", (F.col("pos") + 1).cast("int").alias("line_no"), "h.h1", "h.h2")
    return each.join(marks, ["source", "h1", "h2"], "left_semi").select("id", "line_no")


def without_lines(rows: DataFrame, **how) -> DataFrame:
    """(id, text, removed): each record without its source's excess lines, the others in their order.

    The lines of records with any are anti-joined with them and put together again by their position; other records
    stay where they are.  Null texts stay null; a record of which every line goes becomes empty.
    """
    rows = rows.toDF("id", "text", "source").select("id", "text", "source")
    found = durable(found_lines(rows, **how))
    gone = found.groupBy("id").agg(F.count("*").cast("int").alias("removed"))
    each = rows.join(gone, "id", "left_semi").select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = each.withColumn("line_no", F.col("pos") + 1).join(found, ["id", "line_no"], "left_anti")
    # one record's lines, as many as its text holds
    again = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("kept"))
    out = rows.select("id", "text").join(gone.join(again, "id", "left"), "id", "left")
    return out.select("id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.coalesce("kept", F.lit(""))).alias("text"), F.coalesce("removed", F.lit(0)).alias("removed"))
