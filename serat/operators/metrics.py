"""Text overlap and classifier metrics (O-VEC17, O-AGG09..11, O-JN10)."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKENS = r"[a-z0-9]+"


def _ngram_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    words = F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(_TOKENS), F.lit(0))
    # the words beside those one further, and so on; what hangs over the end is null
    grams = words
    for k in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(words, F.lit(k), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return df.select("id", F.explode(grams).alias("g")).where("g is not null").groupBy("id", "g").agg(F.count("*").alias("n"))


def rouge_n(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(id, precision, recall, f1) of (id, reference, prediction): shared n-grams, each as often as in the poorer text.

    Without stemming.  A side without n-grams gives 0.
    """
    r, p = _ngram_counts(pairs, "reference", n).toDF("id", "g", "nr"), _ngram_counts(pairs, "prediction", n).toDF("id", "g", "np")
    each = r.join(p, ["id", "g"], "full_outer").groupBy("id").agg(F.sum(F.least(F.coalesce("nr", F.lit(0)), F.coalesce("np", F.lit(0)))).alias("hit"), F.sum("nr").alias("nr"), F.sum("np").alias("np"))
    out = pairs.select("id").join(each, "id", "left").na.fill(0, ["hit", "nr", "np"])
    return _scores(out, F.col("hit"), F.col("nr"), F.col("np"))


def _scores(df: DataFrame, hit, nr, np_) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide(hit, np_)), zero(F.try_divide(hit, nr))
    return df.select("id", p.alias("precision"), r.alias("recall"), zero(F.try_divide(2 * p * r, p + r)).alias("f1"))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, in one row of memory."""
    if not a or not b:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    y = np.array([codes[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        up = row[1:]
        row = np.concatenate(([0], np.maximum.accumulate(np.maximum(up, np.where(y == codes[w], row[:-1] + 1, 0)))))
    return int(row[-1])


@F.pandas_udf(T.ArrayType(T.LongType()))
def _lcs(reference: pd.Series, prediction: pd.Series) -> pd.Series:
    out = []
    for r, p in zip(reference, prediction):
        x, y = (re.findall(_TOKENS, (t or "").lower()) for t in (r, p))
        out.append([lcs(x, y), len(x), len(y)])
    return pd.Series(out)


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, precision, recall, f1) by the longest common subsequence of words."""
    d = pairs.select("id", _lcs("reference", "prediction").alias("v"))
    return _scores(d, F.col("v")[0], F.col("v")[1], F.col("v")[2])


def average_rouge(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """(rouge1, rouge2, rougeL): mean F1 over (id, text) pairs with two non-empty sides, 0 without any (O-AGG09, O-JN10).

    An id of one side only is an error.
    """
    r = references.toDF("id", "reference").withColumn("r", F.lit(True))
    both = r.join(predictions.toDF("id", "prediction").withColumn("p", F.lit(True)), "id", "full_outer")
    pairs = both.where("reference <> '' and prediction <> ''")
    orphans = both.agg(F.count_if(F.isnull("r") | F.isnull("p")).alias("orphans"))
    mean = lambda df, name: df.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias(name))
    return mean(rouge_n(pairs, 1), "rouge1").crossJoin(mean(rouge_n(pairs, 2), "rouge2")).crossJoin(mean(rouge_l(pairs), "rougeL")).crossJoin(orphans).select(  # one row each
        F.when(F.col("orphans") > 0, F.raise_error(F.lit("references and predictions must have the same ids")).cast("double")).otherwise(F.col("rouge1")).alias("rouge1"), "rouge2", "rougeL"
    )


def classifier_metrics(rows: DataFrame) -> DataFrame:
    """(accuracy, f1_weighted, f1_hoax) of (label, prediction) in {0, 1} (O-AGG11), from the four counts."""
    n = lambda a, b: F.count_if((F.col("label") == a) & (F.col("prediction") == b))
    c = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    f = lambda hit: zero(F.try_divide(2 * hit, 2 * hit + fp + fn))
    total = tp + fp + fn + tn
    return c.select(
        zero(F.try_divide(tp + tn, total)).alias("accuracy"), zero(F.try_divide(f(tp) * (tp + fn) + f(tn) * (tn + fp), total)).alias("f1_weighted"), f(tp).alias("f1_hoax")
    )


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """O-AGG10."""
    return rows.groupBy(label).agg(F.count("*").alias("n"))
