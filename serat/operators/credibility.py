"""Credibility of documents from a misinformation score and the topic-outlier test (O-VEC11..16, O-AGG03/04, O-JN09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serat.functions import text as X


def hoax_label(p: Column, threshold: float = 0.5) -> Column:
    """O-FLT04."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    return F.when(p >= threshold, "HOAX").otherwise("VALID")


def classify(docs: DataFrame, p: Column, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with hoax_label, hoax_probability and confidence (O-VEC11); ``p`` comes from a plugged-in scorer.

    Texts of fewer than 10 characters: VALID with probability 0 and confidence 0.
    """
    enough = X.long_enough(F.col(text), 10)
    prob = F.when(enough, F.coalesce(p, F.lit(0.0))).otherwise(0.0)
    label = F.when(enough, hoax_label(prob, threshold)).otherwise("VALID")
    sure = F.when(enough, F.when(label == "HOAX", prob).otherwise(1 - prob)).otherwise(0.0)
    return docs.withColumns({"hoax_label": label, "hoax_probability": prob, "confidence": sure})


def score(p: Column, similarity: Column, is_outlier: Column, hoax_weight: float = 0.6, outlier_weight: float = 0.4) -> Column:
    """O-VEC12: weights must sum to 1 within 0.01."""
    if abs(hoax_weight + outlier_weight - 1) > 0.01:
        raise ValueError("weights must sum to 1")
    return hoax_weight * (1 - p) + outlier_weight * similarity * F.when(is_outlier, 0.3).otherwise(1.0)


def level(label: Column, is_outlier: Column, value: Column) -> Column:
    """O-VEC13."""
    hoax = label == "HOAX"
    return F.when(hoax & is_outlier, "CRITICAL").when(hoax | is_outlier, "LOW").when(value >= 0.7, "HIGH").otherwise("MEDIUM")


def flags(label: Column, p: Column, is_outlier: Column, z: Column) -> Column:
    """O-VEC14."""
    hoax = F.when(label == "HOAX", F.when(p >= 0.9, "HIGH_CONFIDENCE_HOAX").when(p >= 0.7, "LIKELY_HOAX").otherwise("POSSIBLE_HOAX"))
    topic = F.when(is_outlier, F.when(z < -3, "EXTREME_OUTLIER").otherwise("TOPIC_OUTLIER"))
    unsure = F.when((p >= 0.5) & (p < 0.7), "UNCERTAIN_CLASSIFICATION")
    return F.array_compact(F.array(hoax, topic, unsure))


def recommendation(lvl: Column, flag: Column) -> Column:
    """O-VEC15: only TOPIC_OUTLIER counts as off-topic."""
    low = F.when(F.array_contains(flag, "TOPIC_OUTLIER"), "EXCLUDE: Off-topic content. Does not match document cluster.").otherwise("EXCLUDE: Potential misinformation detected.")
    return (
        F.when(lvl == "CRITICAL", "EXCLUDE: High-risk content. Do not include in summarization.")
        .when(lvl == "LOW", low)
        .when(lvl == "MEDIUM", "INCLUDE WITH CAUTION: Verify facts before publishing.")
        .otherwise("INCLUDE: Content appears credible.")
    )


def assess(classified: DataFrame, outliers: DataFrame) -> DataFrame:
    """(coll, doc, hoax_label, hoax_probability, is_outlier, similarity, z_score, level, score, flags, recommendation, approved).

    ``classified`` (coll, doc, hoax_label, hoax_probability) meets ``outliers`` (coll, doc, ...) on its key (O-JN09).
    """
    d = classified.select("coll", "doc", "hoax_label", "hoax_probability").join(outliers, ["coll", "doc"])
    p, out = F.col("hoax_probability"), F.col("is_outlier")
    d = d.withColumn("score", score(p, F.col("similarity"), out)).withColumn("level", level(F.col("hoax_label"), out, F.col("score")))
    d = d.withColumn("flags", flags(F.col("hoax_label"), p, out, F.col("z_score"))).withColumn("recommendation", recommendation(F.col("level"), F.col("flags")))
    return d.withColumn("approved", F.col("level").isin("HIGH", "MEDIUM"))


def collection_risk(assessed: DataFrame) -> DataFrame:
    """(coll, n_docs, n_high, n_medium, n_low, n_critical, n_approved, n_excluded, risk, summary) (O-AGG03, O-AGG04)."""
    n = {k: F.count_if(F.col("level") == k.upper()).alias(f"n_{k}") for k in ("high", "medium", "low", "critical")}
    a = assessed.groupBy("coll").agg(F.count("*").alias("n_docs"), *n.values(), F.count_if("approved").alias("n_approved"))
    a = a.withColumn("n_excluded", F.col("n_docs") - F.col("n_approved"))
    critical, low = F.col("n_critical") / F.col("n_docs"), F.col("n_low") / F.col("n_docs")
    risk = F.when(critical > 0.3, "CRITICAL").when((critical > 0.1) | (low > 0.4), "HIGH").when(low > 0.2, "MODERATE").otherwise("LOW")
    s = lambda c: F.col(c).cast("string")
    said = (
        F.when(risk == "CRITICAL", F.concat(F.lit("High-risk collection: "), s("n_critical"), F.lit(" critical documents detected. Manual review strongly recommended.")))
        .when(risk == "HIGH", F.concat(F.lit("Elevated risk: "), s("n_excluded"), F.lit(" documents excluded. Verify remaining sources.")))
        .when(risk == "MODERATE", F.concat(F.lit("Some concerns detected: "), s("n_excluded"), F.lit(" documents excluded. Proceed with caution.")))
        .otherwise(F.concat(F.lit("Collection appears credible. "), s("n_approved"), F.lit(" of "), s("n_docs"), F.lit(" documents approved.")))
    )
    return a.withColumns({"risk": risk, "summary": said})


def gate(docs: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """O-FLT07: rows whose score reaches the threshold."""
    return docs.where(F.col(value) >= threshold)


def live_gate(docs: DataFrame, p: str = "hoax_probability", limit: float = 0.7) -> DataFrame:
    """O-FLT05: rows whose probability doesn't pass the limit."""
    return docs.where(F.col(p) <= limit)


def band(p: Column) -> Column:
    """O-FLT06: three bands of the probability."""
    return F.when(p >= 0.7, "HIGH").when(p >= 0.5, "UNCERTAIN").otherwise("LOW")


def report_document(assessed: DataFrame, texts: DataFrame, preview: int = 150) -> DataFrame:
    """(coll, doc, report): one JSON object a document, numbers to four places, the text's start as preview (O-SNK03)."""
    cut = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    r = lambda c: F.round(c, 4).alias(c)
    body = F.struct("hoax_label", r("hoax_probability"), "is_outlier", r("similarity"), r("z_score"), "level", r("score"), "flags", "recommendation", cut.alias("preview"))
    return assessed.join(texts.toDF("coll", "doc", "text"), ["coll", "doc"]).select("coll", "doc", F.to_json(body).alias("report"))
