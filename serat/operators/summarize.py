"""Extractive summaries: sentence ranking, verified summaries, refinement (O-VEC07..10, O-TOP01/12, O-KG16/17)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serat.functions import text as X
from serat.functions.text import STOPWORDS_RANKER

_STOP = frozenset(STOPWORDS_RANKER)
_WORD = re.compile(r"(?u)\b\w\w+\b")


def sentences(text: str) -> list[str]:
    """Sentences of the cleaned text, as ``functions.text.split_sentences``."""
    clean = re.sub(r"<.*?>", "", re.sub(r"\s+", " ", text).strip())
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", clean)) if s]


def similarity(parts: list[str], threshold: float = 0.1) -> np.ndarray | None:
    """Cosine matrix of the sentences' TF-IDF vectors, small values and the diagonal 0; None without any term."""
    docs = []
    for s in parts:
        w = [t for t in _WORD.findall(s.lower()) if t not in _STOP]
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(t for d in docs for t in d)
    if not df:
        return None
    if len(df) > 5000:
        cf = Counter()
        for d in docs:
            cf.update(d)
        df = {t: df[t] for t in sorted(df, key=lambda t: (-cf[t], t))[:5000]}
    at = {t: i for i, t in enumerate(sorted(df))}
    m = np.zeros((len(docs), len(at)))
    for i, d in enumerate(docs):
        for t, n in d.items():
            if t in at:
                m[i, at[t]] = n * (math.log((1 + len(docs)) / (1 + df[t])) + 1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    m /= np.where(norms == 0, 1, norms)
    sim = m @ m.T
    sim[sim < threshold] = 0
    np.fill_diagonal(sim, 0)
    return sim


def pagerank(sim: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """O-VEC07: weighted PageRank; dangling mass spread evenly; uniform if it doesn't settle."""
    n = len(sim)
    out = sim.sum(axis=1)
    step = sim / np.where(out == 0, 1, out)[:, None]
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        new = damping * (x @ step + x[out == 0].sum() / n) + (1 - damping) / n
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    return np.full(n, 1 / n)


def centrality(sim: np.ndarray, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """O-VEC08: power iteration without damping on the row-stochastic matrix; the vector before the last step.

    A graph without edges ranks all alike (the iteration would divide by 0).
    """
    n = len(sim)
    x = np.full(n, 1 / n)
    out = sim.sum(axis=1, keepdims=True)
    step = (sim / np.where(out == 0, 1, out)).T
    for _ in range(rounds):
        new = step @ x
        total = np.abs(new).sum()
        if total == 0:
            return x
        new /= total
        if np.abs(new - x).sum() < tolerance:
            break
        x = new
    return x


def summarize(text: str | None, n: int = 3, method: str = "textrank", threshold: float = 0.1) -> str:
    """O-VEC09, O-VEC10: the n best sentences in their order.

    Shorter than 10 characters: empty.  No more than n sentences: the text as it is.  No more than n sentences with
    words: the first n.  Scores are compared to 12 places, the later sentence first among equals.
    """
    if not text or len(text.strip()) < 10:
        return ""
    parts = sentences(text)
    if len(parts) <= n:
        return text
    words = [re.sub(r"[^a-z\s]", "", s.lower()) for s in parts]
    used = [i for i, w in enumerate(words) if w.strip()]
    sim = similarity([words[i] for i in used], threshold) if len(used) > n else None
    if sim is None:
        return " ".join(parts[:n])
    scores = np.round(pagerank(sim) if method == "textrank" else centrality(sim), 12)
    best = sorted(range(len(used)), key=lambda k: (-scores[k], -k))[:n]
    return " ".join(parts[used[k]] for k in sorted(best))


def summaries(docs: DataFrame, n: int = 3, method: str = "textrank") -> DataFrame:
    """(coll, doc, summary) of (coll, doc, text): each document by itself, in one pass without a shuffle."""
    docs = docs.toDF("coll", "doc", "text")
    schema = docs.select("coll", "doc", F.col("text").alias("summary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([summarize(t, n, method) for t in b.column(2).to_pylist()], pa.string())], ["coll", "doc", "summary"])

    return docs.mapInArrow(run, schema)


def lead(text: Column, n: int = 3) -> Column:
    """O-TOP12: the first n claims joined to a text."""
    return F.concat(F.array_join(F.slice(X.split_claims(text), 1, n), ". "), F.lit("."))


def refine(summary: Column, bad_claims: Column) -> Column:
    """O-KG17: the summary without the sentences that contain the first 30 characters of a bad claim."""
    kept = F.filter(F.split(summary, r"\."), lambda s: ~F.exists(bad_claims, lambda c: s.contains(F.substring(c, 1, 30))))
    return F.array_join(F.filter(F.transform(kept, X.strip), lambda s: s != ""), ". ")


def verified_summaries(docs: DataFrame, verify, n: int = 3, mode: str = "extractive", target: float = 0.7, rounds: int = 3) -> DataFrame:
    """(coll, doc, summary, status, rate, iterations): summary, check, refinement of the bad ones (O-KG16).

    ``verify``: DataFrame (coll, doc, claim_idx, claim) -> (coll, doc, claim_idx, status, confidence).  A summary is
    done at the target rate or without hallucinations, and each round only looks at those that aren't; if the last
    round leaves one open, ``iterations`` is one more than ``rounds``.  "hybrid" starts from twice the sentences.
    """
    from serat.session import durable

    open_ = summaries(docs, 2 * n if mode == "hybrid" else n)
    done = None
    for i in range(1, rounds + 1):
        open_ = durable(open_)
        claims = open_.select("coll", "doc", F.posexplode(X.split_claims(F.col("summary"))).alias("claim_idx", "claim"))
        results = durable(verify(claims))
        bad = F.col("status").isin("HALLUCINATION", "CONTRADICTED")
        c = claims.join(results, ["coll", "doc", "claim_idx"])
        rated = c.groupBy("coll", "doc").agg(
            (F.count_if(F.col("status") == "VERIFIED") / F.count("*")).alias("rate"), F.count_if(F.col("status") == "HALLUCINATION").alias("wrong"), F.collect_list(F.when(bad, F.col("claim"))).alias("bad")
        )
        rated = open_.join(rated, ["coll", "doc"], "left").na.fill(0, ["rate", "wrong"])
        good = (F.col("rate") >= target) | (F.col("wrong") == 0)
        part = rated.where(good).select("coll", "doc", "summary", F.lit("DONE").alias("status"), "rate", F.lit(i).alias("iterations"))
        done = part if done is None else done.unionByName(part)
        open_ = rated.where(~good).select("coll", "doc", refine(F.col("summary"), F.coalesce("bad", F.array().cast("array<string>"))).alias("summary"))
    return done.unionByName(open_.select("coll", "doc", "summary", F.lit("OPEN").alias("status"), F.lit(0.0).alias("rate"), F.lit(rounds + 1).alias("iterations")))


def confidence(rate: Column, mean: Column) -> Column:
    """O-AGG13: the confidence of a checked summary."""
    return 0.6 * rate + 0.4 * mean


def credible_summaries(docs: DataFrame, scores: DataFrame, threshold: float = 0.5, n: int = 3) -> DataFrame:
    """(coll, summary): the first sentences of each collection's documents whose score reaches the threshold (O-FLT07, O-JN11).

    ``scores``: (coll, doc, score).  A collection without such a document gets a fixed text.
    """
    from pyspark.sql import Window

    kept = docs.join(scores.where(F.col("score") >= threshold).select("coll", "doc"), ["coll", "doc"], "left_semi")
    first = kept.withColumn("r", F.row_number().over(Window.partitionBy("coll").orderBy("doc"))).where(F.col("r") <= n)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc", lead(F.col("text"), 1).alias("s")))), lambda x: x["s"]), " ")
    out = docs.select("coll").distinct().join(first.groupBy("coll").agg(parts.alias("summary")), "coll", "left")
    return out.select("coll", F.coalesce("summary", F.lit("No documents passed credibility check.")).alias("summary"))
