"""Retrieval data flows around search hits and vectors (O-RET01..05, O-TOP06/07, O-FLD07, O-STR13/14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serat.operators import credibility as C
from serat.operators import vector as V

NO_RESULTS = "No search results found."
NO_INTELLIGENCE = "No credible intelligence found."


def first_of_link(hits: DataFrame) -> DataFrame:
    """O-FLD07: of (query_id, rank, title, link, snippet) the first hit of each link within a query.

    By a minimum, aggregated before the shuffle: a link that a third of all hits share is one row a task.
    """
    rest = [c for c in hits.columns if c not in ("query_id", "link")]
    best = hits.groupBy("query_id", "link").agg(F.min_by(F.struct(*rest), "rank").alias("b"))
    return best.select("query_id", "link", *[F.col(f"b.{c}").alias(c) for c in rest])


def format_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, text): the numbered hits of each (query_id, query) in order of rank, or a fixed text (O-STR13)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))  # a query's hits are at most a page
    line = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), "title", F.lit("\n    Source: "), "link", F.lit("\n    Context: "), "snippet", F.lit("\n\n"))
    text = hits.withColumn("i", rank).select("query_id", F.struct("i", line.alias("line")).alias("l")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "").alias("body"))
    head = F.concat(F.lit("Search Results for '"), "query", F.lit("':\n\n"))
    return queries.join(text, "query_id", "left").select("query_id", F.when(F.col("body").isNull(), NO_RESULTS).otherwise(F.concat(head, "body")).alias("text"))


def recent(hits: DataFrame, now: str, limit: str | None) -> DataFrame:
    """O-SRC13: hits not older than a day, week, month or year ("d", "w", "m", "y"; None: all) before ``now``."""
    if limit is None:
        return hits
    unit = {"d": "DAY", "w": "WEEK", "m": "MONTH", "y": "YEAR"}[limit]
    return hits.where(F.col("ts") >= F.expr(f"timestampadd({unit}, -1, timestamp'{now}')"))


def format_documents(docs: DataFrame, rich: bool = True) -> DataFrame:
    """(coll, text): a collection's documents for a prompt, in order (O-STR14).

    ``docs``: (coll, i, content, date, source) with defaults for null date and source, or plain (coll, i, content).
    """
    n = F.col("i").cast("string")
    content = F.coalesce("content", F.lit(""))
    if rich:
        one = F.concat(F.lit("--- [Sumber "), n, F.lit(" | Tanggal: "), F.coalesce("date", F.lit("Unknown Date")), F.lit(" | Asal: "), F.coalesce("source", F.lit("Web Search")), F.lit("] ---\n"), content)
    else:
        one = F.concat(F.lit("[Document "), n, F.lit("]\n"), content)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("i", one.alias("t")))), lambda x: x["t"])
    return docs.groupBy("coll").agg(F.array_join(parts, "\n\n" if rich else "\n\n---\n\n").alias("text"))


def temporal_rag(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(vec_id, similarity, date, rank): the k most similar, then by date, a missing one first (O-RET01, O-TOP06)."""
    best = V.top_k(vectors, query, k).join(vectors.select("vec_id", F.col("metadata")["date"].alias("date")), "vec_id")
    order = Window.orderBy(F.coalesce("date", F.lit("0000-00-00")), F.col("similarity").desc(), "vec_id")  # k rows
    return best.withColumn("rank", F.row_number().over(order))


def verified_intel(hits: DataFrame, p: Column, limit: float = 0.7) -> DataFrame:
    """(content, date, source, url): hits as intelligence, those too likely false left out (O-RET02)."""
    content = F.concat_ws(". ", "title", "body")
    d = C.live_gate(hits.withColumn("hoax_probability", p), limit=limit)
    return d.select(content.alias("content"), F.coalesce("date", F.lit("Unknown Date")).alias("date"), "source", "url")


def narrative(intel: DataFrame) -> DataFrame:
    """(coll, text): the prompt of a collection's intelligence, or a fixed text if there is none (O-RET03)."""
    n = intel.where("content is not null").withColumn("i", F.row_number().over(Window.partitionBy("coll").orderBy("date", "url")))
    every = intel.select("coll").distinct()
    return every.join(format_documents(n), "coll", "left").select("coll", F.coalesce("text", F.lit(NO_INTELLIGENCE)).alias("text"))


def add_documents(store: DataFrame, docs: DataFrame) -> DataFrame:
    """O-RET04: the store with the documents whose text isn't empty."""
    return store.unionByName(docs.where("text <> ''"), allowMissingColumns=True)


def with_metadata(docs: DataFrame) -> DataFrame:
    """O-RET05: (id, text, metadata) with date, source and url as a map."""
    return docs.select("id", "text", F.create_map(F.lit("date"), "date", F.lit("source"), "source", F.lit("url"), "url").alias("metadata"))
