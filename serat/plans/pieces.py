"""Queries of lookups, round trips through files and single functions over the test tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serat.functions import dates as D
from serat.functions import text as X
from serat.operators import graph as G
from serat.operators import metrics, retrieval, summarize
from serat.operators import verify as V
from serat.plans import news
from serat.plans.news import WS, _quoted, _strip, documents, table
from serat.session import shared_dir
from serat.sources import readers, writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/serat-{name}-{uuid.uuid4().hex}"


# --- files ------------------------------------------------------------------------------------------------------
_RECORDS = "SELECT news_id, title, kanal, link FROM cnnindonesia_news_raw"


def _news(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cnnindonesia_news_raw").select("news_id", "title", "kanal", "link")


@query("SELECT news_id, nullif(title, '') AS title, nullif(kanal, '') AS kanal, nullif(link, '') AS link FROM cnnindonesia_news_raw")
def csv_round_trip(spark, d):
    """Written with a header and read by name; an empty text comes back as null."""
    path = _place(spark, "csv") + ".csv"
    writers.write_csv(_news(spark, d), path)
    back = readers.read_table(spark, path)
    return back.select(F.col("news_id").cast("long").alias("news_id"), *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("title", "kanal", "link")])


@query(_RECORDS)
def json_round_trip(spark, d):
    path = _place(spark, "json")
    writers.write_json(_news(spark, d), path)
    return spark.read.schema("news_id long, title string, kanal string, link string").json(path)


@query("SELECT news_id, title FROM cnnindonesia_news_raw WHERE news_id % 2 = 0 UNION ALL SELECT news_id, title FROM cnnindonesia_news_raw WHERE news_id % 2 = 1")
def store_appended(spark, d):
    """A store that isn't there is empty; what is appended to it comes back."""
    path = _place(spark, "store")
    news_ = _news(spark, d).select("news_id", "title")
    assert readers.read_store(spark, path).isEmpty()
    for k in (0, 1):
        writers.append_store(news_.where(F.pmod("news_id", F.lit(2)) == k), path)
    return readers.read_store(spark, path)


@query("SELECT news_id, title, NULL::VARCHAR AS kanal FROM cnnindonesia_news_raw UNION ALL SELECT news_id, NULL, kanal FROM cnnindonesia_news_raw")
def directory_by_name(spark, d):
    """Files of a folder with different columns."""
    path = _place(spark, "folder")
    _news(spark, d).select("news_id", "title").write.parquet(f"{path}/a.parquet")
    _news(spark, d).select("news_id", "kanal").write.parquet(f"{path}/b.parquet")
    return readers.read_directory(spark, path)


@query("SELECT title AS text FROM cnnindonesia_news_raw WHERE title IS NOT NULL")
def jsonl_documents(spark, d):
    """Objects with the text under one of the known keys, read as documents."""
    path = _place(spark, "lines") + ".jsonl"
    t = _news(spark, d).where("title is not null")
    one = lambda k, c: t.where(F.pmod("news_id", F.lit(2)) == k).select(F.to_json(F.struct(F.col("title").alias(c), "news_id")).alias("value"))
    one(0, "content").unionByName(one(1, "article")).write.text(path)
    return readers.read_documents(spark, path).select("text")


@query("SELECT doc_id AS id, CASE WHEN length(text) > 100 THEN concat(text[1:100], '...') ELSE text END AS preview, text[1:200] AS claim, round(n_chars / 7, 4) AS share FROM documents")
def report_columns(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("preview"), F.col("text").alias("claim"), (F.col("n_chars") / 7).alias("share"))
    return writers.as_report(t)


# --- graph ------------------------------------------------------------------------------------------------------
@query(f"WITH {news._NODES} SELECT key, mentions, aliases FROM nodes WHERE key = 'SUPPLIER:7'")
def graph_node(spark, d):
    return G.node(news._nodes(spark, d), "SUPPLIER:7").select("key", "mentions", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {news._PLACES}, n AS (SELECT DISTINCT unnest([source, target]) AS key FROM places) SELECT key FROM n WHERE starts_with(key, 'N:')")
def graph_nodes_by_type(spark, d):
    n = news._places(spark, d).select(F.explode(F.array("source", "target")).alias("key")).distinct()
    return G.nodes_by_type(n.withColumn("entity_type", F.substring_index("key", ":", 1)), "N").select("key")


@query(f"WITH {news._NODES} SELECT DISTINCT doc, key FROM inputs")
def graph_by_document(spark, d):
    return G.by_document(news._nodes(spark, d)).select("doc", "key")


@query(f"WITH {news._EDGES} SELECT 'tpch' AS coll, source AS subject, relation_type AS predicate, target AS object FROM edges")
def graph_facts(spark, d):
    return G.triples(news._edges(spark, d))


@query(
    f"""WITH {news._PLACES}, e AS (SELECT *, CASE WHEN starts_with(target, 'N:') THEN 'LIVES_IN' ELSE 'LOCATED_IN' END AS kind FROM places),
c AS (SELECT concat('S:', s_suppkey) AS source, unnest([concat('N:', n_name), concat('R:', r_name)]) AS target, CASE WHEN s_suppkey % 2 = 0 THEN 'LIVES_IN' ELSE 'LEADS' END AS predicate
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey UNION SELECT concat('R:', r_name), 'S:1', 'LEADS' FROM region)
SELECT c.*, CASE WHEN e.kind = c.predicate THEN 'VERIFIED' WHEN e.kind IS NOT NULL THEN 'CONTRADICTED' WHEN starts_with(c.source, 'S:') THEN 'PARTIALLY_VERIFIED' ELSE 'UNVERIFIED' END AS relation_status,
  CASE WHEN e.kind = c.predicate THEN 0.9::DOUBLE WHEN e.kind IS NOT NULL THEN 0.3 WHEN starts_with(c.source, 'S:') THEN 0.5 ELSE 0.0 END AS relation_confidence
FROM c LEFT JOIN e USING (source, target)"""
)
def path_verdicts(spark, d):
    """Claims with an edge of the kind, with another, with a path of two edges, and with none."""
    e = news._places(spark, d).withColumn("relation_type", F.when(F.col("target").startswith("N:"), "LIVES_IN").otherwise("LOCATED_IN")).withColumn("confidence", F.lit(0.9))
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    where = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    both = F.explode(F.array(F.concat(F.lit("N:"), "n_name"), F.concat(F.lit("R:"), "r_name"))).alias("target")
    c = where.select(F.concat(F.lit("S:"), F.col("s_suppkey").cast("string")).alias("source"), both, F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "LIVES_IN").otherwise("LEADS").alias("predicate"))
    c = c.union(r.select(F.concat(F.lit("R:"), "r_name"), F.lit("S:1"), F.lit("LEADS"))).distinct()
    return V.match_relations(c, e)


# --- functions --------------------------------------------------------------------------------------------------
@query(
    f"""SELECT doc_id AS doc, regexp_replace(regexp_replace(regexp_replace({_strip("regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[*_#`]', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), 'http[^\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+', 'website', 'g')")},
  '(?i)^{WS}*so{WS}+it{WS}+looks{WS}+like{WS}*[:,]?{WS}*', ''), '(?i)^{WS}*it{WS}+looks{WS}+like{WS}*[:,]?{WS}*', ''), '(?i)^{WS}*looks{WS}+like{WS}*[:,]?{WS}*', '') AS spoken FROM documents"""
)
def spoken_text(spark, d):
    return documents(spark, d).select("doc", X.strip_fillers(X.scrub_markup(F.col("text"))).alias("spoken"))


def _honorifics(lang: str) -> str:
    return "|".join(sorted((w.replace(".", "\\.") for w in X.HONORIFICS[lang]), key=len, reverse=True))


_TITLE = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


@query(
    f"""WITH e AS (SELECT entity_id, entity_type, coalesce(lang, 'id') AS lang, {_strip("coalesce(text, '')")} AS name FROM entity)
SELECT entity_id, CASE entity_type WHEN 'ORGANIZATION' THEN CASE lower(name) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.ABBREVIATIONS.items())} ELSE name END
  WHEN 'PERSON' THEN CASE WHEN lang = 'id' THEN {_TITLE(_strip(f"regexp_replace(name, '(?i)^(?:{_honorifics('id')})', '')"))} ELSE {_TITLE(_strip(f"regexp_replace(name, '(?i)^(?:{_honorifics('en')})', '')"))} END
  WHEN 'LOCATION' THEN {_TITLE('name')} ELSE name END AS name FROM e"""
)
def normalized_names(spark, d):
    e = table(spark, d, "entity")
    return e.select("entity_id", X.normalize_entity(F.col("text"), F.col("entity_type"), F.coalesce("lang", F.lit("id"))).alias("name"))


@query("SELECT news_id, coalesce(length(title), 0) > 10 AND NOT contains(coalesce(title, ''), 'HOAX') AND NOT contains(coalesce(title, ''), ' di ') AS usable FROM cnnindonesia_news_raw")
def foreign_input(spark, d):
    """Titles that our own marks, here two frequent words, tell from others."""
    return table(spark, d, "cnnindonesia_news_raw").select("news_id", X.is_foreign_input(F.col("title"), ["HOAX", " di "]).alias("usable"))


@query("SELECT doc_id AS doc, contains(upper(coalesce(text, '')), 'WORTH SAVING') OR contains(upper(coalesce(text, '')), 'TRUE') AS worth FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'untrue: ' || text WHEN 1 THEN 'Worth saving ' || text ELSE text END AS text FROM documents)")
def worth_saving(spark, d):
    k = F.pmod("doc_id", F.lit(4))
    t = table(spark, d, "documents").select("doc_id", F.when(k == 0, F.concat(F.lit("untrue: "), "text")).when(k == 1, F.concat(F.lit("Worth saving "), "text")).otherwise(F.col("text")).alias("text"))
    return t.select(F.col("doc_id").alias("doc"), X.worth_saving(F.col("text")).alias("worth"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE concat('cari ', n_name) END AS query, CASE WHEN n_nationkey % 2 = 0 THEN 'w' END AS timelimit FROM nation")
def search_parameters(spark, d):
    n = table(spark, d, "nation")
    said = F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.concat(F.lit('baik, {"query": "'), "n_name", F.lit('",\n "timelimit": "w"} selesai'))).otherwise(F.concat(F.lit("cari "), "n_name"))
    v = X.search_parameters(said)
    return n.select(F.col("n_nationkey").alias("id"), v["query"].alias("query"), v["timelimit"].alias("timelimit"))


@query("SELECT doc_id AS doc, CASE WHEN a < b THEN substr(text, a + 1, b - a) ELSE '' END AS part FROM (SELECT doc_id, text, greatest(least(doc_id % 300 - 20, length(text)), 0) AS a, greatest(least(doc_id % 170, length(text)), 0) AS b FROM documents WHERE text IS NOT NULL)")
def text_slices(spark, d):
    """Slices whose ends may lie outside the text or in the wrong order."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select(F.col("doc_id").alias("doc"), X.py_slice(F.col("text"), (F.pmod("doc_id", F.lit(300)) - 20).cast("int"), F.pmod("doc_id", F.lit(170)).cast("int")).alias("part"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate AS t, date_trunc('day', o_orderdate) AS day, (['DAY', 'WEEK', 'MONTH', 'QUARTER', 'YEAR', 'EXACT'])[1 + o_orderkey % 6] AS g FROM orders)
SELECT o_orderkey, g AS granularity, strftime(CASE g WHEN 'DAY' THEN day + INTERVAL 1 DAY - INTERVAL 1 SECOND WHEN 'WEEK' THEN t + INTERVAL 7 DAY - INTERVAL 1 SECOND WHEN 'MONTH' THEN date_trunc('month', t) + INTERVAL 1 MONTH + (t - day) - INTERVAL 1 SECOND
  WHEN 'QUARTER' THEN date_trunc('quarter', t) + INTERVAL 3 MONTH + (t - day) - INTERVAL 1 SECOND WHEN 'YEAR' THEN date_trunc('year', t) + INTERVAL 1 YEAR - INTERVAL 1 SECOND ELSE t END, '%Y-%m-%dT%H:%M:%S') AS "end" FROM o"""
)
def period_ends_of_all(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    g = F.element_at(F.array(*map(F.lit, ["DAY", "WEEK", "MONTH", "QUARTER", "YEAR", "EXACT"])), (F.pmod("o_orderkey", F.lit(6)) + 1).cast("int"))
    return o.select("o_orderkey", g.alias("granularity"), F.date_format(D.end_of_period(F.col("t"), g), "yyyy-MM-dd'T'HH:mm:ss").alias("end"))


@query(
    """SELECT o_orderkey, printf('%04d-%02d-%02dT00:00:00', year(o_orderdate), month(o_orderdate), CAST(o_orderkey % 32 AS INTEGER)) AS iso,
  CASE (['I', 'ii', 'III', '4', 'x'])[1 + o_orderkey % 5] WHEN 'ii' THEN 4 WHEN 'III' THEN 7 WHEN '4' THEN 10 ELSE 1 END AS month, strftime(DATE '2024-01-17' - CAST(o_orderkey % 11 AS INTEGER), '%Y-%m-%d') AS day FROM orders"""
)
def date_parts(spark, d):
    o = table(spark, d, "orders")
    numeral = F.element_at(F.array(*map(F.lit, ["I", "ii", "III", "4", "x"])), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    iso = D.iso(F.year("o_orderdate"), F.month("o_orderdate"), F.pmod("o_orderkey", F.lit(32)).cast("int"))
    return o.select("o_orderkey", iso.alias("iso"), D.quarter_start(numeral).alias("month"), D.simulated_date("2024-01-17", F.col("o_orderkey")).alias("day"))


# --- retrieval and summaries ------------------------------------------------------------------------------------
@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def recent_events(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return retrieval.recent(e, str(e.agg(F.max("ts")).first()[0]), "d")


@query("SELECT doc_id AS id, text FROM documents WHERE text <> '' AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0")
def store_with_documents(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    third = F.pmod("id", F.lit(3)) == 0
    return retrieval.add_documents(t.where(third), t.where(~third))


@query("SELECT doc_id AS id, strftime(published_at, '%Y-%m-%d') AS date, source, url FROM documents")
def document_metadata(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.date_format("published_at", "yyyy-MM-dd").alias("date"), "source", "url")
    return retrieval.with_metadata(t).select("id", *[F.col("metadata")[c].alias(c) for c in ("date", "source", "url")])


@query("SELECT l_orderkey AS id, round(0.6 * sum(l_discount) / count(*) + 0.4 * avg(l_tax), 6) AS confidence FROM lineitem GROUP BY l_orderkey")
def summary_confidence(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg("l_discount").alias("rate"), F.avg("l_tax").alias("mean"))
    return s.select("id", F.round(summarize.confidence(F.col("rate"), F.col("mean")), 6).alias("confidence"))


@query(
    "WITH scores AS (" + news._rouge_sql(1) + ") SELECT round(avg(f1), 4) AS rouge1 FROM scores WHERE id IN (SELECT doc_id FROM documents WHERE text <> '')"
)
def mean_rouge(spark, d):
    t = news._rouge_pairs(spark, d).where("reference <> ''")
    return metrics.average_rouge(t.select("id", "reference"), t.select("id", "prediction")).select(F.round("rouge1", 4).alias("rouge1"))
