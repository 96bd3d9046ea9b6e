"""Queries of the news-trust operators over the test tables, and their SQL.

The misinformation score is a plug-in; here it is a fixed function of the id.  Graph queries run over triples made of
the relational tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serat.functions import dates as D
from serat.functions import text as X
from serat.operators import credibility as C
from serat.operators import entities as E
from serat.operators import etl, metrics, relations, retrieval, summarize, temporal, vector
from serat.operators import graph as G
from serat.operators import verify as V
from serat.session import durable, spread
from serat.streaming import titles

REFERENCE = datetime(2024, 1, 17)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
# White space and words as both engines' patterns spell them.
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """(coll, doc, text): a collection is a source."""
    return spread(table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("coll"), F.col("doc_id").alias("doc"), "text"))


def _p() -> Column:
    return F.pmod(F.col("doc") * 37, F.lit(101)) / 100.0


# --- SQL pieces -------------------------------------------------------------------------------------------------
def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def _clean(x: str) -> str:
    return "regexp_replace(" + _strip(f"regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g')") + ", '<.*?>', '', 'g')"


def _words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{2,}}')"


_quoted = lambda ws: ", ".join("'" + w.replace("'", "''") + "'" for w in ws)
_OUTLIERS = f"""
docs AS (SELECT coalesce(source, '') AS coll, doc_id AS doc, text, coalesce(length({_strip("text")}) >= 11, false) AS valid FROM documents),
sizes AS (SELECT coll, count(*) AS total, count(*) FILTER (valid) AS n FROM docs GROUP BY coll),
words AS (SELECT coll, doc, list_filter({_words("text")}, lambda w: w NOT IN ({_quoted(X.STOPWORDS_OUTLIER)})) AS w
          FROM docs JOIN sizes USING (coll) WHERE valid AND total >= 3 AND n >= 3),
terms AS (SELECT coll, doc, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT coll, doc, term, count(*) AS tf FROM terms GROUP BY coll, doc, term),
stats AS (SELECT coll, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY coll, term),
kept AS (SELECT coll, term, ln((1 + n) / (1 + df)) + 1 AS idf FROM stats JOIN sizes USING (coll) WHERE df <= 0.95::DOUBLE * n
         QUALIFY row_number() OVER (PARTITION BY coll ORDER BY cf DESC, term) <= 5000),
w AS (SELECT coll, doc, term, tf * idf AS w FROM tf JOIN kept USING (coll, term)),
norms AS (SELECT coll, doc, sqrt(sum(w * w)) AS norm FROM w GROUP BY coll, doc),
vec AS (SELECT coll, doc, term, w / norm AS weight FROM w JOIN norms USING (coll, doc)),
centre AS (SELECT coll, term, sum(weight) / any_value(n) AS c FROM vec JOIN sizes USING (coll) GROUP BY coll, term),
len_ AS (SELECT coll, sqrt(sum(c * c)) AS length FROM centre GROUP BY coll),
sims AS (SELECT words.coll, words.doc, coalesce(dot / length, 0) AS similarity FROM words
         LEFT JOIN (SELECT coll, doc, sum(weight * c) AS dot FROM vec JOIN centre USING (coll, term) GROUP BY coll, doc) d USING (coll, doc) LEFT JOIN len_ USING (coll)),
zs AS (SELECT coll, doc, similarity AS s, (similarity - m) / greatest(dev, 1e-6) AS z FROM sims JOIN (SELECT coll, avg(similarity) AS m, stddev_pop(similarity) AS dev FROM sims GROUP BY coll) USING (coll)),
outliers AS (SELECT docs.coll, docs.doc,
  CASE WHEN total < 3 THEN 1.0 WHEN NOT valid THEN 0.0 ELSE coalesce(s, 1.0) END AS similarity,
  CASE WHEN total < 3 THEN 0.0 WHEN NOT valid AND n >= 3 THEN -999.0 ELSE coalesce(z, 0.0) END AS z_score,
  CASE WHEN total < 3 THEN false WHEN NOT valid THEN true ELSE coalesce(z < -2.0, false) END AS is_outlier
  FROM docs JOIN sizes USING (coll) LEFT JOIN zs ON zs.coll = docs.coll AND zs.doc = docs.doc)"""
_ASSESSED = f"""{_OUTLIERS},
scored AS (SELECT o.coll, o.doc, similarity, z_score, is_outlier, CASE WHEN coalesce(length({_strip("text")}) >= 10, false) THEN ((o.doc * 37) % 101) / 100.0::DOUBLE ELSE 0.0 END AS p
  FROM outliers o JOIN docs USING (coll, doc)),
levels AS (SELECT *, 0.6 * (1 - p) + 0.4 * similarity * CASE WHEN is_outlier THEN 0.3 ELSE 1.0 END AS score FROM scored),
assessed AS (SELECT *, CASE WHEN p >= 0.5 AND is_outlier THEN 'CRITICAL' WHEN p >= 0.5 OR is_outlier THEN 'LOW' WHEN score >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM levels)"""


# --- credibility ------------------------------------------------------------------------------------------------
def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c, t in df.dtypes if t == "double"})


@query(f"WITH {_OUTLIERS} SELECT coll, doc, round(similarity, 6) + 0.0 AS similarity, round(z_score, 6) + 0.0 AS z_score, is_outlier FROM outliers")
def topic_outliers(spark, d):
    return _rounded(vector.detect_outliers(documents(spark, d)))


def _assessed(spark, d):
    docs = documents(spark, d)
    return C.assess(C.classify(docs, _p()), vector.detect_outliers(docs))


@query(f"WITH {_ASSESSED} SELECT coll, doc, round(p, 6) + 0.0 AS hoax_probability, round(score, 6) + 0.0 AS score, level, level IN ('HIGH', 'MEDIUM') AS approved FROM assessed")
def credibility_report(spark, d):
    return _rounded(_assessed(spark, d).select("coll", "doc", "hoax_probability", "score", "level", "approved"))


@query(
    f"""WITH {_ASSESSED}, f AS (SELECT coll, doc, level, list_filter([
  CASE WHEN p >= 0.9 THEN 'HIGH_CONFIDENCE_HOAX' WHEN p >= 0.7 THEN 'LIKELY_HOAX' WHEN p >= 0.5 THEN 'POSSIBLE_HOAX' END,
  CASE WHEN is_outlier THEN CASE WHEN z_score < -3 THEN 'EXTREME_OUTLIER' ELSE 'TOPIC_OUTLIER' END END,
  CASE WHEN p >= 0.5 AND p < 0.7 THEN 'UNCERTAIN_CLASSIFICATION' END], lambda x: x IS NOT NULL) AS flags FROM assessed)
SELECT coll, doc, array_to_string(flags, ',') AS flags, CASE level WHEN 'CRITICAL' THEN 'EXCLUDE: High-risk content. Do not include in summarization.'
  WHEN 'LOW' THEN CASE WHEN list_contains(flags, 'TOPIC_OUTLIER') THEN 'EXCLUDE: Off-topic content. Does not match document cluster.' ELSE 'EXCLUDE: Potential misinformation detected.' END
  WHEN 'MEDIUM' THEN 'INCLUDE WITH CAUTION: Verify facts before publishing.' ELSE 'INCLUDE: Content appears credible.' END AS recommendation FROM f"""
)
def credibility_flags(spark, d):
    return _assessed(spark, d).select("coll", "doc", F.array_join("flags", ",").alias("flags"), "recommendation")


@query(
    f"""WITH {_ASSESSED}, n AS (SELECT coll, count(*) AS n_docs, count(*) FILTER (level = 'HIGH') AS n_high, count(*) FILTER (level = 'MEDIUM') AS n_medium, count(*) FILTER (level = 'LOW') AS n_low,
  count(*) FILTER (level = 'CRITICAL') AS n_critical FROM assessed GROUP BY coll)
SELECT *, n_high + n_medium AS n_approved, n_low + n_critical AS n_excluded,
  CASE WHEN n_critical / n_docs > 0.3 THEN 'CRITICAL' WHEN n_critical / n_docs > 0.1 OR n_low / n_docs > 0.4 THEN 'HIGH' WHEN n_low / n_docs > 0.2 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM n"""
)
def collection_risk(spark, d):
    return C.collection_risk(_assessed(spark, d)).drop("summary")


@query()
def credibility_json(spark, d):
    return C.report_document(_assessed(spark, d), documents(spark, d))


@query("SELECT doc_id AS doc, CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.5 THEN 'UNCERTAIN' ELSE 'LOW' END AS band FROM (SELECT doc_id, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p FROM documents) WHERE p <= 0.7")
def live_gate(spark, d):
    return C.live_gate(documents(spark, d).withColumn("hoax_probability", _p())).select("doc", C.band(F.col("hoax_probability")).alias("band"))


# --- text -------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id AS doc, {_clean('text')} AS clean FROM documents")
def clean_text(spark, d):
    return documents(spark, d).select("doc", X.clean_text(F.col("text")).alias("clean"))


_SENTENCES = f"string_split(regexp_replace({_clean('text')}, '([.!?]){WS}+', concat('\\1', chr(1)), 'g'), chr(1))"
_SENTENCES = f"list_filter(list_transform({_SENTENCES}, lambda s: {_strip('s')}), lambda s: s <> '')"


@query(f"SELECT doc, CAST(pos AS INTEGER) AS pos, s AS sentence FROM (SELECT doc_id AS doc, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents))")
def sentences(spark, d):
    return documents(spark, d).select("doc", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"SELECT doc_id AS doc, array_to_string(list_transform({_SENTENCES}, lambda s: regexp_replace(lower(s), '[^a-z\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]', '', 'g')), '|') AS processed FROM documents")
def preprocessed(spark, d):
    return documents(spark, d).select("doc", F.array_join(X.preprocess_document(F.col("text")), "|").alias("processed"))


@query(
    f"SELECT doc, claim FROM (SELECT doc_id AS doc, unnest(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: {_strip('s')})) AS claim FROM documents) WHERE length(claim) >= 11"
)
def claims(spark, d):
    return documents(spark, d).select("doc", F.explode(X.split_claims(F.col("text"))).alias("claim"))


@query(f"SELECT doc_id AS doc, len(list_filter(w, lambda t: t NOT IN ({_quoted(X.STOPWORDS)}))) AS words FROM (SELECT doc_id, {_words('text')} AS w FROM documents)")
def without_stopwords(spark, d):
    words = F.regexp_extract_all(F.lower(X.text(F.col("text"))), F.lit(vector.TOKEN), F.lit(0))
    return documents(spark, d).select("doc", F.size(X.remove_stopwords(words)).alias("words"))


@query(
    f"""SELECT doc_id AS doc, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip("x")}),
  lambda x: x <> '' AND (length(x) >= 4 OR (upper(x) = x AND lower(x) <> x)) AND NOT regexp_full_match(x, '[^\\p{{L}}\\p{{M}}\\p{{Pc}}]+') AND lower(x) NOT IN ({_quoted(X.UI_TERMS)})
    AND NOT starts_with(x, 'http://') AND NOT starts_with(x, 'https://') AND NOT starts_with(x, 'www.') AND NOT starts_with(x, 'file://') AND NOT starts_with(x, 'C:\\') AND NOT starts_with(x, '/usr/')), chr(10)) AS clean FROM documents"""
)
def clean_for_graph(spark, d):
    return documents(spark, d).select("doc", X.clean_for_graph(F.col("text")).alias("clean"))


_UNTAGGED = rf"regexp_replace(coalesce(text, ''), '^\[.*?\]{WS}*', '')"


@query(f"SELECT doc_id AS doc, {_strip(_UNTAGGED)} AS clean FROM documents")
def strip_tags(spark, d):
    return documents(spark, d).select("doc", X.strip_tag(F.col("text")).alias("clean"))


@query(
    f"SELECT doc_id AS doc, CASE WHEN len(list_filter(w, lambda t: t IN ({_quoted(X.LANGUAGE_WORDS['id'])}))) >= len(list_filter(w, lambda t: t IN ({_quoted(X.LANGUAGE_WORDS['en'])}))) THEN 'id' ELSE 'en' END AS lang FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '{WS}+') AS w FROM documents)"
)
def languages(spark, d):
    return documents(spark, d).select("doc", X.detect_language(F.col("text")).alias("lang"))


@query(f"SELECT doc_id AS doc, coalesce({' OR '.join(f'contains(lower(text), {chr(39)}{k.lower()}{chr(39)})' for k in X.WATCHED)}, false) AS watched, coalesce(length(text), 0) > 10 AS usable FROM documents")
def keyword_filter(spark, d):
    return documents(spark, d).select("doc", X.contains_keyword(F.col("text")).alias("watched"), X.is_foreign_input(F.col("text"), []).alias("usable"))


# --- data sets --------------------------------------------------------------------------------------------------
_TITLES = "SELECT kanal, title, label FROM (SELECT DISTINCT coalesce(kanal, '') AS kanal, title, 0 AS label FROM cnnindonesia_news_raw WHERE title IS NOT NULL)"


@query("SELECT label, count(*) AS n FROM hoax_dataset WHERE length(content) > 20 AND label IS NOT NULL GROUP BY label")
def label_distribution(spark, d):
    return metrics.label_distribution(etl.usable(table(spark, d, "hoax_dataset"), need=("label",)))


@query("SELECT DISTINCT kanal, title FROM cnnindonesia_news_raw WHERE title IS NOT NULL")
def distinct_titles(spark, d):
    return etl.distinct_titles(table(spark, d, "cnnindonesia_news_raw"), "title", "kanal")


@query(
    "WITH h AS (SELECT row_id, label FROM hoax_dataset WHERE label IS NOT NULL) SELECT row_id, label FROM h WHERE label = 1 UNION ALL "
    "SELECT row_id, label FROM (SELECT row_id, label, row_number() OVER (ORDER BY md5(concat('42-', row_id)), row_id) AS r FROM h WHERE label = 0) WHERE r <= (SELECT count(*) FROM h WHERE label = 1)"
)
def balanced(spark, d):
    return etl.balance(table(spark, d, "hoax_dataset").where("label is not null").select("row_id", "label"), "row_id")


@query(
    "SELECT row_id, label, CASE WHEN r <= floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'eval' END AS part FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42-', row_id)), row_id) AS r, "
    "count(*) OVER (PARTITION BY label) AS n FROM hoax_dataset WHERE label IS NOT NULL)"
)
def stratified_split(spark, d):
    return etl.stratified_split(table(spark, d, "hoax_dataset").where("label is not null").select("row_id", "label"), "row_id")


@query("SELECT doc_id FROM documents ORDER BY md5(concat('42-', doc_id)), doc_id LIMIT 100")
def random_sample(spark, d):
    return etl.sample_exact(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT row_id, CASE row_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 0 END AS label FROM hoax_dataset")
def normalized_labels(spark, d):
    """Known words, two unknown ones, of which the first by the alphabet is 1, and null."""
    k = F.pmod("row_id", F.lit(5))
    words = F.when(k == 0, "Hoax ").when(k == 1, "FAKTA").when(k == 2, "aneh").when(k == 3, "Zona abu")
    return etl.normalize_labels(table(spark, d, "hoax_dataset").select("row_id", words.alias("label")))


@query("SELECT source, content, row_id FROM (SELECT content, source, row_id FROM hoax_dataset UNION ALL SELECT title, 'cnn', NULL FROM cnnindonesia_news_raw) WHERE length(content) > 20")
def combined(spark, d):
    news = table(spark, d, "cnnindonesia_news_raw").select(F.col("title").alias("content"))
    both = table(spark, d, "hoax_dataset").select("content", "source", "row_id").unionByName(etl.combine({"cnn": news}), allowMissingColumns=True)
    return etl.usable(both).select("source", "content", "row_id")


@query(
    rf"""WITH p AS (SELECT regexp_replace(coalesce(judul, ''), '^\[.*?\]{WS}*', '') AS content FROM turnbackhoax_2020_2025),
v AS (SELECT DISTINCT coalesce(kanal, '') AS file, title FROM cnnindonesia_news_raw WHERE title IS NOT NULL)
SELECT {_strip("content")} AS content, 1 AS label FROM p UNION ALL
SELECT title, 0 FROM (SELECT title, row_number() OVER (ORDER BY md5(concat('42-', file, '|', title)), concat(file, '|', title)) AS r FROM v) WHERE r <= (SELECT count(*) FROM p)"""
)
def hoax_training_data(spark, d):
    return etl.hoax_data(table(spark, d, "turnbackhoax_2020_2025").select("judul"), table(spark, d, "cnnindonesia_news_raw").select(F.coalesce("kanal", F.lit("")), "title"))


@query()
def synthetic_records(spark, d):
    return etl.synthetic(spark, 1000)


# --- dates ------------------------------------------------------------------------------------------------------
_MONTHS = "|".join(temporal.MONTHS)
_DATE_PATTERN = rf"(?i)\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}}"


@query(
    rf"""WITH m AS (SELECT doc_id AS doc, regexp_extract_all(text, '{_DATE_PATTERN}') AS m, string_split_regex(text, '{_DATE_PATTERN}') AS g FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER), 't': m[i]}})) AS x FROM m)
SELECT doc, x.s AS start, CAST(x.s + length(x.t) AS INTEGER) AS "end", x.t AS text FROM e"""
)
def date_spans(spark, d):
    return documents(spark, d).where("text is not null").select("doc", F.explode(X.find_spans(F.col("text"), _DATE_PATTERN)).alias("s")).select("doc", "s.*")


def _temporals(spark, d):
    return temporal.extract_temporals(documents(spark, d), REFERENCE)


@query()
def temporal_expressions(spark, d):
    return _temporals(spark, d)


@query()
def timeline(spark, d):
    return temporal.timeline(_temporals(spark, d))


@query()
def timeline_bounds(spark, d):
    return temporal.timeline_bounds(temporal.timeline(_temporals(spark, d)))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS start, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (o_orderdate - date_trunc('day', o_orderdate)) - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') AS month_end, "
    "strftime(o_orderdate + INTERVAL 7 DAY - INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S') AS week_end FROM orders"
)
def period_ends(spark, d):
    o = table(spark, d, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", text(F.col("t")).alias("start"), text(D.end_of_period(F.col("t"), F.lit("MONTH"))).alias("month_end"), text(D.end_of_period(F.col("t"), F.lit("WEEK"))).alias("week_end"))


@query(
    """WITH d AS (SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, CASE WHEN n <= 7 THEN 'VERIFIED' WHEN n <= 30 THEN 'PARTIALLY_VERIFIED' ELSE 'CONTRADICTED' END AS status,
  round(CASE WHEN n <= 7 THEN greatest(0.5, 1 - n / 30) WHEN n <= 30 THEN 0.5 ELSE 0.2 END, 6) AS confidence FROM d"""
)
def date_verdicts(spark, d):
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    v = D.date_verdict(day("o_orderdate"), day("l_shipdate"))
    j = l.select("l_orderkey", "l_linenumber", "l_shipdate").join(o.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", v["status"].alias("status"), F.round(v["confidence"], 6).alias("confidence"))


@query(
    """SELECT a.o_orderkey AS a, CAST(a.o_orderdate AS DATE) + 30 >= CAST(b.l_shipdate AS DATE) AND CAST(b.l_shipdate AS DATE) + 10 >= CAST(a.o_orderdate AS DATE) AS meets,
  CAST(a.o_orderdate AS DATE) + 30 < CAST(b.l_shipdate AS DATE) AS before, b.l_linenumber AS line FROM orders a JOIN lineitem b ON l_orderkey = o_orderkey"""
)
def interval_relations(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a0, a1 = day("o_orderdate"), day(F.date_add("o_orderdate", 30))
    b0, b1 = day("l_shipdate"), day(F.date_add("l_shipdate", 10))
    return j.select(F.col("o_orderkey").alias("a"), D.overlaps(a0, a1, b0, b1).alias("meets"), D.is_before(a1, b0).alias("before"), F.col("l_linenumber").alias("line"))


# --- entities, relations, graph of the documents ----------------------------------------------------------------
@query()
def entity_mentions(spark, d):
    return E.extract_entities(documents(spark, d), "intended")


@query()
def entity_counts_reference(spark, d):
    return E.extract_entities(documents(spark, d)).groupBy("coll", "entity_type").agg(F.count("*").alias("mentions"))


@query()
def unique_entities(spark, d):
    return E.unique_entities(E.extract_entities(documents(spark, d), "intended"))


@query()
def entity_dates(spark, d):
    m = E.nearest_temporal(E.extract_entities(documents(spark, d), "intended"), _temporals(spark, d))
    return E.entity_temporals(m).select("coll", "doc", "key", "temporal.normalized_start", "temporal.normalized_end")


@query()
def document_relations(spark, d):
    return relations.extract_relations(documents(spark, d), "intended")


def _graph(spark, d):
    docs = documents(spark, d)
    if docs.groupBy("coll", "doc").agg(F.count("*").alias("n")).where("n > 1 or doc is null").isEmpty():
        return relations.extract_both(docs, "intended", REFERENCE)
    # rows of one id are one document, whose entities and times meet by joins
    found, rel = relations.extract_both(docs, "intended")
    mentions = durable(E.nearest_temporal(found.drop("temporal"), _temporals(spark, d)))
    # an entity's temporal in a document is that of its last mention with one, for all its mentions
    own = E.entity_temporals(mentions).withColumnRenamed("temporal", "last")
    mentions = mentions.drop("temporal").join(own, ["coll", "doc", "key"], "left").withColumnRenamed("last", "temporal")
    return mentions, rel


@query()
def document_graph_nodes(spark, d):
    return G.build_nodes(G.node_inputs(*_graph(spark, d)))


@query()
def document_graph_edges(spark, d):
    return G.build_edges(G.relation_log(relations.extract_relations(documents(spark, d), "intended")))


# --- graph of the relational tables -----------------------------------------------------------------------------
_KINDS = ["SUPPORTS", "OPPOSES", "CAUSES", "PREVENTS", "LEADS"]
_KIND = "(['" + "', '".join(_KINDS) + "'])[1 + (l_linenumber + l_suppkey) % 5]"
_LOG = f"""
log AS (SELECT 'tpch' AS coll, l_orderkey AS doc, l_linenumber AS seq, concat('SUPPLIER:', l_suppkey % 50) AS source, concat('PART:', l_partkey % 40) AS target,
  {_KIND} AS relation_type, floor(l_quantity) / 100.0 AS confidence, strftime(l_shipdate, '%Y-%m-%d') AS temporal_anchor, concat('line ', l_orderkey, ' ', l_linenumber) AS source_sentence FROM lineitem)"""


def _log(spark, d):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod(F.col("l_linenumber") + F.col("l_suppkey"), F.lit(5)) + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        F.lit("tpch").alias("coll"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seq"), F.concat(F.lit("SUPPLIER:"), F.pmod("l_suppkey", F.lit(50)).cast("string")).alias("source"),
        F.concat(F.lit("PART:"), F.pmod("l_partkey", F.lit(40)).cast("string")).alias("target"), kind.alias("relation_type"), (F.floor("l_quantity") / 100.0).alias("confidence"),
        F.array(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("x"), F.lit("y")).alias("evidence"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("temporal_anchor"),
        F.concat_ws(" ", F.lit("line"), "l_orderkey", "l_linenumber").alias("source_sentence"),
    )


_ORDER = "doc, seq, confidence, relation_type, temporal_anchor, source_sentence"
_EDGES = f"""{_LOG},
states AS (SELECT *, arg_min(relation_type, row(-confidence, doc, seq, relation_type)) OVER w AS now, lag(relation_type) OVER w IS NULL AS is_first FROM log
  WINDOW w AS (PARTITION BY source, target ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
finals AS (SELECT source, target, arg_min(relation_type, row(-confidence, doc, seq, relation_type)) AS final, max(confidence) AS top FROM log GROUP BY source, target),
turns AS (SELECT source, target, max(row({_ORDER})) FILTER (now <> final) AS bad FROM states JOIN finals USING (source, target) GROUP BY source, target),
changes AS (SELECT source, target, count(*) FILTER (now <> was) AS replacements FROM (SELECT source, target, now, lag(now) OVER (PARTITION BY source, target ORDER BY {_ORDER}) AS was FROM states) GROUP BY source, target),
tail AS (SELECT s.*, final, top FROM states s JOIN finals USING (source, target) JOIN turns USING (source, target) WHERE relation_type = final AND (bad IS NULL OR row({_ORDER}) > bad)),
edges AS (SELECT source, target, any_value(final) AS relation_type, any_value(top) AS confidence, count(*) AS mentions, arg_min(temporal_anchor, row({_ORDER})) AS temporal_anchor, arg_min(source_sentence, row({_ORDER})) AS source_sentence
  FROM tail GROUP BY source, target)"""


def _edges(spark, d):
    return G.build_edges(_log(spark, d))


@query(f"WITH {_EDGES} SELECT e.*, c.replacements FROM edges e JOIN changes c USING (source, target)")
def graph_edges(spark, d):
    return _edges(spark, d).select("source", "target", "relation_type", "confidence", "mentions", "temporal_anchor", "source_sentence", "replacements")


_NODES = """
inputs AS (SELECT concat('SUPPLIER:', l_suppkey) AS key, 'SUPPLIER' AS entity_type, l_orderkey AS doc, l_linenumber AS pos, concat('s', l_suppkey, '-', l_linenumber) AS text, l_discount AS confidence,
  strftime(l_shipdate, '%Y-%m-%dT00:00:00') AS s, strftime(l_shipdate + INTERVAL 5 DAY, '%Y-%m-%dT23:59:59') AS e FROM lineitem),
nodes AS (SELECT key, any_value(entity_type) AS entity_type, round(avg(confidence), 6) AS confidence, count(*) AS mentions, array_to_string(list_sort(list_distinct(list(text))), ',') AS aliases, min(s) AS temporal_start, max(e) AS temporal_end FROM inputs GROUP BY key)"""


def _nodes(spark, d):
    m = table(spark, d, "lineitem").select(
        F.lit("tpch").alias("coll"), F.concat(F.lit("SUPPLIER:"), F.col("l_suppkey").cast("string")).alias("key"), F.col("l_orderkey").alias("doc"), F.lit(0).alias("phase"), F.col("l_linenumber").cast("long").alias("pos"),
        F.col("l_suppkey").cast("string").alias("normalized"), F.lit("SUPPLIER").alias("entity_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"),
        F.col("l_discount").alias("confidence"), F.lit("id").alias("language"), F.date_format("l_shipdate", "yyyy-MM-dd'T00:00:00'").alias("start"), F.date_format(F.date_add("l_shipdate", 5), "yyyy-MM-dd'T23:59:59'").alias("end"),
    )
    return G.build_nodes(m)


@query(f"WITH {_NODES} SELECT * FROM nodes")
def graph_nodes(spark, d):
    return _nodes(spark, d).select("key", "entity_type", F.round("confidence", 6).alias("confidence"), "mentions", F.array_join("aliases", ",").alias("aliases"), "temporal_start", "temporal_end")


@query(f"WITH {_NODES} SELECT entity_type, count(*) AS nodes, CAST(sum(mentions) AS BIGINT) AS mentions FROM nodes GROUP BY entity_type")
def graph_counts(spark, d):
    return G.count_by_type(_nodes(spark, d))


@query(f"WITH {_NODES} SELECT key FROM nodes WHERE temporal_start <> '' AND temporal_start <= '1995-02-01' AND temporal_end >= '1995-01-10'")
def graph_by_time(spark, d):
    return G.by_time(_nodes(spark, d), "1995-01-10", "1995-02-01").select("key")


@query(f"WITH {_EDGES} SELECT source, target, relation_type FROM edges WHERE contains(source, 'SUPPLIER:1') AND relation_type = 'CAUSES'")
def graph_triples(spark, d):
    return G.match_triples(_edges(spark, d), "SUPPLIER:1", "causes").select("source", "target", "relation_type")


@query(f"WITH {_EDGES} SELECT source, target, 'out' AS direction FROM edges WHERE source = 'SUPPLIER:7' UNION ALL SELECT source, target, 'in' FROM edges WHERE target = 'SUPPLIER:7'")
def graph_edges_of(spark, d):
    return G.edges_of(_edges(spark, d), "SUPPLIER:7").select("source", "target", "direction")


@query(f"WITH {_EDGES} SELECT source, target, relation_type FROM edges SEMI JOIN (SELECT source, target FROM log WHERE relation_type = 'LEADS') USING (source, target)")
def graph_edges_by_kind(spark, d):
    log = _log(spark, d)
    return G.edges_by_kind(G.build_edges(log), log, "LEADS").select("source", "target", "relation_type")


@query(
    f"WITH {_LOG}, p AS (SELECT DISTINCT source, target, relation_type FROM log) SELECT a.source, a.target, a.relation_type AS first, b.relation_type AS second FROM p a JOIN p b USING (source, target) "
    "WHERE (a.relation_type, b.relation_type) IN (('SUPPORTS', 'OPPOSES'), ('CAUSES', 'PREVENTS'))"
)
def graph_contradictions(spark, d):
    log = _log(spark, d)
    c = G.conflicts(spark.createDataFrame([], "coll string, key string, temporal_start string, temporal_end string"), G.build_edges(log), log)
    return c.where("severity = 'HIGH'").select("source", "target", "first", "second")


_PLACES = """
places AS (SELECT concat('N:', n_name) AS source, concat('R:', r_name) AS target FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION SELECT concat('S:', s_suppkey), concat('N:', n_name) FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION SELECT concat('R:', a.r_name), concat('R:', b.r_name) FROM region a JOIN region b ON b.r_regionkey = a.r_regionkey + 1)"""


def _places(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(tag("N:", "n_name").alias("source"), tag("R:", "r_name").alias("target"))
    b = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(tag("S:", "s_suppkey"), tag("N:", "n_name"))
    c = r.select((F.col("r_regionkey") + 1).alias("k"), tag("R:", "r_name").alias("source")).join(r.select(F.col("r_regionkey").alias("k"), tag("R:", "r_name").alias("target")), "k").select("source", "target")
    return a.union(b).union(c).distinct()


@query(
    f"""WITH RECURSIVE {_PLACES}, walk AS (SELECT concat('S:', s_suppkey) AS source, concat('S:', s_suppkey) AS node, [concat('S:', s_suppkey)] AS path FROM supplier
  UNION ALL SELECT w.source, p.target, list_append(path, p.target) FROM walk w JOIN places p ON p.source = w.node WHERE len(path) <= 3)
SELECT source, node AS target, array_to_string(arg_min(path, row(len(path), path)), '>') AS path FROM walk WHERE starts_with(node, 'R:') GROUP BY source, node"""
)
def graph_paths(spark, d):
    places = _places(spark, d)
    s = places.where("source like 'S:%'").select("source").distinct()
    r = places.where("target like 'R:%'").select("target").union(places.where("source like 'R:%'").select("source")).distinct()
    pairs = s.crossJoin(F.broadcast(r))  # the regions are five
    return G.shortest_paths(places, pairs, 3).select("source", "target", F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {_PLACES}, ends AS (SELECT source AS a, target AS b FROM places UNION SELECT target, source FROM places),
n1 AS (SELECT 'R:ASIA' AS n UNION SELECT b FROM ends WHERE a = 'R:ASIA'), n2 AS (SELECT n FROM n1 UNION SELECT b FROM ends JOIN n1 ON n = a)
SELECT source, target FROM places WHERE source IN (SELECT n FROM n2) AND target IN (SELECT n FROM n2)"""
)
def graph_neighbourhood(spark, d):
    return G.neighbourhood(_places(spark, d), "R:ASIA", 2)


@query(f"WITH {_PLACES}, k AS (SELECT source AS key, list_sort(list(target)) AS targets FROM places GROUP BY source) SELECT key, array_to_string(targets, ',') AS targets, CASE WHEN starts_with(key, 'R:') THEN key END AS region, p.target, 0.5::DOUBLE AS confidence FROM k JOIN places p ON p.source = key")
def graph_round_trip(spark, d):
    """Nodes with a list and a null, edges with a number, through JSON and back."""
    e = _places(spark, d).withColumn("confidence", F.lit(0.5))
    n = e.groupBy(F.col("source").alias("key")).agg(F.array_sort(F.collect_set("target")).alias("targets")).withColumn("region", F.when(F.col("key").startswith("R:"), F.col("key")))
    n, e = G.from_json(G.to_json(n, e), "key string, targets array<string>, region string", "source string, target string, confidence double")
    return n.join(e, F.col("key") == F.col("source")).select("key", F.array_join("targets", ",").alias("targets"), "region", "target", "confidence")


@query(
    f"""WITH {_EDGES}, n AS (SELECT source, sum(mentions) AS weight FROM edges GROUP BY source ORDER BY weight DESC, source LIMIT 10),
f AS (SELECT e.source, relation_type, target, weight, row_number() OVER (PARTITION BY e.source ORDER BY target) AS r FROM edges e JOIN n USING (source))
SELECT CAST(row_number() OVER (ORDER BY weight DESC, source, r) AS INTEGER) AS rank, source, relation_type, target FROM f WHERE r <= 3 ORDER BY weight DESC, source, r LIMIT 30"""
)
def graph_top_facts(spark, d):
    e = durable(_edges(spark, d))
    n = e.groupBy(F.col("source").alias("key")).agg(F.sum("mentions").alias("mentions"))
    return G.top_facts(n, e)


# --- verification -----------------------------------------------------------------------------------------------
@query(
    f"""WITH {_EDGES}, c AS (SELECT DISTINCT concat('SUPPLIER:', o_custkey % 50) AS source, concat('PART:', o_orderkey % 44) AS target, (['SUPPORTS', 'CAUSES', 'LEADS'])[1 + o_orderkey % 3] AS predicate FROM orders)
SELECT c.source, c.target, c.predicate, CASE WHEN e.relation_type = c.predicate THEN 'VERIFIED' WHEN e.relation_type IS NOT NULL THEN 'CONTRADICTED' ELSE 'UNVERIFIED' END AS relation_status,
  CASE WHEN e.relation_type = c.predicate THEN e.confidence WHEN e.relation_type IS NOT NULL THEN 0.3 ELSE 0.0 END AS relation_confidence FROM c LEFT JOIN edges e USING (source, target)"""
)
def relation_verdicts(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ["SUPPORTS", "CAUSES", "LEADS"])), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    c = table(spark, d, "orders").select(
        F.concat(F.lit("SUPPLIER:"), F.pmod("o_custkey", F.lit(50)).cast("string")).alias("source"), F.concat(F.lit("PART:"), F.pmod("o_orderkey", F.lit(44)).cast("string")).alias("target"), kind.alias("predicate")
    ).distinct()
    return V.match_relations(c, durable(_edges(spark, d))).select("source", "target", "predicate", "relation_status", "relation_confidence")


@query(
    """WITH c AS (SELECT l_orderkey AS id, CASE WHEN items = 0 THEN 'UNVERIFIED' WHEN wrong > 0 THEN 'HALLUCINATION' WHEN ok = items THEN 'VERIFIED' WHEN ok > 0 THEN 'PARTIALLY_VERIFIED' ELSE 'UNVERIFIED' END AS status,
  CASE WHEN items = 0 THEN 0.5 WHEN wrong > 0 THEN 0.2 WHEN ok = items THEN 0.9 WHEN ok > 0 THEN ok / items ELSE 0.3 END AS confidence
  FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT % 4 AS items, least(l_quantity::INT % 4, l_partkey % 4) AS ok, CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END AS wrong FROM lineitem)),
s AS (SELECT id, count(*) AS claims, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status = 'HALLUCINATION') AS hallucinations, avg(confidence) AS confidence FROM c GROUP BY id)
SELECT id, claims, verified, hallucinations, round(verified / claims, 6) AS rate, round(confidence, 6) AS confidence,
  CASE WHEN hallucinations > 0.3::DOUBLE * claims THEN 'HALLUCINATION' WHEN verified / claims >= 0.8 THEN 'VERIFIED' WHEN verified / claims >= 0.5 THEN 'PARTIALLY_VERIFIED' ELSE 'UNVERIFIED' END AS status FROM s"""
)
def summary_verdicts(spark, d):
    items = F.pmod(F.col("l_quantity").cast("int"), F.lit(4))
    v = V.claim_verdict(items, F.least(items, F.pmod("l_partkey", F.lit(4))), F.when(F.pmod("l_suppkey", F.lit(7)) == 0, 1).otherwise(0))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), v["status"].alias("status"), v["confidence"].alias("confidence"))
    return _rounded(V.summary_verdict(c, "id"))


def _claim_parts(spark, d):
    news = table(spark, d, "cnnindonesia_news_raw").select(F.lit("cnn").alias("coll"), F.col("news_id").alias("doc"), F.col("title").alias("text"))
    return news, durable(E.extract_entities(news, "intended"))


@query()
def entity_matches(spark, d):
    _, claimed = _claim_parts(spark, d)
    # names and aliases only, so neither times nor the lists of documents are made
    found = G.build_nodes(G.node_inputs(*relations.extract_both(documents(spark, d), "intended")))
    nodes = durable(found.select("key", "normalized", "entity_type", "aliases"))
    return V.match_entities(claimed.select("coll", "doc", "pos", "key", "normalized", "entity_type"), nodes)


@query()
def claim_verification(spark, d):
    news, claimed = _claim_parts(spark, d)
    mentions, rel = _graph(spark, d)
    nodes = durable(G.build_nodes(G.node_inputs(mentions, rel)).select("key", "normalized", "entity_type", "aliases", "temporal_start", "temporal_end"))
    edges = durable(G.build_edges(G.relation_log(rel)).select("source", "target", "relation_type", "confidence"))
    matched = durable(V.match_entities(claimed.select("coll", "doc", "pos", "key", "normalized", "entity_type"), nodes))
    said = G.relation_log(relations.extract_relations(news, "intended"))
    at = matched.where("node_key is not null").select("coll", "doc", "key", "node_key").distinct()
    ends = said.join(at.toDF("coll", "doc", "source", "s"), ["coll", "doc", "source"]).join(at.toDF("coll", "doc", "target", "t"), ["coll", "doc", "target"])
    checked = V.match_relations(ends.select("coll", "doc", F.col("s").alias("source"), F.col("relation_type").alias("predicate"), F.col("t").alias("target")), edges)
    dates = V.match_dates(temporal.extract_temporals(news, REFERENCE), matched, nodes)
    return V.verify_claims(news, matched, checked, dates)


@query(
    """WITH n AS (SELECT DISTINCT key, lower(name) AS name FROM (SELECT normalized AS key, unnest(list_concat([normalized], coalesce(aliases, []))) AS name FROM entity WHERE normalized IS NOT NULL) WHERE length(name) > 3),
m AS (SELECT DISTINCT name FROM n), h AS (SELECT DISTINCT doc_id AS id, key FROM documents JOIN m ON contains(lower(text), m.name) JOIN n USING (name))
SELECT id, key FROM (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY key) AS r FROM h) WHERE r <= 5"""
)
def known_entities(spark, d):
    names = table(spark, d, "entity").where("normalized is not null").select(F.col("normalized").alias("key"), F.lit(1).alias("mentions"), "normalized", "aliases").distinct()
    return V.known_entities(spread(table(spark, d, "documents").select("doc_id", "text")), names)


@query()
def similar_names(spark, d):
    e = table(spark, d, "entity")
    return V.similar_names(e.where(F.pmod("entity_id", F.lit(100)) == 0).select("normalized"), e.select("normalized")).drop("space")


# --- summaries and metrics --------------------------------------------------------------------------------------
@query()
def textrank_summaries(spark, d):
    return summarize.summaries(documents(spark, d))


@query()
def lexrank_summaries(spark, d):
    return summarize.summaries(documents(spark, d), method="lexrank")


_LEAD = f"array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: {_strip('s')}), lambda s: length(s) >= 11)[1:3], '. ') || '.'"


@query(f"SELECT doc_id AS doc, {_LEAD} AS summary FROM documents")
def lead_summaries(spark, d):
    return documents(spark, d).select("doc", summarize.lead(F.col("text")).alias("summary"))


@query()
def verified_summaries(spark, d):
    def check(claims_: DataFrame) -> DataFrame:
        # a stand-in for the graph: claims with a number are trusted
        ok = F.col("claim").rlike("[0-9]")
        return claims_.select("coll", "doc", "claim_idx", F.when(ok, "VERIFIED").otherwise("HALLUCINATION").alias("status"), F.lit(0.5).alias("confidence"))

    return summarize.verified_summaries(documents(spark, d), check)


def _rouge_sql(n: int) -> str:
    """Scores of n-grams of each text's lead summary against the text."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    counts = lambda c: f"(SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS g FROM (SELECT id, regexp_extract_all(lower({c}), '[a-z0-9]+') AS w FROM pairs)) GROUP BY id, g)"
    return f"""WITH pairs AS (SELECT doc_id AS id, text AS reference, {_LEAD} AS prediction FROM documents WHERE text IS NOT NULL),
r AS {counts('reference')}, p AS {counts('prediction')},
c AS (SELECT id, sum(least(coalesce(r.n, 0), coalesce(p.n, 0))) AS hit, sum(r.n) AS nr, sum(p.n) AS np FROM r FULL JOIN p USING (id, g) GROUP BY id),
s AS (SELECT pairs.id, coalesce(hit / np, 0) AS p, coalesce(hit / nr, 0) AS r FROM pairs LEFT JOIN c USING (id))
SELECT id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s"""


def _rouge_pairs(spark, d):
    return spread(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("reference"), summarize.lead(F.col("text")).alias("prediction")))


@query(_rouge_sql(1))
def rouge_1(spark, d):
    return _rounded(metrics.rouge_n(_rouge_pairs(spark, d), 1))


@query(_rouge_sql(2))
def rouge_2(spark, d):
    return _rounded(metrics.rouge_n(_rouge_pairs(spark, d), 2))


@query()
def rouge_l(spark, d):
    return metrics.rouge_l(_rouge_pairs(spark, d))


@query(
    """WITH c AS (SELECT count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 0 AND p = 0) AS tn
  FROM (SELECT label, CASE WHEN row_id % 3 = 0 THEN 1 ELSE 0 END AS p FROM hoax_dataset))
SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((2 * tp / (2 * tp + fp + fn) * (tp + fn) + 2 * tn / (2 * tn + fp + fn) * (tn + fp)) / (tp + fp + fn + tn), 6) AS f1_weighted, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_hoax FROM c"""
)
def classifier_metrics(spark, d):
    h = table(spark, d, "hoax_dataset").select("label", F.when(F.pmod("row_id", F.lit(3)) == 0, 1).otherwise(0).alias("prediction"))
    return _rounded(metrics.classifier_metrics(h))


# --- retrieval --------------------------------------------------------------------------------------------------
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT b.vec_id, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY {_COS} DESC, b.vec_id LIMIT 5")
def vector_top_k(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return _rounded(vector.top_k(e, q, 5))


@query(
    f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 QUALIFY rank <= 5"
)
def vector_search(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return _rounded(vector.top_k_join(q, e, 5))


@query("SELECT coalesce(kanal, '') AS query_id, link, arg_min(title, news_id) AS title, min(news_id) AS rank FROM cnnindonesia_news_raw WHERE link IS NOT NULL AND title IS NOT NULL GROUP BY ALL")
def first_hits(spark, d):
    hits = table(spark, d, "cnnindonesia_news_raw").where("link is not null and title is not null").select(F.coalesce("kanal", F.lit("")).alias("query_id"), F.col("news_id").alias("rank"), "title", "link")
    return retrieval.first_of_link(hits).select("query_id", "link", "title", "rank")


@query(
    """SELECT n_regionkey AS query_id, concat('Search Results for ''', r_name, ''':', chr(10), chr(10), string_agg(concat('[', r, '] ', n_name, chr(10), '    Source: ', n_nationkey, chr(10), '    Context: ', n_name, chr(10), chr(10)), '' ORDER BY r)) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey, r_name"""
)
def formatted_hits(spark, d):
    n = table(spark, d, "nation")
    hits = n.select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("string").alias("link"), F.col("n_name").alias("snippet"))
    return retrieval.format_hits(hits, table(spark, d, "region").select(F.col("r_regionkey").alias("query_id"), F.col("r_name").alias("query")))


@query(
    """SELECT coalesce(source, '') AS coll, string_agg(concat('--- [Sumber ', doc_id, ' | Tanggal: ', coalesce(strftime(published_at, '%Y-%m-%d'), 'Unknown Date'), ' | Asal: ', coalesce(source, 'Web Search'), '] ---', chr(10), coalesce(text, '')), chr(10) || chr(10) ORDER BY doc_id) AS text
FROM documents GROUP BY coalesce(source, '')"""
)
def prompt_documents(spark, d):
    t = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("coll"), F.col("doc_id").alias("i"), F.col("text").alias("content"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), "source")
    return retrieval.format_documents(t)


@query("SELECT content, date, source, url FROM (SELECT concat_ws('. ', source, text) AS content, coalesce(strftime(published_at, '%Y-%m-%d'), 'Unknown Date') AS date, source, url, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p FROM documents) WHERE p <= 0.7")
def verified_intel(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("title"), F.col("text").alias("body"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), "source", "url")
    return retrieval.verified_intel(t, _p())


@query("SELECT user_id AS key, ts, event_type AS title FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS was FROM events) WHERE event_type <> was AND (contains(lower(event_type), 'c') OR contains(lower(event_type), 'p'))")
def title_changes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("title"))
    return titles.changes(e, ["c", "p"])


# --- smaller pieces ---------------------------------------------------------------------------------------------
@query()
def document_counts(spark, d):
    docs = documents(spark, d)
    return G.document_counts(docs, E.extract_entities(docs, "intended"), relations.extract_relations(docs, "intended"), _temporals(spark, d))


@query(
    """WITH f AS (SELECT n_regionkey AS coll, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT coll, string_agg(concat_ws(' ', concat(i, '.'), n_name, 'located in', r_name), chr(10) ORDER BY i) AS text FROM f GROUP BY coll"""
)
def fact_context(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    i = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    tag = lambda t, c: F.concat(F.lit(t), F.col(c))
    return G.fact_context(n.select(F.col("n_regionkey").alias("coll"), i.alias("i"), tag("N:", "n_name").alias("source"), F.lit("LOCATED_IN").alias("relation_type"), tag("R:", "r_name").alias("target")))


@query(
    f"""WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), t AS (SELECT b.vec_id, {_COS} AS s, CASE WHEN b.vec_id % 3 <> 0 THEN concat('2024-01-', lpad((b.vec_id % 28 + 1)::VARCHAR, 2, '0')) END AS date
  FROM q a, embeddings b ORDER BY {_COS} DESC, b.vec_id LIMIT 5)
SELECT vec_id, round(s, 6) AS similarity, date, row_number() OVER (ORDER BY coalesce(date, '0000-00-00'), s DESC, vec_id) AS rank FROM t"""
)
def temporal_rag(spark, d):
    date = F.when(F.col("vec_id") % 3 != 0, F.format_string("2024-01-%02d", (F.col("vec_id") % 28 + 1).cast("int")))
    e = table(spark, d, "embeddings").withColumn("metadata", F.create_map(F.lit("date"), date))
    return _rounded(retrieval.temporal_rag(e, e.orderBy("vec_id").select("embedding").first()[0], 5))


@query()
def narratives(spark, d):
    t = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("coll"), F.col("text").alias("content"), F.date_format("published_at", "yyyy-MM-dd").alias("date"), "source", "url")
    return retrieval.narrative(t)


@query()
def credible_summaries(spark, d):
    return summarize.credible_summaries(documents(spark, d), _assessed(spark, d).select("coll", "doc", "score"))


@query()
def sentence_similarity(spark, d):
    """Sentences of one document that are alike: each document is a collection."""
    return vector.sentence_pairs(documents(spark, d).select(F.col("doc").alias("coll"), X.preprocess_document(F.col("text")).alias("sentences")))


@query("SELECT l_partkey AS doc, avg(l_quantity)::FLOAT::DOUBLE AS first, avg(l_discount)::FLOAT::DOUBLE AS second FROM lineitem GROUP BY l_partkey")
def pooled_vectors(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc"), F.array("l_quantity", "l_discount").alias("embedding"))
    return vector.mean_pool(t).select("doc", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"))


@query(f"WITH {_NODES} SELECT DISTINCT left(temporal_start, 10) AS day, key FROM nodes WHERE temporal_start <> ''")
def graph_by_date(spark, d):
    return G.by_date(_nodes(spark, d))


@query()
def grounded_facts(spark, d):
    e = _places(spark, d).withColumn("relation_type", F.lit("LOCATED_IN"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("i"), F.concat(F.lit("R:"), F.col("r_name")).alias("key"))
    return G.grounded_facts(r, r.select("key", F.col("key").alias("node_key")), e)
