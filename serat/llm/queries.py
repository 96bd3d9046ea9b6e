"""Queries of the language-model training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serat.llm import canon, lines, mixing, names, neardup, overlap, packing, residue, tokens
from serat.session import durable

#: What TESTDATA.md fixes for problems 1 and 5: runs of three words, at least half the union shared.
WIDTH, SIMILARITY = 3, 0.5


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hoax(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _table(spark, d, "hoax_dataset").select("row_id", "content", *columns)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlapping_records(_hoax(spark, d, "split"), WIDTH, SIMILARITY).select(F.col("id").alias("row_id"))


def p1_by_split_and_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "hoax_dataset").select("row_id", "split", "source").where("split in ('validation', 'test')")
    hit = p1_found(spark, d).withColumn("hit", F.lit(1))
    counts = rows.join(hit, "row_id", "left").groupBy("split", "source")
    return counts.agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "entity").select("entity_id", "entity_type", "text", "normalized", "aliases")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(_entities(spark, d)).select(F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))


def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_entities(spark, d)).withColumnRenamed("id", "entity_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.found_lines(_hoax(spark, d, "source")).select(F.col("id").alias("row_id"), "line_no")


def p4_branches(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of how many sources the ratio marks, and how many the rule adds."""
    return lines.branches(_hoax(spark, d, "source"))


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines in excess or repeated, by the hash of their comparison form."""
    return lines.repeated_lines(_hoax(spark, d, "source")).where("significant or repeated")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    out = lines.without_lines(_hoax(spark, d, "source"))
    return out.select(F.col("id").alias("row_id"), F.col("text").alias("content"), "removed")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(_hoax(spark, d), WIDTH, SIMILARITY)
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_families(_hoax(spark, d), WIDTH, SIMILARITY).withColumnRenamed("id", "row_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    news = _table(spark, d, "cnnindonesia_news_raw")
    hoax = _hoax(spark, d).select(F.lit("hoax_dataset").alias("tbl"), F.col("row_id").alias("id"), F.col("content").alias("text"))
    return hoax.unionByName(news.select(F.lit("cnnindonesia_news_raw").alias("tbl"), F.col("news_id").alias("id"), F.col("title").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.copy_groups(_records(spark, d))[0]


def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return canon.distinct_records(_records(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_tokens(_table(spark, d, "documents").select("doc_id", "text"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(durable(_sized(spark, d)), _table(spark, d, "pack_capacity"))
    return packed.withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    caps = _table(spark, d, "pack_capacity")
    return packing.fill_report(packing.pack(durable(_sized(spark, d)), caps), caps)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    targets = _table(spark, d, "mix_targets")
    # only documents of the targets' sources, a handful of rows, are encoded
    docs = _table(spark, d, "documents").select("doc_id", "source", "text").join(F.broadcast(targets.select("source")), "source", "left_semi")
    sized = tokens.with_tokens(docs.select("doc_id", "text", "source"))
    return mixing.mix(durable(sized.select("id", "source", "n_tokens")), targets), targets


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(*_mixed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_table(spark, d, "documents").select("doc_id", "text")).select(F.col("id").alias("doc_id"))


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(_table(spark, d, "documents").select("doc_id", "text")).groupBy("kind").agg(F.count("*").alias("documents"))


QUERIES = {
    q.__name__: q
    for q in (
        p1_found, p1_by_split_and_source, p3_found, p3_entities, p4_found, p4_branches, p4_lines, p4_clean, p5_found, p5_groups, p6_found, p6_records,
        p7_packed, p7_fill, p8_mixture, p8_shares, p9_found, p9_kinds,
    )
}

# --- the same results in SQL -------------------------------------------------------------------------------------

_RECORDS = """
records AS (
  SELECT tbl, id, text, list_sort(list_filter(
           list_transform(string_split(text, '|'), lambda f: regexp_replace(lower(f), '[^\\p{L}\\p{N}]+', '', 'g')), lambda f: f <> '')) AS fields
  FROM (SELECT 'hoax_dataset' AS tbl, row_id AS id, content AS text FROM hoax_dataset
        UNION ALL SELECT 'cnnindonesia_news_raw', news_id, title FROM cnnindonesia_news_raw)
  WHERE text IS NOT NULL),
groups AS (
  SELECT tbl, fields, min(id) AS keep_id, count(*) AS copies FROM records WHERE len(fields) > 0 GROUP BY tbl, fields)"""
_PAIRS = f"""{_RECORDS},
words AS (
  SELECT row_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w FROM hoax_dataset WHERE content IS NOT NULL),
shingles AS (
  SELECT DISTINCT row_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s
  FROM words WHERE len(w) >= 3),
sizes AS (SELECT row_id, count(*) AS n FROM shingles GROUP BY row_id),
shared AS (
  SELECT a.row_id AS a, b.row_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.row_id < b.row_id
  GROUP BY a.row_id, b.row_id),
near AS (
  SELECT a AS row_id_a, b AS row_id_b FROM shared JOIN sizes x ON x.row_id = a JOIN sizes y ON y.row_id = b
  JOIN records r ON r.tbl = 'hoax_dataset' AND r.id = a JOIN records t ON t.tbl = 'hoax_dataset' AND t.id = b
  WHERE k >= 0.5 * (x.n + y.n - k) AND r.fields <> t.fields)"""
_LINES = """
lines AS (
  SELECT row_id, source, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS line
  FROM (SELECT row_id, source, string_split(content, chr(10)) AS l FROM hoax_dataset WHERE source IS NOT NULL AND content IS NOT NULL)),
forms AS (
  SELECT row_id, source, line_no, trim(regexp_replace(regexp_replace(lower(line), '\\p{Nd}+', '0', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form
  FROM lines),
repeated AS (
  SELECT f.source, form FROM forms f JOIN (SELECT source, count(*) AS size FROM hoax_dataset GROUP BY source) s ON s.source = f.source
  WHERE form <> '' GROUP BY f.source, form, size HAVING count(DISTINCT row_id) >= 6 AND count(DISTINCT row_id) / size >= 0.05)"""
_P1 = """overlapping AS (
  SELECT DISTINCT h.row_id FROM hoax_dataset h JOIN hoax_dataset t ON t.split = 'train' JOIN (
    SELECT row_id_a AS a, row_id_b AS b FROM near UNION ALL SELECT row_id_b, row_id_a FROM near
    UNION ALL SELECT x.id, y.id FROM records x JOIN records y ON x.tbl = 'hoax_dataset' AND y.tbl = x.tbl AND x.fields = y.fields AND len(x.fields) > 0
  ) p ON p.a = h.row_id AND p.b = t.row_id
  WHERE h.split IN ('validation', 'test'))"""
ORACLES = {
    "p1_found": f"WITH {_PAIRS}, {_P1} SELECT row_id FROM overlapping",
    "p1_by_split_and_source": f"WITH {_PAIRS}, {_P1} SELECT split, source, count(*) AS records, count(o.row_id) AS overlapping "
    "FROM hoax_dataset h LEFT JOIN overlapping o ON o.row_id = h.row_id WHERE split IN ('validation', 'test') GROUP BY split, source",
    "p4_found": f"WITH {_LINES} SELECT row_id, CAST(line_no AS INTEGER) AS line_no FROM forms SEMI JOIN repeated USING (source, form)",
    "p4_clean": f"WITH {_LINES}, gone AS (SELECT row_id, line_no FROM forms SEMI JOIN repeated USING (source, form)), "
    "kept AS (SELECT row_id, string_agg(line, chr(10) ORDER BY line_no) AS content FROM lines ANTI JOIN gone USING (row_id, line_no) GROUP BY row_id), "
    "n AS (SELECT row_id, count(*) AS removed FROM gone GROUP BY row_id) "
    "SELECT h.row_id, CASE WHEN n.removed IS NULL THEN h.content ELSE coalesce(kept.content, '') END AS content, CAST(coalesce(removed, 0) AS INTEGER) AS removed "
    "FROM hoax_dataset h LEFT JOIN kept ON kept.row_id = h.row_id LEFT JOIN n ON n.row_id = h.row_id",
    "p5_found": f"WITH {_PAIRS} SELECT row_id_a, row_id_b FROM near",
    "p6_found": f"WITH {_RECORDS} SELECT r.tbl, keep_id, id AS copy_id FROM records r JOIN groups g ON g.tbl = r.tbl AND g.fields = r.fields WHERE id <> keep_id",
    "p6_records": f"WITH {_RECORDS} SELECT tbl, keep_id, copies FROM groups",
}
