"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serat.operators import strict_csv


def _raw(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet").select("rec_id", "raw_line")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [strict_csv.diagnose(_raw(spark, d, t), h).select(F.lit(t).alias("tbl"), "rec_id", "reason") for t, h in strict_csv.HEADERS.items()]
    return parts[0].unionByName(parts[1])


def p2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return p2_found(spark, d).groupBy("tbl", "reason").agg(F.count("*").alias("records"))


def p2_loaded_turnbackhoax(spark: SparkSession, d: str) -> DataFrame:
    t = "turnbackhoax_2020_2025"
    return strict_csv.load_strict(_raw(spark, d, t), strict_csv.HEADERS[t])


def p2_loaded_detikcom(spark: SparkSession, d: str) -> DataFrame:
    t = "detikcom_news_raw"
    return strict_csv.load_strict(_raw(spark, d, t), strict_csv.HEADERS[t])


QUERIES = {q.__name__: q for q in (p2_found, p2_reasons, p2_loaded_turnbackhoax, p2_loaded_detikcom)}

# A field, and the record as fields without the rest: the same rules as an automaton.
_F = '''(?:"(?:[^"]|"")*"|[^",]*)'''
_GROUPS = "^" + ",".join([f"({_F})"] * 6) + "$"


def _found_sql(table: str, tests: list[str]) -> str:
    v = [f"""trim(CASE WHEN starts_with(f{i}, '"') THEN replace(f{i}[2:-2], '""', '"') ELSE f{i} END, ' ')""" for i in range(1, 7)]
    cols = ", ".join(f"regexp_extract(raw_line, '(?s){_GROUPS}', {i}) AS f{i}" for i in range(1, 7))
    bad = " OR ".join(f"NOT coalesce({t.format(v=f'v{i}')}, false)" for i, t in enumerate(tests, 1))
    vals = ", ".join(f"{x} AS v{i}" for i, x in enumerate(v, 1))
    return f"""
SELECT '{table}' AS tbl, rec_id, reason FROM (
  SELECT rec_id, CASE
    WHEN raw_line IS NULL OR NOT regexp_full_match(raw_line, '(?s){_F}(?:,{_F})*') THEN 'quoting'
    WHEN NOT regexp_full_match(raw_line, '(?s){_F}(?:,{_F}){{5}}') THEN 'columns'
    WHEN {bad} THEN 'value' END AS reason
  FROM (SELECT *, {vals} FROM (SELECT rec_id, raw_line, {cols} FROM {table})))
WHERE reason IS NOT NULL"""


_ID = "regexp_full_match({v}, '[0-9]{{1,18}}')"
_TITLE = r"(regexp_matches({v}, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches({v}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{FFFD}}]'))"
_DATE = "(regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND NOT starts_with({v}, '0000') AND try_strptime({v}, '%Y-%m-%d') IS NOT NULL)"
_STAMP = "(regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND NOT starts_with({v}, '0000') AND try_strptime({v}, '%Y-%m-%d %H:%M:%S') IS NOT NULL)"
_URL = r"regexp_full_match({v}, 'https?://[^\s\p{{Z}}\x{{85}}]+')"
_FOUND = " UNION ALL ".join(
    (
        _found_sql("turnbackhoax_2020_2025", [_ID, _TITLE, _DATE, "true", _URL, "regexp_full_match({v}, '[01]')"]),
        _found_sql("detikcom_news_raw", [_ID, _TITLE, _STAMP, "true", _URL, "regexp_full_match({v}, '(?:[0-9]{{1,18}})?')"]),
    )
)
ORACLES = {
    "p2_found": _FOUND,
    "p2_reasons": f"SELECT tbl, reason, count(*) AS records FROM ({_FOUND}) GROUP BY tbl, reason",
}
