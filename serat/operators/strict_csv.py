"""Rows that fail to parse: strict load of raw CSV records, anti-join, and a reason for each of the rest."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One field: quoted to its closing quote with inner quotes doubled, or free of quotes.
_FIELD = re.compile(r'"([^"]*+(?:""[^"]*+)*+)"(?=,|\Z)|([^",]*+)(?=,|\Z)')


def split_record(raw: str | None) -> list[str] | None:
    """The fields of a CSV record under the strict quoting rules, None if it breaks them."""
    if raw is None:
        return None
    fields, at = [], 0
    while m := _FIELD.match(raw, at):
        fields.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        if m.end() == len(raw):
            return fields
        at = m.end() + 1
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(raw: pd.Series) -> pd.Series:
    # a state machine: Java's regular expressions recurse on repeated groups and overflow on long records
    return raw.map(split_record, na_action="ignore").astype(object).where(raw.notna(), None)


#: Code points no title may hold: controls but tab, line feed and carriage return, and the replacement character.
BROKEN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F�]"


@dataclass(frozen=True)
class Kind:
    """A column type: the test of a trimmed value and the typed value, which is null exactly if the test fails or the value is empty."""

    test: object
    load: object


def _digits(v: Column) -> Column:
    return v.rlike(r"\A[0-9]{1,18}\z")


def _title(v: Column) -> Column:
    return v.rlike(r"[\p{L}\p{N}]") & ~v.rlike(BROKEN)


def _stamp(shape: str, pattern: str):
    # years before 1 don't exist; shorter forms are refused by the shape
    return lambda v: v.rlike(shape) & ~v.startswith("0000") & F.try_to_timestamp(v, F.lit(pattern)).isNotNull()


DATE = Kind(_stamp(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd"), lambda v: F.try_to_date(v, "yyyy-MM-dd"))
STAMP = Kind(_stamp(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z", "yyyy-MM-dd HH:mm:ss"), lambda v: F.try_to_timestamp(v, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))
ID = Kind(_digits, lambda v: v.try_cast("bigint"))
TITLE = Kind(_title, lambda v: v)
URL = Kind(lambda v: v.rlike(r"\Ahttps?://") & ~v.rlike(r"(?U)\s") & ~v.rlike(r"\Ahttps?://\z"), lambda v: v)
FLAG = Kind(lambda v: v.rlike(r"\A[01]\z"), lambda v: v.try_cast("int"))
COUNT = Kind(lambda v: (v == "") | _digits(v), lambda v: v.try_cast("bigint"))
ANY = Kind(lambda v: F.lit(True), lambda v: v)

HEADERS = {
    "turnbackhoax_2020_2025": {"id": ID, "judul": TITLE, "tanggal": DATE, "kategori": ANY, "url": URL, "hoax": FLAG},
    "detikcom_news_raw": {"id": ID, "title": TITLE, "published_at": STAMP, "kanal": ANY, "url": URL, "n_komentar": COUNT},
}


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.select("rec_id", _split("raw_line").alias("v"))


def load_strict(raw: DataFrame, header: dict[str, Kind]) -> DataFrame:
    """Conforming records of (rec_id, raw_line), typed under ``header``, with their offset as ``rec_offset``.

    A null record conforms to nothing.  Values are trimmed of spaces; an empty optional number becomes null.
    """
    rows = _parsed(raw).where(F.size("v") == len(header)).select("rec_id", F.transform("v", lambda x: F.trim(x)).alias("v"))
    good = F.lit(True)
    for i, kind in enumerate(header.values()):
        good = good & kind.test(F.get("v", F.lit(i)))
    # a column of the file may be called rec_id too, so the offset gets a name of its own
    return rows.where(good).select(F.col("rec_id").alias("rec_offset"), *[k.load(F.get("v", F.lit(i))).alias(c) for i, (c, k) in enumerate(header.items())])


def diagnose(raw: DataFrame, header: dict[str, Kind]) -> DataFrame:
    """(rec_id, reason) of records that ``load_strict`` leaves: the first of quoting, columns, value that applies.

    Offsets are unique, so the anti-join has no hot key.  A null record counts as quoting: it isn't a record at all.
    """
    loaded = load_strict(raw, header).select(F.col("rec_offset").alias("rec_id"))
    rest = _parsed(raw.select("rec_id", "raw_line").join(loaded, "rec_id", "left_anti"))
    reason = F.when(F.col("v").isNull(), "quoting").when(F.size("v") != len(header), "columns").otherwise("value")
    return rest.select("rec_id", reason.alias("reason"))
