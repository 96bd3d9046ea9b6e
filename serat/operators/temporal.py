"""Dates, periods, relative times and durations in Indonesian texts (O-EXT09..16, O-TOP04, O-FLD02/05)."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Month names, phrases, units, modifiers.
MONTHS = {
    "januari": 1, "februari": 2, "maret": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "agustus": 8, "september": 9, "oktober": 10, "november": 11, "desember": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "agu": 8, "agst": 8, "sep": 9, "sept": 9, "okt": 10, "nov": 11, "des": 12,
}
RELATIVE = {
    "hari ini": (0, "DAY"), "kemarin": (-1, "DAY"), "kemarin dulu": (-2, "DAY"), "besok": (1, "DAY"), "lusa": (2, "DAY"),
    "minggu ini": (0, "WEEK"), "minggu lalu": (-1, "WEEK"), "minggu kemarin": (-1, "WEEK"), "minggu depan": (1, "WEEK"), "pekan ini": (0, "WEEK"), "pekan lalu": (-1, "WEEK"),
    "bulan ini": (0, "MONTH"), "bulan lalu": (-1, "MONTH"), "bulan kemarin": (-1, "MONTH"), "bulan depan": (1, "MONTH"),
    "tahun ini": (0, "YEAR"), "tahun lalu": (-1, "YEAR"), "tahun kemarin": (-1, "YEAR"), "tahun depan": (1, "YEAR"),
}
UNITS = {"detik": "second", "menit": "minute", "jam": "hour", "hari": "day", "minggu": "week", "bulan": "month", "tahun": "year"}
MODIFIERS = "sekitar|kira-kira|kurang lebih|hampir|lebih dari|kurang dari|mendekati|awal|pertengahan|akhir|beberapa".split("|")
QUARTERS = {"2": 4, "4": 10, "3": 7}

# All patterns meet the text in lower case, without a flag for it: alternatives are then found by their first letters.
_any = lambda words: "|".join(map(re.escape, words))
_DATE = re.compile(rf"(\d{{1,2}})\s+({_any(MONTHS)})\s+(\d{{4}})")
_MONTH = re.compile(rf"({_any(MONTHS)})\s+(\d{{4}})")
_QUARTER = re.compile(r"(?:q|kuartal)\s*([iv1-4])\s*(\d{4})")
_YEAR = re.compile(r"(?:tahun\s+)?(\d{4})\b")
_RELATIVE = re.compile(_any(RELATIVE))
_DURATION = re.compile(rf"(\d+)\s+({_any(UNITS)})")
_MODIFIER = re.compile(rf"(?:{_any(MODIFIERS)})\s+")
_ISO_DATE = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b")
_NUMERIC = re.compile(r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b")

SCHEMA = (
    "text string, temporal_type string, granularity string, normalized_start string, normalized_end string, confidence double, is_approximate boolean, "
    "relative_anchor string, start_pos int, end_pos int, amount long, unit string"
)


def _month_end(year: int, month: int) -> datetime:
    return datetime(year, month, calendar.monthrange(year, month)[1], 23, 59, 59)


def lower_same_length(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def resolve(phrase: str, reference: datetime) -> tuple[datetime, datetime, str]:
    """(start, end, granularity) of a relative phrase (O-EXT13); the reference's time of day is kept in the start."""
    n, unit = RELATIVE[phrase.lower()]
    if unit == "DAY":
        start = reference + timedelta(days=n)
        return start, start.replace(hour=23, minute=59, second=59), unit
    if unit == "WEEK":
        start = reference + timedelta(days=7 * n - reference.weekday())
        return start, start + timedelta(days=7, seconds=-1), unit
    if unit == "MONTH":
        index = reference.year * 12 + reference.month - 1 + n
        after = index + 1
        start = reference.replace(year=index // 12, month=index % 12 + 1, day=1)
        return start, start.replace(year=after // 12, month=after % 12 + 1) - timedelta(seconds=1), unit
    start = reference.replace(year=reference.year + n, month=1, day=1)
    return start, start.replace(month=12, day=31, hour=23, minute=59, second=59), unit


def extract(text: str | None, reference: datetime, profile: str = "reference") -> list[tuple]:
    """All expressions of a text in order of position, as tuples in the order of SCHEMA (O-EXT16).

    Later kinds leave out what begins within an earlier one (dates, months, quarters, years).  Days that don't exist
    and the year 0000 give nothing.  ``profile="intended"`` also reads ISO and numeric dates.
    """
    if not text:
        return []
    low = lower_same_length(text)
    near = [m.end() for m in _MODIFIER.finditer(low)]
    found: list[tuple] = []

    def add(m: re.Match, kind: str, grain: str, start: datetime | None, end: datetime | None, sure: float, vague: float | None = None, **more) -> None:
        about = vague is not None and any(abs(m.start() - e) < 20 for e in near)
        iso = lambda d: d.isoformat() if d else ""
        found.append((text[m.start() : m.end()], kind, grain, iso(start), iso(end), vague if about else sure, about, more.get("anchor"), m.start(), m.end(), more.get("amount"), more.get("unit")))

    def taken(at: int) -> bool:
        return any(f[8] <= at < f[9] for f in found)

    def day(m: re.Match, y: int, mo: int, d: int) -> None:
        try:
            add(m, "POINT", "DAY", datetime(y, mo, d), datetime(y, mo, d, 23, 59, 59), 0.95, 0.7)
        except ValueError:
            pass

    for m in _DATE.finditer(low):
        day(m, int(m[3]), MONTHS[m[2].lower()], int(m[1]))
    if profile == "intended":
        for m in _ISO_DATE.finditer(low):
            day(m, int(m[1]), int(m[2]), int(m[3]))
        for m in _NUMERIC.finditer(low):
            day(m, int(m[3]), int(m[2]), int(m[1]))
    for m in _MONTH.finditer(low):
        y, mo = int(m[2]), MONTHS[m[1].lower()]
        if y and not taken(m.start()):
            add(m, "INTERVAL", "MONTH", datetime(y, mo, 1), _month_end(y, mo), 0.85, 0.6)
    for m in _QUARTER.finditer(low):
        y, mo = int(m[2]), QUARTERS.get(m[1], 1)
        if y:
            add(m, "INTERVAL", "QUARTER", datetime(y, mo, 1), _month_end(y, mo + 2), 0.9)
    for m in _YEAR.finditer(low):
        if 1900 <= (y := int(m[1])) <= 2100 and not taken(m.start()):
            add(m, "INTERVAL", "YEAR", datetime(y, 1, 1), datetime(y, 12, 31, 23, 59, 59), 0.7, 0.5)
    for m in _RELATIVE.finditer(low):
        start, end, grain = resolve(m[0], reference)
        add(m, "RELATIVE", grain, start, end, 0.8, anchor=reference.isoformat())
    for m in _DURATION.finditer(low):
        unit = UNITS[m[2].lower()]
        add(m, "DURATION", unit.upper(), None, None, 0.85, amount=min(int(m[1]), 2**63 - 1), unit=unit)
    return sorted(found, key=lambda f: f[8])


def _names() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def extract_temporals(docs: DataFrame, reference: datetime, profile: str = "reference") -> DataFrame:
    """(coll, doc, pos, and the columns of SCHEMA) for (coll, doc, text): one pass, no shuffle.  Null texts hold nothing."""
    docs = docs.toDF("coll", "doc", "text")
    keys = docs.select("coll", "doc", F.lit(0).alias("pos")).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    schema = docs.sparkSession.createDataFrame([], f"{keys}, {SCHEMA}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, pos = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                got = extract(t, reference, profile)
                rows += got
                at += [i] * len(got)
                pos += range(len(got))
            idx = pa.array(at, pa.int64())
            cols = list(zip(*rows)) if rows else [[]] * len(_names())
            types = [pa.string()] * 5 + [pa.float64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(idx), batch.column(1).take(idx), pa.array(pos, pa.int32()), *arrays], ["coll", "doc", "pos", *_names()])

    return docs.mapInArrow(run, schema)


def timeline(temporals: DataFrame) -> DataFrame:
    """(coll, doc, text, normalized_start, normalized_end, rank): the best expression of each document in order (O-TOP04, O-FLD05).

    Points before intervals before others, then the first in the text.  Durations have no start and come first.
    """
    rank = F.when(F.col("temporal_type") == "POINT", 0).when(F.col("temporal_type") == "INTERVAL", 1).otherwise(2)
    best = F.min_by(F.struct("text", "normalized_start", "normalized_end"), F.struct(rank, "start_pos", "pos"))
    return temporals.groupBy("coll", "doc").agg(best.alias("b")).select("coll", "doc", "b.*")


def timeline_bounds(events: DataFrame) -> DataFrame:
    """(coll, events, first_start, last_end): the first start, and the end of the event that is last in order."""
    order = F.struct("normalized_start", "doc")
    return events.groupBy("coll").agg(
        F.count("*").alias("events"), F.min("normalized_start").alias("first_start"), F.max_by("normalized_end", order).alias("last_end")
    )
