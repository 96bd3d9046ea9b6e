"""Entities in texts by patterns, with the overlap merge (O-EXT02..08, O-FLD01).

``profile="reference"`` keeps the patterns' behaviour as it is known, in which runs of letters come out as
organisations of up to five; ``"intended"`` reads capitals as capitals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serat.functions.text import ABBREVIATIONS, HONORIFICS, LANGUAGE_WORDS
from serat.operators.temporal import lower_same_length

_MONTHS_ID = "(?:Januari|Februari|Maret|April|Mei|Juni|Juli|Agustus|September|Oktober|November|Desember)"
_MONTHS_EN = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
# The patterns of each language and kind, in order.
PATTERNS = {
    "id": {
        "ORGANIZATION": [
            r"(?:Kementerian|Kementeri)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*",
            r"(?:PT|CV|UD|Yayasan|Universitas|Institut|Politeknik)\s+[A-Z][a-zA-Z\s]+",
            r"(?:Bank|Partai|Badan|Lembaga|Komisi|Dewan)\s+[A-Z][a-zA-Z\s]+",
            r"[A-Z]{2,5}(?:\s+RI)?",
        ],
        "POSITION": [
            r"(?:Presiden|Wakil Presiden|Wapres)",
            r"(?:Menteri|Wakil Menteri)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*",
            r"(?:Gubernur|Wakil Gubernur|Wagub)",
            r"(?:Bupati|Wakil Bupati|Wabup)",
            r"(?:Wali ?Kota|Wakil Wali ?Kota|Wawali)",
            r"(?:Ketua|Wakil Ketua)\s+(?:DPR|MPR|DPD|MK|MA|KPK|KPU|Umum)",
            r"(?:Direktur|Dirjen|Sekjen|Irjen)\s+[A-Z][a-zA-Z\s]+",
            r"(?:Kepala|Kapolri|Kapolda|Panglima|Kasad|Kasal|Kasau)",
        ],
        "DATE": [
            rf"\d{{1,2}}\s+{_MONTHS_ID}\s+\d{{4}}",
            r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
            rf"{_MONTHS_ID}\s+\d{{4}}",
            r"(?:tahun\s+)?\d{4}",
            r"(?:kemarin|hari ini|besok|lusa)",
            r"(?:minggu|bulan|tahun)\s+(?:lalu|depan|ini)",
        ],
    },
    "en": {
        "ORGANIZATION": [
            r"(?:Ministry|Department)\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*",
            r"(?:University|Institute|College)\s+of\s+[A-Z][a-zA-Z\s]+",
            r"[A-Z][a-zA-Z\s]+\s+(?:Inc\.|Corp\.|Ltd\.|LLC|Group|Bank|Association)",
            r"(?:The\s+)?(?:United\s+Nations|World\s+Health\s+Organization|European\s+Union)",
            r"[A-Z]{2,5}",
        ],
        "POSITION": [
            r"(?:President|Vice\s+President|VP)",
            r"(?:Prime\s+Minister|Minister)\s+of\s+[A-Z][a-z]+",
            r"(?:Governor|Mayor|Senator|Congressman|Representative)",
            r"(?:CEO|CFO|CTO|COO|Director|Chairman|Secretary)",
            r"(?:Head|Chief)\s+of\s+[A-Z][a-zA-Z\s]+",
        ],
        "DATE": [
            rf"{_MONTHS_EN}\s+\d{{1,2}},?\s+\d{{4}}",
            rf"\d{{1,2}}\s+{_MONTHS_EN}\s+\d{{4}}",
            r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
            rf"{_MONTHS_EN}\s+\d{{4}}",
            r"(?:yesterday|today|tomorrow)",
            r"(?:last|next)\s+(?:week|month|year)",
        ],
    },
}
SHARED = {
    "MONEY": [r"Rp\.?\s*[\d.,]+(?:\s*(?:ribu|juta|miliar|triliun))?", r"\$\s*[\d.,]+(?:\s*(?:thousand|million|billion))?", r"[\d.,]+\s*(?:rupiah|dollar|dolar|USD|IDR|EUR|GBP)"],
    "PERCENT": [r"[\d.,]+\s*(?:persen|%)"],
}
SKIP = {"id": ["kementerian", "partai", "bank", "pt"], "en": ["ministry", "bank", "corp", "inc"]}
_NAME = r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4})"


#: A pattern that begins with one of some words.
_FIRST = re.compile(r"\(\?:([A-Za-z][A-Za-z ?|]*)\)(?![?*{])")


def _beginnings(pattern: str) -> list[str]:
    """Words of which one stands in each text that the pattern is found in; none: any text."""
    m = _FIRST.match(pattern)
    return sorted({re.match(r"[A-Za-z]+(?!\?)", a)[0] for a in m[1].split("|")}) if m else []


def _compiled(language: str, profile: str) -> tuple[list[tuple[str, bool, re.Pattern, list[str]]], bool, re.Pattern]:
    """Patterns with whether they meet the text in lower case, alternatives are then found by their first letters, and their first words."""
    fold = profile == "reference"
    out = []
    for kind, patterns in (PATTERNS[language] | SHARED).items():
        for p in patterns:
            if not fold and p.startswith("[A-Z]{2,5}"):
                p = rf"\b{p}\b"
            # amounts, dates and the like have no capitals that matter
            low = fold or kind not in ("ORGANIZATION", "POSITION")
            p = p.lower() if low else p
            out.append((kind, low, re.compile(p), _beginnings(p)))
    # honorifics stand as they are, a dot in one fits any character, in the reference profile; the longest first
    words = sorted(HONORIFICS[language], key=lambda w: (-len(w), w))
    lead = "|".join(words if fold else map(re.escape, words))
    return out, fold, re.compile(rf"(?:(?:{lead})\s+)?{_NAME}".lower()) if fold else re.compile(rf"(?:(?i:{lead})\s+)?{_NAME}")


_cache: dict[tuple[str, str], tuple] = {}
_WORDS = {k: frozenset(ws) for k, ws in LANGUAGE_WORDS.items()}
_LONGEST_FIRST = {k: sorted(ws, key=len, reverse=True) for k, ws in HONORIFICS.items()}
_CORE = re.compile(_NAME)
_MOST = max(len(w) for ws in HONORIFICS.values() for w in ws)
#: Each language's honorifics where a part of a text ends.
_LEADS = {k: re.compile(rf"(?i:{'|'.join(map(re.escape, ws))})\Z") for k, ws in _LONGEST_FIRST.items()}


def language_of(text: str) -> str:
    words = text.lower().split()
    n = {k: sum(map(ws.__contains__, words)) for k, ws in _WORDS.items()}
    return "id" if n["id"] >= n["en"] else "en"


def people(text: str, person: re.Pattern, language: str) -> Iterator[re.Match]:
    """What ``person.finditer(text)`` gives for a pattern of the intended profile, an honorific and a name, without trying every honorific at every place.

    A match can't begin behind the first bare name, and before it only with an honorific: one that ends at the blanks
    in front of the name, or one in which the name begins.
    """
    at = 0
    while name := _CORE.search(text, at):
        begin = name.start()
        m = None
        if begin > at and text[begin - 1].isspace():
            end = begin - 1
            while end > at and text[end - 1].isspace():
                end -= 1
            lead = _LEADS[language].search(text, max(at, end - _MOST), end)
            m = lead and person.match(text, lead.start())
        else:
            m = next((m for k in range(max(at, begin - _MOST), begin) if (m := person.match(text, k))), None)
        m = m or person.match(text, begin)
        yield m
        at = m.end()


def normalize(text: str, kind: str, language: str) -> str:
    text = text.strip()
    if kind == "ORGANIZATION":
        return ABBREVIATIONS.get(text.lower(), text)
    if kind == "PERSON":
        low = text.lower()
        lead = next((h for h in _LONGEST_FIRST[language] if low.startswith(h)), "")
        return text[len(lead) :].strip().title()
    return text.title() if kind == "LOCATION" else text


def merge_overlaps(spans: list[tuple]) -> list[tuple]:
    """O-FLD01 over (start, end, confidence, ...): in order of start, the longer first, a span meets the first kept one it overlaps.

    It takes that one's place if it is surer, or as sure and longer, and is dropped otherwise.  As starts only grow, a
    kept span that ends before the current start is out of play, so each span is held against the few active ones.
    """
    kept: list[tuple] = []
    active: list[int] = []  # places in ``kept``, in order
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        active = [i for i in active if kept[i][1] > s[0]]
        hit = next((i for i in active if s[1] > kept[i][0]), None)
        if hit is None:
            active.append(len(kept))
            kept.append(s)
        elif (s[2], s[1] - s[0]) > (kept[hit][2], kept[hit][1] - kept[hit][0]):
            kept[hit] = s
    return kept


def extract(text: str | None, profile: str = "reference", merge: bool = True) -> list[tuple]:
    """(start, end, confidence, text, normalized, entity_type, language) of a text in order of (start, -end) (O-EXT07)."""
    if not text or len(text.strip()) < 5:
        return []
    language = language_of(text)
    if (language, profile) not in _cache:
        _cache[language, profile] = _compiled(language, profile)
    patterns, folded, person = _cache[language, profile]
    low = lower_same_length(text)
    spans = []
    for kind, lowered, p, first in patterns:
        where = low if lowered else text
        if first and not any(w in where for w in first):
            continue
        for m in p.finditer(where):
            found = text[m.start() : m.end()]
            spans.append((m.start(), m.end(), 0.8, found, normalize(found, kind, language), kind, language))
    for m in person.finditer(low) if folded else people(text, person, language):
        name = text[m.start(1) : m.end(1)]
        if not any(w in name.lower() for w in SKIP[language]):
            spans.append((m.start(), m.end(), 0.6, text[m.start() : m.end()], normalize(name, "PERSON", language), "PERSON", language))
    return sorted(merge_overlaps(spans) if merge else spans, key=lambda s: (s[0], -s[1]))


COLUMNS = ["start", "end", "confidence", "text", "normalized", "entity_type", "language"]
_TYPES = [pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string()]


def extract_entities(docs: DataFrame, profile: str = "reference", merge: bool = True) -> DataFrame:
    """(coll, doc, pos, start, end, confidence, text, normalized, entity_type, language, key) for (coll, doc, text).

    One pass without a shuffle; null texts and those of fewer than 5 characters hold nothing.
    """
    docs = docs.toDF("coll", "doc", "text")
    head = docs.select("coll", "doc", F.lit(0).alias("pos")).schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")
    schema = f"{head}, start int, end int, confidence double, text string, normalized string, entity_type string, language string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                rows, at, pos = [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    got = extract(t, profile, merge)
                    rows += got
                    at += [i] * len(got)
                    pos += range(len(got))
                idx = pa.array(at, pa.int64())
                cols = list(zip(*rows)) if rows else [[]] * len(COLUMNS)
                yield pa.RecordBatch.from_arrays([part.column(0).take(idx), part.column(1).take(idx), pa.array(pos, pa.int32()), *[pa.array(c, t) for c, t in zip(cols, _TYPES)]], ["coll", "doc", "pos", *COLUMNS])

    return docs.mapInArrow(run, schema).withColumn("key", F.concat_ws(":", "entity_type", "normalized"))


def unique_entities(mentions: DataFrame) -> DataFrame:
    """(coll, key, first_text, first_doc, mentions, aliases): one row an entity; texts of later mentions as aliases (O-EXT08)."""
    seq = F.struct("doc", "pos")
    g = mentions.groupBy("coll", "key").agg(F.min(F.struct(seq.alias("seq"), "text", "doc")).alias("f"), F.count("*").alias("mentions"))
    again = mentions.join(g.select("coll", "key", F.col("f.seq").alias("first")), ["coll", "key"]).where(F.struct("doc", "pos") != F.col("first"))
    aliases = again.groupBy("coll", "key").agg(F.array_sort(F.collect_set("text")).alias("aliases"))
    none = F.array().cast("array<string>")
    return g.join(aliases, ["coll", "key"], "left").select("coll", "key", F.col("f.text").alias("first_text"), F.col("f.doc").alias("first_doc"), "mentions", F.coalesce("aliases", none).alias("aliases"))


def nearest_temporal(mentions: DataFrame, temporals: DataFrame, within: int = 100) -> DataFrame:
    """``mentions`` with the nearest temporal of their document, closer than ``within`` characters (O-JN01), or null.

    The temporals of a document travel as one array; the gap is 0 for overlaps and the first wins among equals.
    """
    each = F.struct("pos", "start_pos", "end_pos", "normalized_start", "normalized_end")
    packed = temporals.groupBy("coll", "doc").agg(F.array_sort(F.collect_list(each)).alias("ts"))
    gap = lambda t: F.greatest(F.col("start") - t["end_pos"], t["start_pos"] - F.col("end"), F.lit(0))
    rated = F.transform("ts", lambda t: F.struct(gap(t).alias("gap"), t["pos"].alias("pos"), t.alias("t")))
    best = F.array_min(F.filter(rated, lambda r: r["gap"] < within))
    return mentions.join(packed, ["coll", "doc"], "left").withColumn("temporal", best["t"]).drop("ts")


def entity_temporals(associated: DataFrame) -> DataFrame:
    """(coll, doc, key, temporal): the last association of each entity in its document wins (O-FLD09)."""
    return associated.where("temporal is not null").groupBy("coll", "doc", "key").agg(F.max_by("temporal", "pos").alias("temporal"))
