"""Text cleaning and string scalars as column expressions (O-STR01..18, O-FLT, O-KG12).

Null texts count as empty unless a function says otherwise.  Patterns are Unicode-aware, offsets are 0-based.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that results depend on.
STOPWORDS_RANKER = (
    "yang di ke dari dan ini itu untuk pada adalah sebagai dengan juga akan sudah atau ia dia mereka kita kami anda saya tidak bisa ada oleh sebuah dalam tersebut dapat"
).split()
STOPWORDS_OUTLIER = STOPWORDS_RANKER + "lebih telah hanya karena agar seperti saat bahwa jika maka hal sehingga namun tetapi".split()
STOPWORDS = STOPWORDS_OUTLIER + "lalu kemudian secara hingga antara setelah sebelum masih belum pun begitu lain sama".split()
LANGUAGE_WORDS = {"id": "yang dan di ke dari ini itu untuk".split(), "en": "the and in to of this that for".split()}
UI_TERMS = (
    "settings|menu|login|sign in|sign up|search|home|profile|notifications|messages|dashboard|copyright|all rights reserved|privacy policy|terms of service|"
    "skip to content|back to top|cookie policy|accept|decline|loading|please wait|404|not found|error|pengaturan|masuk|daftar|beranda|profil|notifikasi|pesan|"
    "kebijakan privasi|syarat dan ketentuan|hak cipta"
).split("|")
NOISE_PREFIXES = ("http://", "https://", "www.", "file://", "C:\\", "/usr/")
ABBREVIATIONS = {
    "kemkes": "Kementerian Kesehatan",
    "kemenkeu": "Kementerian Keuangan",
    "who": "World Health Organization",
    "un": "United Nations",
    "pbb": "Perserikatan Bangsa-Bangsa",
    "fbi": "Federal Bureau of Investigation",
    "cia": "Central Intelligence Agency",
    "nasa": "National Aeronautics and Space Administration",
}
HONORIFICS = {
    "id": "bapak ibu pak bu saudara saudari dr dr. prof prof. ir ir. h h. hj hj. kh kh. drs drs. drg drg. letjen mayjen brigjen kolonel komjen jenderal laksamana marsekal".split(),
    "en": "mr mr. mrs mrs. ms ms. dr dr. prof prof. sir madam general colonel major captain".split(),
}
WATCHED = "News Article PDF Paper Report BBC CNN Kompas Detik".split()
FILLERS = ["so it looks like", "it looks like", "looks like"]


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def clean_text(c: Column) -> Column:
    """O-STR01: white space collapsed and trimmed, then tags removed (so that two spaces may stay)."""
    return F.regexp_replace(strip(F.regexp_replace(text(c), r"(?U)\s+", " ")), "<.*?>", "")


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def split_sentences(c: Column) -> Column:
    """O-STR02: sentences of the cleaned text, cut at white space after a full stop, exclamation or question mark."""
    return _filled(F.split(clean_text(c), r"(?U)(?<=[.!?])\s+"))


def split_claims(c: Column, least: int = 11) -> Column:
    """O-STR03: parts between runs of sentence marks, stripped, of at least ``least`` characters."""
    return F.filter(F.transform(F.split(text(c), "[.!?]+"), strip), lambda s: F.length(s) >= least)


def preprocess_sentence(c: Column) -> Column:
    """O-STR04: lower case with everything but a-z and white space deleted.  Stemming is the caller's."""
    return F.regexp_replace(F.lower(c), r"(?U)[^a-z\s]", "")


def preprocess_document(c: Column) -> Column:
    """O-STR05."""
    return F.transform(split_sentences(c), preprocess_sentence)


def remove_stopwords(tokens: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """O-STR06: tokens that are no stop word, whatever their case."""
    return F.filter(tokens, lambda t: ~F.lower(t).isin(stopwords))


def clean_for_graph(c: Column) -> Column:
    """O-STR07: lines without navigation terms, paths, addresses and noise."""

    def keep(x: Column) -> Column:
        upper = (F.upper(x) == x) & (F.lower(x) != x)
        noise = x.rlike(r"(?U)\A[\d\W]+\z") | F.lower(x).isin(UI_TERMS)
        for p in NOISE_PREFIXES:
            noise = noise | x.startswith(p)
        return (x != "") & ((F.length(x) >= 4) | upper) & ~noise

    return F.array_join(F.filter(F.transform(F.split(text(c), "\n"), strip), keep), "\n")


def scrub_markup(c: Column) -> Column:
    """O-STR08: marks of emphasis deleted, links by their text, addresses by a word."""
    c = F.regexp_replace(text(c), r"[*_#`]", "")
    c = F.regexp_replace(c, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return strip(F.regexp_replace(c, r"(?U)http\S+", "website"))


def strip_fillers(c: Column, phrases: list[str] = FILLERS) -> Column:
    """O-STR09: the given leading phrases removed one after the other, whatever their case, with a colon or comma after them."""
    for p in phrases:
        c = F.regexp_replace(c, r"(?iU)\A\s*" + r"\s+".join(p.split()) + r"\s*[:,]?\s*", "")
    return c


def strip_tag(c: Column) -> Column:
    """O-STR10: without a leading bracketed tag."""
    return strip(F.regexp_replace(text(c), r"(?U)\A\[.*?\]\s*", ""))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital first, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def normalize_entity(name: Column, entity_type: Column, language: Column) -> Column:
    """O-STR11: organisations by their abbreviation, persons without the longest honorific they begin with, in title case.

    Deviation: where several honorifics fit, the longest is dropped (the order is undefined otherwise).
    """
    name = strip(text(name))
    low = F.lower(name)
    full = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])

    def person(words: list[str]) -> Column:
        any_ = "|".join(sorted((w.replace(".", r"\.") for w in words), key=len, reverse=True))
        return title_case(strip(F.regexp_replace(name, rf"(?i)\A(?:{any_})", "")))

    return (
        F.when(entity_type == "ORGANIZATION", F.coalesce(F.try_element_at(full, low), name))
        .when(entity_type == "PERSON", F.when(language == "id", person(HONORIFICS["id"])).otherwise(person(HONORIFICS["en"])))
        .when(entity_type == "LOCATION", title_case(name))
        .otherwise(name)
    )


def detect_language(c: Column) -> Column:
    """O-STR12: "id" or "en" by common words, ties "id"."""
    words = F.split(F.lower(text(c)), r"(?U)\s+")
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(known)))
    n = {k: count(known) for k, known in LANGUAGE_WORDS.items()}
    return F.when(n["id"] >= n["en"], "id").otherwise("en")


def fact_line(number: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """O-STR15: one numbered fact; keys without their type, the predicate in words."""
    name = lambda k: F.element_at(F.split(k, ":"), -1)
    return F.concat_ws(" ", F.concat(number.cast("string"), F.lit(".")), name(subject), F.replace(F.lower(predicate), F.lit("_"), F.lit(" ")), name(obj))


def search_parameters(c: Column) -> Column:
    """O-STR16: {query, timelimit} of the JSON object in a free text; the text itself as the query if there is none."""
    found = F.from_json(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), "query string, timelimit string")
    return F.when(found["query"].isNotNull(), found).otherwise(F.struct(c.alias("query"), F.lit(None).cast("string").alias("timelimit")))


def is_foreign_input(c: Column, markers: list[str]) -> Column:
    """O-STR17: longer than 10 characters and without the marks of our own output."""
    ok = F.length(text(c)) > 10
    for m in markers:
        ok = ok & ~text(c).contains(m)
    return ok


def worth_saving(verdict: Column) -> Column:
    """O-STR18: the verdict says WORTH SAVING or TRUE (UNTRUE contains it too)."""
    up = F.upper(text(verdict))
    return up.contains("WORTH SAVING") | up.contains("TRUE")


def long_enough(c: Column, least: int) -> Column:
    """O-FLT01..03: at least ``least`` characters without the white space around them; null isn't."""
    return F.coalesce(F.length(strip(c)) >= least, F.lit(False))


def contains_keyword(c: Column, keywords: list[str] = WATCHED) -> Column:
    """O-FLT10: any keyword occurs, whatever its case."""
    low, hit = F.lower(text(c)), F.lit(False)
    for k in keywords:
        hit = hit | low.contains(k.lower())
    return hit


def py_slice(c: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) with both clamped to the text; empty if start >= end (O-KG12)."""
    n = F.length(c)
    a = F.greatest(F.least(start, n), F.lit(0))
    b = F.greatest(F.least(end, n), F.lit(0))
    return F.when(a < b, F.substr(c, a + 1, F.greatest(b - a, F.lit(0)))).otherwise("")


def find_spans(c: Column, pattern: str) -> Column:
    """O-EXT01: array<struct<start, end, text>> of all matches, 0-based and half-open.

    The pattern must match no empty text.  Lengths of the gaps and of the matches add up to the offsets.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(c, pattern, -1), F.length)
    span = "struct<start:int,end:int,text:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))

    def add(state: Column, z: Column) -> Column:
        start = state["at"] + z["gap"]
        end = start + F.length(z["text"])
        one = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), z["text"].alias("text"))
        return F.struct(end.cast("int").alias("at"), F.array_append(state["spans"], one).alias("spans"))

    zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, t: F.struct(g.alias("gap"), t.alias("text")))
    return F.aggregate(zipped, empty, add, lambda s: s["spans"])
