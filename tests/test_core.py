"""Core operators against hand-made cases and plain folds."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from serat.functions import dates as D
from serat.functions import text as X
from serat.operators import credibility as C
from serat.operators import entities as E
from serat.operators import etl, metrics, strict_csv, summarize, temporal, vector
from serat.operators import graph as G
from serat.operators import relations as R
from serat.operators import verify as V
from serat.operators.components import connected_components
from serat.sources import readers, writers
from serat.streaming import titles

REF = datetime(2024, 1, 17)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.clean_text, None, ""),
        (X.clean_text, "  a\n <b>x</b>\t <i> y", "a x  y"),
        (X.strip_tag, "[SALAH] Judul", "Judul"),
        (X.clean_for_graph, "Menu\nOK\nab\n12:30\nhttps://x\nBerita utama", "OK\nBerita utama"),
        (X.scrub_markup, "*a* [t](u) http://x", "a t website"),
        (X.strip_fillers, "It looks like: rain", "rain"),
        (X.split_sentences, "A b. C! D", ["A b.", "C!", "D"]),
        (X.split_claims, "satu dua tiga. x! 1.5 juta orang", ["satu dua tiga", "5 juta orang"]),
        (X.title_case, "o'neil al-hamid", "O'Neil Al-Hamid"),
        (X.detect_language, "the end of this and that", "en"),
        (X.detect_language, "", "id"),
        (X.worth_saving, "UNTRUE", True),
        (X.preprocess_sentence, "Élan 9 A!", "lan  a"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_spans(spark):
    got = one(spark, lambda c: X.find_spans(c, r"\d+"), "é12 b 345")
    assert [tuple(s) for s in got] == [(1, 3, "12"), (6, 9, "345")]
    assert one(spark, lambda c: X.find_spans(c, r"\d+"), "none") == []


def test_search_parameters(spark):
    assert one(spark, lambda c: X.search_parameters(c), 'ok {"query": "q", "timelimit": "d"} x').asDict() == {"query": "q", "timelimit": "d"}
    assert one(spark, lambda c: X.search_parameters(c), "plain").asDict() == {"query": "plain", "timelimit": None}


@pytest.mark.parametrize(
    "text, want",
    [
        ("pada 15 Januari 2024.", [("POINT", "DAY", "2024-01-15T00:00:00", "2024-01-15T23:59:59", 0.95)]),
        ("30 Februari 2024", [("INTERVAL", "MONTH", "2024-02-01T00:00:00", "2024-02-29T23:59:59", 0.85)]),
        ("kuartal III 2023", [("INTERVAL", "YEAR", "2023-01-01T00:00:00", "2023-12-31T23:59:59", 0.7)]),
        ("Q3 2024", [("INTERVAL", "QUARTER", "2024-07-01T00:00:00", "2024-09-30T23:59:59", 0.9)]),
        ("2024-01-15", [("INTERVAL", "YEAR", "2024-01-01T00:00:00", "2024-12-31T23:59:59", 0.7)]),
        ("Sekitar tahun 2020", [("INTERVAL", "YEAR", "2020-01-01T00:00:00", "2020-12-31T23:59:59", 0.5)]),
        ("3 bulan", [("DURATION", "MONTH", "", "", 0.85)]),
        ("minggu lalu", [("RELATIVE", "WEEK", "2024-01-08T00:00:00", "2024-01-14T23:59:59", 0.8)]),
        ("Januari 0000", []),
        (None, []),
    ],
)
def test_temporal(text, want):
    assert [(t[1], t[2], t[3], t[4], t[5]) for t in temporal.extract(text, REF)] == want


def test_temporal_profiles():
    assert temporal.extract("bulan ini", datetime(2024, 1, 17, 10, 30))[0][4] == "2024-02-01T10:29:59"
    assert temporal.extract("2024-01-15", REF, "intended")[0][1] == "POINT"


def test_timeline(spark):
    docs = spark.createDataFrame([("c", 1, "Maret 2023"), ("c", 2, "15 Januari 2024"), ("c", 3, "September 2023 dan 3 hari"), ("c", 4, None)], "coll string, doc long, text string")
    t = temporal.timeline(temporal.extract_temporals(docs, REF))
    assert [r.doc for r in t.orderBy("normalized_start").collect()] == [1, 3, 2]
    b = temporal.timeline_bounds(t).first()
    assert (b.events, b.first_start, b.last_end) == (3, "2023-03-01T00:00:00", "2024-01-15T23:59:59")


def naive_merge(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], s[0] - s[1])):
        for i, k in enumerate(kept):
            if not (s[1] <= k[0] or s[0] >= k[1]):
                if s[2] > k[2] or s[2] == k[2] and s[1] - s[0] > k[1] - k[0]:
                    kept[i] = s
                break
        else:
            kept.append(s)
    return kept


def test_merge_overlaps():
    assert E.merge_overlaps([(0, 11, 0.6), (0, 4, 0.8), (5, 10, 0.8)]) == [(0, 4, 0.8), (5, 10, 0.8)]
    rng = random.Random(1)
    for _ in range(2000):
        spans = [(a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice([0.6, 0.8])) for _ in range(rng.randrange(12))]
        assert E.merge_overlaps(spans) == naive_merge(spans)


def test_entities():
    got = E.extract("Menteri Keuangan mengumumkan anggaran Rp 150 miliar pada 15 Januari 2024, naik 5 persen.", "intended")
    kinds = {g[5]: g[3] for g in got}
    assert kinds["MONEY"] == "Rp 150 miliar" and kinds["DATE"] == "15 Januari 2024" and kinds["PERCENT"] == "5 persen"
    assert all(g[5] == "ORGANIZATION" and len(g[3]) <= 5 for g in E.extract("sekumpulan kata biasa", "reference"))
    assert E.extract("abc") == [] and E.extract(None) == []


def test_nearest_temporal(spark):
    m = spark.createDataFrame([("c", 1, 0, 0, 10, "k"), ("c", 1, 1, 300, 310, "k2")], "coll string, doc long, pos int, start int, end int, key string")
    t = spark.createDataFrame([("c", 1, 0, 109, 115, "a", "b"), ("c", 1, 1, 411, 420, "x", "y")], "coll string, doc long, pos int, start_pos int, end_pos int, normalized_start string, normalized_end string")
    got = {r.key: r.temporal and r.temporal.normalized_start for r in E.nearest_temporal(m, t).collect()}
    assert got == {"k": "a", "k2": None}  # gaps of 99 and 101


def test_relations():
    spans = [(0, 4, 0.9, "Budi", "Budi", "PERSON", "id"), (14, 17, 0.9, "KPK", "KPK", "ORGANIZATION", "id")]
    got = R.extract("Budi memimpin KPK sejak lama", spans)
    assert [(r[1][4], r[2], r[3][4]) for r in got] == [("Budi", "LEADS", "KPK")]
    assert R.infer("Budi dan KPK", (0, 4, 0, "", "", "PERSON"), (9, 12, 0, "", "", "ORGANIZATION")) == ("WORKS_AT", 0.4)
    assert R.infer("a menyetujui b", (0, 1, 0, "", "", "X"), (13, 14, 0, "", "", "X"))[0] == "DECIDED_BY"


def naive_edges(rows):
    edge = None
    for conf, kind, doc in rows:
        if edge is None:
            edge = {"kind": kind, "conf": conf, "n": 1, "docs": {doc}, "turns": 0}
        elif kind == edge["kind"]:
            edge["n"] += 1
            edge["conf"] = max(edge["conf"], conf)
            edge["docs"].add(doc)
        elif conf > edge["conf"]:
            edge = {"kind": kind, "conf": conf, "n": 1, "docs": {doc}, "turns": edge["turns"] + 1}
    return edge


def test_edges_match_the_fold(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for p in range(120):
        seq = [(rng.choice([0.3, 0.5, 0.5, 0.8, 0.9]), rng.choice("ABC"), i) for i in range(rng.randrange(1, 12))]
        want[f"s{p}"] = naive_edges(seq)
        rows += [("c", d, 0, f"s{p}", "t", k, c, [k, "2", "3", "4"], None, "x") for c, k, d in seq]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "coll string, doc long, seq int, source string, target string, relation_type string, confidence double, evidence array<string>, temporal_anchor string, source_sentence string")
    for block in (3, 10_000):
        for r in G.build_edges(log, block).collect():
            w = want[r.source]
            assert (r.relation_type, r.confidence, r.mentions, set(r.source_docs), r.replacements) == (w["kind"], w["conf"], w["n"], w["docs"], w["turns"])
            assert len(r.evidence) == 3 + 2 * (w["n"] - 1)


def test_graph_queries(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a")], "source string, target string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "e"), ("a", "a")], "source string, target string")
    assert {(r.source, r.target): r.path for r in G.shortest_paths(e, pairs).collect()} == {("a", "d"): ["a", "b", "c", "d"], ("a", "a"): ["a"]}
    assert {(r.source, r.target) for r in G.neighbourhood(e, "b").collect()} == {("a", "b"), ("b", "c"), ("a", "a")}
    assert G.edges_of(e, "a").count() == 3  # the loop twice
    n = spark.createDataFrame([("a", "2024-01-15T00:00:00", None), ("b", "", None), ("c", None, None)], "key string, temporal_start string, temporal_end string")
    assert G.by_time(n, "2024-01-01", "2024-01-15").count() == 0 and G.by_time(n, "2024-01-01", "2024-01-16").count() == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 1)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if x is not None}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_outliers_small_collections(spark):
    docs = spark.createDataFrame([("a", 1, "berita vaksin pertama"), ("a", 2, "berita vaksin kedua"), *[("b", i, f"berita vaksin nomor {i} di kota") for i in range(5)], ("b", 9, "x"), ("c", 1, None), ("c", 2, "y"), ("c", 3, "panjang sekali teks ini")], "coll string, doc long, text string")
    got = {(r.coll, r.doc): (r.is_outlier, r.z_score) for r in vector.detect_outliers(docs).collect()}
    assert got["a", 1] == (False, 0.0) and got["b", 9] == (True, -999.0) and got["c", 2] == (True, 0.0) and got["c", 3] == (False, 0.0)
    assert not any(o for (c, d), (o, _) in got.items() if c == "b" and d < 9)


def test_credibility(spark):
    row = spark.createDataFrame([(0.2, 0.5, False, 0.0), (0.95, 0.1, True, -3.5)], "p double, s double, o boolean, z double")
    v = C.score(F.col("p"), F.col("s"), F.col("o"))
    lab = C.hoax_label(F.col("p"))
    got = row.select(v.alias("v"), C.level(lab, F.col("o"), v).alias("l"), C.flags(lab, F.col("p"), F.col("o"), F.col("z")).alias("f")).collect()
    assert (round(got[0].v, 6), got[0].l, got[0].f) == (0.68, "MEDIUM", [])
    assert (got[1].l, got[1].f) == ("CRITICAL", ["HIGH_CONFIDENCE_HOAX", "EXTREME_OUTLIER"])
    with pytest.raises(ValueError):
        C.score(F.lit(1), F.lit(1), F.lit(True), 0.5, 0.4)


def test_date_verdicts(spark):
    rows = [("2024-01-01", f"2024-01-{1 + d:02d}") for d in (0, 7, 8, 30)] + [("2024-01-01", "2024-02-01"), ("x", "y")]
    got = [tuple(r[0]) for r in spark.createDataFrame(rows, "a string, b string").select(D.date_verdict(F.col("a"), F.col("b"))).collect()]
    assert got == [("VERIFIED", 1.0), ("VERIFIED", 1 - 7 / 30), ("PARTIALLY_VERIFIED", 0.5), ("PARTIALLY_VERIFIED", 0.5), ("CONTRADICTED", 0.2), ("UNVERIFIED", 0.3)]


def test_similar_names(spark):
    from difflib import SequenceMatcher

    rng = random.Random(5)
    names = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(3, 9))).strip() or "abc" for _ in range(80)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {(r.want, r.name) for r in V.similar_names(df, df).collect()}
    want = {(a, b) for a in names for b in names if len(a) > 2 and len(b) > 2 and SequenceMatcher(None, a, b).ratio() >= 0.7}
    assert want <= got


@pytest.mark.parametrize("cell", [7, 2000])
def test_similar_names_in_cells(spark, monkeypatch, cell):
    """Exactly the pairs of brute force, and of those the best, however names are divided."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(V, "CELL", cell)
    rng = random.Random(6)
    names = list(dict.fromkeys("".join(rng.choice("aBcd é9") for _ in range(rng.randrange(1, 12))).strip() or "x" for _ in range(60))) + ["a" * 300, "a" * 299 + "b", "", None]
    df = spark.createDataFrame([("s", n) for n in names] + [("t", "only here")], "space string, n string")
    low = sorted({n.lower() for n in names if n})
    ratio = {(a, b): SequenceMatcher(None, a, b).ratio() for a in low for b in low}
    got = {(r.want, r.name): r.ratio for r in V.similar_names(df, df).collect() if r.space == "s"}
    assert got == {k: pytest.approx(v) for k, v in ratio.items() if v >= 0.7}
    other = spark.createDataFrame([("s", n) for n in low[::2]], "space string, n string")
    best = {}
    for r in V.similar_names(df, other, best=True).collect():
        best[r.want] = max(best.get(r.want, 0), r.ratio)
    assert best == {a: pytest.approx(m) for a in low if (m := max(ratio[a, b] for b in low[::2])) >= 0.7}
    assert V.similar_names(df.limit(0), df).count() == 0


@pytest.mark.parametrize("few", [0, 10**6])
def test_known_entities(spark, monkeypatch, few):
    monkeypatch.setattr(V, "BEGINNINGS", few)
    nodes = spark.createDataFrame(
        [("P:budi", 3, "Budi Santoso", ["Pak Budi", "abc", None]), ("O:kpk", 9, "KPK", None), ("O:bank", 3, "Bank Nerin", []), ("P:budi2", 5, "budi santoso", [])], "key string, mentions int, normalized string, aliases array<string>"
    )
    texts = spark.createDataFrame([(1, "kata BUDI SANTOSO dan bank nerin, KPK"), (2, "pak budiman"), (3, None), (4, ""), (5, "abc" * 40_000)], "id long, text string")
    assert {(r.id, r.key) for r in V.known_entities(texts, nodes, 2).collect()} == {(1, "P:budi2"), (1, "O:bank"), (2, "P:budi")}
    assert {r.key for r in V.known_entities(texts.where("id = 1"), nodes, 5).collect()} == {"P:budi2", "O:bank", "P:budi"}
    assert V.known_entities(texts, nodes.limit(0)).count() == 0


def test_rouge_n_is_linear(spark):
    """A text of 200,000 words, twice: each word is read once."""
    text = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, text, text), (2, "a b c d", "b c"), (3, None, "a"), (4, "a", "a")], "id long, reference string, prediction string")
    got = {r.id: (r.precision, r.recall) for r in metrics.rouge_n(df, 2).collect()}
    assert got == {1: (1.0, 1.0), 2: (1.0, pytest.approx(1 / 3)), 3: (0.0, 0.0), 4: (0.0, 0.0)}


def test_edges_with_ties(spark):
    """Records of one document and place are in a fixed order, whatever the order of the rows."""
    cols = "coll string, doc long, seq int, source string, target string, relation_type string, confidence double, evidence array<string>, temporal_anchor string, source_sentence string"
    rows = [("c", 1, 1, "a", "b", k, c, ["e"], t, s) for k, c, t, s in [("X", 0.5, "2", "s"), ("Y", 0.5, "1", "s"), ("X", None, "3", "s"), ("X", 0.5, "1", "t")]]
    seen = {tuple(map(str, G.build_edges(spark.createDataFrame(r, cols)).first())) for r in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(seen) == 1 and next(iter(seen))[3:6] == ("X", "0.5", "3")


def test_match_entities(spark):
    nodes = spark.createDataFrame([("PERSON:Budi Santoso", "Budi Santoso", "PERSON", ["Pak Budi"]), ("ORGANIZATION:KPK", "KPK", "ORGANIZATION", [])], "key string, normalized string, entity_type string, aliases array<string>")
    c = spark.createDataFrame([("ORGANIZATION:KPK", "KPK", "ORGANIZATION"), ("PERSON:Budi Santosa", "Budi Santosa", "PERSON"), ("PERSON:Xyz", "Xyz", "PERSON")], "key string, normalized string, entity_type string")
    got = {r.key: (r.node_key, r.match_status) for r in V.match_entities(c, nodes).collect()}
    assert got == {"ORGANIZATION:KPK": ("ORGANIZATION:KPK", "VERIFIED"), "PERSON:Budi Santosa": ("PERSON:Budi Santoso", "PARTIALLY_VERIFIED"), "PERSON:Xyz": (None, "UNVERIFIED")}


def test_summaries():
    text = "Vaksin baru tiba di kota besar. Vaksin baru diperiksa petugas kota. Cuaca cerah hari itu. Petugas kota membagikan vaksin baru."
    for method in ("textrank", "lexrank"):
        got = summarize.summarize(text, 2, method)
        assert "Cuaca" not in got and len(summarize.sentences(got)) == 2
    assert summarize.summarize("Satu kalimat saja.", 3) == "Satu kalimat saja." and summarize.summarize("", 3) == "" and summarize.summarize(None) == ""


def test_rouge(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "a b", None)], "id long, reference string, prediction string")
    got = {r.id: r.f1 for r in metrics.rouge_n(pairs, 1).collect()}
    assert round(got[1], 6) == round(2 / 3, 6) and got[2] == 0
    assert round({r.id: r.f1 for r in metrics.rouge_l(pairs).collect()}[1], 6) == round(2 / 3, 6)
    ref, pred = pairs.select("id", "reference"), pairs.select("id", "prediction")
    assert round(metrics.average_rouge(ref, pred).first().rouge1, 6) == round(2 / 3, 6)
    with pytest.raises(Exception, match="same ids"):
        metrics.average_rouge(ref, pred.where("id = 1")).collect()


def test_etl(spark):
    d = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(200)], "id long, label int")
    assert etl.balance(d, "id").groupBy("label").count().collect() == etl.balance(d, "id").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in etl.balance(d, "id").groupBy("label").count().collect()} == {0: 50, 1: 50}
    s = {(r.label, r.part): r["count"] for r in etl.stratified_split(d, "id").groupBy("label", "part").count().collect()}
    assert s == {(0, "train"): 127, (0, "eval"): 23, (1, "train"): 42, (1, "eval"): 8}
    assert etl.sample_exact(d, "id", 37).count() == 37 and etl.sample_exact(d, "id", 500).count() == 200
    words = spark.createDataFrame([("Hoax ",), ("FAKTA",), ("aaa",), ("zzz",), (None,)], "label string")
    assert [r.label for r in etl.normalize_labels(words).collect()] == [1, 0, 1, 0, None]
    assert etl.synthetic(spark, 11).where("label = 1 and content not like '%{%'").count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"docs": ["satu", "dua"]}')
    (tmp_path / "b.jsonl").write_text('"x"\n\n{"content": "y"}\n{"other": 1}\n3\n')
    (tmp_path / "c.txt").write_text("satu\n\n\n dua \n\n")
    text = lambda p: [r.text for r in readers.read_documents(spark, str(tmp_path / p)).orderBy("doc_idx").collect()]
    assert text("a.json") == ["satu", "dua"] and text("b.jsonl") == ["x", "y"] and text("c.txt") == ["satu", "dua"]
    with pytest.raises(Exception):
        text("missing.json")
    (tmp_path / "t").mkdir()
    writers.write_csv(spark.createDataFrame([('a "q", b', 1)], "content string, label int").coalesce(1), str(tmp_path / "t/x.csv"))
    assert readers.read_directory(spark, str(tmp_path / "t")).first().content == 'a "q", b'
    assert readers.read_store(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a,b", ["a", "b"]),
        ('"a,""x""\n",', ['a,"x"\n', ""]),
        ("", [""]),
        ('a"b,c', None),
        ('"a"b,c', None),
        ('"a', None),
        (' "a"', None),
        ('"' + '""' * 50_000 + '",x', ['"' * 50_000, "x"]),
        (None, None),
    ],
)
def test_split_record(raw, want):
    assert strict_csv.split_record(raw) == want


def test_strict_load(spark):
    ok = "1,Judul,2024-02-29,k,https://x/y,1"
    rows = [ok, ok, '1,"Judul,2024-02-29,k,https://x/y,1', "1,2", "1,Judul,2023-02-29,k,https://x/y,1", " 7 ,J, 2024-01-01 ,,http://z , 0 ", "1,...,2024-01-01,k,https://x,1", None, "1,J�,2024-01-01,k,https://x,1", "1,J,2024-01-01,k,https://,1", "x" * 100_000]
    raw = spark.createDataFrame(list(enumerate(rows)), "rec_id long, raw_line string").withColumn("v", F.lit(1))
    h = strict_csv.HEADERS["turnbackhoax_2020_2025"]
    assert {r.rec_offset for r in strict_csv.load_strict(raw, h).collect()} == {0, 1, 5}
    assert {r.rec_id: r.reason for r in strict_csv.diagnose(raw, h).collect()} == {2: "quoting", 3: "columns", 4: "value", 6: "value", 7: "quoting", 8: "value", 9: "value", 10: "columns"}
    assert strict_csv.diagnose(raw.limit(0), h).count() == 0


def test_title_stream(spark, tmp_path):
    rows = [(1, i, i, t) for i, t in enumerate(["A news", "A news", "X", "A news", None, "B news"])] + [(2, 9, 9, "news")]
    df = spark.createDataFrame(rows, "key long, t int, seq int, title string").withColumn("ts", F.timestamp_seconds("t")).select("key", "ts", "seq", "title")
    want = sorted((r.key, str(r.ts), r.title) for r in titles.changes(df).collect())
    assert [w[2] for w in want] == ["A news", "A news", "B news", "news"]
    for k in range(2):
        df.where(F.col("seq") % 2 >= 0).where((F.col("seq") < 3) if k == 0 else (F.col("seq") >= 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = titles.change_stream(stream).writeStream.format("memory").queryName("titles").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    q.stop()
    assert sorted((r.key, str(r.ts), r.title) for r in spark.sql("select * from titles").collect()) == want


def test_narratives_hold_all_documents(spark, tmp_path):
    from serat.plans import registry

    rows = [(i, "s", f"isi berita nomor {i}" if i < 4 else None, __import__("datetime").datetime(2024, 1, 1), f"u{i}") for i in range(1, 5)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, published_at timestamp, url string").write.parquet(f"{tmp_path}/documents.parquet")
    said = str(registry.QUERIES["narratives"](spark, str(tmp_path)).collect())
    assert all(f"isi berita nomor {i}" in said for i in (1, 2, 3))


def test_sentence_pairs(spark):
    """The pairs of the joins, for rows of their own and rows that share a document; nothing is shuffled but the ids."""
    rng = random.Random(8)
    words = ["vaksin", "kota", "yang", "Baru", "a", "naïve", "9x", "uji_coba", "dan", "rina", "pasar"]
    say = lambda: [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) + "." for _ in range(rng.randrange(0, 12))]
    rows = [(i, say()) for i in range(40)] + [(3, say()), (None, ["vaksin kota", "vaksin kota"]), (50, None), (51, [None, "kota", "kota"])]
    docs = spark.createDataFrame(rows, "coll long, sentences array<string>")
    apart = docs.select("coll", F.posexplode("sentences").alias("doc", "text"))
    for most in (5000, 6):
        want = {(r.coll, r.i, r.j): r.similarity for r in vector.cosine_pairs(vector.tfidf(apart, X.STOPWORDS_RANKER, 1.0, most)).collect()}
        got = {(r.coll, r.i, r.j): r.similarity for r in vector.sentence_pairs(docs, max_features=most).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()} and (51, 1, 2) in got and len(got) > 100
    assert "Exchange" not in vector.sentence_pairs(docs.where("coll > 3"))._jdf.queryExecution().executedPlan().toString()


def test_similar_names_compares_few(spark, monkeypatch):
    """The best of many names, as by brute force, with few comparisons character by character."""
    from difflib import SequenceMatcher

    rng = random.Random(9)
    name = lambda: " ".join("".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(2))
    names, want = sorted({name() for _ in range(3000)}), sorted({name() for _ in range(20)} | {"x" * 70, "é" + "a" * 300})
    best = {w: max(SequenceMatcher(None, w, n).ratio() for n in names) for w in want}
    calls = []

    class Counted(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(V, "SequenceMatcher", Counted)
    got = {}
    for i, _, r in V._compared(want, np.full(len(want), 0.7), names, True):
        got[want[i]] = max(got.get(want[i], 0), r)
    assert got == {w: r for w, r in best.items() if r >= 0.7} and got
    assert len(calls) < 30 * len(want)  # of 3000 each


def test_extract_both(spark, monkeypatch):
    """Entities, relations and times of the separate passes, with each text searched for entities once."""
    texts = ["Pak Budi Santoso dari KPK bertemu Menteri Rina Wati pada 3 Mei 2020. Bank Nerin Jaya di Bandung Kota.", None, "", 'kH Ana Lisa memimpin PT Sumber pada tahun 2021. "Benar," kata Ana Lisa.', "Ibu  Rina Wati kemarin."]
    docs = spark.createDataFrame([("c", i, t) for i, t in enumerate(texts)], "coll string, doc long, text string")
    ref = datetime(2024, 1, 17)
    mentions, rel = R.extract_both(docs, "intended", ref)
    old = E.nearest_temporal(E.extract_entities(docs, "intended"), temporal.extract_temporals(docs, ref))
    last = E.entity_temporals(old).withColumnRenamed("temporal", "t")
    old = old.join(last, ["coll", "doc", "key"], "left").select("coll", "doc", "pos", "key", "confidence", "t.normalized_start", "t.normalized_end")
    assert sorted(mentions.select("coll", "doc", "pos", "key", "confidence", "temporal.*").collect(), key=str) == sorted(old.collect(), key=str)
    assert sorted(rel.collect(), key=str) == sorted(R.extract_relations(docs, "intended").collect(), key=str)
    for language in ("id", "en"):
        person = E._compiled(language, "intended")[2]
        for t in [*texts, "drs. H Budi Ana", "xIbu Ana Lisa Pak\n Budi Ana", "bApak Ana Rina kh  Ana Budi"]:
            assert [m.span() for m in E.people(t or "", person, language)] == [m.span() for m in person.finditer(t or "")]
