"""Training-data operators against brute force, round trips and hand-made edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from serat.llm import canon, lines, mixing, names, neardup, overlap, packing, residue, tokens
from serat.llm import words as W

WORD = re.compile(r"[^\W_]+")
EDGE = [None, "", "...", "|||", "a", "satu dua", "Ab c d " * 3000, "é" * 9, "x\0y", "a|b|c", "C | a|B!"]


def shingles(t, k):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def canonical(t):
    return tuple(sorted(x for x in ("".join(WORD.findall(p.lower())) for p in (t or "").split("|")) if x))


def corpus(n=150, seed=1, length=60):
    """Texts with families of edited and reformatted copies, one of which holds a third of all."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(rng.randrange(2, 4))) for _ in range(900)]
    texts = []
    hot = [rng.choice(vocab) for _ in range(length)]
    for i in range(n):
        base = hot if i < n // 3 else [rng.choice(vocab) for _ in range(rng.randrange(4, length))] if i % 3 or not texts else WORD.findall(texts[rng.randrange(len(texts))].lower())
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocab)
        t = " ".join(w)
        texts.append(rng.choice([t, t.upper(), t.replace(" ", ",  ")]))
    return texts + EDGE


def frame(spark, texts, extra="", start=1):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "id long, text string")


def near(texts, k, s):
    sh, key = [shingles(t, k) for t in texts], [canonical(t) for t in texts]
    out = set()
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            u = len(sh[i] | sh[j])
            if u and len(sh[i] & sh[j]) >= s * u and key[i] != key[j]:
                out.add((i + 1, j + 1))
    return out


def test_hashes_agree_with_python():
    texts = corpus()
    w = W.words(texts)
    want = [WORD.findall((t or "").lower()) for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert len(set(zip(flat, w.hashes.tolist()))) == len(set(flat)) == len(set(w.hashes.tolist()))
    g, first = w.grams(3)
    grams = [tuple(ws[i : i + 3]) for ws in want for i in range(len(ws) - 2)]
    assert len(grams) == len(g) and len(set(zip(grams, g.tolist()))) == len(set(grams))
    (a, b), n = w.records()
    keys = [canonical(t) for t in texts]
    assert n.tolist() == [len(k) for k in keys] and len(set(zip(a.tolist(), b.tolist()))) == len(set(keys))
    parts = [x for _, _, c in W.chunks(texts) for x in c.hashes.tolist()]
    assert parts == w.hashes.tolist()
    assert W.words([]).docs == 0 and W.words([None]).counts.tolist() == [0]


def test_masks_cover():
    rng = random.Random(2)
    need = neardup.COORDINATES * (neardup.KEEP - 1) // neardup.BLOCK + 1
    for _ in range(500):
        agree = set(rng.sample(range(neardup.COORDINATES), need))
        assert any(agree.issuperset(mask) for mask in neardup.MASKS)


@pytest.mark.parametrize("k, s", [(3, 0.5), (5, 0.8)])
def test_near_duplicates(spark, k, s):
    texts = corpus()
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(frame(spark, texts), k, s).collect()}
    want = near(texts, k, s)
    assert got <= want and len(want - got) <= 0.005 * len(want)


def test_near_duplicates_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMMON_LEAST", 5)
    monkeypatch.setattr(neardup.common_shingles, "__defaults__", (1e-3, 5))
    texts = corpus()
    assert len(neardup.common_shingles(frame(spark, texts).where("text is not null"), 3)) > 20
    got = {(r.id_a, r.id_b) for r in neardup.near_duplicate_pairs(frame(spark, texts), 3, 0.5).collect()}
    want = near(texts, 3, 0.5)
    assert got <= want and len(want - got) <= 0.005 * len(want)


@pytest.mark.parametrize("often, rare, own_a, own_b", [(33, 34, 33, 33), (30, 24, 6, 46), (24, 26, 25, 25), (24, 34, 42, 16)])
def test_sketches_of_pairs_with_site_lines(often, rare, own_a, own_b):
    """Pairs at a similarity of 0.5 that share common shingles meet in some table."""
    rng = random.Random(13)
    new = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    lost = 0
    for _ in range(400):
        site, same = new(often), new(rare)
        w = W.words([f"{site} {same} {new(own_a)}", f"{site} {same} {new(own_b)}"])
        common = np.sort(W.words([site]).grams(1)[0])
        _, _, weighted, _, plain = neardup.sketch(w, 1, common)
        meet = lambda s, masks: len(s) == 2 and any(all(s[0][i] == s[1][i] for i in mask) for mask in masks)
        lost += not (meet(weighted, neardup.MASKS) or meet(plain, neardup.PLAIN_MASKS))
    assert lost <= 0.015 * 400


def test_odd_sketches_count_distinct_shingles():
    """A passage that stands twice in one of two texts doesn't set their odd sketches apart."""
    rng = random.Random(14)
    new = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    for _ in range(20):
        same = new(150)
        texts = [f"{same} {new(150)}", f"{same} {same}"]
        w = W.words(texts)
        base, first = W.distinct(*w.grams(3))
        n, odd = np.diff(first), neardup._odd(base, first)
        a, b = (shingles(t, 3) for t in texts)
        assert n.tolist() == [len(a), len(b)]
        apart = sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(*odd))
        assert apart <= len(a ^ b)


def test_near_duplicate_groups(spark):
    texts = ["a b c d e f g", "a b c d e f h", "A b c d e f g!", "q r s t", "", None]
    got = {r.id: (r.rep, r.links, r.group_id) for r in neardup.near_duplicate_groups(frame(spark, texts), 3, 0.5).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 1, 1), 3: (1, 1, 1), 4: (4, 0, 4)}
    assert neardup.near_duplicate_groups(frame(spark, texts[:0]), 3, 0.5).count() == 0


@pytest.mark.parametrize("stars", [0, 1, 4])
def test_near_duplicate_families(spark, monkeypatch, stars):
    """The components of all pairs, for a family that holds a third of all rows too."""
    monkeypatch.setattr(neardup, "STARS", stars)
    texts = corpus()
    parent = list(range(len(texts) + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words_of = {}
    for i, t in enumerate(texts):
        words_of.setdefault((tuple(WORD.findall((t or "").lower())), canonical(t)), i + 1)
    for a, b in near(texts, 3, 0.5):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: (r.rep, r.group_id) for r in neardup.near_duplicate_families(frame(spark, texts), 3, 0.5).collect()}
    assert set(got) == {i + 1 for i, t in enumerate(texts) if shingles(t, 3)}
    wrong = sum(g != find(r) or r != words_of[(tuple(WORD.findall((texts[i - 1] or "").lower())), canonical(texts[i - 1]))] for i, (r, g) in got.items())
    assert wrong <= 0.01 * len(texts)
    assert neardup.near_duplicate_families(frame(spark, texts[:0]), 3, 0.5).count() == 0


def test_overlap(spark):
    texts = corpus()
    rng = random.Random(4)
    split = [rng.choice(["train", "train", "train", "test", "validation", None]) for _ in texts]
    rows = spark.createDataFrame([(i + 1, t, s) for i, (t, s) in enumerate(zip(texts, split))], "id long, text string, split string")
    keys = [canonical(t) for t in texts]
    pairs = near(texts, 3, 0.5)
    want = set()
    for i, s in enumerate(split):
        if s in ("test", "validation"):
            same = any(split[j] == "train" and keys[j] == keys[i] and keys[i] for j in range(len(texts)))
            like = any((min(i, j) + 1, max(i, j) + 1) in pairs for j in range(len(texts)) if split[j] == "train")
            if same or like:
                want.add(i + 1)
    got = {r.id for r in overlap.overlapping_records(rows, 3, 0.5).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want)
    assert overlap.overlapping_records(rows.limit(0)).count() == 0


def overlap_rows(spark, train, test):
    rows = [(i + 1, t, "train") for i, t in enumerate(train)] + [(10_000 + i, t, "test") for i, t in enumerate(test)]
    return spark.createDataFrame(rows, "id long, text string, split string")


def test_overlap_of_hot_spans(spark):
    """The spans shared with the only partner stand in many other training rows, each of which isn't similar enough."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    train, test = [], []
    for _ in range(8):
        stock = new(45)
        test.append(" ".join(stock + new(12)))
        train.append(" ".join(new(12) + stock))
        train += [" ".join(new(60) + stock) for _ in range(150)]
    rng.shuffle(train)
    got = {r.id: r.partner for r in overlap.overlapping_records(overlap_rows(spark, train, test), 3, 0.5).collect()}
    assert set(got) == {10_000 + i for i in range(8)}
    both = [(shingles(train[got[10_000 + i] - 1], 3), shingles(t, 3)) for i, t in enumerate(test)]
    assert all(len(a & b) >= 0.5 * len(a | b) for a, b in both)


@pytest.mark.parametrize("block, shard", [(1, 10**9), (40, 10**9), (4096, 3)])
def test_overlap_of_large_intervals(spark, monkeypatch, block, shard):
    """Intervals that aren't listed in full, and intervals divided into shards, lose no record."""
    monkeypatch.setattr(overlap, "BLOCK", block)
    monkeypatch.setattr(overlap, "SHARD", shard)
    texts = corpus(120, 5)
    split = ["test" if i % 4 == 0 else "train" for i in range(len(texts))]
    rows = spark.createDataFrame([(i + 1, t, s) for i, (t, s) in enumerate(zip(texts, split))], "id long, text string, split string")
    pairs, keys = near(texts, 3, 0.5), [canonical(t) for t in texts]
    meets = lambda i, j: keys[i] and keys[i] == keys[j] or (min(i, j) + 1, max(i, j) + 1) in pairs
    test, train = ([i for i, s in enumerate(split) if s == x] for x in ("test", "train"))
    got = {r.id: r for r in overlap.overlapping_records(rows, 3, 0.5).collect()}
    assert set(got) == {i + 1 for i in test if any(meets(i, j) for j in train)}
    for r in got.values():
        a, b = WORD.findall(texts[r.id - 1].lower()), shingles(texts[r.partner - 1], 3)
        inside = {p + k for p in range(len(a) - 2) if tuple(a[p : p + 3]) in b for k in range(3)}
        assert r.coverage == pytest.approx(len(inside) / len(a) if len(a) > 2 else 0)


def test_overlap_of_copies(spark):
    """A text with many copies is one representative on either side; the copies of an evaluation text all come out."""
    text = " ".join(f"k{i}" for i in range(30))
    got = overlap.overlapping_records(overlap_rows(spark, [text + " lagi"] * 50, [text, text.upper(), text.replace(" ", ", "), "lain sekali ini"]), 3, 0.5)
    assert {(r.id, r.partner) for r in got.collect()} == {(10_000, 1), (10_001, 1), (10_002, 1)}


def test_overlap_of_short_runs(spark):
    """Texts of 24 words against retellings of 26 words, with no long run in common."""
    rng = random.Random(12)
    train, test = [], []
    for _ in range(60):
        w = [f"w{rng.randrange(10**9)}" for _ in range(24)]
        test.append(" ".join(w))
        train.append(" ".join([*w[:8], "x" + w[8], *w[9:16], "x" + w[16], *w[17:], "y" + w[0], "z" + w[1]]))
    assert all(len(shingles(a, 3) & shingles(b, 3)) >= 0.5 * len(shingles(a, 3) | shingles(b, 3)) for a, b in zip(train, test))
    got = {r.id: r.partner for r in overlap.overlapping_records(overlap_rows(spark, train, test), 3, 0.5).collect()}
    assert got == {10_000 + i: i + 1 for i in range(60)}


def test_copies(spark):
    texts = corpus() + ["a |b", "B|A", "b|a|", "a|b|b"]
    rows = frame(spark, texts).select(F.lit("t").alias("tbl"), "id", "text")
    groups = {}
    for i, t in enumerate(texts):
        if canonical(t):
            groups.setdefault(canonical(t), []).append(i + 1)
    copies, sizes = canon.copy_groups(rows)
    assert {(r.keep_id, r.copy_id) for r in copies.collect()} == {(g[0], x) for g in groups.values() for x in g[1:]}
    assert {r.keep_id: r.copies for r in canon.distinct_records(rows).collect()} == {g[0]: len(g) for g in groups.values()}
    assert canon.distinct_records(rows.limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(6)
    docs = []
    for i in range(300):
        body = [f"kalimat {rng.random()} isi" for _ in range(3)]
        source = "a" if i % 3 == 0 else rng.choice(["b", "c", None])
        if source == "a" and i % 2 == 0:
            body.insert(1, f"Baca juga: artikel {i}!")
        if i % 5 == 0:
            body.append("  Umum, sekali ")
        docs.append((i, "\n".join(body) if i % 50 else None, source))
    rows = spark.createDataFrame(docs, "id long, text string, source string")
    size, df = {}, {}
    form = lambda x: " ".join(re.sub(r"[^a-z0-9]+", " ", re.sub(r"\d+", "0", x.lower())).split())
    for i, t, s in docs:
        if s:
            size[s] = size.get(s, 0) + 1
            for f in {form(x) for x in (t or "").split("\n")} - {""}:
                df.setdefault((s, f), set()).add(i)
    hot = {k for k, v in df.items() if len(v) >= 6 and len(v) >= 0.05 * size[k[0]]}
    want = {(i, n) for i, t, s in docs if s and t for n, x in enumerate(t.split("\n"), 1) if (s, form(x)) in hot}
    assert {(r.id, r.line_no) for r in lines.found_lines(rows).collect()} == want
    clean = {r.id: (r.text, r.removed) for r in lines.without_lines(rows).collect()}
    for i, t, s in docs:
        gone = {n for j, n in want if j == i}
        assert clean[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if n not in gone), len(gone))
    stats = lines.repeated_lines(rows).where("significant").collect()
    assert any(r.source == "a" and r.outside == 0 for r in stats) and lines.found_lines(rows.limit(0)).count() == 0


def test_ratio_decides_or_does_not_run(spark, monkeypatch):
    """By ratio, lines as frequent in other sources stay; by the rule they go, and no ratio is computed."""
    docs = [(i, f"Umum, sekali\nisi {chr(97 + i // 26)}{chr(97 + i % 26)}" + ("\nBaca juga: situs a" if i % 2 else ""), "ab"[i % 2]) for i in range(120)]
    rows = spark.createDataFrame(docs, "id long, text string, source string")
    found = lambda rows, **how: {(r.id, r.line_no) for r in lines.found_lines(rows, **how).collect()}
    own, common = {(i, 3) for i, _, s in docs if s == "b"}, {(i, 1) for i, _, _ in docs}
    assert found(rows, by="ratio") == own and found(rows, by="ratio", rate=0.0) == set()
    assert {r.id: (r.text, r.removed) for r in lines.without_lines(rows, by="ratio").collect()} == {i: ("\n".join(t.split("\n")[:2]), i % 2) for i, t, _ in docs}
    assert found(rows.where("source = 'b'"), by="ratio") == set()
    assert {tuple(r) for r in lines.branches(rows).collect()} == {("ratio", 1, 1), ("share", 2, 2)}
    with pytest.raises(ValueError):
        lines.found_lines(rows, rate=0.5)

    def no_ratio(*_):
        raise AssertionError("the ratio was computed")

    monkeypatch.setattr(lines, "line_statistics", no_ratio)
    monkeypatch.setattr(lines, "significant_ratio", no_ratio)
    assert found(rows) == own | common
    assert {r.id: (r.text, r.removed) for r in lines.without_lines(rows).collect()} == {i: (t.split("\n")[1], 1 + i % 2) for i, t, _ in docs}


def test_packing(spark):
    rng = np.random.default_rng(3)
    for capacity in (10, 512, 1000):
        sizes = rng.integers(1, capacity + 1, 800)
        bins = packing.plan_bins(sizes, capacity)
        assert (np.bincount(bins, sizes) <= capacity).all() and set(bins) == set(range(bins.max() + 1))
    sized = spark.createDataFrame([(i, int(n)) for i, n in enumerate([0, 1, 512, 513, 5000, *rng.integers(1, 300, 500)])] + [(9999, None)], "id long, n long")
    caps = spark.createDataFrame([("short", 512), ("bad", 0), ("none", None)], "k string, c int")
    got = packing.pack(sized, caps, 100).toPandas()
    assert set(got.bin_kind) == {"short"} and got.groupby("bin_id").n_tokens.sum().max() <= 512
    total = got.groupby("id").n_tokens.sum()
    assert total[4] == 5000 and total[0] == 0 and total[9999] == 0 and got[got.id == 4].shape[0] == 10 and got[got.id == 2].shape[0] == 1
    assert got[got.n_tokens == 0].bin_id.isna().all()
    assert packing.fill_report(packing.pack(sized, caps, 1000), caps).first().filled > 0.9
    assert packing.pack(sized.limit(0), caps).count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice("aaab") if i % 10 else "c", rng.randrange(1, 400)) for i in range(4000)] + [(5000, None, 5), (5001, "d", 9), (5002, "a", 0)]
    sized = spark.createDataFrame(docs, "id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.0, 1)], "source string, share double, max int")
    mixed = mixing.mix(sized, targets)
    rep = {r.source: r for r in mixing.share_report(mixed, targets).collect()}
    for s, share, most in [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]:
        assert abs(rep[s].actual_share - share) < 0.01 and rep[s].most <= most
    assert rep["none"].copies == 0 and {r.source for r in mixed.select("source").distinct().collect()} == {"a", "b", "c"}
    assert mixing.mix(sized.limit(0), targets).count() == 0


def test_tokens(spark):
    enc = tokens.encoding(tokens.VOCABULARY)
    for t in ("Pasien di Kelurahan 12!", "<|endoftext|>", "", "\ud800x"):
        n = tokens.count_tokens(t)
        assert n == len(enc.encode_ordinary(t.encode("utf-8", "replace").decode()))
    assert tokens.count_tokens("a" * 200_000) > 0
    df = spark.createDataFrame([(1, None, "s"), (2, "satu dua", None)], "id long, text string, source string")
    assert {r.id: r.n_tokens > 0 for r in tokens.with_tokens(df).collect()} == {1: False, 2: True}


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Camat {{nama}} membuka pasar.", "placeholder"),
        ('"Siswa menagih 482 #KATEGORI# saham di kota ini," kata Budi.', "placeholder"),
        ("<%= topik %> dan {% block nama %}", "placeholder"),
        ("Harga <jumlah korban> naik", "placeholder"),
        ('Pesan itu masih memuat sapaan "Halo {nama}" karena pelaku lupa menggantinya.', None),
        ("Dalam cuplikan kode, variabel ${harga} dipakai untuk menghitung.", None),
        ("```\nprint({x})\n``` selesai", None),
        ("[SALAH] Judul berita", None),
        ("Harga <b>naik</b>", None),
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", "filler"),
        ("Budi menjelaskan bahwa teks lorem ipsum lazim dipakai perancang.", None),
        ("Ganti kalimat ini dengan isi artikel. Teks contoh.", "notice"),
        ("Sumber: null\nTanggal: null", "empty value"),
        ("kolom yang kosong ditulis null oleh operator.", None),
        ("404 - Page not found", "notice"),
        ("Aktifkan JavaScript untuk melanjutkan Verifikasi bahwa Anda bukan robot", "notice"),
        ("Menurut dia, tautan itu meminta korban untuk mengaktifkan JavaScript sebelum mengisi data.", None),
        ("Layanan tidak tersedia untuk sementara di puskesmas itu, ujar Budi, karena perbaikan atap.", None),
        ("Situs itu sempat menampilkan tulisan halaman tidak ditemukan selama 10 jam.", None),
        ("", None),
        (None, None),
    ],
)
def test_residue(text, kind):
    assert residue.residue_kind(text) == kind


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Halaman yang Anda cari tidak ada.", "notice"),
        ("Server tidak merespons.", "notice"),
        ("Server sibuk.", "notice"),
        ("Checking if the site connection is secure", "notice"),
        ("The server is temporarily overloaded.", "notice"),
        ("Vestibulum integer mauris vivamus phasellus curabitur", "filler"),
        ("Excepteur sint occaecat cupidatat non proident", "filler"),
        ("Sumber nil\nTanggal nil", "empty value"),
    ],
)
def test_residue_without_anchors(text, kind):
    assert residue.residue_kind(text) == kind


@pytest.mark.parametrize(
    "text, kind",
    [
        ("{{" + "x" * 500 + "}}", "placeholder"),
        ("Kepada [Your Name], salam", "placeholder"),
        ("Kota $NAMA_KOTA$ dan @@NAMA@@", "placeholder"),
        ("<nama lengkap calon penerima bantuan sosial>", "placeholder"),
        ("Request time out.", "notice"),
        ("This page isn't working", "notice"),
        ("Just a moment...", "notice"),
        ("The requested resource could not be found on this server.", "notice"),
        ("Laman yang Anda tuju belum tersedia.", "notice"),
        ("Judul: null\n", "empty value"),
        ("Harga beras $ 5 dan $ 7 per kilogram @ pasar", None),
        ("Wali kota mengatakan halaman sekolah tidak tersedia untuk parkir.", None),
        ("The page he wrote was never found by the police.", None),
        ("Server di kantor itu sudah tidak berfungsi sejak banjir.", None),
    ],
)
def test_residue_of_any_length_and_wording(text, kind):
    assert residue.residue_kind(text) == kind


def test_residue_long(spark):
    df = frame(spark, ["kata biasa " * 50_000, "{" * 5000, None, "x {{nama}}"])
    assert {r.id for r in residue.find_residue(df).collect()} == {4}


def test_trie_pairs():
    rng = random.Random(9)
    ws = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(60)}
    assert set(names.trie_pairs(list(ws))) == {(a, b) for a in ws for b in ws if a < b and names.within_one(a, b)}


def test_names(spark):
    rows = [
        (1, "PERSON", "Budi Santoso", "Budi Santoso", []),
        (2, "PERSON", "Dr. Budi Santosa", "Budi Santosa", None),
        (3, "PERSON", "Santoso, Budi", "Santoso, Budi", []),
        (4, "PERSON", "BudiSantoso", "Budisantoso", []),
        (5, "PERSON", "Cahya Santoso", "Cahya Santoso", []),
        (6, "PERSON", "Santoso", "Santoso", ["Cahya Santoso"]),
        (7, "ORGANIZATION", "Bank Nerin Tikujaya", "Bank Nerin Tikujaya", []),
        (8, "ORGANIZATION", "Nerin Tikujaya Foundation", "Nerin Tikujaya Foundation", []),
        (9, "ORGANIZATION", "Yay. Nerin Tikudjaya", "Yay. Nerin Tikudjaya", []),
        (10, "ORGANIZATION", "BNT", "BNT", ["Bank Nerin Tikujaya"]),
        (11, "UNKNOWN", "BANK NERIN TIKUJAYA Tbk", "BANK NERIN TIKUJAYA Tbk", []),
        (12, "DATE", "2020", "2020", []),
        (13, "PERSON", None, None, []),
        (14, None, "", "", [None, ""]),
    ]
    df = spark.createDataFrame(rows, "id long, t string, text string, normalized string, aliases array<string>")
    got = {(r.id_a, r.id_b) for r in names.linked_pairs(df).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (5, 6), (7, 10), (7, 11), (10, 11), (8, 9)}
    assert names.linked_pairs(df.limit(0)).count() == 0


def test_names_of_other_persons_and_organisations(spark):
    """All tokens count, short names too; nothing is decided by a list of words."""
    rows = [
        (1, "PERSON", "Budi Agus Santoso"), (2, "PERSON", "Budi Joko Santoso"), (3, "PERSON", "Budi J. Santoso"), (4, "PERSON", "Budi Santoso"), (5, "PERSON", "Budi Agoes Santoso"),
        (6, "ORGANIZATION", "Bank Sinar Kencana Jaya"), (7, "ORGANIZATION", "Bank Sinar Kencana Makmur"), (8, "ORGANIZATION", "Bank Sinar Kencana Jaya Tbk"), (9, "ORGANIZATION", "Bank Sinar Kencana"),
        (10, "PERSON", "Ahmad Rizal"), (11, "PERSON", "Ahmad Rizl"), (12, "PERSON", "Ahmad Rizam"), (13, "PERSON", "Lia Ode"), (14, "PERSON", "Ode, Lia"),
        (15, "ORGANIZATION", "Kementrian Laut Dalam"), (16, "ORGANIZATION", "Laut Dalam Kemenetrian"), (17, "ORGANIZATION", "Ministry of Laut Dalam"),
    ]
    df = spark.createDataFrame([(*r, r[2], []) for r in rows], "id long, t string, text string, normalized string, aliases array<string>")
    got = {(r.id_a, r.id_b) for r in names.linked_pairs(df).collect()}
    assert got == {(1, 5), (2, 3), (6, 8), (10, 11), (13, 14), (15, 16), (15, 17), (16, 17)}
