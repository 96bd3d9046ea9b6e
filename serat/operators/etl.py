"""Labelled data sets: filters, unions, balance, splits, samples, synthetic records (O-ETL01..03, O-SRC10/11, O-TOP08..11, O-AGG12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from serat.functions import text as X

HOAX, VALID = ["hoax", "fake", "palsu", "bohong", "1", "true"], ["valid", "real", "fakta", "benar", "0", "false"]
#: Documents of one bucket in exact sampling; buckets of a hash replace one sort of everything.
BUCKETS = 4096


def draw(key: Column, seed: int = 42) -> Column:
    """A fixed random order: the same in every engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))


def combine(frames: dict[str, DataFrame]) -> DataFrame:
    """O-SET01, O-SET02, O-ETL01: frames by column name with their name as ``source``; missing columns are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def usable(df: DataFrame, text: str = "content", longer_than: int = 20, need: tuple[str, ...] = ()) -> DataFrame:
    """O-FLT02, O-FLT03: rows whose text is longer than that and whose needed columns aren't null."""
    keep = F.length(text) > longer_than
    for c in need:
        keep = keep & F.col(c).isNotNull()
    return df.where(keep)


def distinct_titles(df: DataFrame, title: str, per: str) -> DataFrame:
    """O-AGG12: distinct non-null titles of each file; the same title in two files stays twice."""
    return df.where(F.col(title).isNotNull()).select(per, title).distinct()


def sample_exact(df: DataFrame, key: str, n: Column | int, by: str | None = None, seed: int = 42) -> DataFrame:
    """The ``n`` rows (of each ``by``) that come first in the drawn order (O-TOP08, O-TOP10, O-TOP11), exactly.

    ``n``: a number, or a column of ``df`` that is constant within ``by``.  Rows fall into BUCKETS ranges of the drawn
    order; counts of the ranges tell which are in whole and which one is cut, so only that one is ranked.
    """
    n = F.lit(n) if isinstance(n, int) else n
    group = F.lit(0) if by is None else F.col(by)
    d = df.withColumns({"_o": draw(F.col(key), seed), "_g": group, "_n": n})
    d = d.withColumn("_b", F.conv(F.substring("_o", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy("_g", "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BUCKETS rows a group
    counts = counts.select("_g", "_b", "_c", before.alias("_before"))
    counts = counts.toDF("_g2", "_b2", "_c", "_before")
    # without groups there are BUCKETS rows of counts
    d = d.join(F.broadcast(counts) if by is None else counts, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_b") == F.col("_b2"))).drop("_g2", "_b2")
    whole = d.where(F.col("_before") + F.col("_c") <= F.col("_n"))
    cut = d.where((F.col("_before") < F.col("_n")) & (F.col("_before") + F.col("_c") > F.col("_n")))
    ranked = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_o", key))).where(F.col("_before") + F.col("_r") <= F.col("_n")).drop("_r")
    return whole.unionByName(ranked).select(*df.columns)


def balance(df: DataFrame, key: str, label: str = "label", positive: int = 1, seed: int = 42) -> DataFrame:
    """O-TOP10: all positives and as many negatives, drawn."""
    few = df.where(F.col(label) == positive).agg(F.count("*").alias("_p"))
    negatives = df.where(F.col(label) != positive).crossJoin(F.broadcast(few))  # one row
    return df.where(F.col(label) == positive).unionByName(sample_exact(negatives, key, F.col("_p"), seed=seed).drop("_p"))


def stratified_split(df: DataFrame, key: str, label: str = "label", share: float = 0.85, seed: int = 42) -> DataFrame:
    """O-TOP11: ``df`` with ``part`` ("train" or "eval"): of each label exactly the floor of its share goes to train."""
    size = df.groupBy(label).agg(F.floor(F.count("*") * F.lit(share)).alias("_t"))
    joined = df.join(F.broadcast(size), df[label].eqNullSafe(size[label])).drop(size[label])  # one row a label
    train = sample_exact(joined, key, F.col("_t"), by=label, seed=seed).select(key).withColumn("part", F.lit("train"))
    return df.join(train, key, "left").withColumn("part", F.coalesce("part", F.lit("eval")))


def normalize_labels(df: DataFrame, label: str = "label", numeric: bool | None = None) -> DataFrame:
    """O-ETL03: labels as 1 (hoax) or 0.

    Numbers are cast.  Words are looked up; unknown ones take 1 if they stand in the first half of the sorted distinct
    unknown labels (a deviation: the order is undefined otherwise).  Null stays null.
    """
    if numeric is None:
        numeric = dict(df.dtypes)[label] not in ("string",)
    if numeric:
        return df.withColumn(label, F.col(label).cast("int"))
    low = F.lower(X.strip(F.col(label)))
    known = F.when(low.isin(HOAX), 1).when(low.isin(VALID), 0)
    unknown = df.where(known.isNull() & F.col(label).isNotNull()).select(low.alias("_l")).distinct()
    order = unknown.agg(F.array_sort(F.collect_set("_l")).alias("_all"))  # a label set is small
    place = F.array_position("_all", low)
    return df.crossJoin(F.broadcast(order)).withColumn(label, F.coalesce(known, F.when(place > 0, (place <= F.floor(F.size("_all") / 2)).cast("int")))).drop("_all")


def hoax_data(hoax: DataFrame, valid: DataFrame, seed: int = 42) -> DataFrame:
    """O-ETL02: (content, label): cleaned hoax titles (repeated and empty ones kept) and as many distinct valid ones.

    ``hoax``: (title); ``valid``: (file, title).  Rows come in the drawn order.
    """
    pos = hoax.toDF("title").select(X.strip_tag(F.col("title")).alias("content"), F.lit(1).alias("label"))
    neg = distinct_titles(valid.toDF("file", "title"), "title", "file").select(F.col("title").alias("content"), F.lit(0).alias("label"), F.concat_ws("|", "file", "title").alias("k"))
    few = pos.agg(F.count("*").alias("_p"))
    drawn = sample_exact(neg.crossJoin(F.broadcast(few)), "k", F.col("_p"), seed=seed)
    return pos.unionByName(drawn.select("content", "label"))


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first candidate that the frame has; none: ValueError."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} in {df.columns}")


TEXT_COLUMNS = ["content", "isi_berita", "text", "content", "article", "body", "narasi", "Clean Narasi"]
LABEL_COLUMNS = ["label", "class", "kategori", "hoax"]
TITLE_COLUMNS = ["title", "judul", "headline"]

#: Sentences of the synthetic sets, with slots that FILLINGS fills.
HOAX_TEMPLATES = [
    "Pesan berantai: {place} akan ditutup karena {cause}, teruskan ke semua grup",
    "Dokter asing mengaku {food} menyembuhkan {illness} dalam semalam",
    "Foto ini bukti {office} menyembunyikan {cause}",
    "Undian {office}: klik tautan dan menangkan {prize}",
    "Jangan makan {food} sesudah mandi, akibatnya {illness}",
    "Saksi mata melihat {cause} di {place}, media bungkam",
    "Mulai besok {office} memotong gaji untuk {cause}",
    "Video lama {cause} di {place} kini beredar lagi",
    "Air rebusan {food} membuat kebal {illness}",
    "Nomor tak dikenal dari {place} menyedot {prize}",
]
VALID_TEMPLATES = [
    "{office} membuka kembali layanan di {place} pekan ini",
    "Harga {food} di pasar {place} turun tipis",
    "Puskesmas {place} memeriksa warga untuk {illness}",
    "{office} menjelaskan anggaran perbaikan jalan di {place}",
    "Petani {place} memanen {food} lebih awal tahun ini",
    "Sekolah di {place} libur sehari karena {cause}",
    "Pertandingan di {place} ditunda akibat {cause}",
    "{office} menerima laporan warga tentang {cause}",
    "Lomba memasak {food} di {place} diikuti ratusan peserta",
    "Penelitian baru membahas pencegahan {illness} pada anak",
]
FILLINGS = {
    "place": ["Bogor", "Kendari", "Ambon", "Solo", "Jambi", "Kupang", "Ternate"],
    "cause": ["banjir", "angin kencang", "pemadaman listrik", "gempa kecil", "kabut asap"],
    "office": ["Dinas Perhubungan", "kantor pos", "balai desa", "perusahaan air minum"],
    "food": ["singkong", "jahe", "ikan asin", "pepaya", "kacang hijau", "tempe"],
    "illness": ["flu", "asam urat", "sakit gigi", "demam berdarah"],
    "prize": ["sepeda motor", "pulsa", "uang tunai"],
}


def synthetic(spark: SparkSession, n: int, seed: int = 42, hoax: list[str] = HOAX_TEMPLATES, valid: list[str] = VALID_TEMPLATES) -> DataFrame:
    """(id, content, label): n // 2 hoax records and the rest valid, templates and fillings drawn by id (O-SRC10, O-SRC11).

    Deterministic by design; made on the executors.
    """

    def pick(values: list[str], salt: int) -> Column:
        mixed = F.pmod(F.col("id") * 2654435761 + (seed * 97 + salt) * 40503, F.lit(1 << 31))
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.floor(mixed / 64), F.lit(len(values))) + 1).cast("int"))

    label = F.when(F.col("id") < n // 2, 1).otherwise(0)
    text = F.when(label == 1, pick(hoax, 1)).otherwise(pick(valid, 2))
    for k, (slot, values) in enumerate(FILLINGS.items()):
        text = F.replace(text, F.lit("{" + slot + "}"), pick(values, 3 + k))
    return spark.range(n).select("id", text.alias("content"), label.alias("label"))
