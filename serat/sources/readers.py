"""Reading collections, labelled files and stores (O-SRC01..17)."""

from __future__ import annotations

import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serat.functions import text as X

JSON_KEYS = ["documents", "docs", "texts", "articles", "content"]
JSONL_KEYS = ["text", "content", "body", "article"]
DEMO = [
    "Menteri Kesehatan mengumumkan program vaksinasi baru pada 15 Januari 2024.",
    "Program vaksinasi itu menjangkau 5 juta warga di Jakarta.",
    "Gubernur mendukung program vaksinasi pemerintah pusat.",
    "Pada Maret 2024 pemerintah menambah anggaran Rp 150 miliar.",
    "Universitas Indonesia meneliti dampak program itu.",
    "Resep rendang terenak sedunia menurut para juru masak.",
]
DEFAULT_CONFIG = {"threshold": 0.5, "batch_size": 8, "max_length": 256}


def _file_system(spark: SparkSession, path: str):
    """The path and the file system it lies in, whichever that is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _file_system(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder, by name."""
    p, fs = _file_system(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_idx, text) of a JSON, JSONL or text file by its extension (O-SRC01..03).

    JSON: a list, or an object with the list under the first known key; anything else is an error when it is read.  JSONL: strings, or objects
    with the text under the first known key present; others and blank lines are dropped.  Other files: parts between
    blank lines.  A missing file is an error when the plan is made (O-SRC04).
    """
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{k}", "array<variant>") for k in JSON_KEYS])
        items = F.coalesce(items, F.raise_error(F.lit(f"JSON must be a list or have one of the keys {JSON_KEYS}")).cast("array<variant>"))
        each = raw.select(F.posexplode(items).alias("doc_idx", "v"))
        return each.select("doc_idx", F.coalesce(F.try_variant_get("v", "$", "string"), F.col("v").cast("string")).alias("text"))
    if path.endswith(".jsonl"):
        raw = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_idx"), F.try_parse_json("value").alias("v"))
        string = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
        return raw.select("doc_idx", F.coalesce(string, *[F.try_variant_get("v", f"$.{k}", "string") for k in JSONL_KEYS]).alias("text")).where("text is not null")
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.split("value", "\n\n")).alias("doc_idx", "text")).select("doc_idx", X.strip(F.col("text")).alias("text")).where("text <> ''")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A labelled file by its extension (O-SRC05): JSON, CSV, Parquet.  Spreadsheets have no built-in source: convert them."""
    kind = os.path.splitext(path)[1]
    if kind == ".json":
        return spark.read.option("multiLine", True).json(path)
    if kind == ".csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file: {path}")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """All supported files of a folder by column name (O-SRC06, O-SET02); none: ValueError."""
    files = [p for p in listed(spark, path) if os.path.splitext(p)[1] in (".csv", ".parquet", ".json")]
    if not files:
        raise ValueError(f"no supported file in {path}")
    out = read_table(spark, files[0])
    for p in files[1:]:
        out = out.unionByName(read_table(spark, p), allowMissingColumns=True)
    return out


def read_titles(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """(file, title) of the CSV files that exist and have one of the columns (O-SRC07, O-SRC08).

    Others, and those whose header can't be read, are passed over.
    """
    out = spark.createDataFrame([], "file string, title string")
    for p in paths:
        if not exists(spark, p):
            continue
        try:
            df = read_table(spark, p)
        except AnalysisException:
            continue
        if (c := next((c for c in columns if c in df.columns), None)) is not None:
            out = out.unionByName(df.select(F.lit(os.path.basename(p)).alias("file"), F.col(c).cast("string").alias("title")))
    return out


def available(spark: SparkSession, paths: dict[str, str]) -> dict[str, bool]:
    """O-SRC12."""
    return {name: exists(spark, p) for name, p in paths.items()}


def read_store(spark: SparkSession, path: str, schema: str = "vec_id bigint, text string, embedding array<float>, metadata map<string,string>") -> DataFrame:
    """A vector store, or an empty one where there is none (O-SRC15); one that can't be read is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def demo(spark: SparkSession) -> DataFrame:
    """O-SRC16: a small collection to try things on."""
    return spark.createDataFrame(list(enumerate(DEMO)), "doc_idx long, text string")


def read_config(path: str | None) -> dict:
    """O-SRC17: the settings of a JSON file over the defaults."""
    if path and os.path.exists(path):
        with open(path) as f:
            return DEFAULT_CONFIG | json.load(f)
    return dict(DEFAULT_CONFIG)
