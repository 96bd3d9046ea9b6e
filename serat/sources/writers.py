"""Writing data sets, reports, graphs and stores (O-SNK01..07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """O-SNK01, O-SNK02: with a header, quotes doubled, white space kept."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """O-SNK03..05: one object a line."""
    df.write.mode("overwrite").json(path)


def append_store(df: DataFrame, path: str) -> None:
    """O-SNK06: new entries as new files of the store."""
    df.write.mode("append").parquet(path)


def cut(c: Column, n: int, mark: str = "...") -> Column:
    """The first n characters, with a mark if there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


#: What a report keeps of each column (O-SNK07): characters, or elements of a list; numbers have four places.
REPORT = {"claim": 200, "explanation": 300, "suggestions": 3, "evidence": 3, "source_sentence": 200, "description": 100}


def as_report(df: DataFrame) -> DataFrame:
    """O-SNK07: the columns as a result dictionary has them."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            out[name] = F.round(c, 4)
        elif name in REPORT:
            out[name] = F.slice(c, 1, REPORT[name]) if kind.startswith("array") else F.substring(c, 1, REPORT[name])
        elif name == "preview":
            out[name] = cut(c, 100)
    return df.withColumns(out)
