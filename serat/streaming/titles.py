"""Changes of a window's title, and those with a keyword (O-STM01, O-FLD06), as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from serat.functions import text as X


def changes(titles: DataFrame, keywords: list[str] = X.WATCHED) -> DataFrame:
    """(key, ts, title) of (key, ts, seq, title) where the title isn't the one before and holds a keyword.

    The first title follows an empty one.  The state moves before the keyword is looked for: A, X, A gives A twice.
    Null titles count as empty.  The order within a key is (ts, seq).
    """
    now = X.text(F.col("title"))
    was = F.coalesce(F.lag(now).over(Window.partitionBy("key").orderBy("ts", "seq")), F.lit(""))
    rows = titles.withColumns({"title": now, "_was": was})
    return rows.where((F.col("title") != F.col("_was")) & X.contains_keyword(F.col("title"), keywords)).select("key", "ts", "title")


class _LastTitle(StatefulProcessor):
    """One value a key: the last title."""

    def __init__(self, keywords: list[str]) -> None:
        self.keywords = [k.lower() for k in keywords]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "title string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "seq"])
        last = self.last.get()[0] if self.last.exists() else ""
        out = []
        for ts, title in zip(frame["ts"], frame["title"].fillna("")):
            if title != last:
                last = title
                if any(k in title.lower() for k in self.keywords):
                    out.append((key[0], ts, title))
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["key", "ts", "title"])

    def close(self) -> None:
        pass


def change_stream(titles: DataFrame, keywords: list[str] = X.WATCHED) -> DataFrame:
    """The same over a stream of (key, ts, seq, title): rows of a micro-batch in order, the last title kept between them."""
    key = dict(titles.dtypes)["key"]
    return titles.groupBy("key").transformWithStateInPandas(_LastTitle(keywords), f"key {key}, ts timestamp, title string", "append", "none")


def start(titles: DataFrame, foreach, checkpoint: str, keywords: list[str] = X.WATCHED, every: str = "2 seconds"):
    """The query that hands each micro-batch of changes to ``foreach(df, epoch)``; needs the RocksDB state store."""
    return change_stream(titles, keywords).writeStream.foreachBatch(foreach).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
