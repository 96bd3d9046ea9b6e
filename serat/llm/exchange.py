"""Postings (key, document) sent to the task of their key as packed arrays instead of rows.

A posting is a 64-bit hash and a document.  As a row it costs some 20 bytes of shuffle; packed by task, with each
document's id and number once a chunk, it costs the 5 bytes of its hash that the task doesn't imply, and little more.
Two keys that agree in those bits and the task are one key: a false candidate, never a lost one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
KEY_BITS = 40
#: Postings a map task holds before it sends them: some 40 MB.
FLUSH = 1_000_000
SCHEMA = "part int, docs int, ids binary, info binary, counts binary, keys binary, rest binary"


@dataclass
class Postings:
    """Documents with how many keys each has, and the keys in order of the documents."""

    ids: np.ndarray  # int64 a document
    info: np.ndarray  # uint32 a document
    counts: np.ndarray  # keys of each document
    keys: np.ndarray  # uint64 a posting
    rest: np.ndarray | None  # uint16 a posting


def _small(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _large(b: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _pack(held: list[Postings], parts: int) -> Iterator[pa.RecordBatch]:
    ids, info, counts, keys = (np.concatenate([getattr(p, f) for p in held]) for f in ("ids", "info", "counts", "keys"))
    rest = None if held[0].rest is None else np.concatenate([p.rest for p in held])
    doc = np.repeat(np.arange(len(ids)), counts)
    part = ((keys >> U(KEY_BITS)) % U(parts)).astype(np.int64)
    at = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[at], np.arange(parts + 1))
    low = (keys & U((1 << KEY_BITS) - 1)).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
    for p in np.flatnonzero(np.diff(edge)):
        here = at[edge[p] : edge[p + 1]]
        of, n = np.unique(doc[here], return_counts=True)
        row = [int(p), len(of), _small(np.diff(ids[of], prepend=0)), _small(info[of].astype(np.uint32)), _small(n.astype(np.uint32)), low[here].tobytes(), b"" if rest is None else rest[here].tobytes()]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in SCHEMA.split(", ")])


def _routes(df: DataFrame, parts: int) -> list[int]:
    """For each of ``parts`` partitions an int that Spark's hash sends there."""
    ids = df.sparkSession.range(0, parts * 40, 1, 1).select(F.col("id").cast("int").alias("v"))
    rows = ids.groupBy(F.pmod(F.hash("v"), F.lit(parts)).alias("p")).agg(F.min("v").alias("v")).collect()  # one row a partition
    found = {r.p: r.v for r in rows}
    return [found.get(p, p) for p in range(parts)]


def send(df: DataFrame, make: Callable[[pa.RecordBatch], Iterable[Postings]], receive: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``receive(key, id, info, rest)`` over all postings of a task, as long keys, of what ``make`` gets from ``df``'s batches."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routes = pa.array(_routes(df, parts), pa.int32())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Postings] = []
        for batch in batches:
            for p in make(batch):
                if len(p.keys):
                    held.append(p)
                if sum(len(h.keys) for h in held) >= FLUSH:
                    yield from _routed(held)
                    held = []
        if held:
            yield from _routed(held)

    def _routed(held: list[Postings]) -> Iterator[pa.RecordBatch]:
        for b in _pack(held, parts):
            yield pa.RecordBatch.from_arrays([routes.take(b.column(0)), *b.columns[1:]], b.schema.names)

    def into(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, info, rest = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                n = _large(r["counts"], np.uint32, r["docs"])
                wide = np.zeros((len(r["keys"]) * 8 // KEY_BITS, 8), np.uint8)
                wide[:, : KEY_BITS // 8] = np.frombuffer(r["keys"], np.uint8).reshape(-1, KEY_BITS // 8)
                # the partition's number makes keys unique over all tasks
                key.append(wide.view(np.int64)[:, 0] | r["part"] << KEY_BITS)
                ids.append(np.repeat(np.cumsum(_large(r["ids"], np.int64, r["docs"])), n))
                info.append(np.repeat(_large(r["info"], np.uint32, r["docs"]), n))
                rest.append(np.frombuffer(r["rest"], np.uint16))
        if key:
            yield from receive(np.concatenate(key), np.concatenate(ids), np.concatenate(info), np.concatenate(rest))

    return df.mapInArrow(out, SCHEMA).repartition(parts, "part").mapInArrow(into, schema)


def semi(df: DataFrame, ids: DataFrame, column: str, limit: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``column`` is among ``ids`` (written, distinct): by a broadcast of up to ``limit`` ids, else by a shuffle."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, column, "left_semi")
