"""Filling containers of fixed capacity with documents, by harmonic packing.

Lengths are divided into classes of multiples of the capacity's GRAIN-th part, the reciprocal classes of harmonic
packing.  A container opened for a class takes a fixed number of its documents (as many as fit by the class's upper
end) and then fixed numbers of documents of smaller classes for the room that is left, largest first; the plan is made
from the class counts of a shard alone.  Shards are drawn by a hash of the id and packed independently of each other,
so that no task sees more than about SHARD documents whatever lengths or sources are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAIN = 256
#: Documents a shard holds on average.
SHARD = 50_000


def plan_bins(sizes: np.ndarray, capacity: int, grain: int = GRAIN) -> np.ndarray:
    """The container of each item (0 < size <= capacity), numbered from 0."""
    unit = np.maximum(-(-sizes * grain // capacity), 1)  # class: size in grains, rounded up
    order = np.argsort(-unit, kind="stable")
    left = np.bincount(unit, minlength=grain + 1)
    start = np.zeros(grain + 2, np.int64)  # next item of each class in ``order``, which has the largest first
    counts = left[::-1].cumsum()[::-1]
    start[: grain + 1] = counts - left
    bins = np.empty(len(sizes), np.int64)
    used = 0
    for head in range(grain, 0, -1):
        while left[head]:
            # the pattern: how many of each class one container holds
            room, pattern = grain, []
            c = head
            while room and c:
                c = min(c, room)
                while c and not left[c]:
                    c -= 1
                if not c:
                    break
                n = min(room // c, int(left[c]))
                pattern.append((c, n))
                room -= n * c
                c -= 1
            times = min(int(left[c]) // n for c, n in pattern)
            for c, n in pattern:
                take = order[start[c] : start[c] + n * times]
                bins[take] = used + np.arange(n * times) // n
                start[c] += n * times
                left[c] -= n * times
            used += times
    return bins


def pack(sized: DataFrame, capacities: DataFrame, shard: int = SHARD) -> DataFrame:
    """(bin_kind, bin_id, id, piece_no, first_token, n_tokens): each piece of each document in one container of each kind.

    ``sized``: (id BIGINT unique, n_tokens BIGINT).  ``capacities``: (bin_kind STRING, capacity_tokens INT), a handful
    of rows.  A document no longer than the capacity is one piece; a longer one is cut into full containers and a
    rest, which is packed like any other.  Documents without tokens take no room and come out with a null ``bin_id``.
    Kinds with a null or non-positive capacity hold nothing and don't come out.  An empty table gives no rows.
    """
    kinds = [(r[0], int(r[1])) for r in capacities.toDF("k", "c").where("c > 0").collect()]
    sized = sized.toDF("id", "n").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    shards = max(1, -(-sized.count() // shard))

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        n = items["n"].to_numpy()
        out = []
        for k, (kind, capacity) in enumerate(kinds):
            full, rest = n // capacity, n % capacity
            # full containers first, then the rests
            at = np.repeat(np.arange(len(n)), full)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
            small = np.flatnonzero(rest)
            bins = np.concatenate((np.arange(len(at)), len(at) + plan_bins(rest[small], capacity) if len(small) else small))
            at, piece = np.concatenate((at, small)), np.concatenate((piece, full[small]))
            size = np.concatenate((np.full(len(piece) - len(small), capacity), rest[small]))
            frame = pd.DataFrame({"bin_kind": kind, "bin_id": pd.array(bins * shards + int(key[0]), "Int64"), "id": items["id"].to_numpy()[at], "piece_no": piece, "first_token": piece * capacity, "n_tokens": size})
            none = np.flatnonzero(n == 0)
            empty = pd.DataFrame({"bin_kind": kind, "bin_id": pd.array([None] * len(none), "Int64"), "id": items["id"].to_numpy()[none], "piece_no": 0, "first_token": 0, "n_tokens": 0})
            out.append(pd.concat((frame, empty)) if len(none) else frame)
        return pd.concat(out) if out else pd.DataFrame(columns=["bin_kind", "bin_id", "id", "piece_no", "first_token", "n_tokens"])

    drawn = sized.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return drawn.groupBy("shard").applyInPandas(run, "bin_kind string, bin_id long, id long, piece_no long, first_token long, n_tokens long")


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(bin_kind, capacity_tokens, bins, tokens, filled): how full the containers of each kind are."""
    caps = capacities.toDF("bin_kind", "capacity_tokens")
    each = packed.where("bin_id is not null").groupBy("bin_kind", "bin_id").agg(F.sum("n_tokens").alias("t"))
    total = each.groupBy("bin_kind").agg(F.count("*").alias("bins"), F.sum("t").alias("tokens"))
    return total.join(caps, "bin_kind").select("bin_kind", "capacity_tokens", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled"))
