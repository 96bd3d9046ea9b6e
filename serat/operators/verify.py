"""Checking claims against the graph (O-JN06..08, O-AGG05/06, O-DT06, O-VEC18, O-KG15)."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serat.functions import dates as D
from serat.functions import text as X
from serat.operators import graph as G
from serat.session import durable


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """O-VEC18: twice the matched characters over both lengths (Ratcliff and Obershelp), whatever the case."""
    return pd.Series([SequenceMatcher(None, x.lower(), y.lower()).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


#: Names of one side that a task compares with as many of the other.
CELL = 50_000
#: Classes of characters for the bounds: letters and digits of their own, the others by their code.
CLASSES = 48
#: Characters of a name that the bounds look at one by one; those behind them count as shared.
SEEN = 256
#: Wanted names of one batch.
BATCH = 256
#: One name in so many is compared first, where only the best pairs count: what they reach is the least for all others.
FIRST = 16


def _codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(class of each character + 1 by name and place, 0 behind the end; length of each name)."""
    length = np.array([len(n) for n in names], np.int64)
    seen = np.minimum(length, SEEN)
    k = np.frombuffer("".join(n[:SEEN] for n in names).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = np.where((k >= 97) & (k < 123), k - 97, np.where((k >= 48) & (k < 58), k - 22, 36 + k % 12)) + 1
    out = np.zeros((len(names), int(seen.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < seen[:, None]] = k
    return out, length


def _items(codes: np.ndarray) -> np.ndarray:
    """Each character as its class and how often the class stood before it in the name, as one number; -1 behind the end."""
    seen = np.zeros((len(codes), CLASSES + 1), np.int32)
    out = np.full(codes.shape, -1, np.int32)
    at = np.arange(len(codes))
    for j in range(codes.shape[1]):
        c = codes[:, j]
        out[:, j] = np.where(c > 0, seen[at, c] * CLASSES + c - 1, -1)
        seen[at, c] += 1
    return out


def _bits(items: np.ndarray, bit: np.ndarray, words: int, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a set of bits for each name, by word and name; the number of its characters without a bit)."""
    out, n = np.zeros((words, len(items)), np.uint64), np.zeros(len(items), np.int64)
    for j in range(items.shape[1]):
        b = np.where(items[:, j] >= 0, bit[items[:, j]], -1)
        n += b >= 0
        for k in range(words):
            own = (b >= 64 * k) & (b < 64 * k + 64)
            out[k] |= np.where(own, np.uint64(1) << np.where(own, b - 64 * k, 0).astype(np.uint64), np.uint64(0))
    return out, length - n


def _common(masks: np.ndarray, i: np.ndarray, codes: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The longest common subsequence of each pair of wanted name i, of at most 64 characters, and name j, by the bits of the wanted."""
    order = np.argsort(-length[j], kind="stable")
    i, j, n = i[order] * (CLASSES + 1), j[order], np.minimum(length[j[order]], SEEN)
    v, flat = np.full(len(i), ~np.uint64(0)), masks.ravel()
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k))  # those that have a character there
        u = v[:m] & flat[i[:m] + codes[j[:m], k]]
        v[:m] = (v[:m] + u) | (v[:m] - u)
    out = np.empty(len(i), np.int64)
    out[order] = np.bitwise_count(~v) + np.maximum(length[j] - SEEN, 0)
    return out


def _compared(wanted: list[str], least: np.ndarray, names: list[str], best: bool) -> Iterator[tuple[int, int, float]]:
    """(place of wanted, place of name, ratio) from the ``least`` of each wanted name on, or of each only the best.

    The ratio is bounded from above twice, first by the characters that two names share, which are one set of bits a
    name, so that a pair costs a few nanoseconds; then, where that passes, by their longest common subsequence.  A pair
    is compared only if both pass, for the best in order of the bound, until it falls below what is found.
    """
    codes, length = _codes(names)
    order = np.argsort(length, kind="stable")
    codes, length = codes[order], length[order]
    items = _items(codes)
    # the most frequent characters get a bit; as many words as leave half a character a name without one
    often = np.sort(np.bincount(items[items >= 0], minlength=1))[::-1]
    words = next((k for k in (1, 2) if often[64 * k :].sum() <= len(names) / 2), 3)
    ranked = np.argsort(-np.bincount(items[items >= 0], minlength=1), kind="stable")[: 64 * words]
    bit = np.full(CLASSES * (SEEN + 1), -1, np.int64)
    bit[ranked] = np.arange(len(ranked))
    bits, _ = _bits(items, bit, words, length)
    sizes, starts = np.unique(length, return_index=True)
    ends = np.append(starts[1:], len(length))
    matcher = SequenceMatcher(None)
    by_length = sorted(range(len(wanted)), key=lambda i: (len(wanted[i]), least[i]))
    for batch in (by_length[k : k + BATCH] for k in range(0, len(by_length), BATCH)):
        texts = [wanted[i] for i in batch]
        own, size = _codes(texts)
        sets, rest = _bits(_items(own), bit, words, size)
        masks = np.zeros((len(batch), CLASSES + 1), np.uint64)
        for k in range(min(own.shape[1], 64)):
            masks[np.arange(len(batch)), own[:, k]] |= np.uint64(1 << k)
        masks[:, 0] = 0
        near: list[np.ndarray] = []
        last, lo, hi, need = None, 0, 0, None
        for x, i in enumerate(batch):
            if last != (size[x], least[i], rest[x]):
                last = (size[x], least[i], rest[x])
                fit = np.flatnonzero(2 * np.minimum(sizes, size[x]) >= (least[i] - 1e-9) * (sizes + size[x]))
                shared = np.ceil((least[i] - 1e-9) * (sizes[fit] + size[x]) / 2) - rest[x]
                need = np.repeat(np.clip(shared, 0, 255).astype(np.uint8), (ends - starts)[fit])
                lo, hi = (starts[fit[0]], ends[fit[-1]]) if len(fit) else (0, 0)
            n = np.bitwise_count(bits[0, lo:hi] & sets[0, x])
            for k in range(1, words):
                n += np.bitwise_count(bits[k, lo:hi] & sets[k, x])
            near.append(np.flatnonzero(n >= need) + lo)
        i = np.repeat(np.arange(len(batch)), [len(n) for n in near])
        j = np.concatenate(near)
        bound = np.ones(len(i))
        if len(short := np.flatnonzero(size[i] <= 64)):
            bound[short] = 2 * _common(masks, i[short], codes, j[short], length) / (size[i[short]] + length[j[short]])
        least_of = least[np.array(batch)][i]
        kept = np.flatnonzero(bound >= least_of - 1e-9)
        kept = kept[np.lexsort((-bound[kept], i[kept]))]
        top: dict[int, float] = {}
        found: dict[int, list[tuple[int, float]]] = {}
        for x, y, most in zip(i[kept].tolist(), j[kept].tolist(), bound[kept].tolist()):
            t = top.get(x, least[batch[x]])
            if best and most < t - 1e-9:
                continue
            w, name = texts[x], names[order[y]]
            matcher.set_seqs(w, name)
            r = matcher.ratio() if w != name else 1.0
            if r >= t:
                if best and r > t:
                    found[x] = []
                found.setdefault(x, []).append((int(order[y]), r))
                top[x] = r if best else t
        for x, pairs in found.items():
            for y, r in pairs:
                yield batch[x], y, r


def _cells(w: DataFrame, n: DataFrame, parts: list[int], best: bool) -> DataFrame:
    """(space, want, name, ratio) of (space, want, least) and (space, name), in cells by the hashes of both."""
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    w = w.select("space", "want", "least", own("want", parts[0]).alias("i"), every(parts[1]).alias("j"))
    n = n.select("space", "name", every(parts[0]).alias("i"), own("name", parts[1]).alias("j"))

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, y = a.sort_values("want"), sorted(b["name"])
        x = a["want"].tolist()
        pairs = _compared(x, a["least"].to_numpy(), y, best) if x and y else ()
        return pd.DataFrame([(key[0], x[i], y[j], r) for i, j, r in pairs], columns=["space", "want", "name", "ratio"])

    cells = max(int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts[0] * parts[1], 10_000))
    w, n = (d.repartition(cells, "space", "i", "j") for d in (w, n))
    return w.groupBy("space", "i", "j").cogroup(n.groupBy("space", "i", "j")).applyInPandas(run, "space string, want string, name string, ratio double")


def similar_names(wanted: DataFrame, names: DataFrame, least: float = 0.7, best: bool = False) -> DataFrame:
    """(space, want, name, ratio) of the pairs of names of one space whose ratio reaches ``least``, whatever their case.

    Both inputs are (space STRING, name STRING), or names of one space alone; a null space equals itself.  With ``best`` only the best pairs of each
    wanted name in its cell come out, of which the caller takes the best of all.  The ratio has no selective key: two
    similar names need not have three letters in a row in common.  So distinct names are divided into cells of about
    CELL by CELL names, by their hash, and each cell is bounded in blocks; no pair is a row before it has been compared.
    For the best of many names, one name in FIRST is compared before: its ratio is a least for all, so no cell begins
    from nothing.  Empty and null names match nothing.
    """
    both = lambda d: d if len(d.columns) == 2 else d.select(F.lit("").alias("space"), *d.columns)
    low = lambda d, c: both(d).toDF("space", "x").where("x <> ''").select(F.coalesce("space", F.lit("")).alias("space"), F.lower("x").alias(c)).distinct()
    w, n = durable(low(wanted, "want").withColumn("least", F.lit(float(least)))), durable(low(names, "name"))
    rows = [w.count(), n.count()]
    parts = [max(1, -(-k // CELL)) for k in rows]
    if best and parts[1] > 1:
        some = n.where(F.pmod(F.xxhash64("name", F.lit(FIRST)), F.lit(FIRST)) == 0)
        first = _cells(w, some, [parts[0], max(1, -(-rows[1] // (FIRST * CELL)))], best).groupBy("space", "want").agg(F.max("ratio").alias("reached"))
        w = durable(w.join(first, ["space", "want"], "left").select("space", "want", F.greatest("least", "reached").alias("least")))
    return _cells(w, n, parts, best)


def match_entities(claim_entities: DataFrame, nodes: DataFrame, least: float = 0.7) -> DataFrame:
    """``claim_entities`` (key, normalized, entity_type, ...) with node_key, match_status, match_confidence (O-JN06).

    The node of the key itself (1.0), else the most similar name or alias of the type, else of any type (times 0.8);
    the smaller key among equals.  Only what one step leaves enters the next.
    """
    keys = nodes.select(F.col("key").alias("node_key")).distinct()
    exact = claim_entities.join(keys, F.col("key") == F.col("node_key"), "left")
    rest = durable(exact.where("node_key is null").select("key", F.lower("normalized").alias("want"), "entity_type").distinct())
    names = nodes.select(F.col("key").alias("near_key"), F.col("entity_type").alias("space"), F.explode(F.array_union(F.array("normalized"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    names = durable(names.select("near_key", "space", F.lower("name").alias("name")).where("name <> ''").distinct())

    def nearest(rest: DataFrame, names: DataFrame, weight: float) -> DataFrame:
        """(k, near_key, near): the best node of each key."""
        near = similar_names(rest.select("space", "want"), names.select("space", "name"), least, best=True)
        found = rest.join(near, ["space", "want"]).join(names, ["space", "name"])
        top = F.min(F.struct((-F.col("ratio")).alias("neg"), "near_key")).alias("best")
        return durable(found.groupBy("key").agg(top).select(F.col("key").alias("k"), F.col("best.near_key").alias("near_key"), (F.lit(weight) * -F.col("best.neg")).alias("near")))

    typed = nearest(rest.withColumnRenamed("entity_type", "space"), names, 1.0)
    left = rest.join(typed.select(F.col("k").alias("key")), "key", "left_anti").withColumn("space", F.lit(""))
    any_ = nearest(left, names.select("near_key", F.lit("").alias("space"), "name").distinct(), 0.8)
    out = exact.join(typed.unionByName(any_), F.col("key") == F.col("k"), "left")
    status = F.when(F.col("node_key").isNotNull(), "VERIFIED").when(F.col("near_key").isNotNull(), "PARTIALLY_VERIFIED").otherwise("UNVERIFIED")
    sure = F.when(F.col("node_key").isNotNull(), 1.0).otherwise(F.coalesce("near", F.lit(0.0)))
    return out.withColumns({"match_status": status, "match_confidence": sure, "node_key": F.coalesce("node_key", "near_key")}).drop("k", "near", "near_key")


def match_relations(claimed: DataFrame, edges: DataFrame) -> DataFrame:
    """``claimed`` (source, predicate, target) with relation_status, relation_confidence (O-JN07).

    The edge of the kind: VERIFIED with its confidence; of another: CONTRADICTED, 0.3; a path of at most two edges:
    PARTIALLY_VERIFIED, 0.5; else UNVERIFIED, 0.  Only the ends of claimed pairs enter the two-hop join.
    """
    e = edges.select("source", "target", "relation_type", "confidence")
    pairs = claimed.select("source", "target").distinct()
    paths = G.shortest_paths(e, pairs, 2).select("source", "target", F.lit(True).alias("near"))
    out = claimed.join(e, ["source", "target"], "left").join(paths, ["source", "target"], "left")
    same = F.col("relation_type") == F.col("predicate")
    status = F.when(same, "VERIFIED").when(F.col("relation_type").isNotNull(), "CONTRADICTED").when(F.col("near"), "PARTIALLY_VERIFIED").otherwise("UNVERIFIED")
    sure = F.when(same, F.col("confidence")).when(F.col("relation_type").isNotNull(), 0.3).when(F.col("near"), 0.5).otherwise(0.0)
    return out.withColumns({"relation_status": status, "relation_confidence": sure}).drop("relation_type", "confidence", "near")


def match_dates(claim_temporals: DataFrame, matched: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every temporal of a claim against every matched entity of it (O-JN08), by the node's start (O-DT06).

    Nodes without marks: UNVERIFIED, 0.5.
    """
    marks = nodes.select(F.col("key").alias("node_key"), "temporal_start", "temporal_end")
    j = claim_temporals.select("coll", "doc", "normalized_start").join(matched.where("node_key is not null").select("coll", "doc", "node_key"), ["coll", "doc"]).join(marks, "node_key")
    empty = (F.coalesce("temporal_start", F.lit("")) == "") & (F.coalesce("temporal_end", F.lit("")) == "")
    start = F.when(F.col("temporal_start") != "", F.substring("temporal_start", 1, 10))
    v = D.date_verdict(F.substring("normalized_start", 1, 10), start)
    v = F.when(empty, F.struct(F.lit("UNVERIFIED").alias("status"), F.lit(0.5).alias("confidence"))).otherwise(v)
    return j.select("coll", "doc", "node_key", "normalized_start", v["status"].alias("date_status"), v["confidence"].alias("date_confidence"))


def claim_verdict(items: Column, verified: Column, hallucinations: Column) -> Column:
    """O-AGG06: struct(status, confidence) of the counts, in this order of precedence."""
    pair = lambda s, c: F.struct(F.lit(s).alias("status"), c.cast("double").alias("confidence"))
    return (
        F.when(items == 0, pair("UNVERIFIED", F.lit(0.5)))
        .when(hallucinations > 0, pair("HALLUCINATION", F.lit(0.2)))
        .when(verified == items, pair("VERIFIED", F.lit(0.9)))
        .when(verified > 0, pair("PARTIALLY_VERIFIED", verified / items))
        .otherwise(pair("UNVERIFIED", F.lit(0.3)))
    )


def verify_claims(claims: DataFrame, matched: DataFrame, relations: DataFrame, dates: DataFrame) -> DataFrame:
    """(coll, doc, status, confidence, hallucination_type, n_verified, n_unverified, n_hallucinations, suggestions, explanation) (O-KG15).

    ``claims`` (coll, doc, text); ``matched``, ``relations`` and ``dates`` as from the three matchers, the latter two
    only of resolved entities.  Claims of fewer than 10 characters: UNVERIFIED, 0.
    """
    bad = (F.col("match_status") == "UNVERIFIED") & F.col("entity_type").isin("PERSON", "ORGANIZATION")
    missing = F.col("match_status") == "UNVERIFIED"
    first3 = F.slice(F.transform(F.array_sort(F.collect_list(F.when(missing, F.struct("pos", "normalized")))), lambda x: x["normalized"]), 1, 3)
    e = matched.groupBy("coll", "doc").agg(F.count("*").alias("ne"), F.count_if(~missing).alias("ve"), F.count_if(bad).alias("he"), first3.alias("names"))
    r = relations.groupBy("coll", "doc").agg(F.count("*").alias("nr"), F.count_if(F.col("relation_status") == "VERIFIED").alias("vr"), F.count_if(F.col("relation_status") == "CONTRADICTED").alias("hr"))
    d = dates.groupBy("coll", "doc").agg(F.count_if(F.col("date_status") == "CONTRADICTED").alias("hd"))
    out = claims.join(e, ["coll", "doc"], "left").join(r, ["coll", "doc"], "left").join(d, ["coll", "doc"], "left").na.fill(0, ["ne", "ve", "he", "nr", "vr", "hr", "hd"])
    total, verified, wrong = F.col("ne") + F.col("nr"), F.col("ve") + F.col("vr"), F.col("he") + F.col("hr") + F.col("hd")
    short = ~X.long_enough(F.col("text"), 10)
    v = F.when(short, F.struct(F.lit("UNVERIFIED").alias("status"), F.lit(0.0).alias("confidence"))).otherwise(claim_verdict(total, verified, wrong))
    kind = F.when(F.col("he") > 0, "ENTITY_FABRICATION").when(F.col("hr") > 0, "RELATION_FABRICATION").when(F.col("hd") > 0, "TEMPORAL_ERROR")
    hints = F.array_compact(F.array(F.when(F.size("names") > 0, F.concat(F.lit("Verify entities: "), F.array_join("names", ", "))), F.when(F.col("hd") > 0, F.lit("Check dates"))))
    said = lambda n, w: F.when(n > 0, F.concat(n.cast("string"), F.lit(w)))
    why = F.concat_ws("; ", said(F.col("ve"), " entities verified"), said(F.col("ne") - F.col("ve"), " entities unverified"), said(wrong, " potential hallucinations"))
    return out.select(
        "coll", "doc", v["status"].alias("status"), v["confidence"].alias("confidence"), kind.alias("hallucination_type"), F.col("ve").alias("n_verified"), (F.col("ne") - F.col("ve")).alias("n_unverified"),
        wrong.alias("n_hallucinations"), hints.alias("suggestions"), F.when(short, "Claim too short to verify").otherwise(why).alias("explanation"),
    )


def summary_verdict(results: DataFrame, by: str = "summary_id") -> DataFrame:
    """(by, claims, verified, hallucinations, rate, confidence, status) of claim results (O-AGG05)."""
    n = lambda s: F.count_if(F.col("status") == s)
    a = results.groupBy(by).agg(
        F.count("*").alias("claims"), n("VERIFIED").alias("verified"), n("PARTIALLY_VERIFIED").alias("partial"), n("HALLUCINATION").alias("hallucinations"), n("CONTRADICTED").alias("contradicted"), F.avg("confidence").alias("confidence")
    )
    rate = F.col("verified") / F.col("claims")
    status = (
        F.when(F.col("hallucinations") > 0.3 * F.col("claims"), "HALLUCINATION").when(rate >= 0.8, "VERIFIED").when(rate >= 0.5, "PARTIALLY_VERIFIED").when(F.col("contradicted") > 0, "CONTRADICTED").otherwise("UNVERIFIED")
    )
    return a.select(by, "claims", "verified", "hallucinations", rate.alias("rate"), "confidence", status.alias("status"))


#: Distinct first four letters of names that are sent to all texts: some 100 MB in a worker at most.
BEGINNINGS = 500_000


def known_entities(texts: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """(id BIGINT, key): up to ``most`` nodes of which a name of more than 3 characters occurs in the text (O-FLT11, O-JN16).

    Where four letters of a text begin some name, the pieces of the text as long as such names are travel to an
    equi-join with the names; the text itself doesn't.  The most mentioned first, then the smaller key.
    """
    names = nodes.select("key", "mentions", F.explode(F.array_union(F.array("normalized"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("length(name) > 3")
    names = durable(names.select("key", "mentions", F.lower("name").alias("name"), F.lower(F.substring("name", 1, 4)).alias("g")).distinct())
    lengths = durable(names.groupBy("g").agg(F.collect_set(F.length("name")).alias("lengths")))
    # the beginnings of names are sent to the texts if they are few; else every place of a text travels to them
    few = lengths.count() <= BEGINNINGS
    begins = texts.sparkSession.sparkContext.broadcast({r.g: r.lengths for r in lengths.collect()} if few else {})
    reach = 0 if few else lengths.agg(F.max(F.array_max("lengths"))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = begins.value
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = range(len(t) - 3)
                pieces = list({t[k : k + n] for k in at if (ns := known.get(t[k : k + 4])) for n in ns} if few else {t[k : k + reach] for k in at})
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(pieces), pa.int64()), pa.array(pieces, pa.string())], ["id", "name"])

    lower = texts.toDF("id", "text").where("length(text) > 3").select(F.col("id").cast("long").alias("id"), F.lower("text").alias("low"))
    pieces = lower.mapInArrow(run, "id long, name string")
    if not few:
        pieces = pieces.withColumn("g", F.substring("name", 1, 4)).join(lengths, "g").select("id", "name", F.explode("lengths").alias("n"))
        pieces = pieces.select("id", F.substr("name", F.lit(1), F.col("n")).alias("name")).distinct()
    hits = pieces.join(names, "name").select("id", "key", "mentions").distinct()
    w = Window.partitionBy("id").orderBy(F.col("mentions").desc(), "key")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("id", "key")
