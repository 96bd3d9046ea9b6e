"""The knowledge graph as node, edge and history tables, and queries over it (O-FLD03/04, O-KG01..09, O-JN12..15, O-SET03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of relation kinds of which one pair of entities can't have both (O-SET03).
CONTRARY = [("SUPPORTS", "OPPOSES"), ("CAUSES", "PREVENTS"), ("BEFORE", "AFTER")]
#: Documents of one block of an edge's history; blocks are folded in parallel.
BLOCK = 10_000


def node_inputs(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(coll, key, doc, phase, pos, normalized, entity_type, text, confidence, language, start, end): mentions and relation endpoints.

    ``mentions`` may carry ``temporal``, the association of its entity in its document; endpoints bring none.
    """
    none = F.lit(None).cast("string")
    m = mentions.select(
        "coll", "key", "doc", F.lit(0).alias("phase"), F.col("pos").cast("long").alias("pos"), "normalized", "entity_type", "text", "confidence", "language",
        F.col("temporal.normalized_start").alias("start"), F.col("temporal.normalized_end").alias("end"),
    )

    def ends(side: str, n: int) -> DataFrame:
        key = F.concat_ws(":", f"{side}_type", f"{side}_norm")
        return relations.select(
            "coll", key.alias("key"), "doc", F.lit(1).alias("phase"), (F.col("emit_idx").cast("long") * 2 + n).alias("pos"), F.col(f"{side}_norm").alias("normalized"),
            F.col(f"{side}_type").alias("entity_type"), F.col(f"{side}_text").alias("text"), F.col(f"{side}_confidence").alias("confidence"), "language", none.alias("start"), none.alias("end"),
        )

    return m.unionByName(ends("subj", 0)).unionByName(ends("obj", 1))


def build_nodes(inputs: DataFrame) -> DataFrame:
    """(coll, key, normalized, entity_type, confidence, mentions, source_docs, aliases, temporal_start, temporal_end, language).

    The upsert's running mean is the mean, its marks are minimum and maximum as strings (an empty start of a duration
    is the smallest), and the first mention gives the language (O-FLD03), the smaller one among mentions of one place.
    Aggregated before the shuffle.
    """
    seq = F.struct("doc", "phase", "pos", "language")
    return inputs.groupBy("coll", "key", "normalized", "entity_type").agg(
        F.avg("confidence").alias("confidence"),
        F.count("*").alias("mentions"),
        F.array_sort(F.collect_set("doc")).alias("source_docs"),
        F.array_sort(F.collect_set("text")).alias("aliases"),
        F.min("start").alias("temporal_start"),
        F.max("end").alias("temporal_end"),
        F.min_by("language", seq).alias("language"),
    )


def build_edges(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """(coll, source, target, relation_type, confidence, mentions, source_docs, evidence, temporal_anchor, source_sentence, replacements).

    ``log``: (coll, doc, seq, source, target, relation_type, confidence, evidence, temporal_anchor, source_sentence),
    applied in order of (doc, seq) (O-FLD04): the same kind adds to the edge, another replaces it only if it is
    strictly surer.  So the kind after any prefix is that of the earliest record with the prefix's greatest confidence;
    the edge's content comes from the last stretch of its final kind.  The prefix maximum is taken over blocks of
    documents first and then within each block, so that one pair's long history is no single task's.  Records of one
    (doc, seq) are in order of their confidence, kind, anchor and sentence; a null confidence is the least.
    """
    order = ["doc", "seq", "confidence", "relation_type", "temporal_anchor", "source_sentence"]
    # the smallest state is the surest record, the earliest of equals
    state = F.struct(F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("c"), "doc", "seq", F.col("relation_type").alias("t"))
    rows = log.withColumn("block", F.floor(F.col("doc") / block)).withColumn("state", state)
    pair = ["coll", "source", "target"]
    blocks = rows.groupBy(*pair, "block").agg(F.min("state").alias("top"))
    carry = F.min("top").over(Window.partitionBy(*pair).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    final = blocks.groupBy(*pair).agg(F.min("top").alias("final"))
    rows = rows.join(blocks.select(*pair, "block", carry.alias("carry")), [*pair, "block"]).join(final, pair)
    run = Window.partitionBy(*pair, "block").orderBy(*order)
    up_to = lambda end: F.min("state").over(run.rowsBetween(Window.unboundedPreceding, end))
    rows = rows.withColumn("now", F.least(up_to(0), "carry")).withColumn("was", F.least(up_to(-1), "carry"))
    at = F.struct(*order)
    bad = F.col("now.t") != F.col("final.t")
    turns = rows.groupBy(*pair).agg(F.max(F.when(bad, at)).alias("bad"), F.count_if(F.col("was.t") != F.col("now.t")).alias("replacements"))
    tail = rows.join(turns, pair).where(F.col("bad").isNull() | (at > F.col("bad"))).where(F.col("relation_type") == F.col("final.t"))
    first = tail.groupBy(*pair).agg(F.min(at).alias("first"))
    tail = tail.join(first, pair)
    part = F.slice(F.coalesce("evidence", F.array().cast("array<string>")), 1, F.when(at == F.col("first"), 3).otherwise(2))
    return tail.groupBy(*pair).agg(
        F.max("final.t").alias("relation_type"),
        F.max("confidence").alias("confidence"),
        F.count("*").alias("mentions"),
        F.array_sort(F.collect_set("doc")).alias("source_docs"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), part.alias("e")))), lambda x: x["e"])).alias("evidence"),
        F.min_by("temporal_anchor", at).alias("temporal_anchor"),
        F.min_by(F.substring("source_sentence", 1, 200), at).alias("source_sentence"),
        F.max("replacements").alias("replacements"),
    )


def relation_log(relations: DataFrame) -> DataFrame:
    """Relations as the history of edges."""
    key = lambda s: F.concat_ws(":", f"{s}_type", f"{s}_norm")
    return relations.select(
        "coll", "doc", F.col("emit_idx").alias("seq"), key("subj").alias("source"), key("obj").alias("target"), F.col("predicate").alias("relation_type"), "confidence", "evidence", "temporal_anchor", "source_sentence"
    )


def history(log: DataFrame) -> DataFrame:
    """(coll, relation_type, source, target): every kind a pair ever had, stored or not (O-KG05)."""
    return log.select("coll", "relation_type", "source", "target").distinct()


def node(nodes: DataFrame, key: str) -> DataFrame:
    """O-KG02: the node of a key in each collection; the filter reaches the scan of stored nodes."""
    return nodes.where(F.col("key") == key)


def nodes_by_type(nodes: DataFrame, entity_type: str) -> DataFrame:
    """O-JN13: all nodes of a type."""
    return nodes.where(F.col("entity_type") == entity_type)


def by_document(nodes: DataFrame) -> DataFrame:
    """O-KG09: (coll, doc, key), the index of documents."""
    return nodes.select("coll", F.explode("source_docs").alias("doc"), "key")


def by_time(nodes: DataFrame, start: str, end: str) -> DataFrame:
    """O-KG03: nodes whose marks lie in the range, compared as strings; no or empty start: not in it."""
    return nodes.where((F.col("temporal_start") != "") & (F.col("temporal_start") <= end) & (F.col("temporal_end").isNull() | (F.col("temporal_end") >= start)))


def match_triples(edges: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """O-KG04: edges whose keys contain the given parts and whose kind is the given one, whatever its case; empty: any."""
    if subject:
        edges = edges.where(F.col("source").contains(subject))
    if obj:
        edges = edges.where(F.col("target").contains(obj))
    if predicate:
        edges = edges.where(F.upper("relation_type") == predicate.upper())
    return edges


def edges_of(edges: DataFrame, key: str, direction: str = "both") -> DataFrame:
    """O-JN12: edges out of, into, or at a node, with ``direction``; a loop comes twice for "both"."""
    out = edges.where(F.col("source") == key).withColumn("direction", F.lit("out"))
    into = edges.where(F.col("target") == key).withColumn("direction", F.lit("in"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def edges_by_kind(edges: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """O-JN14: the present edges of pairs that ever had the kind; their present kind may be another."""
    return edges.join(history(log).where(F.col("relation_type") == kind).select("coll", "source", "target"), ["coll", "source", "target"], "left_semi")


def conflicts(nodes: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """(coll, kind, severity, source, target, first, second): contrary relations and impossible orders in time (O-KG08)."""
    h = history(log)
    out = []
    for a, b in CONTRARY:
        both = h.where(F.col("relation_type") == a).select("coll", "source", "target").intersect(h.where(F.col("relation_type") == b).select("coll", "source", "target"))
        out.append(both.select("coll", F.lit("contradiction").alias("kind"), F.lit("HIGH").alias("severity"), "source", "target", F.lit(a).alias("first"), F.lit(b).alias("second")))
    s = nodes.select("coll", F.col("key").alias("source"), F.col("temporal_end").alias("first"))
    t = nodes.select("coll", F.col("key").alias("target"), F.col("temporal_start").alias("second"))
    late = edges.select("coll", "source", "target", "relation_type").join(s, ["coll", "source"]).join(t, ["coll", "target"])
    late = late.where("first <> '' and second <> '' and first < second")
    out.append(late.select("coll", F.lit("temporal_impossibility").alias("kind"), F.lit("MEDIUM").alias("severity"), "source", "target", "first", "second"))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_length: int = 3) -> DataFrame:
    """(source, target, path): the shortest directed path of at most ``max_length`` edges for each (source, target), if any (O-KG06).

    Breadth first for all pairs at once: a step keeps one path a pair and node reached, the first in alphabetical
    order, so nothing multiplies.  A pair of equal nodes has a path of that node alone.
    """
    e = edges.select(F.col("source").alias("at"), F.col("target").alias("next")).distinct()
    front = pairs.toDF("source", "target").distinct().select("source", "target", F.col("source").alias("at"), F.array("source").alias("path"))
    reached = front
    for _ in range(max_length):
        step = front.where("at <> target").join(e, "at").select("source", "target", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        front = step.groupBy("source", "target", "at").agg(F.min("path").alias("path")).join(reached.select("source", "target", "at"), ["source", "target", "at"], "left_anti")
        reached = reached.unionByName(front)
    return reached.where("at = target").select("source", "target", "path")


def neighbourhood(edges: DataFrame, key: str, depth: int = 1) -> DataFrame:
    """Edges between the nodes at most ``depth`` steps from a node, whatever their direction (O-KG07)."""
    spark = edges.sparkSession
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("next")).union(edges.select("target", "source")).distinct()
    near = spark.createDataFrame([(key,)], "node string")
    for _ in range(depth):
        near = near.union(near.join(both, "node").select("next")).distinct()
    return edges.join(near.toDF("source"), "source", "left_semi").join(near.toDF("target"), "target", "left_semi")


def count_by_type(nodes: DataFrame) -> DataFrame:
    """O-AGG07."""
    return nodes.groupBy("entity_type").agg(F.count("*").alias("nodes"), F.sum("mentions").alias("mentions"))


def top_facts(nodes: DataFrame, edges: DataFrame, entities: int = 10, each: int = 3, cap: int = 30) -> DataFrame:
    """(rank, source, relation_type, target): relations out of the most mentioned nodes (O-TOP02), capped as a report is."""
    top = nodes.orderBy(F.col("mentions").desc(), "key").limit(entities).select(F.col("key").alias("source"), F.col("mentions").alias("weight"))
    w = Window.partitionBy("source").orderBy("target")
    facts = edges.join(F.broadcast(top), "source").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)
    facts = facts.orderBy(F.col("weight").desc(), "source", "r").limit(cap)
    return facts.select(F.row_number().over(Window.orderBy(F.col("weight").desc(), "source", "r")).alias("rank"), "source", "relation_type", "target")


def to_json(nodes: DataFrame, edges: DataFrame, name: str = "graph") -> DataFrame:
    """One row a node or edge as JSON (O-SNK04): ``kind``, ``body``; sets as sorted arrays."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*nodes.columns)).alias("body"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*edges.columns)).alias("body"))).withColumn("name", F.lit(name))


def from_json(rows: DataFrame, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``to_json`` rows (O-SRC14); all indexes follow from the tables."""
    read = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("body", schema).alias("r")).select("r.*")
    return read("node", node_schema), read("edge", edge_schema)


def key_of(entity_type: Column, normalized: Column) -> Column:
    return F.concat_ws(":", entity_type, normalized)


def document_counts(docs: DataFrame, mentions: DataFrame, relations: DataFrame, temporals: DataFrame) -> DataFrame:
    """(coll, doc, entities, relations, temporals) for every document (O-AGG08), 0 where there are none."""
    out = docs.select("coll", "doc")
    for name, df in (("entities", mentions), ("relations", relations), ("temporals", temporals)):
        out = out.join(df.groupBy("coll", "doc").agg(F.count("*").alias(name)), ["coll", "doc"], "left")
    return out.na.fill(0)


def grounded_facts(topics: DataFrame, matched: DataFrame, edges: DataFrame, each: int = 5, cap: int = 20) -> DataFrame:
    """(i, source, relation_type, target): relations of the nodes that topics mean (O-TOP03).

    ``topics``: (i, key) in order; ``matched``: (key, node_key) as from ``verify.match_entities``.  At most ``each`` a
    topic; topics are taken in order until ``cap`` facts are reached, the last one whole.
    """
    at = topics.join(matched.where("node_key is not null").select("key", "node_key").distinct(), "key")
    both = edges.select("source", "relation_type", "target", F.col("source").alias("node_key")).union(edges.select("source", "relation_type", "target", F.col("target").alias("node_key")))
    w = Window.partitionBy("i").orderBy("source", "target", "relation_type")
    facts = at.join(both, "node_key").withColumn("r", F.row_number().over(w)).where(F.col("r") <= each)
    n = facts.groupBy("i").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a topic
    open_ = n.select("i", before.alias("before")).where(F.col("before") < cap)
    return facts.join(open_.select("i"), "i").select("i", "source", "relation_type", "target")


def fact_context(facts: DataFrame) -> DataFrame:
    """(coll, text): numbered facts (coll, i, source, relation_type, target), one a line (O-STR15); none: no row."""
    from serat.functions.text import fact_line

    line = fact_line(F.col("i"), F.col("source"), F.col("relation_type"), F.col("target"))
    return facts.groupBy("coll").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def triples(edges: DataFrame) -> DataFrame:
    """O-KG13."""
    return edges.select("coll", F.col("source").alias("subject"), F.col("relation_type").alias("predicate"), F.col("target").alias("object"))


def by_date(nodes: DataFrame) -> DataFrame:
    """(day, key): the days on which nodes begin (O-KG09)."""
    return nodes.where("temporal_start <> ''").select(F.substring("temporal_start", 1, 10).alias("day"), "key").distinct()
