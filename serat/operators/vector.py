"""TF-IDF, topic outliers, cosine pairs and vector search on long, sparse tables (O-VEC01..06, O-TOP05, O-AGG14)."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serat.functions import text as X
from serat.session import durable

#: A word of at least two letters, digits or underscores.
TOKEN = r"[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}"
MAX_FEATURES = 5000


def tokens(text: Column, stopwords: list[str]) -> Column:
    """Words without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(X.text(text)), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(stopwords))


def terms(words: Column) -> Column:
    """The words, and the pairs of neighbours among them."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b)))


def tfidf(docs: DataFrame, stopwords: list[str] = X.STOPWORDS_OUTLIER, max_df: float = 0.95, max_features: int = MAX_FEATURES) -> DataFrame:
    """(coll, doc, term, weight): L2-normalised weights of (coll, doc, text), each collection by itself.

    Terms of more than ``max_df`` of a collection's documents are dropped, then all but the ``max_features`` most
    frequent, ties in alphabetical order.  Counting is partial before the shuffle and the feature cap prunes map-side,
    so a collection that holds a third of all documents is no single task's.  Documents without a kept term have no rows.
    """
    docs = docs.toDF("coll", "doc", "text")
    # the words in a step of their own: the pairs read them several times
    words = docs.select("coll", "doc", tokens(F.col("text"), stopwords).alias("w"))
    tf = durable(words.select("coll", "doc", F.explode(terms(F.col("w"))).alias("term")).groupBy("coll", "doc", "term").agg(F.count("*").alias("tf")))
    n = docs.groupBy("coll").agg(F.count("*").alias("n"))
    stats = tf.groupBy("coll", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).join(n, "coll").where(F.col("df") <= F.lit(max_df) * F.col("n"))
    top = Window.partitionBy("coll").orderBy(F.col("cf").desc(), "term")
    kept = stats.withColumn("r", F.row_number().over(top)).where(F.col("r") <= max_features)
    kept = kept.select("coll", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(kept, ["coll", "term"]).select("coll", "doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy("coll", "doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, ["coll", "doc"]).select("coll", "doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def centroid_similarity(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(coll, doc, similarity): cosine to the mean vector; ``sizes`` (coll, n) counts documents without terms too."""
    centre = vectors.groupBy("coll", "term").agg(F.sum("weight").alias("c")).join(sizes, "coll").select("coll", "term", (F.col("c") / F.col("n")).alias("c"))
    length = centre.groupBy("coll").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("length"))
    dots = vectors.join(centre, ["coll", "term"]).groupBy("coll", "doc").agg(F.sum(F.col("weight") * F.col("c")).alias("dot"))
    return dots.join(length, "coll").select("coll", "doc", (F.col("dot") / F.col("length")).alias("similarity"))


def detect_outliers(docs: DataFrame, threshold: float = 2.0, least: int = 3) -> DataFrame:
    """(coll, doc, similarity, z_score, is_outlier) of (coll, doc, text) (O-VEC04, O-FLD10).

    Collections of fewer than ``least`` documents: similarity 1, z 0, no outlier.  Otherwise texts of at most 10
    characters are outliers (similarity 0, z -999, or z 0 if fewer than ``least`` are longer, which then stay without
    statistics: similarity 1).  z is over the collection's longer texts, by the population deviation, and an outlier
    has z < -threshold.  Null texts count as empty.  |z| can't pass sqrt(n - 1), so 2.0 needs six documents.
    """
    docs = docs.toDF("coll", "doc", "text").withColumn("valid", X.long_enough(F.col("text"), 11))
    sizes = docs.groupBy("coll").agg(F.count("*").alias("total"), F.count_if("valid").alias("n"))
    measured = docs.join(sizes.where((F.col("total") >= least) & (F.col("n") >= least)).select("coll"), "coll", "left_semi").where("valid").select("coll", "doc", "text")
    sims = measured.select("coll", "doc").join(centroid_similarity(durable(tfidf(measured)), sizes), ["coll", "doc"], "left").na.fill(0.0, ["similarity"])
    # statistics as a small aggregate, not as a window over a whole collection
    stats = sims.groupBy("coll").agg(F.avg("similarity").alias("mean"), F.stddev_pop("similarity").alias("dev"))
    z = (F.col("similarity") - F.col("mean")) / F.greatest("dev", F.lit(1e-6))
    scored = sims.join(stats, "coll").select("coll", "doc", "similarity", z.alias("z"))
    out = docs.select("coll", "doc", "valid").join(sizes, "coll").join(scored, ["coll", "doc"], "left")
    few, short = F.col("total") < least, ~F.col("valid")
    return out.select(
        "coll",
        "doc",
        F.when(few, 1.0).when(short, 0.0).otherwise(F.coalesce("similarity", F.lit(1.0))).alias("similarity"),
        F.when(few, 0.0).when(short & (F.col("n") >= least), -999.0).otherwise(F.coalesce("z", F.lit(0.0))).alias("z_score"),
        F.when(few, False).when(short, True).otherwise(F.coalesce(F.col("z") < -threshold, F.lit(False))).alias("is_outlier"),
    )


def cosine_pairs(vectors: DataFrame, least: float = 0.1) -> DataFrame:
    """(coll, i, j, similarity), i < j, of at least ``least``: an inverted-index join on the term (O-VEC03, O-VEC06).

    Meant for small collections (the sentences of a document); a large one goes through near-duplicate search instead.
    """
    a, b = vectors.toDF("coll", "i", "term", "wi"), vectors.toDF("coll", "j", "term", "wj")
    dots = a.join(b, ["coll", "term"]).where("i < j").groupBy("coll", "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("similarity"))
    return dots.where(F.col("similarity") >= least)


def _pairs(sentences: list[list[str]], least: float, max_features: int) -> Iterator[tuple[int, int, float]]:
    """(i, j, similarity) of the sentences of one document, given as words: as ``cosine_pairs`` over ``tfidf`` with max_df 1."""
    counts = [Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for w in sentences]
    df: Counter = Counter()
    for c in counts:
        df.update(c.keys())
    if len(df) > max_features:
        cf: Counter = Counter()
        for c in counts:
            cf.update(c)
        df = Counter({t: df[t] for t in sorted(df, key=lambda t: (-cf[t], t))[:max_features]})
    idf = {n: math.log((1 + len(counts)) / (1 + n)) + 1 for n in set(df.values())}
    behind: dict[str, list[tuple[int, float]]] = defaultdict(list)  # from the last sentence to the first
    for i in range(len(counts) - 1, -1, -1):
        square, met = 0.0, []
        for t, n in counts[i].items():
            if k := df.get(t):
                x = n * idf[k]
                square += x * x
                if k > 1:  # a term of one sentence meets no other
                    met.append((t, x))
        norm = math.sqrt(square)
        dots: dict[int, float] = defaultdict(float)
        for t, x in met:
            x /= norm
            for j, y in (others := behind[t]):
                dots[j] += x * y
            others.append((i, x))
        yield from ((i, j, dot) for j, dot in dots.items() if dot >= least)


def sentence_pairs(docs: DataFrame, stopwords: list[str] = X.STOPWORDS_RANKER, least: float = 0.1, max_features: int = MAX_FEATURES) -> DataFrame:
    """(coll, i, j, similarity), i < j: the sentences of each (coll, sentences ARRAY) that are alike, each row a collection of its own.

    The same pairs as ``cosine_pairs`` of ``tfidf`` over the sentences, but a document is whole in its row, so its terms
    stay in its task and nothing is shuffled.  Only rows that share their coll with others, which then are one
    collection, go through the joins; a null coll has no pairs.
    """
    docs = docs.toDF("coll", "sentences")
    many = durable(docs.groupBy("coll").agg(F.count("*").alias("n")).where("n > 1").select("coll"))
    own = docs.where("coll is not null")
    shared = None
    if not many.isEmpty():
        parts = own.join(many, "coll", "left_semi").select("coll", F.posexplode("sentences").alias("doc", "text"))
        shared = cosine_pairs(tfidf(parts, stopwords, 1.0, max_features), least)
        own = own.join(many, "coll", "left_anti")
    # a line a sentence: words hold no white space, and one string a document is cheap to hand over
    words = own.select("coll", F.array_join(F.transform("sentences", lambda t: F.array_join(tokens(t, stopwords), " ")), "\n").alias("w"))
    names = ["coll", "i", "j", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []

            def out() -> pa.RecordBatch:
                i, j, s = zip(*rows)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s, pa.float64())], names)

            for k in range(batch.num_rows):
                for pair in _pairs([line.split() for line in (batch.column(1)[k].as_py() or "").split("\n")], least, max_features):
                    at.append(k)
                    rows.append(pair)
                    if len(rows) == 50_000:
                        yield out()
                        at, rows = [], []
            if rows:
                yield out()

    found = words.mapInArrow(run, f"coll {docs.schema['coll'].dataType.simpleString()}, i int, j int, similarity double")
    return found if shared is None else found.unionByName(shared)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, null if one has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(vec_id, similarity): the k vectors most like the query, the smaller id first among equals (O-TOP05).

    A limit after an order keeps k rows a task before anything moves.
    """
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select("vec_id", cosine(F.col("embedding"), q).alias("similarity")).orderBy(F.col("similarity").desc_nulls_last(), "vec_id").limit(k)


def top_k_join(queries: DataFrame, vectors: DataFrame, k: int = 5, blocks: int = 16) -> DataFrame:
    """(query_id, vec_id, similarity, rank) for a stated query set against all vectors, in blocks.

    Each block of the vectors meets the queries once; the k best of a block are kept before the shuffle by query.
    """
    v = vectors.select("vec_id", "embedding", F.pmod("vec_id", F.lit(blocks)).cast("int").alias("block"))
    q = queries.select(F.col("query_id"), F.col("embedding").alias("q"), F.explode(F.array(*[F.lit(b) for b in range(blocks)])).alias("block"))
    sims = q.join(v, "block").select("query_id", "block", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("similarity"))
    order = [F.col("similarity").desc_nulls_last(), F.col("vec_id")]
    first = sims.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).where(F.col("r") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "vec_id", "similarity", "rank")


def mean_pool(tokens: DataFrame) -> DataFrame:
    """(doc, embedding): the mean of a document's token vectors (doc, pos, embedding) (O-VEC05); padding isn't given in.

    By place in the vector, aggregated before the shuffle.
    """
    each = tokens.select("doc", F.posexplode("embedding").alias("at", "v")).groupBy("doc", "at").agg(F.avg("v").alias("v"))
    packed = F.array_sort(F.collect_list(F.struct("at", "v")))  # as long as one vector
    return each.groupBy("doc").agg(F.transform(packed, lambda x: x["v"].cast("float")).alias("embedding"))
