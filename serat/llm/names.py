"""Variant spellings of persons' and organisations' names, linked to the entity they mean, by a trie join.

Names are parsed into a class (person, or an organisation's kind), a family token and a given token, spelling habits
evened out.  Two trie joins find typos: one over all family tokens, one over the given tokens that stand with a family
token.  Each shards its words by how they begin and by how they end (one edit can't touch both), builds a trie per
shard and walks it with the Levenshtein automaton of each word.  Both orders of the tokens are tried, and the one is
taken that other names support.  Short forms (initials, first letters, family name alone, organisations without their
kind) go to the only entity they fit; aliases decide for all that fit several or can't be read.

Joins are on hashes of class and tokens, distinct names before rows, so that a frequent name is one entry.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serat.operators.components import connected_components
from serat.session import durable

# Titles, degrees, kinds of organisations, and legal forms and seats that may follow an organisation's name.
TITLES = frozenset("pak bu bapak ibu prof professor dr drs dra ir h hj kh haji hajah ustad ustadz brigjen mayjen letjen jenderal kolonel mayor kapten saudara saudari sdr sdri tuan nyonya mr mrs ms".split())
NICK = frozenset("kak cak mas mbak bang cik mang neng".split())
DEGREES = frozenset("sh mh se mm st mt spd mpd msi ssi phd mba skom mkom sip sos ssos ma msc bsc ag sag stmt".split())
KINDS = {
    "bank": ["bank", "bk", "bnk"],
    "badan": ["badan", "bdn", "agency", "board"],
    "koperasi": ["koperasi", "kop", "cooperative", "coop"],
    "yayasan": ["yayasan", "yay", "yys", "foundation"],
    "lembaga": ["lembaga", "lemb", "lmbg", "institute", "institution"],
    "universitas": ["universitas", "univ", "university of", "university"],
    "partai": ["partai", "prt", "party"],
    "kementerian": ["kementerian", "kemen", "kmtr", "ministry of", "ministry"],
    "pt": ["pt", "p t", "perseroan terbatas", "limited company", "company", "corporation", "corp", "inc", "ltd"],
    "rumah sakit": ["rumah sakit", "rs", "r s", "rsu", "rsud", "hospital"],
}
ADDED = frozenset("pusat persero tbk ri indonesia".split())
_KIND_WORDS = sorted(((w.split(), k) for k, ws in KINDS.items() for w in ws), key=lambda x: -len(x[0]))


def even(token: str) -> str:
    """A token with spelling habits evened out: look-alike digits, old spellings, doubled letters."""
    t = token.replace("0", "o").replace("1", "l")
    for a, b in (("oe", "u"), ("dj", "j"), ("tj", "c"), ("sy", "s"), ("sj", "s"), ("kh", "k"), ("ph", "f")):
        t = t.replace(a, b)
    t = re.sub(r"y(?![aeiou])", "i", t)
    return re.sub(r"(.)\1+", r"\1", t)


def _kind(tokens: list[str]) -> tuple[str | None, list[str]]:
    for words, kind in _KIND_WORDS:
        n = len(words)
        if len(tokens) > n and tokens[:n] == words:
            return kind, tokens[n:]
        if len(tokens) > n and tokens[-n:] == words:
            return kind, tokens[:-n]
    # a kind with one typing error
    for words, kind in _KIND_WORDS:
        if len(words) == 1 and len(words[0]) >= 5 and len(tokens) > 1:
            if within_one(tokens[0], words[0]):
                return kind, tokens[1:]
            if within_one(tokens[-1], words[0]):
                return kind, tokens[:-1]
    return None, tokens


def parse(name: str | None, entity_type: str | None) -> tuple[str, list[str]]:
    """(class, tokens): class "P", "O:kind", "O?" (no kind) or "" (neither); tokens in the order given, family last."""
    s = unicodedata.normalize("NFKC", name or "")
    s = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", s) if not re.search(r"\b[A-Z][a-z]\.", s) else s
    s = re.sub(r"[()]", " ", s).lower()
    parts = [re.findall(r"[^\W_]+(?:\.[^\W_]+)*", p) for p in s.split(",")]
    glued = lambda t: t.replace(".", "")
    if entity_type not in ("PERSON", "ORGANIZATION", "UNKNOWN", None):
        return "", []
    flat = [x for p in parts for t in p for x in ([t.replace(".", "")] if t.count(".") and glued(t) in {"pt", "rs", "rsu"} else t.split("."))]
    if entity_type != "PERSON":
        kind, rest = _kind(flat)
        if kind:
            rest = [even(t) for t in rest]
            core = [t for t in rest if t not in ADDED]
            return f"O:{kind}", core if len(core) >= 2 else rest
    if entity_type == "ORGANIZATION":
        rest = [even(t) for t in flat]
        core = [t for t in rest if t not in ADDED]
        return "O?", core if len(core) >= 2 else rest
    parts = [[t for t in p if glued(t) not in DEGREES or len(glued(t)) < 2] if i or len(p) > 2 else p for i, p in enumerate(parts)]
    parts = [p for p in parts if p]
    tokens = [x for p in [*parts[1:], *parts[:1]] for t in p for x in t.split(".")]
    nick = False
    while len(tokens) > 1 and (tokens[0] in NICK or tokens[0] in TITLES and (len(tokens[0]) > 1 or len(tokens) > 2)):
        nick |= tokens[0] in NICK
        tokens = tokens[1:]
    return ("" if nick else "P"), [even(t) for t in tokens]


def within_one(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def trie_pairs(words: list[str], bound: int = 1) -> list[tuple[str, str]]:
    """All pairs a < b of distinct words at most ``bound`` edits (with swaps of neighbours) apart.

    The trie is walked with each word's Levenshtein automaton: a state is a node, a place in the word and the edits so
    far, and a branch ends with the edit that would pass the bound.
    """
    words = sorted(set(words))
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    out = []
    for w in words:
        n, found = len(w), set()
        stack = [(root, 0, 0)]
        while stack:
            node, i, e = stack.pop()
            while True:
                if i == n and node.get("", "") > w:
                    found.add(node[""])
                if e < bound:
                    here = w[i] if i < n else None
                    for c, child in node.items():
                        if c:
                            stack.append((child, i, e + 1))
                            if here is not None and c != here:
                                stack.append((child, i + 1, e + 1))
                    if here is not None:
                        stack.append((node, i + 1, e + 1))
                        if i + 1 < n and (swap := node.get(w[i + 1], {}).get(here)) is not None:
                            stack.append((swap, i + 2, e + 1))
                if i == n or (node := node.get(w[i])) is None:
                    break
                i += 1
        out += [(w, f) for f in sorted(found)]
    return out


def trie_join(words: DataFrame, prefix: int, suffix: int) -> DataFrame:
    """(space, a, b): words of one space, (space STRING, word STRING) distinct, within one edit of each other.

    The shards of a word are its first ``prefix`` and its last ``suffix`` letters within its space: an edit leaves one
    of the two as it was if the word has at least prefix + suffix letters; shorter words take part with what they have.
    A task holds the words of its shards, each of which is one trie; the words of a shard by their end are read from it.
    """
    ends = F.array(F.concat(F.lit("<"), F.substring("word", 1, prefix)), F.concat(F.lit(">"), F.expr(f"right(word, {suffix})")))
    shards = words.select("space", "word", F.explode(ends).alias("shard"))
    # a fixed number of partitions, which isn't merged by size: a few bytes of words are much work
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[str]] = {}
        for batch in batches:
            for space, word, shard in zip(*[c.to_pylist() for c in batch.columns]):
                held.setdefault((space, shard), []).append(word)
        spaces, left, right = [], [], []
        for (space, shard), group in held.items():
            if len(group) > 1:
                back = shard[0] == ">"
                for a, b in trie_pairs([w[::-1] for w in group] if back else group):
                    a, b = sorted((a[::-1], b[::-1])) if back else (a, b)
                    spaces.append(space)
                    left.append(a)
                    right.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (spaces, left, right)], ["space", "a", "b"])

    return shards.repartition(parts, "space", "shard").mapInArrow(run, "space string, a string, b string").distinct()


def _classes(words: DataFrame, prefix: int, suffix: int, fuzzy: int, replaced: bool = True) -> DataFrame:
    """(space, word, class): the trie join's components, by a hash of space and word.

    Words of fewer than ``fuzzy`` letters are classes of their own.  ``replaced``: whether a letter may be another one,
    or only be missing or in the other's place.
    """
    node = lambda w: F.xxhash64("space", w)
    pairs = trie_join(words.where(F.length("word") >= fuzzy), prefix, suffix)
    if not replaced:
        letters = lambda w: F.array_sort(F.split(w, ""))
        pairs = pairs.where((F.length("a") != F.length("b")) | (letters("a") == letters("b")))
    pairs = pairs.select(node("a").alias("a"), node("b").alias("b"))
    comp = connected_components(durable(pairs))
    return words.withColumn("node", node("word")).join(comp, "node", "left").select("space", "word", F.coalesce("component", "node").alias("class"))


def _forms(rows: DataFrame) -> DataFrame:
    """(id, own BOOLEAN, cls, tokens) for each row's text and aliases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, cls, toks = [], [], [], []
            for i, kind, text, normalized, aliases in zip(*[c.to_pylist() for c in batch.columns]):
                if kind not in ("PERSON", "ORGANIZATION", "UNKNOWN", None):
                    continue
                if text and normalized and text.lower().endswith(normalized.lower()):
                    text = text[-len(normalized) :]  # without the honorific
                for j, name in enumerate([text or normalized, *(aliases or [])]):
                    if not name:
                        continue
                    c, t = parse(name, kind)
                    if not t:
                        continue
                    ids.append(i)
                    own.append(j == 0)
                    cls.append(c)
                    toks.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.bool_()), pa.array(cls, pa.string()), pa.array(toks, pa.list_(pa.string()))], ["id", "own", "cls", "tokens"])

    return rows.mapInArrow(run, "id long, own boolean, cls string, tokens array<string>")


def _by_middle(full: DataFrame) -> DataFrame:
    """``full`` (name, ent, turn, tokens, ...) with entities divided that agree in two tokens but not in the others.

    These are the names between a person's given and family names and the words after an organisation's first two.  They are the same if they are one edit apart, and an initial stands for the only one that begins so.  Of
    an entity that is divided, names without any of them fit several: they are left out, as short forms are.
    """
    middle = F.when((F.col("turn") == 0) & (F.col("cls") == "P"), F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(0)))).otherwise(F.slice("tokens", 3, F.size("tokens")))
    full = durable(full.withColumn("m", F.when(F.size("tokens") > 2, F.array_join(middle, " "))).drop("tokens", "turn"))
    said = full.where("length(m) > 1").select(F.col("ent").cast("string").alias("space"), F.col("m").alias("word")).distinct()
    several = said.groupBy("space").agg(F.count("*").alias("n")).where("n > 1").select("space")
    words = _classes(said.join(several, "space", "left_semi"), 1, 1, 4)
    words = durable(words.select(F.col("space").cast("long").alias("ent"), F.col("word").alias("m"), "class"))
    apart = words.groupBy("ent").agg(F.count_distinct("class").alias("n")).where("n > 1").select("ent", F.lit(True).alias("apart"))
    first = words.groupBy("ent", F.substring("m", 1, 1).alias("m")).agg(F.min("class").alias("class"), F.max("class").alias("top")).where("class = top").drop("top")
    known = words.unionByName(first.join(words.select("ent", "m"), ["ent", "m"], "left_anti"))
    out = full.join(apart, "ent", "left").join(known, ["ent", "m"], "left").where("apart is null or class is not null")
    return out.withColumn("ent", F.when(F.col("apart"), F.xxhash64("ent", "class")).otherwise(F.col("ent"))).drop("apart", "class", "m")


def link_names(rows: DataFrame) -> DataFrame:
    """(id, entity): the entity of each row that names a person or organisation and can be resolved.

    ``rows``: (id BIGINT unique, entity_type, text, normalized STRING, aliases ARRAY<STRING>).  ``entity`` is equal for
    rows that mean the same one.  Rows of other types, without a name, or with a short form that fits no entity or
    several and no alias to tell, don't come out.  Null and empty aliases say nothing.
    """
    forms = durable(_forms(rows.toDF("id", "entity_type", "text", "normalized", "aliases").distinct()))
    names = forms.groupBy("cls", "tokens").agg(F.count("*").alias("n")).where("cls <> ''").withColumn("name", F.xxhash64("cls", "tokens"))
    several = names.where(F.size("tokens") > 1)
    # hypotheses: family last and given first, or family first and given second
    t = F.col("tokens")
    # an organisation's name is its first two tokens, whatever follows tells it from others
    last = F.when(F.col("cls").startswith("O"), t[1]).otherwise(F.element_at(t, -1))
    both = F.array(F.struct(F.lit(0).alias("turn"), last.alias("f"), t[0].alias("g")), F.struct(F.lit(1).alias("turn"), t[0].alias("f"), t[1].alias("g")))
    hyp = several.select("name", "cls", "n", F.explode(both).alias("h")).select("name", "cls", "n", "h.*")
    # shorter family names only where the given name is as short, else the longer token is the family
    hyp = hyp.where("length(f) >= 4 or cls = 'P' and length(f) > 1 and length(g) in (2, 3)")
    glue = names.where(F.size("tokens") == 1).select("name", "cls", "n", t[0].alias("f"))
    words = hyp.select("f").union(glue.select("f")).distinct().select(F.lit("f").alias("space"), F.col("f").alias("word"))
    fam = durable(_classes(words, 2, 3, 6)).select(F.col("word").alias("f"), F.col("class").alias("fam"))
    # families of four and five letters: an edit counts where the given name is the same, as near ones are often others
    brief = hyp.where("turn = 0 and length(f) in (4, 5) and length(g) >= 3").select(F.concat_ws("|", "cls", "g").alias("space"), F.col("f").alias("word")).distinct()
    brief = _classes(brief, 1, 1, 4, replaced=False)
    brief = durable(brief.join(brief.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "class", "left_semi"))
    hyp = hyp.join(fam, "f").withColumn("space", F.concat_ws("|", "cls", "g")).join(brief.select("space", F.col("word").alias("f"), F.lit(0).alias("turn"), "class"), ["space", "f", "turn"], "left")
    hyp = durable(hyp.withColumn("fam", F.coalesce("class", "fam")).drop("space", "class"))
    # three letters are a given name of their own unless a longer one of the family begins with them
    g4 = hyp.where("length(g) >= 4").select("cls", "fam", F.substring("g", 1, 3).alias("g")).distinct()
    long_ = hyp.where("length(g) >= 4 or length(f) < 4").unionByName(hyp.where("length(g) = 3 and length(f) >= 4").join(g4, ["cls", "fam", "g"], "left_anti"), allowMissingColumns=True)
    space = F.concat_ws("|", "cls", F.col("fam").cast("string"))
    given = durable(_classes(long_.select(space.alias("space"), F.col("g").alias("word")).distinct(), 1, 1, 3)).toDF("space", "g", "ent")
    # the order of the tokens: turned only if others have the turned name in its natural order and none has this one
    known = long_.withColumn("space", space).join(given, ["space", "g"]).select("name", "cls", "n", "turn", "fam", "g", "ent")
    known = durable(known)
    support = known.where("turn = 0").groupBy("ent").agg(F.sum("n").alias("support"), F.count("*").alias("forms"))
    rated = known.join(support, "ent", "left").withColumn("others", F.coalesce("support", F.lit(0)) - F.when(F.col("turn") == 0, F.col("n")).otherwise(0))
    best = F.max_by("ent", F.struct(F.col("others") > 0, (F.col("turn") == 0).cast("int"), "others", "ent"))
    full = rated.groupBy("name").agg(best.alias("ent"))
    turns = known.groupBy("name", "ent", "cls", "fam", "g").agg(F.min("turn").alias("turn"))
    full = durable(_by_middle(full.join(turns, ["name", "ent"]).join(names.select("name", "tokens"), "name")))
    entity = full.groupBy("cls", "fam", "ent", "g").agg(F.lit(1).alias("one")).drop("one")
    only = lambda df: df.groupBy("name").agg(F.min("ent").alias("ent"), F.max("ent").alias("top")).where("ent = top").select("name", "ent")
    rest = hyp.join(full.select("name").distinct(), "name", "left_anti").where("turn = 0")
    # initials and first letters of the given name
    short = rest.join(entity.toDF("cls", "fam", "ent", "full_g"), ["cls", "fam"])
    first = F.when(F.length("g") == 2, F.substring("g", 1, 1)).otherwise(F.col("g"))
    short = only(short.where(F.col("full_g").startswith(first)).select("name", "ent"))
    # the family name alone; two names run together
    alone = only(glue.where("length(f) >= 3").join(fam, "f").join(entity, ["cls", "fam"]).select("name", "ent"))
    joined = full.join(names.select("name", "tokens"), "name").select("cls", F.concat_ws("", "tokens").alias("f"), "ent").distinct()
    joined = only(glue.join(joined, ["cls", "f"]).select("name", "ent"))
    # an organisation without its kind
    kindless = full.where("cls = 'O?'").select("name", "fam", "g", F.col("ent").alias("own_ent"))
    kinds = entity.where("cls like 'O:%'").select("fam", "g", "ent")
    kindless = only(kindless.join(kinds, ["fam", "g"]).select("name", "ent")).withColumnRenamed("ent", "kind_ent")
    name_ent = full.select("name", "ent").union(short).union(alone).union(joined).groupBy("name").agg(F.min("ent").alias("ent"))
    name_ent = name_ent.join(kindless, "name", "left").select("name", F.coalesce("kind_ent", "ent").alias("ent"))
    # rows: the own name, and what the aliases say
    named = forms.withColumn("name", F.xxhash64("cls", "tokens")).join(name_ent, "name", "left")
    per = named.groupBy("id").agg(
        F.max(F.when(F.col("own"), F.col("ent"))).alias("own_ent"),
        F.max(F.when(F.col("own"), (F.size("tokens") > 1) & (F.length(F.get("tokens", F.lit(0))) > 2))).alias("own_full"),
        F.min(F.when(~F.col("own"), F.col("ent"))).alias("alias_ent"),
        F.max(F.when(~F.col("own"), F.col("ent"))).alias("alias_top"),
    )
    per = durable(per.withColumn("ent", F.when(F.col("own_full"), F.coalesce("own_ent", "alias_ent")).otherwise(F.coalesce("alias_ent", "own_ent"))))
    # full names and aliases of one row mean one entity
    same = per.where("own_full and own_ent is not null and alias_ent is not null").select(F.col("own_ent").alias("a"), F.col("alias_ent").alias("b"))
    same = same.union(per.where("alias_ent <> alias_top").select("alias_ent", "alias_top")).where("a <> b").distinct()
    comp = connected_components(durable(same)).toDF("ent", "component")
    return per.where("ent is not null").join(comp, "ent", "left").select("id", F.coalesce("component", "ent").alias("entity"))


def linked_pairs(rows: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows that mean the same entity and whose normalized strings differ."""
    rows = rows.toDF("id", "entity_type", "text", "normalized", "aliases")
    named = durable(link_names(rows).join(rows.select("id", "normalized"), "id"))
    a, b = named.toDF("id_a", "entity", "norm_a"), named.toDF("id_b", "entity", "norm_b")
    return a.join(b, "entity").where("id_a < id_b and norm_a <> norm_b").select("id_a", "id_b")
