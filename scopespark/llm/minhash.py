"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document is the set of its distinct ``width``-word shingles.  Documents with equal sets are one
class.  Each class has ``COORDINATES`` minima under independent hash functions and is posted under its
(coordinate, value) pairs.  Two sets of Jaccard similarity 0.75 agree in 48 of 64 coordinates on
average; pairs that agree in fewer than ``MATCHES`` are dropped, which loses a pair exactly at the
threshold with probability below 1e-4.

Prefix and skip: values are ordered by how many classes are posted under them, rarest first.  Values
posted once can't collide, so classes with fewer than ``MATCHES`` shared values leave at once.  Two
signatures with ``MATCHES`` collisions share one of their first COORDINATES - MATCHES + 1 values, so
only this prefix is merged; the long lists behind it are skipped and the collisions counted from the
signatures of the pair.

Long lists never produce all their pairs.  In each list all members are first compared with one
pivot, the member whose own values are the most shared, and the confirmed links are joined into
components; lists that still hold several components do so once more with a pivot outside their main
component.  A link inside one component changes nothing, so what is left to find are links of members
outside the main component.  Members of a large group that lie just beyond the threshold agree in many
coordinates, so for them the lists are refined by the exact sets: two sets are similar enough only if
they share one of their rarest shingles, within prefixes that follow from both sizes (``refined``), and
the shingles that such a member has of its own fill its prefix.  Every link is confirmed on the full
shingle sets, so the components equal those of all pairs.

Null or empty text, and text without words, is an empty set and links with nothing.  Rows with a null
id take part as texts but are never named as a component; where no row of a component has an id, its
name is null.  Repeated ids keep the links of each of their texts.  Other columns of ``docs`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.llm import textkernel
from scopespark.llm.components import components
from scopespark.session import spool

COORDINATES, MATCHES = 64, 34
#: Rounds in which each list compares its members with one pivot, before lists are refined.
ROUNDS = 2
#: Sizes of one class of the refined lists differ by this factor at most.
STEP = 1.06
_PREFIX = COORDINATES - MATCHES + 1


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k")


def _seeds() -> np.ndarray:
    return textkernel.mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, hashes, offsets in textkernel.word_hashes(textkernel.to_bytes(texts)):
        found, at = textkernel.shingles(hashes, offsets, width)
        for a, b in zip(at, at[1:]):
            yield np.unique(found[a:b])


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of each set under each hash function, as 32-bit values; sets must not be empty."""
    out = np.empty((len(sets), COORDINATES), dtype=np.int32)
    done = 0
    while done < len(sets):  # a bounded stretch of shingles at a time
        upto, total = done, 0
        while upto < len(sets) and (upto == done or total + len(sets[upto]) <= 1 << 17):
            total += len(sets[upto])
            upto += 1
        flat = np.concatenate(sets[done:upto])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[done:upto]])[:-1]))
        for k, seed in enumerate(_seeds()):
            x = (flat ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            out[done:upto, k] = np.minimum.reduceat((x >> np.uint64(32)).astype(np.uint32), starts).view(np.int32)
        done = upto
    return out


def sketch(docs: DataFrame, width: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, k, n_shingles, set_a, set_b, sig): set_a and set_b identify the set, k the text, sig is the signature."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes, a, b, sigs = [], [], [], []
            for lo in range(0, len(part), 512):
                sets = list(shingle_sets(part["text"].iloc[lo : lo + 512], width))
                full = [s for s in sets if len(s)]
                made = iter(signature(full)) if full else iter(())
                for s in sets:
                    sizes.append(len(s))
                    a.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                    b.append(int(textkernel.mix64(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                    sigs.append(next(made) if len(s) else None)
            yield pd.DataFrame({"doc": part["doc"], "k": part["k"], "n_shingles": sizes, "set_a": pd.array(a, dtype="Int64"), "set_b": pd.array(b, dtype="Int64"), "sig": sigs})

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), _text_key(text)).mapInPandas(make, f"doc {kind}, k long, n_shingles long, set_a long, set_b long, sig array<int>")


def _matches(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def postings(classes: DataFrame) -> DataFrame:
    """(list, rep, weight): prefix postings of every class that shares enough values with others.

    ``weight`` is the number of postings under all values of the class.
    """
    values = F.transform("sig", lambda x, i: F.shiftleft(i.cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    posted = classes.select("rep", F.explode(values).alias("list"))
    shared = posted.groupBy("list").agg(F.count("*").alias("length")).where("length > 1")
    shared = spool(shared, "lists")
    own = posted.join(shared, "list").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("length", "list"))).alias("own"))
    # values posted once come first in the order and take up their part of the prefix
    left = F.size("own") - (COORDINATES - _PREFIX)
    own = own.where(F.size("own") >= MATCHES)
    weight = F.aggregate("own", F.lit(0).cast("long"), lambda t, x: t + x["length"]).alias("weight")
    return own.select("rep", weight, F.explode(F.slice("own", F.lit(1), left)).alias("p")).select(F.col("p.list").alias("list"), "rep", "weight")


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures match and whose full sets are similar enough."""
    sig = classes.select("rep", "sig", "n")
    x = sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("na"))
    y = sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("nb"))
    # the larger set can't be more than 100 / percent times the smaller
    likely = pairs.join(x, "a").join(y, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (_matches("sig_a", "sig_b") >= MATCHES)).select("a", "b")
    full = sets.select("rep", "shingles")
    joined = likely.join(full.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")

    @F.pandas_udf("boolean")
    def similar(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(sa, sb):
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    return joined.where(similar("sa", "sb")).select("a", "b")


def refined(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of ``members`` (rep, c, stray) of different c, one of them a stray, that can be similar enough.

    Shingles are ordered by how many members have them, rarest first.  Sets of n and m shingles need
    percent * (n + m) / (100 + percent) in common, so they share one within the first n and m minus that
    many (less one).  Sets are listed under shingle and class of size; a set looks for partners of its own
    class and of the smaller ones.
    """
    each = members.join(sets, "rep").select("rep", "c", "stray", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    each = spool(each, "shingles")
    shared = each.groupBy("s").agg(F.count("*").alias("freq")).where("freq > 1")
    own = each.join(shared, "s").groupBy("rep", "c", "stray", "n").agg(F.array_sort(F.collect_list(F.struct("freq", "s"))).alias("own"))
    # shingles of one member only come first in the order and meet nothing
    ranked = own.select("rep", "c", "stray", "n", F.size("own").alias("left"), F.posexplode(F.slice("own", F.lit(1), F.greatest(F.size("own") - F.ceil(F.col("n") * percent / 100).cast("int") + 1, F.lit(0)))).alias("at", "p"))
    ranked = spool(ranked.select("rep", "c", "stray", "n", F.col("p.s").alias("s"), (F.col("n") - F.col("left") + F.col("at")).alias("rank"), F.floor(F.log("n") / float(np.log(STEP))).cast("int").alias("size")), "ranked")
    need = lambda x, y: F.ceil((x + y) * percent / (100 + percent))
    reach = int(np.ceil(np.log(100 / percent) / np.log(STEP))) + 1
    listed = ranked.where(F.col("rank") <= F.col("n") - need(F.col("n"), F.col("n")))
    asked = ranked.withColumn("size", F.explode(F.sequence(F.col("size") - reach, F.col("size"))))
    least = F.greatest(F.ceil(F.col("n") * percent / 100), F.floor(F.pow(F.lit(STEP), F.col("size"))))
    asked = asked.where(F.col("rank") <= F.col("n") - need(F.col("n"), least))
    x = listed.select("s", "size", F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("stray").alias("ta"), F.col("n").alias("na"), F.col("rank").alias("ra"))
    common = need(F.col("n"), F.col("na"))
    order = (F.col("na") < F.col("n")) | ((F.col("na") == F.col("n")) & (F.col("a") < F.col("rep")))
    fits = (F.col("ca") != F.col("c")) & (F.col("ta") | F.col("stray")) & order & (F.col("na") * 100 >= F.col("n") * percent) & (F.col("ra") <= F.col("na") - common) & (F.col("rank") <= F.col("n") - common)
    return x.join(asked, ["s", "size"]).where(fits).select("a", F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc, n_shingles, component, kept) for every row of ``docs``."""
    made = spool(sketch(docs, width, doc, text), "sketch")
    named = made.where("set_a is not null").groupBy("set_a", "set_b", F.col("n_shingles").alias("n")).agg(F.min("doc").alias("name"), F.min("k").alias("k"), F.first("sig").alias("sig"))
    classes = spool(named.withColumn("rep", F.monotonically_increasing_id()), "classes")
    posts = spool(postings(classes), "postings")

    def to_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), 128):
                piece = part.iloc[lo : lo + 128]
                full = list(shingle_sets(piece["text"], width))
                a = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in full]
                ok = (piece["set_a"].to_numpy() == np.array(a, dtype=np.int64)).tolist()  # not another text of equal hash
                yield pd.DataFrame({"rep": piece["rep"][ok], "shingles": pd.Series([s.view(np.int64) for s, o in zip(full, ok) if o], index=piece.index[ok], dtype=object)})

    active = classes.join(posts.select("rep").distinct(), "rep", "left_semi").select("rep", "k", "set_a")
    texts = docs.select(_text_key(text), F.col(text).alias("text")).groupBy("k").agg(F.min("text").alias("text"))
    sets = spool(texts.join(active, "k").select("rep", "set_a", "text").mapInPandas(to_sets, "rep long, shingles array<long>"), "sets")

    pivots = posts.groupBy("list").agg(F.max(F.struct("weight", "rep")).alias("p")).select("list", F.col("p.rep").alias("a"))
    pairs = posts.join(pivots, "list").where("rep <> a").select("a", "rep")
    links = found = None
    for left in range(ROUNDS, -1, -1):
        pairs = pairs.toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = _confirm(pairs, classes, sets, percent)
        links = spool(new if links is None else links.unionByName(new), "links")
        found = spool(components(links, "a", "b"), "components")
        if not left:
            break
        # what is left: lists that hold several components, and in them the members outside the main one
        placed = posts.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("list", "rep", "weight", F.coalesce("component", "rep").alias("c"))
        main = placed.groupBy("list", "c").agg(F.count("*").alias("k")).groupBy("list").agg(F.max(F.struct("k", "c")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("list", F.col("m.c").alias("main"))
        placed = spool(placed.join(main, "list"), "placed")
        if left > 1:
            pivots = placed.where("c <> main").groupBy("list").agg(F.max(F.struct("weight", "rep", "c")).alias("p")).select("list", F.col("p.rep").alias("a"), F.col("p.c").alias("ca"))
            pairs = placed.join(pivots, "list").where("c <> ca").select("a", "rep")
        else:
            members = placed.groupBy("rep", "c").agg(F.max(F.col("c") != F.col("main")).alias("stray"))
            pairs = refined(members, sets, percent)

    told = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.col("n").alias("n_shingles"), "name", F.coalesce("component", "rep").alias("c"))
    names = told.groupBy("c").agg(F.min("name").alias("component"))
    told = told.join(names, "c").select("set_a", "set_b", "n_shingles", "component")
    with_set = made.where("set_a is not null").drop("sig", "k").join(told, ["set_a", "set_b", "n_shingles"], "left")
    without = made.where("set_a is null").select("doc", "n_shingles", F.col("doc").alias("component"))
    out = with_set.select("doc", "n_shingles", "component").union(without)
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component"), F.lit(False)))


def sql(width: int = 5, percent: int = 75) -> str:
    """DuckDB SQL: all pairs that share a shingle, and components by reaching outward."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS t FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < {width} THEN [array_to_string(t, ' ')]
      ELSE list_transform(range(1, len(t) - {width - 2}), lambda i: array_to_string(t[i:i + {width - 1}], ' ')) END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= {percent} * (p.n + q.n - count(*))),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id"""


def one_of_each(docs: DataFrame, key: str, text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one for each key; all columns are kept."""
    found = near_duplicates(docs, key, text, width, percent).where("kept").groupBy(F.col("doc").alias(key)).agg(F.count("*").alias("rows"))
    found = spool(found, "kept")
    once = docs.join(found.where("rows = 1").select(key), key, "left_semi")
    again = docs.join(found.where("rows > 1").select(key), key, "left_semi").dropDuplicates([key])
    return once.unionByName(again)
