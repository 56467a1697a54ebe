"""Neighbourhoods of an anchor bond in tables of small graphs; all graphs are handled at once.

``atoms`` (mol_id, atom_id, element, ...) and ``bonds`` (mol_id, src, dst, bond_order, ...).  Graphs are
small: the bonds of each are gathered in one row by a single shuffle on mol_id, and hops, paths, rings and
colours are array expressions inside that row, however many graphs there are.  Joins go by graph and are always
merged: files of graphs are far smaller than their rows, so a table that looks small enough to broadcast need not be.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both_ways(df: DataFrame, a: str, b: str, x: str, y: str, *more: str) -> DataFrame:
    """(mol_id, x, y, *more): each row as (a, b) and as (b, a), in place, so that the rows stay where they are."""
    turned = F.array(F.struct(F.col(a).alias(x), F.col(b).alias(y)), F.struct(F.col(b).alias(x), F.col(a).alias(y)))
    return df.select("mol_id", F.explode(turned).alias("__e"), *more).select("mol_id", f"__e.{x}", f"__e.{y}", *more)


#: Rows that ``colocated`` deals to one task, about.
ROWS = 100_000


def parts_for(df: DataFrame, rows: int = ROWS) -> int:
    """Shuffle partitions for ``df`` by its number of rows, so that a task doesn't grow with the table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def colocated(bonds: DataFrame, parts: int | None = None) -> DataFrame:
    """``bonds`` dealt out by graph once: every grouping and join by mol_id below needs no further shuffle.

    Without a number of partitions Spark would merge small ones into as many as there are cores, however large the table.
    """
    return bonds.repartition(parts or parts_for(bonds), "mol_id")


def undirected(bonds: DataFrame) -> DataFrame:
    """(mol_id, a, b, bond_order): every bond in both directions."""
    return _both_ways(bonds, "src", "dst", "a", "b", "bond_order").distinct()


def atoms_of(df: DataFrame, atom: str, out: str) -> DataFrame:
    """(mol_id, out): the atoms of each graph in one array, so that joins go by graph and move no rows."""
    return df.where(F.col(atom).isNotNull()).groupBy("mol_id").agg(F.collect_set(atom).alias(out))


def anchors(bonds: DataFrame, atoms: DataFrame | None = None, element: str = "C", order: int = 2) -> DataFrame:
    """(mol_id, a, b, n): bonds of the order whose ends are the element, and how many the graph has."""
    found = bonds.where(F.col("bond_order") == order).select("mol_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    if atoms is not None:
        kind = atoms_of(atoms.where(F.col("element") == element), "atom_id", "kind")
        found = found.join(kind.hint("merge"), "mol_id").where(F.array_contains("kind", F.col("a")) & F.array_contains("kind", F.col("b")))
    own = found.where(F.col("mol_id").isNotNull()).groupBy("mol_id").agg(F.collect_list(F.struct("a", "b")).alias("own"))
    return own.select("mol_id", _each("own").alias("x"), F.size("own").cast("long").alias("n")).select("mol_id", "x.a", "x.b", "n")


def first_anchor(found: DataFrame) -> DataFrame:
    """One anchor per graph, the smallest."""
    return found.groupBy("mol_id").agg(F.min(F.struct("a", "b")).alias("m")).select("mol_id", "m.a", "m.b")


def knockout_variants(bonds: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """(mol_id, variant, src, dst, bond_order, *more): variant i keeps anchor i and makes the others single."""
    own = found.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")))).alias("own"))
    rows = bonds.join(own.hint("merge"), "mol_id").withColumn("i", F.array_position("own", F.struct("src", "dst")))
    rows = rows.select("mol_id", F.explode(F.sequence(F.lit(1), F.size("own"))).alias("variant"), "src", "dst", "bond_order", "i", *more)
    kept = F.when((F.col("i") > 0) & (F.col("i") != F.col("variant")), 1).otherwise(F.col("bond_order"))
    return rows.select("mol_id", "variant", "src", "dst", kept.alias("bond_order"), *more)


def _each(array: Column | str) -> Column:
    """One row for each entry of an array that is never empty.

    Before a plain explode the optimiser tests for empty arrays, which computes a long expression once more.
    """
    return F.explode_outer(array)


def _ends(found: DataFrame) -> DataFrame:
    """(mol_id, anchor, other): both ends of each anchor."""
    return _both_ways(found, "a", "b", "anchor", "other")


def walk_counts(edges: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """(mol_id, anchor, atom, n): walks of length r from each anchor end."""
    ends = _ends(found).select("mol_id", "anchor")
    if not r:
        return ends.select("mol_id", "anchor", F.col("anchor").alias("atom"), F.lit(1).cast("long").alias("n"))
    into = lambda atoms: F.transform(atoms, lambda x: F.transform(F.filter("edges", lambda e: e["b"] == x), lambda e: F.array_position(atoms, e["a"]).cast("int") - 1))
    step = lambda before: lambda now, _: F.transform(before, lambda from_: F.aggregate(from_, F.lit(0).cast("long"), lambda n, i: n + F.get(now, i)))

    def counted(atoms: Column) -> Column:
        first = F.transform(atoms, lambda x: F.when(x == F.col("anchor"), 1).otherwise(0).cast("long"))
        last = _let(into(atoms), lambda before: F.aggregate(F.array(*[F.lit(k) for k in range(r)]), first, step(before)))
        return F.filter(F.zip_with(atoms, last, lambda x, n: F.struct(x.alias("atom"), n.alias("n"))), lambda w: w["n"] > 0)

    rows = ends.join(_by_graph(edges).hint("merge"), "mol_id")
    rows = rows.select("mol_id", "anchor", _each(_let(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["a"], e["b"])))), counted)).alias("w")).where("w is not null")
    return rows.select("mol_id", "anchor", "w.atom", "w.n").groupBy("mol_id", "anchor", "atom").agg(F.sum("n").alias("n"))


def _by_graph(edges: DataFrame, *more: str) -> DataFrame:
    """(mol_id, edges): the directed bonds (a, b, ...) of each graph in one row."""
    return edges.groupBy("mol_id").agg(F.collect_set(F.struct("a", "b", *more)).alias("edges"))


def _behind(edges: Column, front: Column) -> Column:
    """Atoms one bond behind ``front``."""
    return F.array_distinct(F.transform(F.filter(edges, lambda e: F.array_contains(front, e["a"])), lambda e: e["b"]))


def _connected(edges: Column) -> Column:
    """Connected parts of a graph as arrays of atoms: every bond joins the parts of its ends."""
    first = F.transform(F.slice(edges, 1, 0), lambda e: F.array(e["a"]))

    def join(parts: Column, e: Column) -> Column:
        touches = lambda p: F.array_contains(p, e["a"]) | F.array_contains(p, e["b"])
        own = F.array_distinct(F.concat(F.flatten(F.filter(parts, touches)), F.array(e["a"], e["b"])))
        return F.concat(F.filter(parts, lambda p: ~touches(p)), F.array(own))

    return F.aggregate(edges, first, join)


def distances(edges: DataFrame, found: DataFrame, r: int, block_other: bool = False) -> DataFrame:
    """(mol_id, anchor, atom, dist): hops up to r from each anchor end.

    With ``block_other`` paths don't cross the other anchor end.
    """
    rows = _ends(found).join(_by_graph(edges).hint("merge"), "mol_id", "left").withColumns({"front": F.array("anchor"), "seen": F.array(F.struct(F.col("anchor").alias("atom"), F.lit(0).alias("dist")))})
    at = lambda d: lambda x: F.struct(x.alias("atom"), F.lit(d).alias("dist"))
    for d in range(1, r + 1):
        new = F.array_except(_behind(F.col("edges"), F.col("front")), F.transform("seen", lambda x: x["atom"]))
        new = F.filter(new, lambda x: x != F.col("other")) if block_other else new
        rows = rows.withColumn("front", F.coalesce(new, F.slice("front", 1, 0)))
        rows = rows.withColumn("seen", F.concat("seen", F.transform("front", at(d))))
    return rows.select("mol_id", "anchor", _each("seen").alias("x")).select("mol_id", "anchor", "x.atom", "x.dist")


def _turned(bonds: Column, *more: str) -> Column:
    """Directed bonds (a, b, *more) of the bonds (src, dst, ...) of a graph, each once."""
    turn = lambda e, x, y: F.struct(e[x].alias("a"), e[y].alias("b"), *[e[c].alias(c) for c in more])
    return F.array_distinct(F.flatten(F.transform(bonds, lambda e: F.array(turn(e, "src", "dst"), turn(e, "dst", "src")))))


def _within(edges: Column, ends: Column, r: int, block_other: bool = False) -> Column:
    """(atom, dist) of the atoms up to r hops from the nearest of ``ends`` (anchor, other), as ``distances`` has them.

    All inside the row of a graph, so that no table is grouped or joined again for it.
    """

    def step(end: Column, so_far: Column, d: Column) -> Column:
        new = F.array_except(_behind(edges, so_far["front"]), F.transform(so_far["seen"], lambda x: x["atom"]))
        new = F.filter(new, lambda x: x != end["other"]) if block_other else new
        return _let(new, lambda new: F.struct(new.alias("front"), F.concat(so_far["seen"], F.transform(new, lambda x: F.struct(x.alias("atom"), d.alias("dist")))).alias("seen")))

    start = lambda end: F.struct(F.array(end["anchor"]).alias("front"), F.array(F.struct(end["anchor"].alias("atom"), F.lit(0).alias("dist"))).alias("seen"))
    hops = F.slice(F.array(*[F.lit(d) for d in range(r + 1)]), 2, r)
    each = F.flatten(F.transform(ends, lambda end: F.aggregate(hops, start(end), lambda so_far, d: step(end, so_far, d), lambda x: x["seen"])))
    least = lambda all_, atom: F.array_min(F.transform(F.filter(all_, lambda x: x["atom"].eqNullSafe(atom)), lambda x: x["dist"]))
    return _let(each, lambda all_: F.transform(F.array_distinct(F.transform(all_, lambda x: x["atom"])), lambda atom: F.struct(atom.alias("atom"), least(all_, atom).alias("dist"))))


def around(bonds: DataFrame, found: DataFrame, r: int, how: str) -> DataFrame:
    """(mol_id, bonds, inside, border): each graph in one row, with the (atom, dist) of ``neighbourhood`` and the atoms of ``boundary``.

    Without an anchor the last two are null.
    """
    kind = bonds.schema["src"].dataType
    own = _ends(found.select("mol_id", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")))
    own = own.groupBy("mol_id").agg(F.collect_list(F.struct("anchor", "other")).alias("ends"))
    rows = bonds.groupBy("mol_id").agg(F.collect_list(F.struct(*[c for c in bonds.columns if c != "mol_id"])).alias("bonds"))
    rows = rows.join(own.hint("merge"), "mol_id", how)
    marks = _let(_turned(F.col("bonds")), lambda edges: F.struct(_within(edges, F.col("ends"), r, block_other=True).alias("inside"), _within(edges, F.col("ends"), r).alias("near")))
    rows = rows.select("mol_id", "bonds", marks.alias("marks"))
    return rows.select("mol_id", "bonds", "marks.inside", F.transform(F.filter("marks.near", lambda x: x["dist"] == r), lambda x: x["atom"]).alias("border"))


def boundary(edges: DataFrame, found: DataFrame, r: int, max_walks: int | None = None) -> DataFrame:
    """(mol_id, atom): atoms r hops from one anchor end and at least r from the other.

    ``max_walks`` keeps only atoms with at most so many walks of length r, the literal rule.
    """
    near = distances(edges, found, r)
    least = near.groupBy("mol_id", "atom").agg(F.min("dist").alias("dist"))
    edge = least.where(F.col("dist") == r).select("mol_id", "atom")
    if max_walks is not None:
        walks = walk_counts(edges, found, r).groupBy("mol_id", "atom").agg(F.min("n").alias("n"))
        edge = edge.join(atoms_of(walks.where(F.col("n") <= max_walks), "atom", "few").hint("merge"), "mol_id").where(F.array_contains("few", F.col("atom"))).drop("few")
    return edge


def neighbourhood(edges: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """(mol_id, atom, dist): atoms within r hops of an anchor end without crossing the other one."""
    return distances(edges, found, r, block_other=True).groupBy("mol_id", "atom").agg(F.min("dist").alias("dist"))


def shells(edges: DataFrame, found: DataFrame, r: int) -> tuple[DataFrame, DataFrame]:
    """((mol_id, atom, shell), (mol_id, src, dst, shell)): atoms by hops, bonds of the anchor and between shells."""
    atoms = distances(edges, found, r).groupBy("mol_id", "atom").agg(F.min("dist").alias("shell"))
    near = atoms.groupBy("mol_id").agg(F.map_from_entries(F.collect_list(F.struct("atom", "shell"))).alias("near"))
    own = found.groupBy("mol_id").agg(F.collect_set(F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).alias("own"))
    rows = _by_graph(edges.where("a < b")).join(near.hint("merge"), "mol_id").join(own.hint("merge"), "mol_id")
    at = lambda x: F.try_element_at("near", x)
    between = lambda e: (F.abs(at(e["a"]) - at(e["b"])) == 1) | (F.array_contains("own", F.struct(e["a"], e["b"])) & at(e["a"]).isNotNull() & at(e["b"]).isNotNull())
    bonds = rows.select("mol_id", "near", _each(F.filter("edges", between)).alias("e")).where("e is not null")
    return atoms, bonds.select("mol_id", F.col("e.a").alias("src"), F.col("e.b").alias("dst"), F.greatest(at(F.col("e.a")), at(F.col("e.b"))).alias("shell"))


def cumulative_shells(atoms: DataFrame, r: int) -> DataFrame:
    """(mol_id, upto, n_atoms): atoms within each prefix of shells."""
    counts = atoms.groupBy("mol_id", "shell").agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.explode(F.sequence(F.col("shell"), F.lit(r))))
    return upto.groupBy("mol_id", "upto").agg(F.sum("k").alias("n_atoms"))


def path_counts(edges: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """(mol_id, anchor, n_paths): maximal simple paths of at most r bonds from each anchor end, not over the other."""
    rows = _ends(found).join(_by_graph(edges).hint("merge"), "mol_id").withColumns({"paths": F.array(F.array("other", "anchor")), "done": F.lit(0).cast("long")})
    for step in range(r):
        goes_on = lambda p: lambda e: (e["a"] == F.element_at(p, -1)) & ~F.array_contains(p, e["b"])
        # a path that can't grow is complete
        ended = F.size(F.filter("paths", lambda p: ~F.exists("edges", goes_on(p)))) if step else F.lit(0)
        rows = rows.withColumn("done", F.col("done") + ended)
        rows = rows.withColumn("paths", F.flatten(F.transform("paths", lambda p: F.transform(F.filter("edges", goes_on(p)), lambda e: F.concat(p, F.array(e["b"]))))))
    return rows.groupBy("mol_id", "anchor").agg(F.max(F.col("done") + F.size("paths")).alias("n_paths")).where("n_paths > 0")


def in_ring(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(mol_id, a, b, in_ring): whether the ends stay connected without the anchor bond."""
    rows = found.select("mol_id", F.col("a").alias("x"), F.col("b").alias("y")).join(_by_graph(edges.where("a < b")).hint("merge"), "mol_id", "left")
    rest = F.filter("edges", lambda e: (e["a"] != F.least("x", "y")) | (e["b"] != F.greatest("x", "y")))
    rows = rows.withColumn("parts", _connected(rest))
    both = F.exists("parts", lambda p: F.array_contains(p, F.col("x")) & F.array_contains(p, F.col("y")))
    return rows.select("mol_id", F.col("x").alias("a"), F.col("y").alias("b"), F.coalesce(both, F.lit(False)).alias("in_ring"))


def ring_systems(aromatic: DataFrame) -> DataFrame:
    """(mol_id, atom, system): connected parts of the aromatic bonds, named by their smallest atom."""
    rows = _by_graph(aromatic).select("mol_id", _each(_connected(F.col("edges"))).alias("part"))
    return rows.select("mol_id", F.array_min("part").alias("system"), _each("part").alias("atom")).select("mol_id", "atom", "system")


def _partial(systems: Column, inside: Column, edge: Column) -> Column:
    """Atoms of those systems that have an atom of ``edge`` and one outside ``inside``."""
    among = lambda atoms: lambda x: F.coalesce(F.array_contains(atoms, x), F.lit(False))
    return F.flatten(F.filter(systems, lambda p: F.exists(p, among(edge)) & ~F.forall(p, among(inside))))


def _made_single(bond: Callable[[str], Column], hit: Column) -> dict[str, Column]:
    """What changes in a bond whose system is in ``hit``."""
    gone = bond("aromatic") & F.coalesce(F.array_contains(hit, bond("src")), F.lit(False))
    return {"bond_order": F.when(gone, 1).otherwise(bond("bond_order")), "aromatic": bond("aromatic") & ~gone}


def break_partial_rings(bonds: DataFrame, network: DataFrame, edge: DataFrame) -> DataFrame:
    """``bonds`` with the aromatic systems that have a boundary atom and a member outside made single.

    A system is a connected part of the aromatic bonds, so fused rings count as one.
    """
    system = _by_graph(undirected(bonds.where("aromatic"))).select("mol_id", _connected(F.col("edges")).alias("systems"))
    inside, on_edge = atoms_of(network, "atom", "inside"), atoms_of(edge, "atom", "edge")
    hit = system.join(inside.hint("merge"), "mol_id", "left").join(on_edge.hint("merge"), "mol_id", "left").select("mol_id", _partial(F.col("systems"), F.col("inside"), F.col("edge")).alias("hit"))
    marked = bonds.join(hit.hint("merge"), "mol_id", "left")
    return marked.withColumns(_made_single(F.col, F.col("hit"))).select(*bonds.columns)


def break_rings_around(bonds: DataFrame, found: DataFrame, r: int) -> DataFrame:
    """``break_partial_rings`` with the network and the boundary r hops around ``found``, all in the row of a graph."""
    rows = around(bonds, found, r, "left")
    systems = _connected(_turned(F.filter("bonds", lambda e: e["aromatic"])))
    rows = rows.select("mol_id", "bonds", _partial(systems, F.transform("inside", lambda x: x["atom"]), F.col("border")).alias("hit"))
    rows = rows.select("mol_id", "hit", _each("bonds").alias("e")).select("mol_id", "hit", "e.*")
    return rows.withColumns(_made_single(F.col, F.col("hit"))).select(*bonds.columns)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` computed once however often f reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _colourings(atoms: Column, first: Column, edges: Column, rounds: int) -> Column:
    """Colours of ``atoms`` before and after each round of refinement, as an array of arrays in the order of ``atoms``.

    A round hashes an atom's own colour with the sorted orders and colours behind its bonds.  ``edges`` are looked
    up once; the rounds only follow positions.
    """
    behind = F.transform(atoms, lambda a: F.transform(F.filter(edges, lambda e: e["a"] == a), lambda e: F.struct(e["bond_order"].cast("string").alias("o"), (F.array_position(atoms, e["b"]) - 1).cast("int").alias("i"))))

    def refined(near: Column) -> Column:
        def step(done: Column, _: Column) -> Column:
            now = lambda i: F.get(F.element_at(done, -1), i)
            told = lambda ns: F.array_join(F.array_sort(F.transform(ns, lambda n: F.concat_ws(":", n["o"], now(n["i"])))), ",")
            return F.concat(done, F.array(F.transform(near, lambda ns, i: F.md5(F.concat(now(i), F.lit("|"), told(ns)).cast("binary")))))

        return F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), F.array(first), step)

    return _let(behind, refined) if rounds else F.array(first)


def motifs(bonds: DataFrame, found: DataFrame, r: int, atoms: DataFrame | None = None) -> DataFrame:
    """(mol_id, motif_key, n_atoms): hash of the r-hop fragment, the same for any numbering of atoms.

    Boundary atoms count as ``*``.  Fragments of one shape share a key; the converse can fail.
    """
    own = around(bonds.select("mol_id", "src", "dst", "bond_order"), found, r, "inner").withColumnRenamed("inside", "own")
    kind = lambda x: F.lit("C")
    if atoms is not None:
        told = atoms.where(F.col("element").isNotNull() & F.col("atom_id").isNotNull()).groupBy("mol_id").agg(F.collect_list(F.struct(F.col("atom_id").alias("atom"), "element")).alias("kinds"))
        own = own.join(told.hint("merge"), "mol_id", "left")
        kind = lambda x: F.get(F.filter("kinds", lambda k: k["atom"] == x), F.lit(0))["element"]
    name = lambda x: F.when(F.array_contains("border", x), "*").otherwise(F.coalesce(kind(x), F.lit("?")))
    first = lambda x: F.md5(F.concat_ws("|", name(x["atom"]), x["dist"].cast("string")).cast("binary"))
    rows = own.withColumn("own", F.transform(F.array_sort("own"), lambda x: F.struct(x["atom"].alias("atom"), first(x).alias("c"))))
    rows = rows.select("mol_id", _turned(F.col("bonds"), "bond_order").alias("edges"), F.transform("own", lambda x: x["atom"]).alias("atoms"), F.transform("own", lambda x: x["c"]).alias("first"))
    inside = F.filter("edges", lambda e: F.array_contains("atoms", e["b"]))
    last = F.element_at(_colourings(F.col("atoms"), F.col("first"), inside, r + 1), -1)
    return rows.select("mol_id", F.md5(F.array_join(F.array_sort(last), ",").cast("binary")).alias("motif_key"), F.size("atoms").cast("long").alias("n_atoms"))


def neighbourhood_bits(bonds: DataFrame, atoms: DataFrame, radius: int = 2, bits: int = 2048) -> DataFrame:
    """(mol_id, bit): distinct bits of the colours of all rounds up to ``radius``."""
    first = F.md5(F.col("element").cast("binary"))
    rows = atoms.groupBy("mol_id").agg(F.array_sort(F.collect_set(F.struct(F.col("atom_id").cast("long").alias("atom"), first.alias("c")))).alias("own"))
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint,bond_order:int>>)")
    edges = undirected(bonds).select("mol_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("bond_order").cast("int").alias("bond_order"))
    rows = rows.join(_by_graph(edges, "bond_order").hint("merge"), "mol_id", "left")
    rows = rows.select("mol_id", F.coalesce("edges", none).alias("edges"), F.transform("own", lambda x: x["atom"]).alias("atoms"), F.transform("own", lambda x: x["c"]).alias("first"))
    bit = lambda c: F.pmod(F.conv(F.substring(c, 1, 8), 16, 10).cast("long"), F.lit(bits)).cast("int")
    seen = F.array_distinct(F.flatten(_colourings(F.col("atoms"), F.col("first"), F.col("edges"), radius)))
    return rows.select("mol_id", _each(F.array_distinct(F.transform(seen, bit))).alias("bit"))


def count_keys(atoms: DataFrame, rules: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """(mol_id, rule columns 0/1): whether more than n atoms of the graph satisfy a predicate."""
    return atoms.groupBy("mol_id").agg(*[(F.count_if(p) > n).cast("int").alias(name) for name, (p, n) in rules.items()])
