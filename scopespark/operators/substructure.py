"""Substructure keys and topological descriptors of molecules, in DataFrame functions only.

Each molecule is one row: an array of its atoms, each with the bonds around it by position, so that a pattern is matched by
growing arrays of positions along bonds, and all patterns are answered by one pass over the row.

Patterns are read from text on the driver: atoms, bonds, branches and ring numbers of the usual pattern notation, with the
primitives ``*``, ``a``, ``#n``, symbols, ``Hn``, ``R`` and ``+0``, each with ``!``, joined by nothing, ``,`` or ``;``; and
``[$(...),$(...)]`` as a whole, the alternatives for one atom.  Anything else is an error.

Aromatic atoms and bonds are those marked so.  Hydrogens that a table doesn't tell are implied by the usual valences, less the
orders of the bonds, and less one for an aromatic atom; written hydrogens stay atoms.  Bonds told twice count once (the
highest order), bonds to atoms that the table doesn't hold and bonds from an atom to itself don't count, and of
atoms with one id the one that sorts first stands.  Rows without molecule or id take no part.  Other columns are not read.
Work grows with the number of paths as long as a pattern, which is small where atoms have few bonds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.operators.graph import _let

# Symbols by atomic number, from 1.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn "
    "Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm "
    "Bk Cf Es Fm Md No Lr Rf"
).split()
# Valences that imply hydrogens.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}

#: From the SQL of an atom or a bond to the SQL of a condition.
Test = Callable[[str], str]

# ---- molecules as rows ----------------------------------------------------------------------------


def _implied(atom: Column, near: Column) -> Column:
    """Hydrogens implied by the valences."""
    used = F.aggregate(near, F.lit(0), lambda n, e: n + e["order"]) + F.when(atom["aromatic"], 1).otherwise(0)
    known = F.create_map(*[x for s, vs in VALENCES.items() for x in (F.lit(s), F.array(*map(F.lit, vs)))])
    fits = F.try_element_at(known, atom["element"])
    lowest = F.when(atom["aromatic"], F.slice(fits, 1, 1)).otherwise(fits)
    free = F.get(F.filter(lowest, lambda v: v >= used), F.lit(0)) - used
    return F.coalesce(free, F.lit(0)).cast("int")


def _paths(near: Column) -> Column:
    """For each atom the positions from the root of its part down to itself, along a breadth-first tree."""
    all_ = F.sequence(F.lit(0), F.size(near) - 1)

    def visit(order: Column, i: Column) -> Column:
        root = F.get(F.array_except(all_, F.transform(order, lambda o: o["atom"])), F.lit(0))
        begun = F.when(i < F.size(order), order).otherwise(F.concat(order, F.array(F.struct(root.alias("atom"), F.array(root).alias("path")))))

        def grow(order: Column) -> Column:
            here = F.get(order, i)
            new = F.filter(F.transform(F.get(near, here["atom"]), lambda e: e["to"]), lambda x: ~F.exists(order, lambda o: o["atom"] == x))
            return F.concat(order, F.transform(new, lambda x: F.struct(x.alias("atom"), F.concat(here["path"], F.array(x)).alias("path"))))

        return _let(begun, grow)

    seen = F.aggregate(all_, F.expr("cast(array() as array<struct<atom:int,path:array<int>>>)"), visit)
    return F.transform(F.array_sort(seen), lambda o: o["path"])


def _in_rings(near: Column, paths: Column) -> Column:
    """``near`` with a mark on every bond that lies in a ring.

    A bond outside the tree closes a ring with the tree bonds above just one of its ends; every bond of any ring is in one of these.
    """
    above = lambda x: F.element_at(F.slice(F.get(paths, x), -2, 1), 1)
    deep = lambda x: F.size(F.get(paths, x))
    tree = lambda a, b: F.when(deep(a) == deep(b) + 1, above(a) == b).when(deep(b) == deep(a) + 1, above(b) == a).otherwise(F.lit(False))
    pair = lambda i, e: F.struct(i.cast("int").alias("a"), e["to"].alias("b"))
    closing = F.flatten(F.transform(near, lambda es, i: F.transform(F.filter(es, lambda e: (i < e["to"]) & ~tree(i, e["to"])), lambda e: pair(i, e))))

    def marked(closing: Column) -> Column:
        def ring(a: Column, b: Column) -> Column:
            child = F.when(deep(a) > deep(b), a).otherwise(b)
            over = lambda x: F.array_contains(F.get(paths, x), child.cast("int"))
            return F.when(tree(a, b), F.exists(closing, lambda c: over(c["a"]) != over(c["b"]))).otherwise(F.lit(True))

        return F.transform(near, lambda es, i: F.transform(es, lambda e: F.struct(e["to"].alias("to"), e["order"].alias("order"), e["aromatic"].alias("aromatic"), ring(i, e["to"]).alias("ring"))))

    return _let(closing, marked)


def molecule_rows(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, parts, atoms): each molecule in one row; tables ``colocated`` before aren't shuffled again.

    An entry of ``atoms`` has element, charge, isotope, aromatic, hydrogens, implied (the hydrogens that the valences tell), ring and ``near``: (to, order, aromatic, ring) for each bond around
    it, ``to`` a position in the same array.  ``parts`` is the number of connected parts.
    """
    given = lambda df, c, other, t: (F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)).cast(t).alias(c)
    own = atoms.where("mol_id is not null and atom_id is not null").select("mol_id", F.struct(F.col("atom_id").cast("long").alias("atom_id"), F.coalesce("element", F.lit("*")).alias("element"), given(atoms, "isotope", 0, "int"), given(atoms, "charge", 0, "int"), given(atoms, "aromatic", False, "boolean"), given(atoms, "hydrogens", None, "int")).alias("a"))
    own = own.groupBy("mol_id", "a.atom_id").agg(F.min("a").alias("a")).groupBy("mol_id").agg(F.array_sort(F.collect_list("a")).alias("own"))
    ends = bonds.where("src <> dst").select("mol_id", F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), given(bonds, "bond_order", 1, "int"), given(bonds, "aromatic", False, "boolean"))
    edges = ends.groupBy("mol_id", "src", "dst").agg(F.max("bond_order").alias("order"), F.max("aromatic").alias("aromatic"))
    edges = edges.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "order", "aromatic"))).alias("edges"))
    none = F.expr("cast(array() as array<struct<src:bigint,dst:bigint,order:int,aromatic:boolean>>)")
    rows = own.join(edges.hint("merge"), "mol_id", "left")

    def placed(ids: Column) -> Column:
        at = lambda x: (F.array_position(ids, x) - 1).cast("int")
        bond = lambda a, b: lambda e: F.struct(at(e[a]).alias("at"), at(e[b]).alias("to"), e["order"].alias("order"), e["aromatic"].alias("aromatic"))
        both = F.concat(*[F.transform(F.coalesce("edges", none), bond(*x)) for x in (("src", "dst"), ("dst", "src"))])
        both = F.filter(both, lambda e: (e["at"] >= 0) & (e["to"] >= 0))
        around = lambda es, i: F.transform(F.filter(es, lambda e: e["at"] == i), lambda e: F.struct(e["to"].alias("to"), e["order"].alias("order"), e["aromatic"].alias("aromatic")))
        return _let(both, lambda es: F.transform(ids, lambda _, i: around(es, i)))

    def told(near: Column) -> Column:
        def whole(paths: Column) -> Column:
            atom = lambda ns: lambda a, i: F.struct(a["element"].alias("element"), a["charge"].alias("charge"), a["isotope"].alias("isotope"), a["aromatic"].alias("aromatic"), F.coalesce(a["hydrogens"], _implied(a, F.get(ns, i))).alias("hydrogens"), _implied(a, F.get(ns, i)).alias("implied"), F.exists(F.get(ns, i), lambda e: e["ring"]).alias("ring"), F.get(ns, i).alias("near"))
            listed = _let(_in_rings(near, paths), lambda ns: F.transform("own", atom(ns)))
            return F.struct(F.size(F.filter(paths, lambda p: F.size(p) == 1)).alias("parts"), listed.alias("atoms"))

        return _let(_paths(near), whole)

    ids = F.transform("own", lambda a: a["atom_id"])
    return rows.select("mol_id", _let(_let(ids, placed), told).alias("m")).select("mol_id", "m.parts", "m.atoms")


# ---- patterns -------------------------------------------------------------------------------------

_PIECE = re.compile(r"\[[^\]]*\]|Br|Cl|[BCNOPSFIbcnopsa*]|[()]|%[0-9]{2}|[0-9]|[-=#:~@!;]+")
_PRIMITIVE = re.compile(r"(!?)(?:#([0-9]+)|H(?![a-z])([0-9]*)|(R)(?![a-z])|(\+0)|([A-Z][a-z]?|[a-z]|\*))")
_BOND: dict[str, Test] = {
    "-": lambda e: f"({e}.order = 1 and not {e}.aromatic)",
    "=": lambda e: f"({e}.order = 2 and not {e}.aromatic)",
    "#": lambda e: f"({e}.order = 3)",
    ":": lambda e: f"({e}.aromatic)",
    "~": lambda e: "true",
    "@": lambda e: f"({e}.ring)",
    "": lambda e: f"({e}.order = 1 or {e}.aromatic)",
}


@dataclass
class Pattern:
    """Atoms in the order of the text: a test, the atom before it with the bond between, and the rings it closes."""

    atoms: list[Test] = field(default_factory=list)
    before: list[tuple[int, Test] | None] = field(default_factory=list)
    rings: list[list[tuple[int, Test]]] = field(default_factory=list)


def _joined(word: str, tests: list[Test]) -> Test:
    return lambda x: "(" + f" {word} ".join(t(x) for t in tests) + ")"


def _not(test: Test) -> Test:
    return lambda x: f"(not {test(x)})"


def _primitive(number: str | None, hydrogens: str | None, ring: str | None, charge: str | None, symbol: str | None) -> Test:
    if number:
        return lambda a: f"({a}.element = '{ELEMENTS[int(number) - 1]}')"
    if hydrogens is not None:
        return lambda a: f"({a}.hydrogens = {int(hydrogens or 1)})"
    if ring:
        return lambda a: f"({a}.ring)"
    if charge:
        return lambda a: f"({a}.charge = 0)"
    if symbol == "*":
        return lambda a: "true"
    if symbol == "a":
        return lambda a: f"({a}.aromatic)"
    return lambda a: f"({a}.element = '{symbol.capitalize()}' and {'' if symbol.islower() else 'not '}{a}.aromatic)"


def _atom_test(text: str) -> Test:
    def part(word: str) -> Test:
        found = list(_PRIMITIVE.finditer(word))
        if not word or "".join(m.group() for m in found) != word:
            raise ValueError(f"unknown atom in a pattern: {text}")
        return _joined("and", [_not(_primitive(*m.groups()[1:])) if m.group(1) else _primitive(*m.groups()[1:]) for m in found])

    return _joined("and", [_joined("or", [part(w) for w in words.split(",")]) for words in text.removeprefix("[").removesuffix("]").split(";")])


def _bond_test(text: str) -> Test:
    parts = []
    for word in text.split(";"):
        found = re.findall(r"(!?)([-=#:~@])", word)
        if text and "".join(a + b for a, b in found) != word:
            raise ValueError(f"unknown bond in a pattern: {text}")
        parts += [_not(_BOND[b]) if a else _BOND[b] for a, b in found] if text else [_BOND[""]]
    return _joined("and", parts)


def pattern(text: str) -> Pattern:
    """A pattern without alternatives, read from its text."""
    out, stack, last, bond = Pattern(), [], None, ""
    open_: dict[str, tuple[int, str]] = {}
    pieces = _PIECE.findall(text)
    if "".join(pieces) != text or not text:
        raise ValueError(f"unknown pattern: {text}")
    for p in pieces:
        if (not out.atoms and not (p[0].isalpha() or p[0] in "[*")) or (p == ")" and not stack):
            raise ValueError(f"unknown pattern: {text}")
        if p == "(":
            stack.append(last)
        elif p == ")":
            last = stack.pop()
        elif p[0] in "-=#:~@!;":
            bond = p
        elif p.lstrip("%").isdigit():
            if p in open_:
                start, mark = open_.pop(p)
                out.rings[last].append((start, _bond_test(bond or mark)))
            else:
                open_[p] = (last, bond)
            bond = ""
        else:
            out.atoms.append(_atom_test(p))
            out.before.append(None if last is None else (last, _bond_test(bond)))
            out.rings.append([])
            last, bond = len(out.atoms) - 1, ""
    if open_ or stack or bond:
        raise ValueError(f"unfinished pattern: {text}")
    return out


def _alternatives(text: str) -> list[str] | None:
    """The patterns of ``[$(...),$(...)]``, or none."""
    if not text.startswith("[$("):
        return None
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "(" and depth == 1:
            start = i + 1
        elif c == ")" and depth == 0:
            out.append(text[start:i])
    if "[" + ",".join(f"$({p})" for p in out) + "]" != text:
        raise ValueError(f"unknown pattern: {text}")
    return out


def _grown(p: Pattern, atoms: str) -> str:
    """Arrays of positions, one for each way to lay the pattern on a molecule."""
    at = lambda i: f"get({atoms}, {i})"
    found = f"transform(filter(sequence(0, size({atoms}) - 1), i -> {p.atoms[0](at('i'))}), i -> array(i))"
    for test, (parent, bond), rings in zip(p.atoms[1:], p.before[1:], p.rings[1:], strict=True):
        closed = [f"exists({at('e.to')}.near, r -> r.to = m[{start}] and {ring('r')})" for start, ring in rings]
        fits = " and ".join([bond("e"), "not array_contains(m, e.to)", test(at("e.to")), *closed])
        found = f"flatten(transform({found}, m -> transform(filter({at(f'm[{parent}]')}.near, e -> {fits}), e -> concat(m, array(e.to)))))"
    return found


def _covered(text: str, atoms: str) -> str:
    several = _alternatives(text)
    if several is None:
        return f"array_distinct(transform({_grown(pattern(text), atoms)}, m -> array_sort(m)))"
    first = ", ".join(f"transform({_grown(pattern(t), atoms)}, m -> m[0])" for t in several)
    return f"transform(array_distinct(concat({first})), i -> array(i))"


def matches(text: str, atoms: str = "atoms") -> Column:
    """Distinct sets of positions that a pattern covers in ``atoms`` of ``molecule_rows``; alternatives cover one atom."""
    return F.expr(_covered(text, atoms))


def _more(text: str, atoms: str, least: int) -> str:
    """Whether a pattern covers more than ``least`` sets of atoms."""
    one = None if _alternatives(text) else pattern(text)
    if one is not None and len(one.atoms) == 1:  # atoms are just counted
        return f"exists({atoms}, a -> {one.atoms[0]('a')})" if least == 0 else f"size(filter({atoms}, a -> {one.atoms[0]('a')})) > {least}"
    return f"size({_grown(one, atoms)}) > 0" if one is not None and least == 0 else f"size({_covered(text, atoms)}) > {least}"


def _bonds(atoms: Column, test: Callable[[Column], Column]) -> Column:
    """Number of bonds that pass a test."""
    return F.aggregate(atoms, F.lit(0), lambda n, a: n + F.size(F.filter(a["near"], test))) / 2


def _aromatic_rings(atoms: Column) -> Column:
    """Independent rings of aromatic ring bonds: bonds less atoms, plus the parts they form."""
    kept = lambda e: e["aromatic"] & e["ring"]
    near = F.transform(atoms, lambda a: F.filter(a["near"], kept))
    parts = _let(near, lambda ns: F.size(F.filter(_paths(ns), lambda p: F.size(p) == 1)))
    return _bonds(atoms, kept) - F.size(atoms) + parts  # an atom without such a bond is a part of its own


def _ring(n: int) -> str:
    return "[R]@1" + "@[R]" * (n - 1) + "1"


def pattern_keys(rows: DataFrame, rules: Mapping[int, tuple[str, int]]) -> DataFrame:
    """(mol_id, keys): the numbers, ascending, of the patterns that cover more than so many sets of atoms.

    ``rows`` come from ``molecule_rows``.  Two names stand for what no pattern says: ``aromatic rings`` and ``parts``.
    """

    own = {"aromatic rings": _aromatic_rings(F.col("atoms")), "parts": F.col("parts")}
    told = ", ".join(f"if({_more(text, 'ats', least)}, {k}, null)" for k, (text, least) in rules.items() if text not in own)
    others = [F.when(own[text] > least, k) for k, (text, least) in rules.items() if text in own]
    keys = F.concat(F.expr(f"transform(array(atoms), ats -> array({told}))[0]"), F.array(*others).cast("array<int>"))
    return rows.select("mol_id", F.array_sort(F.filter(keys, lambda k: k.isNotNull())).alias("keys"))


def key_columns(keys: DataFrame, n: int = 167) -> DataFrame:
    """(mol_id, bit0, bit1, ...): keys as columns of 0 and 1, for feature selection and learning."""
    return keys.select("mol_id", *[F.array_contains("keys", i).cast("int").alias(f"bit{i}") for i in range(n)])


def descriptors(rows: DataFrame) -> DataFrame:
    """(mol_id, counts and indices): what only the graph, the elements and the hydrogens decide.

    Atoms, heteroatoms, rings (independent ones), ring atoms, aromatic atoms, rotatable bonds (single, outside rings, between atoms with
    further bonds, none of them triple), donors (N or O with hydrogen), N and O, share of carbons with four single bonds,
    charge, connectivity indices of order 0 and 1, atom-bond connectivity and both Zagreb indices.
    """
    count = lambda test: F.size(F.filter("atoms", test))
    no = lambda a: a["element"].isin("N", "O")
    degree = lambda a: F.size(a["near"]).cast("double")
    inner = lambda a: (F.size(a["near"]) > 1) & ~F.exists(a["near"], lambda e: e["order"] == 3)
    total = lambda f: F.aggregate("atoms", F.lit(0.0), lambda s, a: s + f(a))
    # every bond is met from both ends
    pairs = lambda f: total(lambda a: F.aggregate(a["near"], F.lit(0.0), lambda s, e: s + f(degree(a), degree(F.get(F.col("atoms"), e["to"]))))) / 2
    turning = F.aggregate("atoms", F.lit(0), lambda s, a: s + F.when(inner(a), F.size(F.filter(a["near"], lambda e: (e["order"] == 1) & ~e["aromatic"] & ~e["ring"] & inner(F.get(F.col("atoms"), e["to"]))))).otherwise(0))
    carbons, saturated = count(lambda a: a["element"] == "C"), count(lambda a: (a["element"] == "C") & ~a["aromatic"] & ~F.exists(a["near"], lambda e: e["order"] > 1))
    told = {
        "n_atoms": F.size("atoms"),
        "n_hetero": count(lambda a: ~a["element"].isin("C", "H")),
        "n_rings": (_bonds(F.col("atoms"), lambda e: F.lit(True)) - F.size("atoms") + F.col("parts")).cast("int"),
        "n_ring_atoms": count(lambda a: a["ring"]),
        "n_aromatic": count(lambda a: a["aromatic"]),
        "n_rotatable": (turning / 2).cast("int"),
        "n_donors": count(lambda a: no(a) & (a["hydrogens"] > 0)),
        "n_no": count(no),
        "share_sp3": F.when(carbons > 0, saturated / carbons).otherwise(0.0),
        "charge": F.aggregate("atoms", F.lit(0), lambda s, a: s + a["charge"]),
        "chi0": total(lambda a: F.when(degree(a) > 0, 1 / F.sqrt(degree(a))).otherwise(0.0)),
        "chi1": pairs(lambda x, y: 1 / F.sqrt(x * y)),
        "abc": pairs(lambda x, y: F.sqrt((x + y - 2) / (x * y))),
        "zagreb1": total(lambda a: degree(a) * degree(a)),
        "zagreb2": pairs(lambda x, y: x * y),
    }
    return rows.select("mol_id", *[c.alias(name) for name, c in told.items()])

# ---- canonical order ------------------------------------------------------------------------------


def _dense(values: Column) -> Column:
    """Places of values among the distinct ones in order, from 1."""
    return _let(F.array_sort(F.array_distinct(values)), lambda known: F.transform(values, lambda v: F.array_position(known, v).cast("int")))


def _ranks(atoms: Column) -> Column:
    """A rank from 1 for every atom, which doesn't depend on the order of the atoms.

    Ranks are refined by those of the atoms around; where that tells no more atoms apart, one atom of the first tied rank goes first.
    Every round tells one more atom apart at least, so as many rounds as atoms are enough.
    """
    own = lambda a: F.struct(a["element"], a["isotope"], a["charge"], a["aromatic"], a["hydrogens"], F.size(a["near"]))

    def refined(now: Column) -> Column:
        around = lambda a: F.array_sort(F.transform(a["near"], lambda e: F.struct(e["order"], e["aromatic"], F.get(now, e["to"]).alias("rank"))))
        return _dense(F.transform(atoms, lambda a, i: F.struct(F.get(now, i).alias("rank"), around(a).alias("around"))))

    def parted(now: Column) -> Column:
        tied = F.array_min(F.filter(now, lambda r: F.size(F.filter(now, lambda q: q == r)) > 1))
        one = F.array_position(now, tied)
        return _dense(F.transform(now, lambda r, i: 2 * r + F.when(i + 1 == one, 0).otherwise(1)))

    def told(now: Column, _: Column) -> Column:
        grown = _let(refined(now), lambda new: F.when(F.array_max(new) > F.array_max(now), new).otherwise(parted(new)))
        return F.when(F.array_max(now) < F.size(now), grown).otherwise(now)

    return F.aggregate(F.sequence(F.lit(1), F.size(atoms)), _dense(F.transform(atoms, own)), told)


def canonical_rows(rows: DataFrame) -> DataFrame:
    """(mol_id, canonical_key, ranked): a key of each whole molecule, for joins and grouping, and its atoms in canonical order.

    The key hashes the atoms in canonical order with all their bonds, so molecules with one key are the same molecule.
    All numberings of a molecule have one key, but for rare graphs whose atoms look alike all round without being
    interchangeable.  ``ranked``: (element, isotope, charge, aromatic, hydrogens, implied, near), ``near``: (to, order, aromatic) by rank.
    """

    def whole(atoms: Column) -> Column:
        def listed(ranks: Column) -> Column:
            near = lambda a: F.array_sort(F.transform(a["near"], lambda e: F.struct(F.get(ranks, e["to"]).alias("to"), e["order"].alias("order"), e["aromatic"].alias("aromatic"))))
            atom = lambda a, i: F.struct(F.get(ranks, i).alias("rank"), *[a[c].alias(c) for c in ("element", "isotope", "charge", "aromatic", "hydrogens", "implied")], near(a).alias("near"))
            return F.array_sort(F.transform(atoms, atom))

        return _let(_ranks(atoms), listed)

    ranked = rows.select("mol_id", _let(F.col("atoms"), whole).alias("ranked"))
    return ranked.select("mol_id", F.md5(F.to_json("ranked").cast("binary")).alias("canonical_key"), "ranked")


def canonical_tables(canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, bonds) of ``canonical_rows`` for writing, numbered by rank; hydrogens are told where the valences don't imply them."""
    a = canonical.select("mol_id", F.explode("ranked").alias("a"))
    hydrogens = F.when(F.col("a.hydrogens") != F.col("a.implied"), F.col("a.hydrogens")).when((F.col("a.isotope") != 0) | (F.col("a.charge") != 0), F.col("a.hydrogens"))
    atoms = a.select("mol_id", F.col("a.rank").alias("atom_id"), "a.element", "a.isotope", "a.charge", "a.aromatic", hydrogens.alias("hydrogens"))
    bonds = a.select("mol_id", F.col("a.rank").alias("src"), F.explode("a.near").alias("e")).where("src < e.to")
    return atoms, bonds.select("mol_id", "src", F.col("e.to").alias("dst"), F.col("e.order").alias("bond_order"), "e.aromatic")


# ---- the keys -------------------------------------------------------------------------------------

# Key numbers, their patterns, and the number of matches that each has to exceed.
KEYS: dict[int, tuple[str, int]] = {
    2: ("[#104]", 0),
    3: ("[#32,#33,#34,#50,#51,#52,#82,#83,#84]", 0),
    4: ("[Ac,Th,Pa,U,Np,Pu,Am,Cm,Bk,Cf,Es,Fm,Md,No,Lr]", 0),
    5: ("[Sc,Ti,Y,Zr,Hf]", 0),
    6: ("[La,Ce,Pr,Nd,Pm,Sm,Eu,Gd,Tb,Dy,Ho,Er,Tm,Yb,Lu]", 0),
    7: ("[V,Cr,Mn,Nb,Mo,Tc,Ta,W,Re]", 0),
    8: ("[!#6;!#1]1~*~*~*~1", 0),
    9: ("[Fe,Co,Ni,Ru,Rh,Pd,Os,Ir,Pt]", 0),
    10: ("[Be,Mg,Ca,Sr,Ba,Ra]", 0),
    11: ("*1~*~*~*~1", 0),
    12: ("[Cu,Zn,Ag,Cd,Au,Hg]", 0),
    13: ("[#8]~[#7](~[#6])~[#6]", 0),
    14: ("[#16]-[#16]", 0),
    15: ("[#8]~[#6](~[#8])~[#8]", 0),
    16: ("[!#6;!#1]1~*~*~1", 0),
    17: ("[#6]#[#6]", 0),
    18: ("[#5,#13,#31,#49,#81]", 0),
    19: ("*1~*~*~*~*~*~*~1", 0),
    20: ("[#14]", 0),
    21: ("[#6]=[#6](~[!#6;!#1])~[!#6;!#1]", 0),
    22: ("*1~*~*~1", 0),
    23: ("[#7]~[#6](~[#8])~[#8]", 0),
    24: ("[#7]-[#8]", 0),
    25: ("[#7]~[#6](~[#7])~[#7]", 0),
    26: ("[#6]=;@[#6](@*)@*", 0),
    27: ("[I]", 0),
    28: ("[!#6;!#1]~[CH2]~[!#6;!#1]", 0),
    29: ("[#15]", 0),
    30: ("[#6]~[!#6;!#1](~[#6])(~[#6])~*", 0),
    31: ("[!#6;!#1]~[F,Cl,Br,I]", 0),
    32: ("[#6]~[#16]~[#7]", 0),
    33: ("[#7]~[#16]", 0),
    34: ("[CH2]=*", 0),
    35: ("[Li,Na,K,Rb,Cs,Fr]", 0),
    36: ("[#16R]", 0),
    37: ("[#7]~[#6](~[#8])~[#7]", 0),
    38: ("[#7]~[#6](~[#6])~[#7]", 0),
    39: ("[#8]~[#16](~[#8])~[#8]", 0),
    40: ("[#16]-[#8]", 0),
    41: ("[#6]#[#7]", 0),
    42: ("F", 0),
    43: ("[!#6;!#1;!H0]~*~[!#6;!#1;!H0]", 0),
    45: ("[#6]=[#6]~[#7]", 0),
    46: ("Br", 0),
    47: ("[#16]~*~[#7]", 0),
    48: ("[#8]~[!#6;!#1](~[#8])(~[#8])", 0),
    49: ("[!+0]", 0),
    50: ("[#6]=[#6](~[#6])~[#6]", 0),
    51: ("[#6]~[#16]~[#8]", 0),
    52: ("[#7]~[#7]", 0),
    53: ("[!#6;!#1;!H0]~*~*~*~[!#6;!#1;!H0]", 0),
    54: ("[!#6;!#1;!H0]~*~*~[!#6;!#1;!H0]", 0),
    55: ("[#8]~[#16]~[#8]", 0),
    56: ("[#8]~[#7](~[#8])~[#6]", 0),
    57: ("[#8R]", 0),
    58: ("[!#6;!#1]~[#16]~[!#6;!#1]", 0),
    59: ("[#16]!:*:*", 0),
    60: ("[#16]=[#8]", 0),
    61: ("*~[#16](~*)~*", 0),
    62: ("*@*!@*@*", 0),
    63: ("[#7]=[#8]", 0),
    64: ("*@*!@[#16]", 0),
    65: ("c:n", 0),
    66: ("[#6]~[#6](~[#6])(~[#6])~*", 0),
    67: ("[!#6;!#1]~[#16]", 0),
    68: ("[!#6;!#1;!H0]~[!#6;!#1;!H0]", 0),
    69: ("[!#6;!#1]~[!#6;!#1;!H0]", 0),
    70: ("[!#6;!#1]~[#7]~[!#6;!#1]", 0),
    71: ("[#7]~[#8]", 0),
    72: ("[#8]~*~*~[#8]", 0),
    73: ("[#16]=*", 0),
    74: ("[CH3]~*~[CH3]", 0),
    75: ("*!@[#7]@*", 0),
    76: ("[#6]=[#6](~*)~*", 0),
    77: ("[#7]~*~[#7]", 0),
    78: ("[#6]=[#7]", 0),
    79: ("[#7]~*~*~[#7]", 0),
    80: ("[#7]~*~*~*~[#7]", 0),
    81: ("[#16]~*(~*)~*", 0),
    82: ("*~[CH2]~[!#6;!#1;!H0]", 0),
    83: ("[!#6;!#1]1~*~*~*~*~1", 0),
    84: ("[NH2]", 0),
    85: ("[#6]~[#7](~[#6])~[#6]", 0),
    86: ("[C;H2,H3][!#6;!#1][C;H2,H3]", 0),
    87: ("[F,Cl,Br,I]!@*@*", 0),
    88: ("[#16]", 0),
    89: ("[#8]~*~*~*~[#8]", 0),
    90: ("[$([!#6;!#1;!H0]~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~[R]1@[R]@[CH2;R]1)]", 0),
    91: ("[$([!#6;!#1;!H0]~*~*~*~[CH2]~*),$([!#6;!#1;!H0;R]1@[R]@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~[R]1@[R]@[R]@[CH2;R]1),$([!#6;!#1;!H0]~*~[R]1@[R]@[CH2;R]1)]", 0),
    92: ("[#8]~[#6](~[#7])~[#6]", 0),
    93: ("[!#6;!#1]~[CH3]", 0),
    94: ("[!#6;!#1]~[#7]", 0),
    95: ("[#7]~*~*~[#8]", 0),
    96: ("*1~*~*~*~*~1", 0),
    97: ("[#7]~*~*~*~[#8]", 0),
    98: ("[!#6;!#1]1~*~*~*~*~*~1", 0),
    99: ("[#6]=[#6]", 0),
    100: ("*~[CH2]~[#7]", 0),
    102: ("[!#6;!#1]~[#8]", 0),
    103: ("Cl", 0),
    104: ("[!#6;!#1;!H0]~*~[CH2]~*", 0),
    105: ("*@*(@*)@*", 0),
    106: ("[!#6;!#1]~*(~[!#6;!#1])~[!#6;!#1]", 0),
    107: ("[F,Cl,Br,I]~*(~*)~*", 0),
    108: ("[CH3]~*~*~*~[CH2]~*", 0),
    109: ("*~[CH2]~[#8]", 0),
    110: ("[#7]~[#6]~[#8]", 0),
    111: ("[#7]~*~[CH2]~*", 0),
    112: ("*~*(~*)(~*)~*", 0),
    113: ("[#8]!:*:*", 0),
    114: ("[CH3]~[CH2]~*", 0),
    115: ("[CH3]~*~[CH2]~*", 0),
    116: ("[$([CH3]~*~*~[CH2]~*),$([CH3]~*1~*~[CH2]1)]", 0),
    117: ("[#7]~*~[#8]", 0),
    118: ("[$(*~[CH2]~[CH2]~*),$(*1~[CH2]~[CH2]1)]", 1),
    119: ("[#7]=*", 0),
    120: ("[!#6;R]", 1),
    121: ("[#7;R]", 0),
    122: ("*~[#7](~*)~*", 0),
    123: ("[#8]~[#6]~[#8]", 0),
    124: ("[!#6;!#1]~[!#6;!#1]", 0),
    126: ("*!@[#8]!@*", 0),
    127: ("*@*!@[#8]", 1),
    128: ("[$(*~[CH2]~*~*~*~[CH2]~*),$([R]1@[CH2;R]@[R]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[R]@[CH2;R]1),$(*~[CH2]~*~[R]1@[R]@[CH2;R]1)]", 0),
    129: ("[$(*~[CH2]~*~*~[CH2]~*),$([R]1@[CH2]@[R]@[R]@[CH2;R]1),$(*~[CH2]~[R]1@[R]@[CH2;R]1)]", 0),
    130: ("[!#6;!#1]~[!#6;!#1]", 1),
    131: ("[!#6;!#1;!H0]", 1),
    132: ("[#8]~*~[CH2]~*", 0),
    133: ("*@*!@[#7]", 0),
    134: ("[F,Cl,Br,I]", 0),
    135: ("[#7]!:*:*", 0),
    136: ("[#8]=*", 1),
    137: ("[!C;!c;R]", 0),
    138: ("[!#6;!#1]~[CH2]~*", 1),
    139: ("[O;!H0]", 0),
    140: ("[#8]", 3),
    141: ("[CH3]", 2),
    142: ("[#7]", 1),
    143: ("*@*!@[#8]", 0),
    144: ("*!:*:*!:*", 0),
    145: ("*1~*~*~*~*~*~1", 1),
    146: ("[#8]", 2),
    147: ("[$(*~[CH2]~[CH2]~*),$([R]1@[CH2;R]@[CH2;R]1)]", 0),
    148: ("*~[!#6;!#1](~*)~*", 0),
    149: ("[C;H3,H4]", 1),
    150: ("*!@*@*!@*", 0),
    151: ("[#7;!H0]", 0),
    152: ("[#8]~[#6](~[#6])~[#6]", 0),
    153: ("[!#6;!#1]~[CH2]~*", 0),
    154: ("[#6]=[#8]", 0),
    155: ("*!@[CH2]!@*", 0),
    156: ("[#7]~*(~*)~*", 0),
    157: ("[#6]-[#8]", 0),
    158: ("[#6]-[#7]", 0),
    159: ("[#8]", 1),
    160: ("[C;H3,H4]", 0),
    161: ("[#7]", 0),
    162: ("a", 0),
    163: ("*1~*~*~*~*~*~1", 0),
    164: ("[#8]", 0),
    165: ("[R]", 0),
}
# Keys without a pattern of their own; 1 and 44 are never set.
KEYS |= {101: ("[" + ",".join(f"$({_ring(n)})" for n in range(8, 15)) + "]", 0), 125: ("aromatic rings", 1), 166: ("parts", 1)}
