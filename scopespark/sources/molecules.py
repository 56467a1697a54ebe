"""Molecules in line notation, as tables of atoms and bonds, in DataFrame functions only.

A line is cut into tokens by one pattern, and one fold over the tokens keeps the last atom, the pending bond, the
open branches and the open ring bonds.  Atoms count from 0 in the order of the line.  Bonds between two aromatic atoms
without a mark of their own are aromatic, with order 1.

Lines that don't parse (unknown text, unbalanced brackets, branches or rings, a bond without an end) come out as a table
of their own.  Valences aren't tested and stereo marks are read over; hydrogens are counted where a bracket tells them
and null where they are implied.  Null and empty lines are no molecules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scopespark.session import spool

# The tokens of the notation - bracketed atom, atom outside brackets, ring number, bond or branch mark.
BRACKET = r"\[[^\]]*\]"
ORGANIC = r"Br|Cl|[BCNOPSFI]|[bcnops]|\*"
TOKEN = rf"{BRACKET}|{ORGANIC}|%[0-9]{{2}}|[0-9]|[-=#$:/\\.()]|(?s:.)"
#: Isotope, symbol, stereo mark, hydrogens, charge and map number of a bracketed atom.
INSIDE = r"^\[([0-9]*)([A-Z][a-z]?|[a-z][a-z]?|\*)@{0,2}(H[0-9]*)?((?:\++|-+)[0-9]*)?(?::[0-9]+)?\]$"
# Orders of the bond marks; AROMATIC stands for the mark between aromatic atoms.
AROMATIC = 5
ORDERS = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": AROMATIC}

_BONDS = "array<struct<src:int,dst:int,order:int>>"
_OPEN = "array<struct<ring:int,atom:int,order:int>>"


_ATOM, _RING, _OPENS, _CLOSES, _DOT, _MARK = 1, 2, 3, 4, 5, 6
_SYMBOLS = ("Br", "Cl", *"BCNOPSFIbcnops*")


def _known() -> Column:
    """Kinds of the tokens outside brackets, as a constant map."""
    kinds = dict.fromkeys(_SYMBOLS, _ATOM) | dict.fromkeys("0123456789", _RING) | {"(": _OPENS, ")": _CLOSES, ".": _DOT} | dict.fromkeys(ORDERS, _MARK)
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])


def _sorted_out(t: Column) -> Column:
    """struct<text, kind, order, ring> of a token; kind 0 is unknown text.  Only brackets are taken apart by a pattern."""
    wide = F.when(t.startswith("[") & t.rlike(INSIDE), _ATOM).when(t.startswith("%") & (F.length(t) == 3), _RING).otherwise(0)
    kind = F.coalesce(F.try_element_at(_known(), t), wide)
    mark = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ORDERS.items() for x in pair]), t), F.lit(0))
    ring = F.coalesce(F.ltrim(t, F.lit("%")).try_cast("int"), F.lit(-1))
    return F.struct(t.alias("text"), kind.alias("kind"), mark.alias("order"), ring.alias("ring"))


def _atom(token: Column) -> Column:
    """struct<element, isotope, charge, aromatic, hydrogens> of an atom's token."""
    part = lambda i: F.regexp_extract(token, INSIDE, i)
    size = F.coalesce(F.substring(part(4), 2, 9).try_cast("int"), F.length(part(4)))
    size = F.when(part(4).rlike("[+-]{2}"), F.length(part(4))).otherwise(size)
    told = lambda symbol, isotope, charge, hydrogens: F.struct(F.initcap(symbol).alias("element"), isotope.alias("isotope"), charge.alias("charge"), ((F.lower(symbol) == symbol) & (symbol != "*")).alias("aromatic"), hydrogens.cast("int").alias("hydrogens"))
    inside = told(part(2), F.coalesce(part(1).try_cast("int"), F.lit(0)), F.when(part(4).startswith("-"), -size).otherwise(size), F.coalesce(F.substring(part(3), 2, 9).try_cast("int"), F.length(part(3))))
    return F.when(token.startswith("["), inside).otherwise(told(token, F.lit(0), F.lit(0), F.lit(None)))


def parsed(line: Column) -> Column:
    """struct<good, atoms, bonds> of a line."""
    tokens = F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))
    none = F.lit(-1)
    start = F.struct(
        F.lit(0).alias("n"),
        none.alias("last"),
        F.lit(0).alias("order"),
        F.expr("cast(array() as array<int>)").alias("stack"),
        F.expr(f"cast(array() as {_OPEN})").alias("open"),
        F.expr(f"cast(array() as {_BONDS})").alias("bonds"),
        F.lit(True).alias("good"),
    )

    def step(acc: Column, t: Column) -> Column:
        n, last, order, kind = acc["n"], acc["last"], acc["order"], t["kind"]
        is_ = lambda k: kind == k
        held = F.exists(acc["open"], lambda o: o["ring"] == t["ring"])
        end = F.element_at(F.filter(acc["open"], lambda o: o["ring"] == t["ring"]), 1)
        bond = lambda a, b, o: F.array(F.struct(a.alias("src"), b.alias("dst"), o.alias("order")))
        bonds = F.when(is_(_ATOM) & (last >= 0), F.concat(acc["bonds"], bond(last, n, order))).when(is_(_RING) & held, F.concat(acc["bonds"], bond(end["atom"], last, F.greatest(order, end["order"])))).otherwise(acc["bonds"])
        opened = F.concat(acc["open"], F.array(F.struct(t["ring"].alias("ring"), last.alias("atom"), order.alias("order"))))
        opened = F.when(~is_(_RING), acc["open"]).when(held, F.filter(acc["open"], lambda o: o["ring"] != t["ring"])).otherwise(opened)
        stack = F.when(is_(_OPENS), F.concat(acc["stack"], F.array(last))).when(is_(_CLOSES), F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).otherwise(acc["stack"])
        closes = (end["atom"] != last) & ((order == 0) | (end["order"] == 0) | (order == end["order"]))
        goes_on = (
            F.when(is_(_ATOM), True)
            .when(is_(_RING), (last >= 0) & F.when(held, closes).otherwise(True))
            .when(is_(_CLOSES), (F.size(acc["stack"]) > 0) & (order == 0))
            .otherwise((kind > 0) & (last >= 0) & (order == 0))
        )
        return F.struct(
            F.when(is_(_ATOM), n + 1).otherwise(n).alias("n"),
            F.when(is_(_ATOM), n).when(is_(_CLOSES), F.coalesce(F.try_element_at(acc["stack"], F.lit(-1)), none)).when(is_(_DOT), none).otherwise(last).alias("last"),
            t["order"].alias("order"),
            stack.alias("stack"),
            opened.alias("open"),
            bonds.alias("bonds"),
            (acc["good"] & goes_on).alias("good"),
        )

    def done(acc: Column) -> Column:
        whole = acc["good"] & (acc["n"] > 0) & (acc["last"] >= 0) & (acc["order"] == 0) & (F.size(acc["stack"]) == 0) & (F.size(acc["open"]) == 0)
        return F.struct(whole.alias("good"), acc["bonds"].alias("bonds"))

    def told(ts: Column) -> Column:
        atoms = F.transform(F.filter(ts, lambda t: t["kind"] == _ATOM), lambda t: _atom(t["text"]))
        return F.struct(F.aggregate(ts, start, step, done).alias("graph"), atoms.alias("atoms"))

    return F.element_at(F.transform(F.array(F.transform(tokens, _sorted_out)), told), 1)


def read_lines(df: DataFrame, key: str, line: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(atoms, bonds, failed) of lines, each molecule named by its key.

    ``atoms`` (mol_id, atom_id, element, isotope, charge, aromatic, hydrogens), ``bonds`` (mol_id, src, dst, bond_order, aromatic) with
    src below dst, ``failed`` (mol_id, line).  Keys have to be distinct.
    """
    lines = df.select(F.col(key).alias("mol_id"), F.trim(F.col(line)).alias("line")).where("line <> ''")
    rows = spool(lines.withColumn("m", parsed(F.col("line"))), "molecules")  # read for each of the three tables
    good = rows.where("m.graph.good")
    atoms = good.select("mol_id", F.posexplode("m.atoms").alias("atom_id", "a")).select("mol_id", "atom_id", "a.*")
    bonds = good.select("mol_id", F.col("m.atoms").alias("atoms"), F.explode("m.graph.bonds").alias("b"))
    both = F.get("atoms", F.col("b.src"))["aromatic"] & F.get("atoms", F.col("b.dst"))["aromatic"]
    aromatic = (F.col("b.order") == AROMATIC) | ((F.col("b.order") == 0) & both)
    order = F.when(aromatic | (F.col("b.order") == 0), 1).otherwise(F.col("b.order"))
    bonds = bonds.select("mol_id", F.least("b.src", "b.dst").alias("src"), F.greatest("b.src", "b.dst").alias("dst"), order.alias("bond_order"), aromatic.alias("aromatic"))
    return atoms, bonds, rows.where("not m.graph.good").select("mol_id", "line")


def write_lines(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, line): every atom by itself and every bond as a ring bond between two of them.

    Any reader of the notation takes such lines, though nobody writes them by hand.  A molecule has 99 bonds at most;
    more are an error.  Atoms stand in the order of their ids.
    """
    known = F.coalesce(*[F.when(F.col("bond_order") == o, F.lit(m)) for m, o in (("", 1), ("=", 2), ("#", 3), ("$", 4))], F.lit(""))
    mark = F.when(F.col("aromatic"), ":").otherwise(known) if "aromatic" in bonds.columns else known
    listed = bonds.select("mol_id", F.struct("src", "dst", mark.alias("mark")).alias("b")).groupBy("mol_id").agg(F.array_sort(F.collect_list("b")).alias("bonds"))
    listed = listed.withColumn("bonds", F.when(F.size("bonds") <= 99, F.col("bonds")).otherwise(F.raise_error(F.lit("more than 99 bonds")).cast(listed.schema["bonds"].dataType)))
    given = lambda c, other: F.col(c) if c in atoms.columns else F.lit(other)
    own = atoms.select("mol_id", F.struct("atom_id", "element", given("isotope", 0).alias("isotope"), given("charge", 0).alias("charge"), given("aromatic", False).alias("aromatic"), given("hydrogens", None).cast("int").alias("hydrogens")).alias("a"))
    rows = own.groupBy("mol_id").agg(F.array_sort(F.collect_list("a")).alias("atoms")).join(listed.hint("merge"), "mol_id", "left")

    def text(a: Column) -> Column:
        symbol = F.when(a["aromatic"], F.lower(a["element"])).otherwise(a["element"])
        charge = F.when(a["charge"] > 0, F.concat(F.lit("+"), a["charge"].cast("string"))).when(a["charge"] < 0, a["charge"].cast("string")).otherwise("")
        plain = symbol.rlike(rf"^(?:{ORGANIC})$") & (a["isotope"] == 0) & (a["charge"] == 0) & a["hydrogens"].isNull()
        hydrogens = F.when(a["hydrogens"] > 0, F.concat(F.lit("H"), a["hydrogens"].cast("string"))).otherwise("")
        word = F.when(plain, symbol).otherwise(F.concat(F.lit("["), F.when(a["isotope"] > 0, a["isotope"].cast("string")).otherwise(""), symbol, hydrogens, charge, F.lit("]")))
        ends = F.transform("bonds", lambda b, i: F.when((b["src"] == a["atom_id"]) | (b["dst"] == a["atom_id"]), F.concat(b["mark"], F.lit("%"), F.lpad((i + 1).cast("string"), 2, "0"))))
        return F.concat(word, F.coalesce(F.array_join(F.filter(ends, lambda e: e.isNotNull()), ""), F.lit("")))

    return rows.select("mol_id", F.array_join(F.transform("atoms", text), ".").alias("line"))
