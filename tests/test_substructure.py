"""Substructure keys and descriptors: known molecules, brute force over all placings, odd rows."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from scopespark.operators import substructure as S
from scopespark.plans import lifecycles
from scopespark.sources.molecules import read_lines

# keys set, as the operator gave them first and then read over by hand against the patterns
KEYS = {
    "C": [160],
    "CCO": [82, 109, 114, 139, 153, 155, 157, 160, 164],
    "c1ccccc1": [162, 163, 165],
    "C1CCC1": [11, 118, 147, 165],
    "c1ccccc1-c1ccccc1": [62, 125, 145, 162, 163, 165],
    "CC(=O)O": [123, 139, 154, 157, 159, 160, 164],
    "CC.O": [139, 149, 160, 164, 166],
    "N#CC": [41, 160, 161],
    "FC(F)(F)C=C": [34, 42, 99, 106, 107, 112, 134],
    "C1CCCCCCC1": [101, 118, 128, 129, 147, 165],
}


def _rows(spark, lines):
    atoms, bonds, _ = read_lines(spark.createDataFrame(list(enumerate(lines)), "k int, line string"), "k", "line")
    return S.molecule_rows(atoms, bonds)


def test_keys_read_over(spark):
    got = {r["mol_id"]: r["keys"] for r in S.pattern_keys(_rows(spark, KEYS), S.KEYS).collect()}
    assert [got[i] for i in range(len(KEYS))] == list(KEYS.values())


def test_hydrogens_and_rings(spark):
    lines = ["CCO", "c1ccccc1C", "c1cc[nH]c1", "C1CC1CC1CC1", "[NH3+]CC", "CN(=O)=O", "c1ccncc1", "C[S](C)C", "[Fe]C"]
    rows = {r["mol_id"]: r["atoms"] for r in _rows(spark, lines).collect()}
    told = [[a["hydrogens"] for a in rows[i]] for i in range(len(lines))]
    assert told[:3] == [[3, 2, 1], [1, 1, 1, 1, 1, 0, 3], [1, 1, 1, 1, 1]]
    assert told[4:] == [[3, 2, 3], [3, 0, 0, 0], [1, 1, 1, 0, 1, 1], [3, 0, 3, 3], [0, 3]]
    assert [a["ring"] for a in rows[3]] == [True, True, True, False, True, True, True]
    bridge = sorted((i, e["to"]) for i, a in enumerate(rows[3]) for e in a["near"] if not e["ring"])
    assert bridge == [(2, 3), (3, 2), (3, 4), (4, 3)]


# pattern, its atoms as sets of elements (None: any), its bonds as orders (None: any)
FORMS = {
    "[#8]~*~[#7]": (["O", None, "N"], {(0, 1): None, (1, 2): None}),
    "[#6]=[#6](~*)~*": (["C", "C", None, None], {(0, 1): 2, (1, 2): None, (1, 3): None}),
    "*1~*~*~1": ([None] * 3, {(0, 1): None, (1, 2): None, (2, 0): None}),
    "*1~*~*~*~1": ([None] * 4, {(0, 1): None, (1, 2): None, (2, 3): None, (3, 0): None}),
    "[#7]~[#6](-[#8])~[#7]": (["N", "C", "O", "N"], {(0, 1): None, (1, 2): 1, (1, 3): None}),
    "[#7]=[#8]": (["N", "O"], {(0, 1): 2}),
}


def _graph(rng):
    n = rng.randrange(1, 9)
    bonds = {(a, b): rng.choice([1, 1, 2]) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3}
    return [rng.choice(["C", "N", "O"]) for _ in range(n)], bonds


def _tables(spark, graphs):
    ids = [rng for rng in range(len(graphs))]
    atoms = [(m, i * 7 + 3, e) for m in ids for i, e in enumerate(graphs[m][0])]
    bonds = [(m, b * 7 + 3, a * 7 + 3, o) for m in ids for (a, b), o in graphs[m][1].items()]
    return spark.createDataFrame(atoms, "mol_id int, atom_id int, element string"), spark.createDataFrame(bonds, "mol_id int, src int, dst int, bond_order int")


def _placings(graph, form):
    elements, bonds = graph
    wanted, links = form
    order = lambda a, b: bonds.get((min(a, b), max(a, b)))
    for at in itertools.permutations(range(len(elements)), len(wanted)):
        if all(w is None or elements[x] == w for w, x in zip(wanted, at, strict=True)):
            if all(order(at[i], at[j]) is not None and o in (None, order(at[i], at[j])) for (i, j), o in links.items()):
                yield frozenset(at)


def _bridges(graph):
    """Parts of a graph, with and without each bond."""
    elements, bonds = graph

    def parts(kept):
        left, n = set(range(len(elements))), 0
        while left:
            stack, n = [left.pop()], n + 1
            while stack:
                x = stack.pop()
                near = {b if a == x else a for a, b in kept if x in (a, b)} & left
                left -= near
                stack += near
        return n

    return parts(bonds), {e for e in bonds if parts(bonds.keys() - {e}) > parts(bonds)}


def test_brute_force(spark):
    rng = random.Random(7)
    graphs = [_graph(rng) for _ in range(150)]
    rows = S.molecule_rows(*_tables(spark, graphs))
    told = rows.select("mol_id", "parts", F.transform("atoms", lambda a: F.transform(F.filter(a["near"], lambda e: e["ring"]), lambda e: e["to"])).alias("ring"), *[F.size(S.matches(p)).alias(str(i)) for i, p in enumerate(FORMS)])
    for r in told.collect():
        graph = graphs[r["mol_id"]]
        assert [r[str(i)] for i in range(len(FORMS))] == [len(set(_placings(graph, f))) for f in FORMS.values()]
        parts, bridges = _bridges(graph)
        assert r["parts"] == parts
        assert {tuple(sorted((i, x))) for i, xs in enumerate(r["ring"]) for x in xs} == set(graph[1]) - bridges
    sums = [told.agg(F.sum(str(i))).first()[0] for i in range(len(FORMS))]
    assert all(s > 0 for s in sums)


def test_descriptors_by_hand(spark):
    lines = ["OCC(N)C(=O)O", "c1ccc2ccccc2c1", "CC.O", "C#CC", "CCCC"]
    got = {r["mol_id"]: r for r in S.descriptors(_rows(spark, lines)).collect()}
    told = lambda i, *cs: tuple(got[i][c] for c in cs)
    assert told(0, "n_atoms", "n_hetero", "n_rings", "n_rotatable", "n_donors", "n_no") == (7, 4, 0, 2, 3, 4)
    assert told(1, "n_rings", "n_ring_atoms", "n_aromatic", "zagreb1", "zagreb2", "share_sp3") == (2, 10, 10, 50, 57, 0)
    assert told(2, "n_atoms", "n_rings", "chi0", "chi1", "abc") == (3, 0, 2, 1, 0)
    assert told(3, "n_rotatable", "share_sp3") == (0, pytest.approx(1 / 3))
    assert told(4, "n_rotatable", "chi1", "abc") == (1, pytest.approx(2 / 2**0.5 + 0.5), pytest.approx(3 / 2**0.5))


def test_odd_rows(spark):
    atoms = spark.createDataFrame([(1, 5, "C", "x"), (1, 5, "C", "y"), (1, 6, None, "x"), (None, 1, "C", "x"), (1, None, "C", "x"), (2, 1, "O", "x")], "mol_id int, atom_id int, element string, near string")
    bonds = spark.createDataFrame([(1, 5, 6, 1), (1, 6, 5, 2), (1, 5, 5, 1), (1, 5, 9, 1), (1, None, 5, 1), (3, 1, 2, 1), (None, 1, 2, 1)], "mol_id int, src int, dst int, bond_order int")
    rows = {r["mol_id"]: r for r in S.molecule_rows(atoms, bonds).collect()}
    assert set(rows) == {1, 2}
    assert [[(e["to"], e["order"]) for e in a["near"]] for a in rows[1]["atoms"]] == [[(1, 2)], [(0, 2)]]
    assert [a["hydrogens"] for a in rows[1]["atoms"]] == [2, 0] and rows[2]["atoms"][0]["near"] == []
    none = S.molecule_rows(atoms.limit(0), bonds)
    assert S.pattern_keys(none, {1: ("C", 0)}).count() == S.descriptors(none).count() == 0


@pytest.mark.parametrize("text", ["", "C(", "C1CC", "[Q!]", "C$C", "[$(C)C]", "[C,]", "C=", "[#6", "C)C", "~C"])
def test_bad_patterns(spark, text):
    with pytest.raises(ValueError, match="pattern"):
        S.matches(text)


def test_long_molecule(spark):
    rows = _rows(spark, ["C1" + "C" * 400 + "1O"])
    out = S.pattern_keys(rows, {k: S.KEYS[k] for k in (11, 82, 101, 139, 157, 165)}).first()
    assert out["keys"] == [82, 139, 157, 165][1:] and S.descriptors(rows).first()["n_ring_atoms"] == 401


def test_line_features(spark):
    rows = [(1, "CCO"), (2, " CCO "), (3, "C1CC"), (4, None), (5, ""), (None, "c1ccccc1"), (1, "CCO")]
    out, failed = lifecycles.line_features(spark.createDataFrame(rows, "near int, line string"), "near", "line")
    got = sorted(((r["near"], r["bit139"], r["bit162"], r["n_atoms"]) for r in out.collect()), key=str)
    assert got == [(1, 1, 0, 3), (1, 1, 0, 3), (2, 1, 0, 3), (None, 0, 1, 6)]
    assert [tuple(r) for r in failed.collect()] == [(3, "C1CC")]
    assert len(out.columns) == 1 + 167 + 15


def _isomorphic(one, two):
    if sorted(one[0]) != sorted(two[0]) or sorted(one[1].values()) != sorted(two[1].values()):
        return False
    for at in itertools.permutations(range(len(one[0]))):
        if all(one[0][i] == two[0][x] for i, x in enumerate(at)) and all(two[1].get((min(at[a], at[b]), max(at[a], at[b]))) == o for (a, b), o in one[1].items()):
            return True
    return False


def test_canonical_keys_by_brute_force(spark):
    rng = random.Random(3)
    graphs = [g for g in (_graph(rng) for _ in range(120)) if len(g[0]) <= 6]
    graphs = [([x if rng.random() < 0.2 else "C" for x in e], b) for e, b in graphs]
    shuffled = []
    for elements, bonds in graphs:
        at = rng.sample(range(len(elements)), len(elements))
        named = {x: e for x, e in zip(at, elements, strict=True)}
        shuffled.append(([named[i] for i in range(len(elements))], {(min(at[a], at[b]), max(at[a], at[b])): o for (a, b), o in bonds.items()}))
    both = graphs + shuffled
    keys = {r["mol_id"]: r["canonical_key"] for r in S.canonical_rows(S.molecule_rows(*_tables(spark, both))).collect()}
    n = len(graphs)
    assert all(keys[i] == keys[i + n] for i in range(n))
    same = 0
    for i, j in itertools.combinations(range(n), 2):
        iso = _isomorphic(both[i], both[j])
        same += iso
        assert (keys[i] == keys[j]) == iso
    assert same > 10


def test_canonical_lines(spark):
    groups = [
        ["CCO", "OCC", "C(O)C", "[CH3]CO"],
        ["c1ccccc1C", "Cc1ccccc1"],
        ["C1CCC2CCCCC2C1", "C1CCCC2C1CCCC2"],
        ["C1CCCC1C1CCCC1"],
        ["CC.O", "O.CC"],
        ["[13CH4]"],
        ["C", " [CH4] "],
        ["[CH3]"],
        ["[O-]CC[NH3+]", "[NH3+]CC[O-]"],
        ["c1cc[nH]c1", "[nH]1cccc1"],
        ["N" + "C" * 120, "C" * 120 + "N"],
    ]
    rows = [(g, line) for g, lines in enumerate(groups) for line in lines]
    out, failed = lifecycles.canonical_lines(spark.createDataFrame([*rows, (99, "C("), (99, None)], "ranked int, line string"), "ranked", "line")
    got = out.collect()
    assert [tuple(r) for r in failed.collect()] == [(99, "C(")] and len(got) == len(rows)
    keys = {g: {r["canonical_key"] for r in got if r["ranked"] == g} for g in range(len(groups))}
    assert all(len(k) == 1 for k in keys.values()) and len(set.union(*keys.values())) == len(groups)
    lines = {r["ranked"]: r["canonical_line"] for r in got}
    assert lines.pop(len(groups) - 1) is None
    again, bad = lifecycles.canonical_lines(spark.createDataFrame(list(lines.items()), "ranked int, line string"), "ranked", "line")
    for r in again.collect():
        assert {r["canonical_key"]} == keys[r["ranked"]] and r["canonical_line"] == lines[r["ranked"]]
    assert bad.count() == 0


@pytest.mark.parametrize("chain", [lifecycles.line_features, lifecycles.canonical_lines])
def test_chains_without_molecules(spark, chain):
    rows = spark.createDataFrame([(1, None), (2, "  "), (3, "C(")], "k int, line string")
    for df, n in ((rows, 1), (rows.limit(0), 0)):
        out, failed = chain(df, "k", "line")
        assert out.count() == 0 and failed.count() == n
