"""Line notation: reading by hand-worked lines, round trips, cleaning, motifs, and the stream's third sink."""

import random

import pytest
from pyspark.sql import functions as F

from scopespark.plans import lifecycles
from scopespark.sources import molecules
from scopespark.streaming.screening import screen_stream

LINES = {
    "C/C=C\\C": (["C"] * 4, [(0, 1, 1), (1, 2, 2), (2, 3, 1)]),
    "C1CC1C(=O)[O-]": (["C"] * 4 + ["O"] * 2, [(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 4, 2), (3, 5, 1)]),
    "ClC(Br)(I)C#N": (["Cl", "C", "Br", "I", "C", "N"], [(0, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1), (4, 5, 3)]),
    "C%12CC=%12": (["C"] * 3, [(0, 1, 1), (0, 2, 2), (1, 2, 1)]),
    "C1.C1": (["C"] * 2, [(0, 1, 1)]),
    "C12CC1CC2": (["C"] * 5, [(0, 1, 1), (0, 2, 1), (0, 4, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)]),
    "[13CH2]=C[NH3+]": (["C", "C", "N"], [(0, 1, 2), (1, 2, 1)]),
    "[Fe+2].[OH-]": (["Fe", "O"], []),
}
BAD = ["CC(", "C1CC", "C==C", "(C)C", "C)", "[Xx", "C=1CC#1", "C11", "é", "C=", "=C", "C(=)C", "C..C", "plain words", "CX", "[C", "C]", "C%1", "."]


def _read(spark, lines):
    atoms, bonds, failed = molecules.read_lines(spark.createDataFrame(list(enumerate(lines)), "k int, line string"), "k", "line")
    a, b = {}, {}
    for r in atoms.orderBy("mol_id", "atom_id").collect():
        a.setdefault(r["mol_id"], []).append(r)
    for r in bonds.collect():
        b.setdefault(r["mol_id"], []).append((r["src"], r["dst"], r["bond_order"]))
    return a, {k: sorted(v) for k, v in b.items()}, {r["mol_id"] for r in failed.collect()}, atoms, bonds


def test_read_lines(spark):
    a, b, failed, _, _ = _read(spark, [*LINES, *BAD, None, "", "  "])
    for i, (elements, bonds) in enumerate(LINES.values()):
        assert [r["element"] for r in a[i]] == elements and b.get(i, []) == bonds
    assert failed == set(range(len(LINES), len(LINES) + len(BAD)))
    assert [(r["isotope"], r["charge"], r["hydrogens"]) for r in a[6]] == [(13, 0, 2), (0, 0, None), (0, 1, 3)]
    assert [r["charge"] for r in a[7]] == [2, -1]


def test_aromatic_bonds(spark):
    _, _, _, _, bonds = _read(spark, ["c1ccccc1-c1cc[nH]c1C"])
    rows = bonds.collect()
    assert sum(r["aromatic"] for r in rows) == 11 and [(r["src"], r["dst"]) for r in rows if not r["aromatic"]] == [(5, 6), (10, 11)]


def test_written_lines_read_the_same(spark):
    rng = random.Random(1)
    lines = list(LINES)
    for _ in range(60):  # trees with branches and a ring
        text = "".join(rng.choice(["C", "N", "O(C)", "C(=O)", "c1ccccc1", "C(C(F)Cl)", "S", "C2CC2", "[15N]", "=C"]) for _ in range(rng.randrange(1, 9)))
        lines.append(text.removeprefix("=").replace("==", "=") + "C")
    a, b, failed, atoms, bonds = _read(spark, lines)
    out = {r["mol_id"]: r["line"] for r in molecules.write_lines(atoms, bonds).collect()}
    good = [i for i in range(len(lines)) if i not in failed]
    a2, b2, failed2, _, _ = _read(spark, [out[i] for i in good])
    assert not failed2 and len(good) > 40
    for n, i in enumerate(good):
        assert b2.get(n, []) == b.get(i, [])
        keep = ("element", "isotope", "charge", "aromatic")
        assert [[r[c] for c in keep] for r in a2[n]] == [[r[c] for c in keep] for r in a[i]]


def test_too_many_bonds(spark):
    _, _, _, atoms, bonds = _read(spark, ["C" * 101])
    with pytest.raises(Exception, match="more than 99 bonds"):
        molecules.write_lines(atoms, bonds).collect()


def test_long_line(spark):
    a, b, failed, _, _ = _read(spark, ["C" * 3000 + "(" + "CO" * 500 + ")N"])
    assert not failed and len(a[0]) == 4001 and len(b[0]) == 4000


def test_cleaned_lines(spark):
    rows = [(1, "CC=CC"), (2, "C=CC=C"), (3, "CCC"), (4, "[Pd]C=C"), (5, "CC(C=C"), (6, "[13CH2]=CC"), (7, "C=CCC.CCO"), (8, "CC=O"), (9, "c1ccccc1"), (10, None), (11, "C=C[O-]")]
    out, failed = lifecycles.cleaned_lines(spark.createDataFrame(rows, "k int, line string"), "k", "line")
    told = sorted((r["mol_id"], r["variant"], r["line"]) for r in out.collect())
    assert [(m, v) for m, v, _ in told] == [(1, 1), (2, 1), (2, 2), (6, 1), (7, 1)]
    assert [t[2] for t in told[1:3]] == ["C=%01.C=%01%02.C%02%03.C%03", "C%01.C%01%02.C%02=%03.C=%03"]
    assert told[3][2] == "[CH2]=%01.C=%01%02.C%02"
    assert [r["mol_id"] for r in failed.collect()] == [5]


def test_motif_lines(spark):
    rows = [(1, "OCCC=CC"), (2, "NCCC=CC"), (3, "C=C"), (4, "c1ccccc1C=C"), (5, "C=CC=C"), (6, "CCCC=CC")]
    atoms, bonds, _ = molecules.read_lines(spark.createDataFrame(rows, "k int, line string"), "k", "line")
    out = {r["mol_id"]: r for r in lifecycles.motif_lines(atoms, bonds, 2).collect()}
    assert set(out) == {1, 2, 3, 4, 6}  # just one double bond
    assert out[1]["motif_key"] == out[2]["motif_key"] == out[6]["motif_key"] != out[3]["motif_key"]
    assert out[1]["line"] == "*%01.C%01%02.C%02=%03.C=%03%04.C%04" and out[3]["line"] == "C=%01.C=%01"
    assert "c" not in out[4]["line"] and out[4]["line"].count("*") == 2  # the ring is only partly inside
    read, _, bad = molecules.read_lines(spark.createDataFrame([(k, r["line"]) for k, r in out.items()], "k int, line string"), "k", "line")
    assert bad.count() == 0 and {r["mol_id"]: r["n"] for r in read.groupBy("mol_id").agg(F.count("*").alias("n")).collect()} == {k: r["n_atoms"] for k, r in out.items()}


def test_stream_parts_failed_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("C=CC\n\nC=C(\n[Pd]C=C\nC1CC\n")
    screen_stream(spark, *[str(tmp_path / x) for x in ("in", "out", "cp")], parse=True)
    count = lambda s: spark.read.parquet(str(tmp_path / "out" / s)).count()
    assert (count("keep"), count("reject"), count("failed")) == (1, 1, 2)
