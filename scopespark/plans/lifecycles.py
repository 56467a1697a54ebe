"""The chains of the engine, as composed plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scopespark.functions.columns import Roles, apply_roles, union_common
from scopespark.operators import graph, substructure
from scopespark.operators.clean import align_yield, screen_records
from scopespark.operators.features import kmeans, pca, scores, select_features
from scopespark.operators.grouped import split_routes
from scopespark.operators.learn import evaluate_gbt, tune_gbt
from scopespark.operators.lookup import classify_scope
from scopespark.session import spool
from scopespark.sources.molecules import read_lines, write_lines


def route_tables(raw: DataFrame, roles: Roles, chemistry: str, terms: Sequence[str], routes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Literature table to one mean value per route and id."""
    rows = apply_roles(raw, roles).withColumn("yield", align_yield(F.col("yield_num"), F.col("yield_text")))
    return split_routes(rows, chemistry, terms, routes, ["reference", "link"], carry=["reference", "link"])


def scope_map(features: Mapping[str, DataFrame], scopes: DataFrame, key: str, cuts: Sequence[float], k: int, offset: float = 0.0) -> DataFrame:
    """Feature tables and scopes to a classified, clustered two-dimensional map."""
    joined, _ = union_common(features, key)
    kept, _ = select_features(joined.na.drop(), key)
    columns = [c for c in kept.columns if c != key]
    placed = kmeans(scores(kept, pca(kept, columns, 2), 2, offset), ["PCA1", "PCA2"], k)
    return classify_scope(placed.select(F.col(key).alias("key"), "PCA1", "PCA2", "cluster"), scopes, cuts)


def regression(features: Mapping[str, DataFrame], key: str, target: str, grid: Mapping[str, Sequence], folds: int = 5, repeats: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature tables to (voted parameters, metrics, importances)."""
    joined, _ = union_common(features, key, target)
    rows = joined.na.drop()
    columns = [c for c in rows.columns if c not in (key, target)]
    _, votes = tune_gbt(rows, columns, target, key, grid, folds, repeats)
    kinds = {name: {str(v): v for v in values} for name, values in grid.items()}
    best = {r["param"]: kinds[r["param"]][r["value"]] for r in votes.collect()}  # one row per parameter
    return votes, *evaluate_gbt(rows, columns, target, key, best, folds)


def _double_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, a, b, n): double bonds between two carbons that aren't aromatic."""
    return graph.anchors(bonds.where(~F.col("aromatic")), atoms)


def cleaned_lines(rows: DataFrame, key: str, line: str) -> tuple[DataFrame, DataFrame]:
    """((mol_id, variant, line), (mol_id, line)): molecules with one double bond, and the lines that don't parse.

    Lines are screened; of what is kept, molecules without a double bond between carbons go, and one with several
    becomes as many variants, each keeping one of them.
    """
    status, _, fragment = screen_records(F.col(line))
    kept = rows.select(F.col(key).alias("mol_id"), status, fragment).where(F.col("status") == "keep")
    atoms, bonds, failed = read_lines(kept, "mol_id", "fragment")
    parts = graph.parts_for(bonds)
    atoms, bonds = graph.colocated(atoms, parts), graph.colocated(bonds, parts)
    found = _double_bonds(atoms, bonds)
    of = F.struct("mol_id", "variant")
    named = graph.knockout_variants(bonds, found, "aromatic").withColumn("of", of).drop("mol_id").withColumnRenamed("of", "mol_id")
    turns = found.groupBy("mol_id").agg(F.sequence(F.lit(1), F.count("*").cast("int")).alias("turns"))
    own = atoms.join(turns.hint("merge"), "mol_id").withColumn("variant", F.explode("turns")).withColumn("of", of).drop("mol_id", "variant", "turns").withColumnRenamed("of", "mol_id")
    return write_lines(own, named).select("mol_id.mol_id", "mol_id.variant", "line"), failed


def motif_lines(atoms: DataFrame, bonds: DataFrame, r: int) -> DataFrame:
    """(mol_id, motif_key, n_atoms, line): what lies within r bonds of the only double bond of each molecule.

    Atoms on the border are written as ``*``; aromatic systems that are only partly inside count as single bonds.
    """
    bonds = graph.colocated(bonds)
    found = _double_bonds(atoms, bonds).where("n = 1").select("mol_id", "a", "b")
    whole = graph.break_rings_around(bonds, found, r)
    marks = graph.around(bonds, found, r, "inner").select("mol_id", F.transform("inside", lambda x: x["atom"]).alias("inside"), "border")
    among = lambda name, atom: F.coalesce(F.array_contains(name, F.col(atom)), F.lit(False))
    own_bonds = whole.join(marks.hint("merge"), "mol_id").where(among("inside", "src") & among("inside", "dst")).select(*whole.columns)
    aromatic = graph.atoms_of(own_bonds.where("aromatic").select("mol_id", F.explode(F.array("src", "dst")).alias("atom_id")), "atom_id", "still")
    own = atoms.join(marks.hint("merge"), "mol_id").join(aromatic.hint("merge"), "mol_id", "left").where(among("inside", "atom_id"))
    star, still = among("border", "atom_id"), among("still", "atom_id")
    cleared = {"element": F.when(star, "*").otherwise(F.col("element")), "aromatic": ~star & still, "isotope": F.when(star, 0).otherwise(F.col("isotope")), "charge": F.when(star, 0).otherwise(F.col("charge")), "hydrogens": F.when(~star, F.col("hydrogens"))}
    text = write_lines(own.withColumns(cleared).drop("inside", "border", "still"), own_bonds)
    return graph.motifs(whole, found, r, atoms).join(text.hint("merge"), "mol_id").select("mol_id", "motif_key", "n_atoms", "line")


def line_features(rows: DataFrame, key: str, line: str, keys: int = 167) -> tuple[DataFrame, DataFrame]:
    """((key, bit0, bit1, ..., descriptors), (key, line)): lines to a feature table, and the lines that don't parse.

    Every distinct line is read and described once, however many rows hold it.  Rows with a null key keep it; null and empty
    lines are in neither table.
    """
    own = rows.select(F.col(key).alias("__key"), F.trim(F.col(line)).alias("mol_id"))
    atoms, bonds, failed = read_lines(own.select("mol_id").distinct(), "mol_id", "mol_id")
    parts = graph.parts_for(atoms)
    told = spool(substructure.molecule_rows(graph.colocated(atoms, parts), graph.colocated(bonds, parts)), "molecule_rows")  # read for keys and for descriptors
    bits = substructure.key_columns(substructure.pattern_keys(told, substructure.KEYS), keys)
    features = bits.join(substructure.descriptors(told).hint("merge"), "mol_id")
    named = lambda df: df.withColumnRenamed("__key", key)
    return named(own.join(features.hint("merge"), "mol_id").drop("mol_id")), named(own.join(failed.select("mol_id").hint("merge"), "mol_id", "left_semi").select("__key", F.col("mol_id").alias("line")))


def canonical_lines(rows: DataFrame, key: str, line: str) -> tuple[DataFrame, DataFrame]:
    """((key, canonical_key, canonical_line), (key, line)): one key and one line for all ways to write a molecule.

    Every distinct line is read once; rows with a null key keep it, null and empty lines are in neither table.  Molecules of more than
    99 bonds have a key and a null line.
    """
    own = rows.select(F.col(key).alias("__key"), F.trim(F.col(line)).alias("mol_id"))
    atoms, bonds, failed = read_lines(own.select("mol_id").distinct(), "mol_id", "mol_id")
    parts = graph.parts_for(atoms)
    told = spool(substructure.canonical_rows(substructure.molecule_rows(graph.colocated(atoms, parts), graph.colocated(bonds, parts))), "canonical")
    size = F.aggregate("ranked", F.lit(0), lambda n, a: n + F.size(a["near"])) / 2
    text = write_lines(*substructure.canonical_tables(told.where(size <= 99))).withColumnRenamed("line", "canonical_line")
    named = lambda df: df.withColumnRenamed("__key", key)
    out = own.join(told.select("mol_id", "canonical_key").hint("merge"), "mol_id").join(text.hint("merge"), "mol_id", "left").drop("mol_id")
    return named(out), named(own.join(failed.select("mol_id").hint("merge"), "mol_id", "left_semi").select("__key", F.col("mol_id").alias("line")))
