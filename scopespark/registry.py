"""Registered queries of the engine and their DuckDB oracles, on the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scopespark.functions import columns as C
from scopespark.operators import boost, clean, features, graph, grouped, learn, lookup, sampling, substructure
from scopespark.plans import lifecycles
from scopespark.session import scratch_dir
from scopespark.sources import molecules, tables
from scopespark.streaming.screening import screen_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---- cleaning -------------------------------------------------------------------------------------

@_query("""WITH b AS (SELECT p_brand, p_name, p_retailprice, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part),
  m AS (SELECT p_brand, p_name, p_retailprice FROM b WHERE rn = 1 AND p_retailprice <= 100000)
  SELECT p.p_brand, m.p_name AS label, round(avg(p.p_retailprice), 4) AS mean_value, count(*) AS n_rows
  FROM part p JOIN m ON p.p_brand = m.p_brand WHERE jaro_winkler_similarity(p.p_name, m.p_name) >= 0.75 GROUP BY 1, 2""")
def representative(spark, sf):
    out = grouped.representative(_t(spark, sf, "part"), "p_brand", "p_retailprice", "p_name", ["p_partkey"], cap=100000)
    return out.select("p_brand", "label", F.round("mean_value", 4).alias("mean_value"), "n_rows")


@_query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE) + 1 ELSE NULL END AS aligned FROM part""")
def align_yield(spark, sf):
    k, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    num = F.when(k == 1, F.concat(s, F.lit("; "), (F.col("p_size") + 1).cast("string")))
    text = F.when(k == 0, F.concat(s, F.lit(" percent"))).otherwise("good")
    return _t(spark, sf, "part").select("p_partkey", clean.align_yield(num, text).alias("aligned"))


_BRASS, _STEEL = ["brass", "copper"], ["steel", "tin"]


@_query("""WITH r AS (SELECT *, lower(p_name || ' ' || p_type) AS reagent, nullif(p_type, 'ECONOMY') AS cat FROM part),
  f AS (SELECT * FROM r WHERE contains(reagent, 'a')),
  x AS (SELECT 'A + economy' AS route, * FROM f WHERE contains(reagent, 'economy') OR contains(lower(coalesce(cat, '')), 'economy')
    UNION ALL SELECT 'A + promo' AS route, * FROM f WHERE contains(reagent, 'promo') OR contains(lower(coalesce(cat, '')), 'promo')
    UNION ALL SELECT 'A' AS route, * FROM f WHERE cat IS NULL AND NOT contains(reagent, 'economy') AND NOT contains(reagent, 'promo'))
  SELECT route, p_brand AS id, round(avg(p_retailprice), 4) AS mean_value, arg_max(coalesce(CASE WHEN route = 'A' THEN NULL ELSE coalesce(cat, substr(route, 5)) END, '-'), p_partkey) AS catalyst,
    arg_max(lower(p_type), p_partkey) AS last_type, max(p_partkey) AS p_partkey FROM x GROUP BY 1, 2""")
def split_routes(spark, sf):
    rows = _t(spark, sf, "part").select(F.col("p_brand").alias("id"), "p_partkey", F.col("p_retailprice").alias("yield"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("reagent"), F.nullif("p_type", F.lit("ECONOMY")).alias("catalyst"), F.lower("p_type").alias("last_type"), F.concat("p_brand", F.lit(">>X")).alias("reaction"))
    out = grouped.split_routes(rows, "A", ["a"], {"economy": ["ECONOMY"], "promo": ["promo"]}, ["p_partkey"], carry=["last_type", "p_partkey"])
    return out.select("route", "id", F.round("mean_value", 4).alias("mean_value"), F.coalesce("catalyst", F.lit("-")).alias("catalyst"), "last_type", "p_partkey")


@_query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def exclude_groups(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return clean.exclude_groups_where(o, "o_custkey", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "o_custkey")


_METAL_SQL = "|".join(sorted(clean.METALS, key=lambda m: (-len(m), m)))


@_query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, t,
    CASE WHEN regexp_matches(t, '\\[\\d*({_METAL_SQL})[^a-z]') THEN 'metal' WHEN regexp_matches(t, '\\[\\d+[A-Za-z]') THEN 'isotope' WHEN contains(t, '.') THEN 'fragments'
      WHEN contains(t, '+') OR contains(t, '-') THEN 'charge' ELSE 'clean' END AS reason,
    list_filter(string_split(t, '.'), lambda p: length(p) > 4 AND contains(p, 'the')) AS parts FROM t)
  SELECT doc_id, CASE WHEN reason IN ('metal', 'charge') THEN 'reject' ELSE 'keep' END AS status, reason,
    CASE WHEN reason IN ('metal', 'charge') THEN NULL WHEN reason = 'fragments' THEN length(coalesce(parts[-1], t)) WHEN reason = 'isotope' THEN length(regexp_replace(t, '\\[\\d+([A-Za-z])', '[\\1', 'g')) ELSE length(t) END AS fragment_length FROM r""")
def screen_records(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", *clean.screen_records(F.col("text"), bond="the"))
    return d.select("doc_id", "status", "reason", F.length("fragment").cast("long").alias("fragment_length"))


@_query("""SELECT 'p_size' AS "column", p_partkey FROM part WHERE nullif(p_size, 1) IS NULL UNION ALL SELECT 'p_retailprice', p_partkey FROM part WHERE p_retailprice < 950""")
def null_report(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.nullif("p_size", F.lit(1)).alias("p_size"), F.when(F.col("p_retailprice") < 950, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("p_retailprice"))
    return clean.null_report(p, "p_partkey")


@_query("""SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""")
def dedupe_first(spark, sf):
    return clean.dedupe_first(_t(spark, sf, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


@_query("""SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.06""")
def box(spark, sf):
    return clean.box(_t(spark, sf, "lineitem"), {"l_quantity": (10, 20), "l_discount": (0.02, 0.06)}).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@_query("""SELECT CAST(CASE WHEN value < 15 THEN 0 WHEN value <= 40 THEN 1 ELSE 2 END AS INTEGER) AS category, count(*) AS n FROM events GROUP BY 1""")
def categorise(spark, sf):
    return _t(spark, sf, "events").groupBy(C.categorise(F.col("value")).alias("category")).agg(F.count("*").alias("n"))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@_query("""SELECT feature, count(*) AS n, round(avg(v), 4) AS mean FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY 1""")
def melt_matrix(spark, sf):
    wide = C.numeric_only(_t(spark, sf, "lineitem").select("l_orderkey", *_FEATURES, "l_returnflag"))
    return C.melt(wide, ["l_orderkey"]).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@_query("""SELECT x_name, y_name, count(*) AS n, round(avg(x * y), 3) AS mean_xy FROM (
    SELECT 'l_extendedprice' AS x_name, 'l_discount' AS y_name, l_extendedprice AS x, l_discount AS y FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_tax', l_extendedprice, l_tax FROM lineitem) GROUP BY 1, 2""")
def pair_long(spark, sf):
    li = _t(spark, sf, "lineitem")
    fam = C.family_columns(li.columns, {"price": ["price"], "rate": ["discount", "tax"]})
    pairs = C.pair_long(li, "l_orderkey", fam["price"], fam["rate"])
    return pairs.groupBy("x_name", "y_name").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") * F.col("y")), 3).alias("mean_xy"))


@_query("""SELECT c_custkey, 'Customer_' || lpad(CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS VARCHAR), 6, '0') AS assigned_id FROM customer""")
def assign_ids(spark, sf):
    return clean.assign_ids(_t(spark, sf, "customer").select("c_custkey"), "Customer_", ["c_custkey"])


# ---- lookups --------------------------------------------------------------------------------------

@_query("""SELECT c.c_custkey, c.c_name, coalesce(o.o_totalprice, 0.0) AS o_totalprice FROM customer c LEFT JOIN
  (SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1) o ON o.o_custkey = c.c_custkey""")
def lookup_default(spark, sf):
    right = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderkey")
    return lookup.lookup(_t(spark, sf, "customer").select("c_custkey", "c_name"), right, "c_custkey", "o_totalprice", ["o_orderkey"], 0.0)


@_query("""WITH s AS (SELECT o_orderpriority AS chemistry, o_custkey AS key, max(o_totalprice) AS y FROM orders GROUP BY 1, 2),
  g AS (SELECT c.c_custkey AS key, h.chemistry, k.cut FROM customer c, (SELECT DISTINCT chemistry FROM s) h, (SELECT unnest([50000.0, 100000.0, 200000.0, 300000.0]) AS cut) k)
  SELECT g.chemistry, CAST(g.cut AS DOUBLE) AS cut, CASE WHEN s.y IS NULL THEN 'grey' WHEN s.y >= g.cut THEN 'highlight' ELSE 'hollow' END AS class, count(*) AS n
  FROM g LEFT JOIN s ON s.chemistry = g.chemistry AND s.key = g.key GROUP BY 1, 2, 3""")
def classify_scope(spark, sf):
    scopes = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("chemistry"), F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("yield"))
    background = _t(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    return lookup.classify_scope(background, scopes, [50000, 100000, 200000, 300000]).groupBy("chemistry", "cut", "class").agg(F.count("*").alias("n"))


@_query("""WITH n AS (SELECT DISTINCT s_nationkey AS for_group FROM supplier) SELECT n.for_group, count(*) AS n, round(avg(s.s_acctbal), 4) AS mean FROM n JOIN supplier s ON s.s_nationkey <> n.for_group GROUP BY 1""")
def background_of(spark, sf):
    out = lookup.background_of(_t(spark, sf, "supplier").select("s_nationkey", "s_acctbal"), "s_nationkey")
    return out.groupBy("for_group").agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 4).alias("mean"))


@_query("""SELECT o.o_orderpriority, count(*) AS n, round(avg(p.o_totalprice), 4) AS mean FROM (SELECT DISTINCT o_orderpriority FROM orders) o JOIN orders p ON p.o_orderpriority <> o.o_orderpriority GROUP BY 1""")
def background_stats(spark, sf):
    return lookup.background_stats(_t(spark, sf, "orders"), "o_orderpriority", "o_totalprice").select("o_orderpriority", "n", F.round("mean", 4).alias("mean"))


@_query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@_query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark, sf):
    return _t(spark, sf, "customer").join(_t(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# ---- grouped --------------------------------------------------------------------------------------

@_query("""WITH g AS (SELECT DISTINCT l_partkey AS p, l_returnflag AS f FROM lineitem), r AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS i FROM (SELECT DISTINCT f FROM g))
  SELECT p AS l_partkey, CAST(sum(1 << CAST(i AS INTEGER)) AS BIGINT) AS mask FROM g JOIN r USING (f) GROUP BY 1""")
def membership_mask(spark, sf):
    return grouped.membership_mask(_t(spark, sf, "lineitem"), "l_partkey", "l_returnflag")


@_query("""SELECT o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def last_by(spark, sf):
    return grouped.last_by(_t(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"])


@_query("""SELECT o_orderpriority, count(*) AS population, CAST(count(*) * 500 // (SELECT count(*) FROM orders) AS BIGINT) AS quota FROM orders GROUP BY 1""")
def quotas(spark, sf):
    return grouped.quotas(_t(spark, sf, "orders"), "o_orderpriority", 500)


_EDGES = [0, 50000, 100000, 150000, 200000, 250000, 300000, 400000, 600000]
_BIN = "CASE " + " ".join(f"WHEN o_totalprice >= {a} AND o_totalprice {'<=' if b == _EDGES[-1] else '<'} {b} THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END"


@_query(f"""WITH q AS (SELECT o_orderpriority, count(*) * 200 // (SELECT count(*) FROM orders) AS quota FROM orders GROUP BY 1),
  p AS (SELECT o_orderkey, o_orderpriority, CAST({_BIN} AS INTEGER) AS bin FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY md5('42-' || o_orderkey), o_orderkey) AS round FROM p WHERE bin IS NOT NULL),
  s AS (SELECT r.*, quota, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round, bin) AS place FROM r JOIN q USING (o_orderpriority))
  SELECT o_orderkey, o_orderpriority, bin, CAST(round AS INTEGER) AS round FROM s WHERE place <= quota""")
def stratified_sample(spark, sf):
    o = _t(spark, sf, "orders")
    return sampling.stratified_sample(o, "o_orderkey", "o_orderpriority", "o_totalprice", _EDGES, 200, o.where("o_orderstatus = 'P'"))


@_query("""SELECT source_key, nationkey, acctbal FROM (SELECT c_custkey AS source_key, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier)""")
def union_common(spark, sf):
    c = _t(spark, sf, "customer").toDF("source_key", "name", "nationkey", "acctbal", "segment")
    s = _t(spark, sf, "supplier").toDF("source_key", "title", "nationkey", "acctbal")
    r = _t(spark, sf, "region").select(F.col("r_regionkey").alias("source_key"), "r_name")
    return C.union_common({"c": c, "s": s, "r": r}, "source_key")[0]


@_query("""WITH c AS (SELECT l_quantity AS x, count(*) AS y FROM lineitem GROUP BY 1), e AS (SELECT min(x) AS x0, max(x) AS x1, arg_min(y, x) AS y0, arg_max(y, x) AS y1 FROM c)
  SELECT x, y, round(abs(y - (y0 + (y1 - y0) * (x - x0) / (x1 - x0))), 6) AS distance FROM c, e ORDER BY abs(y - (y0 + (y1 - y0) * (x - x0) / (x1 - x0))) DESC, x LIMIT 1""")
def elbow(spark, sf):
    curve = _t(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count("*").alias("y"))
    return grouped.elbow(curve, "x", "y").select("x", "y", F.round("distance", 6).alias("distance"))


@_query("""WITH c AS (SELECT l_returnflag AS param, l_linestatus AS value, count(*) AS k, min(l_orderkey) AS f FROM lineitem GROUP BY 1, 2)
  SELECT param, value FROM (SELECT *, row_number() OVER (PARTITION BY param ORDER BY k DESC, f) AS rn FROM c) WHERE rn = 1""")
def vote(spark, sf):
    return grouped.vote(_t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("param"), F.col("l_linestatus").alias("value"), F.col("l_orderkey").alias("seen"), F.lit(False).alias("numeric")))


# ---- features -------------------------------------------------------------------------------------

_ORDER_SQL = """f AS (SELECT l_orderkey, sum(l_quantity) AS a, 2 * sum(l_quantity) + 1 AS b, max(l_extendedprice) AS c, power(max(l_extendedprice), 3) AS d, avg(l_discount) AS e, 7.0 AS g FROM lineitem GROUP BY 1)"""
_NAMES = ["a", "b", "c", "d", "e", "g"]


def _order_features(spark: SparkSession, sf: str) -> DataFrame:
    q, p = F.sum("l_quantity"), F.max("l_extendedprice")
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(q.alias("a"), (2 * q + 1).alias("b"), p.alias("c"), F.pow(p, F.lit(3.0)).alias("d"), F.avg("l_discount").alias("e"), F.lit(7.0).alias("g"))


def _corr_sql(source: str, names: list[str], rank: bool) -> str:
    cols = ", ".join(f"(rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0) AS {n}" for n in names) if rank else ", ".join(names)
    pairs = " UNION ALL ".join(f"SELECT '{x}' AS i, '{y}' AS j, round(corr({x}, {y}), 4) AS r FROM v" for x in names for y in names)
    return f"WITH {source}, v AS (SELECT {cols} FROM f) {pairs}"


@_query(f"WITH {_ORDER_SQL} SELECT feature FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, var_pop({n}) AS v FROM f" for n in _NAMES) + ") WHERE v > 0")
def variance_filter(spark, sf):
    kept = features.remove_by_variance(_order_features(spark, sf), _NAMES)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@_query(_corr_sql(_ORDER_SQL, ["a", "b", "c", "e"], False))
def pearson(spark, sf):
    return features.corr_matrix(_order_features(spark, sf), ["a", "b", "c", "e"]).select("i", "j", F.round("r", 4).alias("r"))


@_query(_corr_sql(_ORDER_SQL, ["a", "c", "d"], True))
def spearman(spark, sf):
    return features.corr_matrix(_order_features(spark, sf), ["a", "c", "d"], "spearman").select("i", "j", F.round("r", 4).alias("r"))


def _select_sql(names: list[str], threshold: float) -> str:
    """Zero variances, then for each method in turn: a feature goes if an earlier one that stayed correlates."""
    steps = [f"WITH {_ORDER_SQL}", "kept_variance AS (SELECT feature FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, var_pop({n}) AS v FROM f" for n in names) + ") WHERE v > 0)"]
    found = ["SELECT 'variance' AS stage, n AS feature, CAST(NULL AS VARCHAR) AS kept_by, 0.0::DOUBLE AS score FROM all_names WHERE n NOT IN (SELECT feature FROM kept_variance)"]
    steps.append("all_names AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS n)")
    before = "kept_variance"
    for method in ("pearson", "spearman"):
        source = "f" if method == "pearson" else "(SELECT " + ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0 AS {n}" for n in names) + " FROM f)"
        pairs = " UNION ALL ".join(f"SELECT '{x}' AS i, '{y}' AS j, corr({x}, {y}) AS r FROM {source}" for k, x in enumerate(names) for y in names[k + 1 :])
        steps.append(f"r_{method} AS (SELECT * FROM ({pairs}) WHERE i IN (SELECT feature FROM {before}) AND j IN (SELECT feature FROM {before}) AND abs(r) > {threshold})")
        gone = "(SELECT CAST(NULL AS VARCHAR) AS feature, CAST(NULL AS VARCHAR) AS kept_by, CAST(NULL AS DOUBLE) AS r WHERE false)"
        for k, n in enumerate(names):  # from left to right
            steps.append(f"g_{method}_{k} AS (SELECT * FROM {gone} UNION ALL SELECT j, i, r FROM r_{method} WHERE i = '{n}' AND i NOT IN (SELECT feature FROM {gone}) AND j NOT IN (SELECT feature FROM {gone}))")
            gone = f"g_{method}_{k}"
        steps.append(f"kept_{method} AS (SELECT feature FROM {before} WHERE feature NOT IN (SELECT feature FROM {gone}))")
        found.append(f"SELECT '{method}', feature, kept_by, round(r, 4) FROM {gone}")
        before = f"kept_{method}"
    return ", ".join(steps).replace(f"WITH {_ORDER_SQL}, ", f"WITH {_ORDER_SQL}, ") + " " + " UNION ALL ".join(found)


@_query(_select_sql(_NAMES, 0.95))
def select_features(spark, sf):
    return features.select_features(_order_features(spark, sf), "l_orderkey", _NAMES)[1].select("stage", "feature", "kept_by", F.round("score", 4).alias("score"))


@_query(f"""WITH {_ORDER_SQL} SELECT l_orderkey, round((a - (SELECT avg(a) FROM f)) / (SELECT stddev_pop(a) FROM f), 4) AS a, 0.0::DOUBLE AS g FROM f""")
def standardise(spark, sf):
    return features.standardise(_order_features(spark, sf).select("l_orderkey", "a", "g"), ["a", "g"]).select("l_orderkey", F.round("a", 4).alias("a"), "g")


def _wide_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return features.to_columns(rows, "vec_id", "embedding", "x", width)


@_query()
def pca_variance(spark, sf):
    wide = _wide_embeddings(spark, sf)
    return features.explained(spark, features.pca(wide, wide.columns[1:], 10))


@_query()
def loadings(spark, sf):
    wide = _wide_embeddings(spark, sf)
    return features.loadings(spark, features.pca(wide, wide.columns[1:], 2))


@_query()
def pca_scores(spark, sf):
    wide = _wide_embeddings(spark, sf)
    return features.scores(wide, features.pca(wide, wide.columns[1:], 2), 2, 11.0).select("vec_id", "PCA1", "PCA2")


@_query()
def family_pca(spark, sf):
    out = features.family_pca(_wide_embeddings(spark, sf), {"low": ["x1"], "high": ["x"]}, 1)
    return out.select("vec_id", "low_PCA1", "high_PCA1")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    wide = _wide_embeddings(spark, sf)
    return features.scores(wide, features.pca(wide, wide.columns[1:], 2), 2).select("vec_id", "PCA1", "PCA2")


@_query()
def kmeans_fixed(spark, sf):
    return features.kmeans(_scored(spark, sf), ["PCA1", "PCA2"], 10)


@_query()
def kmeans_elbow(spark, sf):
    return features.kmeans_elbow(_scored(spark, sf), ["PCA1", "PCA2"], scale=0.25, trials=8)[0]


# Projections with computed oracles: eigenvectors in SQL, by squaring the correlation matrix until one direction is left.

_PC = ["a", "c", "n", "s"]
_PC_SQL = """f AS (SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS a, CAST(max(l_extendedprice) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n, CAST(sum(l_extendedprice) AS DOUBLE) AS s FROM lineitem GROUP BY 1)"""


def _order_sizes(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("a"), F.max(price).alias("c"), F.count("*").alias("n"), F.sum(price).alias("s"))


def _eigen_sql(names: list[str], count: int, squarings: int = 12) -> str:
    """CTEs m (i, j, x) and e1, e2, ... (i, v, value): the leading eigenvectors of the correlation matrix times n / (n - 1)."""
    cells = " UNION ALL ".join(f"SELECT '{x}' AS i, '{y}' AS j, corr({x}, {y}) * count(*) / (count(*) - 1) AS x FROM f" for x in names for y in names)
    steps, left = [f"m AS MATERIALIZED ({cells})"], "m"
    for k in range(1, count + 1):
        last = left
        for t in range(squarings):
            steps.append(f"q{k}_{t} AS MATERIALIZED (SELECT i, j, x / sum(CASE WHEN i = j THEN x END) OVER () AS x FROM (SELECT a.i, b.j, sum(a.x * b.x) AS x FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2))")
            last = f"q{k}_{t}"
        # the column of the largest diagonal cell is the eigenvector but for its length; the largest entry becomes positive
        steps.append(f"u{k} AS MATERIALIZED (SELECT i, x / sqrt((SELECT sum(x * x) FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j))) AS v FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j))")
        steps.append(f"w{k} AS MATERIALIZED (SELECT i, v * (SELECT sign(arg_max(v, round(abs(v), 9) - 1e-12 * rank)) FROM (SELECT v, rank() OVER (ORDER BY i) AS rank FROM u{k})) AS v FROM u{k})")
        steps.append(f"e{k} AS MATERIALIZED (SELECT i, v, (SELECT sum(a.v * m.x * b.v) FROM w{k} a JOIN m ON a.i = m.i JOIN w{k} b ON b.i = m.j) AS value FROM w{k})")
        steps.append(f"d{k} AS MATERIALIZED (SELECT x.i, x.j, x.x - a.value * a.v * b.v AS x FROM {left} x JOIN e{k} a ON a.i = x.i JOIN e{k} b ON b.i = x.j)")
        left = f"d{k}"
    return ", ".join(steps)


@_query(f"WITH {_PC_SQL}, {_eigen_sql(_PC, 4)} " + " UNION ALL ".join(f"SELECT {k} AS pc, round(max(value), 6) AS variance, round(max(value) / (SELECT sum(x) FROM m WHERE i = j), 6) AS ratio FROM e{k}" for k in range(1, 5)))
def pca_orders(spark, sf):
    model = features.pca(_order_sizes(spark, sf), _PC)
    return features.explained(spark, model).select("pc", F.round("variance", 6).alias("variance"), F.round("ratio", 6).alias("ratio"))


@_query(f"WITH {_PC_SQL}, {_eigen_sql(_PC, 2)} SELECT feature, pc, round(loading, 5) AS loading, CAST(row_number() OVER (PARTITION BY pc ORDER BY abs(loading) DESC, feature) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(f"SELECT i AS feature, {k} AS pc, v * sqrt(value) AS loading FROM e{k}" for k in (1, 2)) + ")")
def loadings_orders(spark, sf):
    model = features.pca(_order_sizes(spark, sf), _PC, 2)
    return features.loadings(spark, model).select("feature", "pc", F.round("loading", 5).alias("loading"), "rank")


@_query(f"""WITH {_PC_SQL}, {_eigen_sql(_PC, 2)}, z AS (SELECT l_orderkey, {", ".join(f"({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f) AS {c}" for c in _PC)} FROM f)
  SELECT l_orderkey, """ + ", ".join(f"round(11 + {' + '.join(f'{c} * (SELECT v FROM e{k} WHERE i = {chr(39)}{c}{chr(39)})' for c in _PC)}, 4) AS PCA{k}" for k in (1, 2)) + " FROM z")
def pca_scores_orders(spark, sf):
    wide = _order_sizes(spark, sf)
    return features.scores(wide, features.pca(wide, _PC, 2), 2, 11.0).select("l_orderkey", *[F.round(c, 4).alias(c) for c in ("PCA1", "PCA2")])


@_query(f"""WITH {_PC_SQL}, z AS (SELECT l_orderkey, {", ".join(f"({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f) AS {c}" for c in _PC)}, (SELECT sign(corr(a, n)) FROM f) AS an, (SELECT sign(corr(c, s)) FROM f) AS cs FROM f)
  SELECT l_orderkey, round((a + an * n) / sqrt(2), 4) + 0.0 AS size_PCA1, round((c + cs * s) / sqrt(2), 4) + 0.0 AS price_PCA1 FROM z""")
def family_pca_orders(spark, sf):
    """Of two standardised features the first component is their sum, or difference where they fall apart."""
    wide = _order_sizes(spark, sf).withColumnsRenamed({"a": "size_a", "n": "size_n", "c": "price_c", "s": "price_s"})
    out = features.family_pca(wide, {"size": ["size_"], "price": ["price_"]}, 1)
    return out.select("l_orderkey", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("size_PCA1", "price_PCA1")])


@_query("""SELECT count(*) AS n, round(min(o_totalprice), 2) AS least, round(max(o_totalprice), 2) AS most, round(avg(o_totalprice), 2) AS centre FROM orders GROUP BY o_orderstatus = 'F'""")
def kmeans_apart(spark, sf):
    """Two groups that stand far apart: any right clustering finds just these."""
    away = F.when(F.col("o_orderstatus") == "F", 1e9).otherwise(0.0)
    points = _t(spark, sf, "orders").select("o_totalprice", (F.col("o_totalprice") + away).alias("x"), away.alias("y"))
    found = features.kmeans(points, ["x", "y"], 2)
    price = F.col("o_totalprice")
    return found.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.min(price), 2).alias("least"), F.round(F.max(price), 2).alias("most"), F.round(F.avg(price), 2).alias("centre")).drop("cluster")


def _kl_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice"):
        parts.append(f"""SELECT '{c}' AS feature, round(sum(p * ln(p / q)), 4) AS kl, any_value(nb) AS n_bins FROM (
          SELECT nb, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (
            SELECT nb, CASE WHEN a > 0 THEN a ELSE 1e-5 * min(CASE WHEN a > 0 THEN a END) OVER () END AS a, CASE WHEN b > 0 THEN b ELSE 1e-5 * min(CASE WHEN b > 0 THEN b END) OVER () END AS b FROM (
              SELECT bin, any_value(nb) AS nb, CAST(count(x) AS DOUBLE) AS a, CAST(count(x) FILTER (inbox) AS DOUBLE) AS b FROM (
                SELECT g.bin, s.nb, v.x, v.inbox FROM s_{c} s JOIN (SELECT unnest(range(0, 5000)) AS bin) g ON g.bin < s.nb LEFT JOIN
                  (SELECT {c} AS x, l_discount BETWEEN 0.02 AND 0.06 AND l_quantity BETWEEN 10 AND 30 AS inbox FROM lineitem) v ON least(CAST(floor((v.x - s.lo) * s.nb / (s.hi - s.lo)) AS BIGINT), s.nb - 1) = g.bin) GROUP BY bin)))""")
    stats = ", ".join(f"""s_{c} AS (SELECT lo, hi, CAST(ceil((hi - lo) / least(greatest(2 * iqr * power(n, -1.0 / 3), (hi - lo) / sqrt(n) / 2), (hi - lo) / (log2(n) + 1))) AS BIGINT) AS nb
        FROM (SELECT min({c}) AS lo, max({c}) AS hi, CAST(count(*) AS DOUBLE) AS n, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr FROM lineitem))""" for c in ("l_quantity", "l_extendedprice"))
    return f"WITH {stats} " + " UNION ALL ".join(parts)


@_query(_kl_sql())
def kl_shift(spark, sf):
    li = _t(spark, sf, "lineitem")
    inside = clean.box(li, {"l_discount": (0.02, 0.06), "l_quantity": (10, 30)})
    return sampling.kl_shift(li, inside, ["l_quantity", "l_extendedprice"])[0].select("feature", F.round("kl", 4).alias("kl"), "n_bins")


# ---- graphs ---------------------------------------------------------------------------------------

def _bonds(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("l_partkey") % 20, F.col("l_suppkey") % 20
    keyed = _t(spark, sf, "lineitem").where(p != s).select(F.floor(F.col("l_orderkey") / 3.0).alias("mol_id"), F.least(p, s).alias("src"), F.greatest(p, s).alias("dst"), F.when(F.col("l_linenumber") == 1, 2).otherwise(1).alias("o"))
    return graph.colocated(keyed).groupBy("mol_id", "src", "dst").agg(F.max("o").alias("bond_order"))


def _atoms(bonds: DataFrame) -> DataFrame:
    ids = bonds.select("mol_id", F.explode(F.array("src", "dst")).alias("atom_id")).distinct()
    return ids.withColumn("element", F.element_at(F.array(*[F.lit(x) for x in ("C", "N", "O", "Cl")]), (F.col("atom_id") % 4 + 1).cast("int")))


def _anchor(bonds: DataFrame) -> DataFrame:
    return graph.first_anchor(graph.anchors(bonds))


_GRAPH_SQL = """bonds AS (SELECT CAST(floor(l_orderkey / 3.0) AS BIGINT) AS mol_id, least(l_partkey % 20, l_suppkey % 20) AS src, greatest(l_partkey % 20, l_suppkey % 20) AS dst,
    max(CASE WHEN l_linenumber = 1 THEN 2 ELSE 1 END) AS bond_order FROM lineitem WHERE l_partkey % 20 <> l_suppkey % 20 GROUP BY 1, 2, 3),
  e AS (SELECT mol_id, src AS a, dst AS b FROM bonds UNION SELECT mol_id, dst, src FROM bonds),
  h AS (SELECT mol_id, src AS a, dst AS b FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY src, dst) AS rn FROM bonds WHERE bond_order = 2) WHERE rn = 1),
  ends AS (SELECT mol_id, a AS anchor, b AS other FROM h UNION ALL SELECT mol_id, b, a FROM h),
  d0 AS (SELECT mol_id, anchor, other, anchor AS atom FROM ends),
  d1 AS (SELECT DISTINCT d0.mol_id, anchor, other, e.b AS atom FROM d0 JOIN e ON e.mol_id = d0.mol_id AND e.a = d0.atom),
  d2 AS (SELECT DISTINCT d1.mol_id, anchor, other, e.b AS atom FROM d1 JOIN e ON e.mol_id = d1.mol_id AND e.a = d1.atom),
  near AS (SELECT mol_id, atom, min(dist) AS dist FROM (SELECT mol_id, atom, 0 AS dist FROM d0 UNION ALL SELECT mol_id, atom, 1 FROM d1 UNION ALL SELECT mol_id, atom, 2 FROM d2) GROUP BY 1, 2)"""


@_query(f"WITH {_GRAPH_SQL} SELECT mol_id, src AS a, dst AS b, count(*) OVER (PARTITION BY mol_id) AS n FROM bonds WHERE bond_order = 2")
def anchors(spark, sf):
    return graph.anchors(_bonds(spark, sf))


@_query(f"""WITH {_GRAPH_SQL}, v AS (SELECT mol_id, src AS a, dst AS b, row_number() OVER (PARTITION BY mol_id ORDER BY src, dst) AS variant FROM bonds WHERE bond_order = 2)
  SELECT v.mol_id, v.variant, count(*) AS n_bonds, sum(CASE WHEN o.bond_order = 2 AND NOT (o.src = v.a AND o.dst = v.b) THEN 1 ELSE o.bond_order END)::BIGINT AS orders FROM v JOIN bonds o USING (mol_id) GROUP BY 1, 2""")
def knockout(spark, sf):
    b = _bonds(spark, sf)
    return graph.knockout_variants(b, graph.anchors(b)).groupBy("mol_id", F.col("variant").cast("long").alias("variant")).agg(F.count("*").alias("n_bonds"), F.sum("bond_order").alias("orders"))


@_query(f"""WITH {_GRAPH_SQL} SELECT ends.mol_id, anchor, y.b AS atom, count(*) AS n FROM ends JOIN e x ON x.mol_id = ends.mol_id AND x.a = anchor JOIN e y ON y.mol_id = x.mol_id AND y.a = x.b GROUP BY 1, 2, 3""")
def walk_counts(spark, sf):
    b = _bonds(spark, sf)
    return graph.walk_counts(graph.undirected(b), _anchor(b), 2).select("mol_id", "anchor", "atom", "n")


@_query(f"WITH {_GRAPH_SQL} SELECT mol_id, atom FROM near WHERE dist = 2")
def boundary(spark, sf):
    b = _bonds(spark, sf)
    return graph.boundary(graph.undirected(b), _anchor(b), 2)


@_query(f"""WITH {_GRAPH_SQL},
  b1 AS (SELECT * FROM d1 WHERE atom <> other), b2 AS (SELECT DISTINCT b1.mol_id, anchor, other, e.b AS atom FROM b1 JOIN e ON e.mol_id = b1.mol_id AND e.a = b1.atom WHERE e.b <> other)
  SELECT mol_id, atom, CAST(min(dist) AS INTEGER) AS dist FROM (SELECT mol_id, atom, 0 AS dist FROM d0 UNION ALL SELECT mol_id, atom, 1 FROM b1 UNION ALL SELECT mol_id, atom, 2 FROM b2) GROUP BY 1, 2""")
def neighbourhood(spark, sf):
    b = _bonds(spark, sf)
    return graph.neighbourhood(graph.undirected(b), _anchor(b), 2)


@_query(f"""WITH {_GRAPH_SQL}, p AS (SELECT e.mol_id, e.a, e.b, greatest(x.dist, y.dist) AS shell FROM e JOIN near x ON x.mol_id = e.mol_id AND x.atom = e.a JOIN near y ON y.mol_id = e.mol_id AND y.atom = e.b
    LEFT JOIN h ON h.mol_id = e.mol_id AND least(h.a, h.b) = e.a AND greatest(h.a, h.b) = e.b WHERE e.a < e.b AND (abs(x.dist - y.dist) = 1 OR h.mol_id IS NOT NULL))
  SELECT mol_id, CAST(shell AS INTEGER) AS shell, count(*) AS n_bonds FROM p GROUP BY 1, 2""")
def shells(spark, sf):
    b = _bonds(spark, sf)
    return graph.shells(graph.undirected(b), _anchor(b), 2)[1].groupBy("mol_id", "shell").agg(F.count("*").alias("n_bonds"))


@_query(f"""WITH {_GRAPH_SQL} SELECT mol_id, CAST(k AS INTEGER) AS upto, count(*) AS n_atoms FROM near JOIN (SELECT unnest([0, 1, 2]) AS k) ON dist <= k GROUP BY 1, 2""")
def cumulative_shells(spark, sf):
    b = _bonds(spark, sf)
    return graph.cumulative_shells(graph.shells(graph.undirected(b), _anchor(b), 2)[0], 2)


@_query(f"""WITH {_GRAPH_SQL}, p1 AS (SELECT mol_id, anchor, other, atom AS x FROM d1 WHERE atom <> other),
  p2 AS (SELECT p1.*, e.b AS y FROM p1 JOIN e ON e.mol_id = p1.mol_id AND e.a = p1.x WHERE e.b <> anchor AND e.b <> other AND e.b <> x)
  SELECT mol_id, anchor, count(*) AS n_paths FROM (SELECT mol_id, anchor FROM p2 UNION ALL SELECT mol_id, anchor FROM p1 WHERE NOT EXISTS (SELECT 1 FROM p2 WHERE p2.mol_id = p1.mol_id AND p2.anchor = p1.anchor AND p2.x = p1.x)) GROUP BY 1, 2""")
def path_counts(spark, sf):
    b = _bonds(spark, sf)
    return graph.path_counts(graph.undirected(b), _anchor(b), 2)


_KIND = "['C', 'N', 'O', 'Cl'][CAST({} % 4 + 1 AS INTEGER)]"
_BLOCKED = """b1 AS (SELECT * FROM d1 WHERE atom <> other), b2 AS (SELECT DISTINCT b1.mol_id, anchor, other, e.b AS atom FROM b1 JOIN e ON e.mol_id = b1.mol_id AND e.a = b1.atom WHERE e.b <> other),
  inside AS (SELECT mol_id, atom, min(dist) AS dist FROM (SELECT mol_id, atom, 0 AS dist FROM d0 UNION ALL SELECT mol_id, atom, 1 FROM b1 UNION ALL SELECT mol_id, atom, 2 FROM b2) GROUP BY 1, 2)"""
_ORDERED = """o AS (SELECT mol_id, src AS a, dst AS b, bond_order FROM bonds UNION SELECT mol_id, dst, src, bond_order FROM bonds)"""


def _refine_sql(rounds: int, edges: str) -> str:
    """c1, c2, ... from c0 (mol_id, atom, colour): own colour and the sorted colours behind the bonds."""
    return ", ".join(
        f"""c{k} AS (SELECT c.mol_id, c.atom, md5(any_value(c.colour) || '|' || coalesce(string_agg(x.bond_order || ':' || n.colour, ',' ORDER BY x.bond_order || ':' || n.colour), '')) AS colour
        FROM c{k - 1} c LEFT JOIN {edges} x ON x.mol_id = c.mol_id AND x.a = c.atom LEFT JOIN c{k - 1} n ON n.mol_id = x.mol_id AND n.atom = x.b GROUP BY c.mol_id, c.atom)"""
        for k in range(1, rounds + 1)
    )


@_query(f"""WITH {_GRAPH_SQL}, {_BLOCKED}, {_ORDERED},
  c0 AS (SELECT i.mol_id, i.atom, md5((CASE WHEN n.dist = 2 THEN '*' ELSE {_KIND.format("i.atom")} END) || '|' || i.dist) AS colour FROM inside i LEFT JOIN near n ON n.mol_id = i.mol_id AND n.atom = i.atom),
  oi AS (SELECT o.* FROM o JOIN inside x ON x.mol_id = o.mol_id AND x.atom = o.a JOIN inside y ON y.mol_id = o.mol_id AND y.atom = o.b), {_refine_sql(3, "oi")}
  SELECT motif_key, count(*) AS n, any_value(n_atoms) AS n_atoms FROM (SELECT mol_id, md5(string_agg(colour, ',' ORDER BY colour)) AS motif_key, count(*) AS n_atoms FROM c3 GROUP BY 1) GROUP BY 1""")
def motif_groups(spark, sf):
    b = _bonds(spark, sf)
    return graph.motifs(b, _anchor(b), 2, _atoms(b)).groupBy("motif_key").agg(F.count("*").alias("n"), F.first("n_atoms").alias("n_atoms"))


@_query(f"""WITH RECURSIVE {_GRAPH_SQL}, {_BLOCKED}, ar AS (SELECT mol_id, a, b FROM e WHERE (a + b) % 3 = 0),
  reach AS (SELECT mol_id, a, a AS b FROM ar UNION SELECT r.mol_id, r.a, ar.b FROM reach r JOIN ar ON ar.mol_id = r.mol_id AND ar.a = r.b),
  system AS (SELECT mol_id, a AS atom, min(b) AS system FROM reach GROUP BY 1, 2),
  broken AS (SELECT s.mol_id, s.system FROM system s LEFT JOIN inside i ON i.mol_id = s.mol_id AND i.atom = s.atom LEFT JOIN near n ON n.mol_id = s.mol_id AND n.atom = s.atom AND n.dist = 2
    GROUP BY 1, 2 HAVING count(n.atom) > 0 AND count(i.atom) < count(*)),
  hit AS (SELECT s.mol_id, s.atom FROM system s JOIN broken x ON x.mol_id = s.mol_id AND x.system = s.system)
  SELECT b.mol_id, src, dst, CAST(CASE WHEN (src + dst) % 3 = 0 AND h.atom IS NOT NULL THEN 1 ELSE bond_order END AS INTEGER) AS bond_order, (src + dst) % 3 = 0 AND h.atom IS NULL AS aromatic
  FROM bonds b LEFT JOIN hit h ON h.mol_id = b.mol_id AND h.atom = b.src""")
def partial_rings(spark, sf):
    b = _bonds(spark, sf).withColumn("aromatic", (F.col("src") + F.col("dst")) % 3 == 0)
    return graph.break_rings_around(b, _anchor(b), 2)


@_query(f"""WITH RECURSIVE {_GRAPH_SQL}, rest AS (SELECT e.mol_id, e.a, e.b FROM e JOIN h USING (mol_id) WHERE NOT (least(e.a, e.b) = least(h.a, h.b) AND greatest(e.a, e.b) = greatest(h.a, h.b))),
  reach AS (SELECT mol_id, a AS atom FROM h UNION SELECT r.mol_id, x.b FROM reach r JOIN rest x ON x.mol_id = r.mol_id AND x.a = r.atom)
  SELECT h.mol_id, h.a, h.b, r.atom IS NOT NULL AS in_ring FROM h LEFT JOIN reach r ON r.mol_id = h.mol_id AND r.atom = h.b""")
def in_ring(spark, sf):
    b = _bonds(spark, sf)
    return graph.in_ring(graph.undirected(b), _anchor(b))


@_query(f"""WITH {_GRAPH_SQL}, {_ORDERED}, c0 AS (SELECT DISTINCT mol_id, a AS atom, md5({_KIND.format("a")}) AS colour FROM e), {_refine_sql(2, "o")}
  SELECT DISTINCT mol_id, CAST(CAST('0x' || substr(colour, 1, 8) AS BIGINT) % 2048 AS INTEGER) AS bit FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2)""")
def fingerprint(spark, sf):
    b = _bonds(spark, sf)
    return graph.neighbourhood_bits(b, _atoms(b))


@_query(f"""WITH {_GRAPH_SQL}, atoms AS (SELECT DISTINCT mol_id, a AS atom_id, ['C', 'N', 'O', 'Cl'][CAST(a % 4 + 1 AS INTEGER)] AS element FROM e)
  SELECT mol_id, CAST(count(*) FILTER (element = 'O') > 3 AS INTEGER) AS o_gt_3, CAST(count(*) FILTER (element = 'N') > 1 AS INTEGER) AS n_gt_1, CAST(count(*) FILTER (element = 'Cl') > 0 AS INTEGER) AS halogen FROM atoms GROUP BY 1""")
def count_keys(spark, sf):
    el = F.col("element")
    return graph.count_keys(_atoms(_bonds(spark, sf)), {"o_gt_3": (el == "O", 3), "n_gt_1": (el == "N", 1), "halogen": (el == "Cl", 0)})


_RINGS_SQL = f"""{_GRAPH_SQL}, {_ORDERED}, own AS (SELECT mol_id, a AS atom, {_KIND.format("a")} AS el, count(*) AS d, sum(bond_order) AS used FROM o GROUP BY 1, 2),
  way AS (SELECT mol_id, src, dst, src AS atom FROM bonds UNION SELECT w.mol_id, w.src, w.dst, e.b FROM way w JOIN e ON e.mol_id = w.mol_id AND e.a = w.atom WHERE NOT (least(e.a, e.b) = w.src AND greatest(e.a, e.b) = w.dst)),
  ring AS (SELECT DISTINCT mol_id, src, dst FROM way WHERE atom = dst),
  x AS (SELECT o.*, p.el AS ea, q.el AS eb, ring.src IS NOT NULL AS ring FROM o JOIN own p ON p.mol_id = o.mol_id AND p.atom = o.a JOIN own q ON q.mol_id = o.mol_id AND q.atom = o.b
    LEFT JOIN ring ON ring.mol_id = o.mol_id AND ring.src = least(o.a, o.b) AND ring.dst = greatest(o.a, o.b)),
  two AS (SELECT x.mol_id, x.a, x.b, y.b AS c, x.ea, x.eb, y.eb AS ec, x.bond_order AS o1, y.bond_order AS o2, x.ring AS r1, y.ring AS r2 FROM x JOIN x y ON y.mol_id = x.mol_id AND y.a = x.b AND y.b <> x.a)"""
#: The keys that the queries compare with joins.
_SOME_KEYS = (11, 13, 22, 45, 62, 69, 77, 117, 126, 130, 136, 138, 139, 140, 143, 146, 154, 160, 165)


@_query(f"""WITH RECURSIVE {_RINGS_SQL},
  three AS (SELECT t.*, y.b AS d, y.ring AS r3 FROM two t JOIN x y ON y.mol_id = t.mol_id AND y.a = t.c AND y.b <> t.a AND y.b <> t.b),
  hy AS (SELECT mol_id, atom, el, CASE el WHEN 'C' THEN 4 WHEN 'O' THEN 2 WHEN 'Cl' THEN 1 ELSE CASE WHEN used <= 3 THEN 3 ELSE 5 END END - used AS h FROM own),
  k AS (
    SELECT mol_id, 11 AS key FROM three JOIN e USING (mol_id) WHERE e.a = d AND e.b = three.a
    UNION SELECT t.mol_id, 13 FROM two t JOIN x y ON y.mol_id = t.mol_id AND y.a = t.b AND y.b NOT IN (t.a, t.c) WHERE t.ea = 'O' AND t.eb = 'N' AND t.ec = 'C' AND y.eb = 'C'
    UNION SELECT two.mol_id, 22 FROM two JOIN e ON e.mol_id = two.mol_id AND e.a = two.c AND e.b = two.a
    UNION SELECT mol_id, 45 FROM two WHERE ea = 'C' AND eb = 'C' AND ec = 'N' AND o1 = 2
    UNION SELECT mol_id, 62 FROM three WHERE r1 AND NOT r2 AND r3
    UNION SELECT x.mol_id, 69 FROM x JOIN hy h ON h.mol_id = x.mol_id AND h.atom = x.b WHERE ea <> 'C' AND eb <> 'C' AND h.h > 0
    UNION SELECT mol_id, 77 FROM two WHERE ea = 'N' AND ec = 'N'
    UNION SELECT mol_id, 117 FROM two WHERE ea = 'N' AND ec = 'O'
    UNION SELECT mol_id, 126 FROM two WHERE eb = 'O' AND NOT r1 AND NOT r2
    UNION SELECT mol_id, 130 FROM x WHERE a < b AND ea <> 'C' AND eb <> 'C' GROUP BY 1 HAVING count(*) > 1
    UNION SELECT mol_id, 136 FROM x WHERE ea = 'O' AND bond_order = 2 GROUP BY 1 HAVING count(DISTINCT least(a, b) * 100 + greatest(a, b)) > 1
    UNION SELECT mol_id, 138 FROM (SELECT DISTINCT t.mol_id, list_sort([t.a, t.b, t.c]) AS s FROM two t JOIN hy h ON h.mol_id = t.mol_id AND h.atom = t.b WHERE ea <> 'C' AND eb = 'C' AND h.h = 2) GROUP BY 1 HAVING count(*) > 1
    UNION SELECT mol_id, 139 FROM hy h WHERE el = 'O' AND h > 0
    UNION SELECT mol_id, 140 FROM own WHERE el = 'O' GROUP BY 1 HAVING count(*) > 3
    UNION SELECT mol_id, 143 FROM two WHERE r1 AND NOT r2 AND ec = 'O'
    UNION SELECT mol_id, 146 FROM own WHERE el = 'O' GROUP BY 1 HAVING count(*) > 2
    UNION SELECT mol_id, 154 FROM x WHERE ea = 'C' AND eb = 'O' AND bond_order = 2
    UNION SELECT mol_id, 160 FROM hy h WHERE el = 'C' AND h = 3
    UNION SELECT mol_id, 165 FROM ring)
  SELECT DISTINCT mol_id, CAST(key AS INTEGER) AS key FROM k""")
def substructure_keys(spark, sf):
    """Keys of every graph, those that joins can tell."""
    b = _bonds(spark, sf)
    keys = substructure.pattern_keys(substructure.molecule_rows(_atoms(b), b), {k: substructure.KEYS[k] for k in _SOME_KEYS})
    # a plain explode is tested for empty arrays first, which lays every pattern once more
    return keys.select("mol_id", F.explode_outer("keys").alias("key")).where("key is not null")


@_query(f"""WITH RECURSIVE {_RINGS_SQL}, linked AS (SELECT mol_id, a, a AS b FROM e UNION SELECT r.mol_id, r.a, e.b FROM linked r JOIN e ON e.mol_id = r.mol_id AND e.a = r.b),
  parts AS (SELECT mol_id, count(DISTINCT part) AS parts FROM (SELECT mol_id, a, min(b) AS part FROM linked GROUP BY 1, 2) GROUP BY 1),
  ra AS (SELECT mol_id, count(DISTINCT atom) AS n FROM (SELECT mol_id, src AS atom FROM ring UNION ALL SELECT mol_id, dst FROM ring) GROUP BY 1),
  b AS (SELECT x.mol_id, count(*) AS bonds, sum(1 / sqrt(p.d * q.d)) AS chi1, sum(sqrt((p.d + q.d - 2) / (p.d * q.d))) AS abc, sum(p.d * q.d) AS z2, count(*) FILTER (bond_order = 1 AND NOT ring AND p.d > 1 AND q.d > 1) AS rot
    FROM x JOIN own p ON p.mol_id = x.mol_id AND p.atom = x.a JOIN own q ON q.mol_id = x.mol_id AND q.atom = x.b WHERE a < x.b GROUP BY 1),
  a AS (SELECT mol_id, count(*) AS atoms, count(*) FILTER (el <> 'C') AS het, sum(1 / sqrt(d)) AS chi0, sum(d * d) AS z1, count(*) FILTER (el IN ('N', 'O')) AS n_no FROM own GROUP BY 1)
  SELECT a.mol_id, CAST(atoms AS INTEGER) AS n_atoms, CAST(het AS INTEGER) AS n_hetero, CAST(bonds - atoms + parts AS INTEGER) AS n_rings, CAST(coalesce(ra.n, 0) AS INTEGER) AS n_ring_atoms, CAST(rot AS INTEGER) AS n_rotatable,
    CAST(n_no AS INTEGER) AS n_no, round(chi0, 4) AS chi0, round(chi1, 4) AS chi1, round(abc, 4) AS abc, CAST(z1 AS DOUBLE) AS zagreb1, CAST(z2 AS DOUBLE) AS zagreb2
  FROM a JOIN b USING (mol_id) JOIN parts USING (mol_id) LEFT JOIN ra ON ra.mol_id = a.mol_id""")
def descriptors(spark, sf):
    """Counts and connectivity indices of every graph."""
    b = _bonds(spark, sf)
    told = substructure.descriptors(substructure.molecule_rows(_atoms(b), b))
    rounded = [F.round(c, 4).alias(c) for c in ("chi0", "chi1", "abc")]
    return told.select("mol_id", "n_atoms", "n_hetero", "n_rings", "n_ring_atoms", "n_rotatable", "n_no", *rounded, "zagreb1", "zagreb2")


# ---- learning and streams -------------------------------------------------------------------------

_PART_FEATURES = ["p_size", "p_partkey"]


@_query()
def tune_gbt(spark, sf):
    """Every trial of the grid, with the parameters that the repeats voted for."""
    trials, votes = learn.tune_gbt(_t(spark, sf, "part"), _PART_FEATURES, "p_retailprice", "p_partkey", {"maxDepth": [1, 2], "maxIter": [1, 2]}, folds=5, repeats=7)
    best = ", ".join(f"{r[0]}={r[1]}" for r in votes.orderBy("param").collect())  # one row per parameter
    return trials.withColumn("voted", F.lit(best))


@_query()
def evaluate_gbt(spark, sf):
    """Metrics of all repeats and folds, and the importances."""
    metrics, ranked = learn.evaluate_gbt(_t(spark, sf, "part"), _PART_FEATURES, "p_retailprice", "p_partkey", {"maxDepth": 2, "maxIter": 2}, folds=5, repeats=10)
    both = metrics.select("metric", "repeat", "fold", "value")
    return both.unionByName(ranked.select(F.concat(F.lit("importance of "), "feature").alias("metric"), F.lit(-1).alias("repeat"), F.lit(-1).alias("fold"), F.col("importance").alias("value")))


_BOOST = {"size": "CAST(p_size AS DOUBLE)", "brand": "CAST(substr(p_brand, 7) AS DOUBLE)"}


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", "p_retailprice", F.expr("cast(p_size as double)").alias("size"), F.expr("cast(substr(p_brand, 7) as double)").alias("brand"))


def _boost_sql(loss: str, trees: int, counts: tuple[int, ...], rate: float = 0.1, alpha: float = 0.9) -> str:
    """Chain of stumps: for each tree all splits of all features rated, leaves estimated anew."""
    start = "avg(y)" if loss == "squared_error" else "median(y)"
    steps = [f"f0 AS MATERIALIZED (SELECT p_partkey, p_retailprice AS y, {', '.join(f'{e} AS {n}' for n, e in _BOOST.items())}, (SELECT {start} FROM (SELECT p_retailprice AS y FROM part)) AS f FROM part)"]
    for t in range(1, trees + 1):
        delta = f"(SELECT quantile_cont(abs(y - f), {alpha}) FROM f{t - 1})" if loss == "huber" else "0"
        slope = {"squared_error": "y - f", "absolute_error": "sign(y - f)", "huber": "sign(y - f) * least(abs(y - f), delta)"}[loss]
        steps.append(f"g{t} AS MATERIALIZED (SELECT *, y - f AS r, {slope} AS g FROM (SELECT *, {delta} AS delta FROM f{t - 1}))")
        sides = " UNION ALL ".join(f"SELECT '{n}' AS feature, {n} AS v, sum(g) AS s, count(*) AS n FROM g{t} GROUP BY {n}" for n in _BOOST)
        steps.append(f"""split{t} AS MATERIALIZED (SELECT feature, v FROM (SELECT feature, v, sum(s) OVER w AS s, sum(n) OVER w AS n, sum(s) OVER (PARTITION BY feature) AS ts, sum(n) OVER (PARTITION BY feature) AS tn FROM ({sides}) WINDOW w AS (PARTITION BY feature ORDER BY v))
          WHERE n < tn ORDER BY s * s / n + (ts - s) * (ts - s) / (tn - n) DESC LIMIT 1)""")
        side = "CASE (SELECT feature FROM split{0}) ".format(t) + " ".join(f"WHEN '{n}' THEN {n}" for n in _BOOST) + f" END <= (SELECT v FROM split{t})"
        value = {"squared_error": "avg(r)", "absolute_error": "median(r)", "huber": "any_value(m) + avg(sign(r - m) * least(abs(r - m), delta))"}[loss]
        inner = f"(SELECT *, {side} AS side FROM g{t})"
        inner = f"(SELECT *, median(r) OVER (PARTITION BY side) AS m FROM {inner})" if loss == "huber" else inner
        steps.append(f"leaf{t} AS MATERIALIZED (SELECT side, {value} AS value FROM {inner} GROUP BY side)")
        before = "".join(f", at_{c}" for c in counts if c < t)
        own = f", f + {rate} * value AS at_{t}" if t in counts else ""
        steps.append(f"f{t} AS MATERIALIZED (SELECT p_partkey, y, {', '.join(_BOOST)}, f + {rate} * value AS f{before}{own} FROM (SELECT *, {side} AS side FROM g{t}) JOIN leaf{t} USING (side))")
    return f"WITH {', '.join(steps)} SELECT '{loss}' AS loss, p_partkey, {', '.join(f'round(at_{c}, 4) AS at_{c}' for c in counts)} FROM f{trees}"


@_query(" UNION ALL ".join(f"SELECT * FROM ({_boost_sql(loss, 3, (1, 3))})" for loss in boost.GRID["loss"]))
def boosted_losses(spark, sf):
    """Predictions after one and after three stumps, for each loss."""
    rows = boost.assembled(_parts(spark, sf), list(_BOOST), "p_retailprice", "p_partkey")
    parts = []
    for loss in boost.GRID["loss"]:
        told = boost.staged(boost.fit(rows, loss, trees=3, depth=1), rows, [1, 3])
        parts.append(told.select(F.lit(loss).alias("loss"), F.col("key").alias("p_partkey"), F.round("at_1", 4).alias("at_1"), F.round("at_3", 4).alias("at_3")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query()
def tune_boosted(spark, sf):
    """Trials of the three losses and two criteria with staged numbers of trees, and the votes of the repeats."""
    grid = {"n_estimators": (1, 2), "max_depth": (1, 2), "criterion": boost.GRID["criterion"], "loss": boost.GRID["loss"]}
    trials, votes = boost.tune(_parts(spark, sf), list(_BOOST), "p_retailprice", "p_partkey", grid, folds=2, repeats=1)
    best = ", ".join(f"{r[0]}={r[1]}" for r in votes.orderBy("param").collect())  # one row per parameter
    return trials.withColumn("voted", F.lit(best))


@_query()
def evaluate_boosted(spark, sf):
    """Scores of folds and test part, and the importances, of a chain with the Huber loss."""
    metrics, ranked = boost.evaluate(_parts(spark, sf), list(_BOOST), "p_retailprice", "p_partkey", {"n_estimators": 2, "max_depth": 2, "loss": "huber"}, folds=2, repeats=2)
    return metrics.unionByName(ranked.select(F.concat(F.lit("importance of "), "feature").alias("metric"), "repeat", F.lit(-1).alias("fold"), F.col("importance").alias("value")))


@_query("""WITH t AS (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
  SELECT CASE WHEN regexp_matches(value, '\\[\\d*(""" + _METAL_SQL + """)[^a-z]') THEN 'metal' WHEN regexp_matches(value, '\\[\\d+[A-Za-z]') THEN 'isotope' WHEN contains(value, '.') THEN 'fragments'
    WHEN contains(value, '+') OR contains(value, '-') THEN 'charge' ELSE 'clean' END AS reason, count(*) AS n FROM t GROUP BY 1""")
def screen_stream_counts(spark, sf):
    """The documents' lines as text files in the shared folder, screened by the stream."""
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    lines = _t(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    lines.write.option("lineSep", "\n").text(f"{base}/in")
    screen_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint")
    both = spark.read.parquet(f"{base}/out/keep").unionByName(spark.read.parquet(f"{base}/out/reject"))
    return both.groupBy("reason").agg(F.count("*").alias("n"))


# ---- sources, sinks and plans ---------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query("SELECT CAST(c_nationkey AS VARCHAR) AS chemistry, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def labelled_scan(spark, sf):
    """One folder per group written, all files read back with the label from their paths."""
    base = _folder(spark, "routes")
    tables.write_routes(_t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), base, "c_nationkey")
    rows = tables.read_labelled(spark, f"{base}/*/*.parquet", "c_nationkey=([^/]*)/", fmt="parquet")
    return rows.groupBy("chemistry").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@_query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS chemistry, true AS has_files FROM customer")
def labelled_files(spark, sf):
    base = _folder(spark, "routes")
    tables.write_routes(_t(spark, sf, "customer").select("c_custkey", "c_nationkey"), base, "c_nationkey")
    return tables.label_counts(spark, f"{base}/*/*.parquet", "c_nationkey=([^/]*)/").select("chemistry", (F.col("files") > 0).alias("has_files"))


@_query("""SELECT feature, count(*) AS n, round(avg(v), 4) AS mean FROM (UNPIVOT (SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY 1""")
def matrix_file(spark, sf):
    """Key and features as a delimited file with its own header, read back as numbers and melted."""
    base = _folder(spark, "matrix")
    _t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").write.mode("overwrite").option("header", "true").option("sep", ";").csv(base)
    wide = tables.read_matrix(spark, base, "p_partkey", ";")
    return C.melt(wide, ["p_partkey"]).groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@_query("""SELECT CAST(file_no AS INTEGER) AS file_no, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS file_no, o_orderkey FROM orders) GROUP BY 1""")
def files_in_order(spark, sf):
    """Tables written one after the other under names in order, concatenated with the number of each file."""
    base = _folder(spark, "ordered")
    orders = _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        orders.where(F.col("o_orderstatus") == status).select("o_orderkey").write.mode("append").parquet(f"{base}/status_{status}")
    rows = tables.read_in_order(spark, f"{base}/status_*", "([^/]+)/[^/]+$", "parquet")
    return rows.groupBy("file_no").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@_query("""WITH g AS (SELECT DISTINCT l_partkey AS p, l_returnflag AS f FROM lineitem), r AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS i FROM (SELECT DISTINCT f FROM g)),
  m AS (SELECT p, CAST(sum(1 << CAST(i AS INTEGER)) AS BIGINT) AS mask FROM g JOIN r USING (f) GROUP BY 1) SELECT mask, count(*) AS n, min(CAST(p AS VARCHAR)) AS first_key FROM m GROUP BY 1""")
def pool_file(spark, sf):
    """The pool of keys and masks as JSON lines, written and read back."""
    base = _folder(spark, "pool")
    masks = grouped.membership_mask(_t(spark, sf, "lineitem"), "l_partkey", "l_returnflag")
    tables.write_pool(masks.select(F.col("l_partkey").cast("string").alias("key"), "mask"), base)
    return tables.read_pool(spark, base).groupBy("mask").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


@_query("""SELECT 'customer' AS name, count(*) AS n_rows, 5 AS n_columns FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'part', count(*), 6 FROM part""")
def shape_report(spark, sf):
    return clean.shape_report({n: _t(spark, sf, n) for n in ("customer", "orders", "part")})


@_query("""SELECT o_custkey, o_orderpriority AS priority, round(max(o_totalprice), 2) AS max_price, round(min(o_totalprice), 2) AS min_price, count(*) AS n_orders FROM orders GROUP BY 1, 2""")
def tidy_columns(spark, sf):
    """Names cleaned, unwanted ones dropped, blocks joined by key, columns in order."""
    orders = _t(spark, sf, "orders").select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"), "o_custkey", "o_orderpriority", "o_totalprice")
    names = orders.groupBy("key").agg(F.first("o_custkey").alias("o_custkey"), F.first("o_orderpriority").alias("priority (%)"), F.lit(1).alias("unused %"))
    prices = orders.groupBy("key").agg(F.round(F.max("o_totalprice"), 2).alias("max_price"), F.round(F.min("o_totalprice"), 2).alias("min_price"), F.count("*").alias("n_orders"))
    blocks = C.join_feature_blocks([C.sanitise_columns(C.drop_columns_like(names, ["unused"], unless=["used by"])), prices], "key")
    return C.filter_columns(C.canonical_column_order(blocks, "key"), "key", remove=["none of these"]).drop("key")


@_query("""WITH r AS (SELECT p_brand AS id, p_name AS cat, lower(p_type) AS reagent, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 0 THEN CAST(p_size + 1 AS DOUBLE) END AS y FROM part)
  SELECT 'A + promo' AS route, id, round(avg(y), 4) AS mean_value, max(p_partkey) AS link FROM r WHERE contains(reagent, 'o') AND y IS NOT NULL AND (contains(reagent, 'promo') OR contains(lower(cat), 'promo')) GROUP BY 2""")
def route_tables(spark, sf):
    """The first chain: roles named, yields aligned, routes split."""
    part = _t(spark, sf, "part")
    size = F.col("p_size").cast("string")
    raw = part.select("p_brand", F.concat("p_brand", F.lit(">>x")).alias("rx"), F.when(F.col("p_partkey") % 2 == 0, size).alias("num"), F.lower("p_type").alias("with"), "p_name", F.lit("none").alias("paper"), "p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") + 1).cast("string"), F.lit(" percent"))).alias("told"))
    roles = C.Roles("p_brand", "rx", "num", "with", "p_name", "paper", "p_partkey", "told")
    out = lifecycles.route_tables(raw, roles, "A", ["o"], {"promo": ["promo"]}).where(F.col("route") != "A")
    return out.select("route", "id", F.round("mean_value", 4).alias("mean_value"), "link")


@_query("""WITH s AS (SELECT o_orderpriority AS chemistry, o_custkey AS key, max(o_totalprice) AS y FROM orders GROUP BY 1, 2)
  SELECT h.chemistry, CAST(k.cut AS DOUBLE) AS cut, CASE WHEN s.y IS NULL THEN 'grey' WHEN s.y >= k.cut THEN 'highlight' ELSE 'hollow' END AS class, count(*) AS n
  FROM (SELECT DISTINCT o_custkey AS key FROM orders) c, (SELECT DISTINCT chemistry FROM s) h, (SELECT unnest([100000.0, 250000.0]) AS cut) k LEFT JOIN s ON s.chemistry = h.chemistry AND s.key = c.key GROUP BY 1, 2, 3""")
def scope_map(spark, sf):
    """The second chain: features selected, projected and clustered, scopes classified against them."""
    orders = _t(spark, sf, "orders")
    price = F.col("o_totalprice")
    own = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.avg(price).alias("mean"), F.max(price).alias("max"), F.min(price).alias("min"), F.count("*").alias("n"), F.lit(1.0).alias("same"))
    scopes = orders.select(F.col("o_orderpriority").alias("chemistry"), F.col("o_custkey").alias("key"), price.alias("yield"))
    out = lifecycles.scope_map({"orders": own}, scopes, "key", [100000, 250000], 5)
    return out.groupBy("chemistry", "cut", "class").agg(F.count("*").alias("n"))


@_query()
def regression(spark, sf):
    """The third chain: trees tuned, voted and evaluated on feature tables joined by name."""
    part = _t(spark, sf, "part")
    frames = {"even": part.where("p_partkey % 2 = 0").select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("name_size")), "odd": part.where("p_partkey % 2 = 1").select("p_partkey", "p_size", "p_retailprice", F.length("p_name").alias("name_size"))}
    votes, metrics, ranked = lifecycles.regression(frames, "p_partkey", "p_retailprice", {"maxDepth": [2, 3], "maxIter": [2]}, folds=5, repeats=3)
    told = votes.select(F.concat(F.lit("voted "), "param").alias("what"), F.col("value").cast("double").alias("value"))
    return told.unionByName(metrics.groupBy(F.col("metric").alias("what")).agg(F.avg("value").alias("value"))).unionByName(ranked.select(F.concat(F.lit("importance of "), "feature").alias("what"), F.col("importance").alias("value")))


# ---- molecules in line notation -------------------------------------------------------------------

def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each part: chains, rings, branches, aromatic rings, open branches and charges by kind, of size a."""
    a = (F.col("p_size") % 4 + 1).cast("int")
    run = lambda c: F.repeat(F.lit(c), a)
    kinds = [F.concat(run("C"), F.lit("C=C")), F.concat(F.lit("C1"), run("C"), F.lit("C1=O")), F.concat(F.lit("C("), run("N"), F.lit(")(O)C=CC=C")), F.concat(F.lit("c1ccccc1"), run("C"), F.lit("C=C")), F.concat(F.lit("C("), run("C"), F.lit("C=C")), F.concat(run("C"), F.lit("[O-]"))]
    parts = _t(spark, sf, "part").select("p_partkey", "p_size").repartition("p_partkey")  # one small file would be one task
    return parts.select("p_partkey", F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int")).alias("line"))


_LINES = "p AS (SELECT p_partkey, p_partkey % 6 AS k, p_size % 4 + 1 AS a FROM part)"


@_query(f"""WITH {_LINES} SELECT p_partkey, CAST([a + 2, a + 3, a + 6, a + 8, 0, a + 1][k + 1] AS BIGINT) AS n_atoms, CAST([a + 1, a + 3, a + 5, a + 8, 0, a][k + 1] AS BIGINT) AS n_bonds,
  CAST([1, 1, 2, 1, 0, 0][k + 1] AS BIGINT) AS n_double, CAST(CASE k WHEN 3 THEN 6 ELSE 0 END AS BIGINT) AS n_aromatic, CAST(CASE k WHEN 5 THEN -1 ELSE 0 END AS BIGINT) AS charge, k = 4 AS failed FROM p""")
def molecule_lines(spark, sf):
    """Lines read into atoms and bonds, counted for each."""
    lines = _lines(spark, sf)
    atoms, bonds, failed = molecules.read_lines(lines, "p_partkey", "line")
    a = atoms.groupBy(F.col("mol_id").alias("p_partkey")).agg(F.count("*").alias("n_atoms"), F.sum("charge").alias("charge"))
    b = bonds.groupBy(F.col("mol_id").alias("p_partkey")).agg(F.count("*").alias("n_bonds"), F.count_if(F.col("bond_order") == 2).alias("n_double"), F.count_if("aromatic").alias("n_aromatic"))
    f = failed.select(F.col("mol_id").alias("p_partkey"), F.lit(True).alias("failed"))
    every = lines.select("p_partkey").join(a, "p_partkey", "left").join(b, "p_partkey", "left").join(f, "p_partkey", "left")
    return every.na.fill(0).na.fill(False).select("p_partkey", "n_atoms", "n_bonds", "n_double", "n_aromatic", "charge", "failed")


@_query(f"""WITH {_LINES}, v AS (SELECT *, unnest(range(1, [1, 0, 2, 1, 0, 0][k + 1] + 1)) AS variant FROM p)
  SELECT p_partkey, variant, CAST([a + 2, 0, a + 6, a + 8][k + 1] AS BIGINT) AS n_atoms, CAST([a + 1, 0, a + 5, a + 8][k + 1] AS BIGINT) AS n_bonds, CAST(1 AS BIGINT) AS n_double FROM v""")
def cleaned_lines(spark, sf):
    """Lines screened, read, turned into variants with one double bond, written, and read once more."""
    out, _ = lifecycles.cleaned_lines(_lines(spark, sf), "p_partkey", "line")
    atoms, bonds, _ = molecules.read_lines(out.select(F.struct("mol_id", "variant").alias("of"), "line"), "of", "line")
    b = bonds.groupBy("mol_id").agg(F.count("*").alias("n_bonds"), F.count_if((F.col("bond_order") == 2) & ~F.col("aromatic")).alias("n_double"))
    both = atoms.groupBy("mol_id").agg(F.count("*").alias("n_atoms")).join(b.hint("merge"), "mol_id")
    return both.select(F.col("mol_id.mol_id").alias("p_partkey"), F.col("mol_id.variant").cast("long").alias("variant"), "n_atoms", "n_bonds", "n_double")


@_query(f"""WITH {_LINES} SELECT CAST(CASE WHEN k = 0 AND a = 1 THEN 3 ELSE 4 END AS BIGINT) AS n_atoms, CASE WHEN k = 0 AND a = 1 THEN 'C=%01.C=%01%02.C%02' ELSE 'border' END AS line, count(*) AS n FROM p WHERE k IN (0, 3) GROUP BY 1, 2""")
def motif_lines(spark, sf):
    """Motifs around the only double bond: a chain of one is whole, all others look alike two bonds off."""
    atoms, bonds, _ = molecules.read_lines(_lines(spark, sf), "p_partkey", "line")
    found = lifecycles.motif_lines(atoms, bonds, 2)
    whole = F.when(F.col("line").contains("*"), "border").otherwise("C=%01.C=%01%02.C%02")
    return found.groupBy("motif_key").agg(F.first("n_atoms").alias("n_atoms"), F.first(whole).alias("line"), F.count("*").alias("n")).drop("motif_key")


@_query(f"""WITH {_LINES} SELECT p_partkey, CAST([0, 1, 0, 1, 0, 0][k + 1] AS INTEGER) AS ring, CAST(k = 3 AS INTEGER) AS aromatic, CAST(k IN (0, 2, 3) AS INTEGER) AS double_carbons, CAST(k = 1 AS INTEGER) AS carbonyl,
  CAST(k = 5 AS INTEGER) AS charged, CAST([a + 2, a + 3, a + 6, a + 8, 0, a + 1][k + 1] AS INTEGER) AS n_atoms, CAST(k IN (1, 3) AS INTEGER) AS n_rings FROM p WHERE k <> 4""")
def line_features(spark, sf):
    """The chain from lines to all keys and descriptors; some of them are compared."""
    out, _ = lifecycles.line_features(_lines(spark, sf), "p_partkey", "line")
    named = {165: "ring", 162: "aromatic", 99: "double_carbons", 154: "carbonyl", 49: "charged"}
    return out.select("p_partkey", *[F.col(f"bit{k}").alias(n) for k, n in named.items()], "n_atoms", "n_rings")


@_query(f"""WITH {_LINES} SELECT p_partkey, min(p_partkey) OVER (PARTITION BY k, a) AS first_same FROM p WHERE k <> 4""")
def canonical_lines(spark, sf):
    """The first part with the same molecule, where every other line is written the other way round."""
    a = (F.col("p_size") % 4 + 1).cast("int")
    run = lambda c: F.repeat(F.lit(c), a)
    turned = [F.concat(F.lit("C=C"), run("C")), F.concat(F.lit("O=C1"), run("C"), F.lit("C1")), F.concat(F.lit("C=CC=CC(O)"), run("N")), F.concat(F.lit("C=C"), run("C"), F.lit("c1ccccc1")), F.lit("C("), F.concat(F.lit("[O-]"), run("C"))]
    parts = _t(spark, sf, "part").select("p_partkey", "p_size").repartition("p_partkey")
    other = parts.select("p_partkey", F.element_at(F.array(*turned), (F.col("p_partkey") % 6 + 1).cast("int")).alias("turned"))
    lines = _lines(spark, sf).join(other, "p_partkey").select("p_partkey", F.when(F.col("p_partkey") % 12 < 6, F.col("line")).otherwise(F.col("turned")).alias("line"))
    out, _ = lifecycles.canonical_lines(lines, "p_partkey", "line")
    first = out.groupBy("canonical_key").agg(F.min("p_partkey").alias("first_same"))
    return out.join(first, "canonical_key").select("p_partkey", "first_same")
