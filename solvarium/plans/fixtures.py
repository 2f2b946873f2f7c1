"""Package repositories derived from the star-schema tables, as DataFrames and as SQL.

Orders: every order is a repository of at most seven packages, a line each. Parts: one repository of all parts, with
arithmetic edges inside blocks of 50 ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvarium.operators.model import Universe
from solvarium.plans.lineage import cut


def order_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    status = F.col("l_linestatus")
    rows = lines.groupBy(F.col("l_orderkey").alias("repo"), F.col("l_linenumber").cast("int").alias("uid")).agg(
        F.min("l_partkey").alias("pk"),
        F.min("l_suppkey").alias("sk"),
        F.min("l_quantity").cast("int").alias("q"),
        (F.bool_and(status >= "F") & F.bool_or(status == "F")).alias("installed"),  # the least is F, without a buffer of text
    )
    return rows.withColumns({"name": name_of(), "ver": F.col("uid")})


def name_of() -> Column:
    return F.concat(F.lit("n"), F.col("pk") % 4)


def order_universe(spark: SparkSession, sf_dir: str) -> Universe:
    p = cut(order_packages(spark, sf_dir))
    v = lambda n: F.lit(n).cast("int")

    some = lambda *each: F.filter(F.array(*each), lambda x: x.isNotNull())
    rows = lambda c: p.select("repo", "uid", F.explode(c).alias("x")).select("repo", "uid", "x.*")

    def atom(when, clause, alt, name, op, ver):
        return F.when(F.expr(when), F.struct(v(clause).alias("clause"), v(alt).alias("alt"), name.alias("name"), F.lit(op).alias("op"), ver.cast("int").alias("ver")))

    n = lambda c: F.concat(F.lit("n"), c)
    deps = some(
        atom("pk % 3 <> 0", 1, 1, n((F.col("pk") + 1) % 4), "any", v(0)),
        atom("pk % 3 <> 0", 1, 2, n(F.col("sk") % 4), ">=", 1 + F.col("sk") % 7),
        atom("sk % 4 = 0", 2, 1, n((F.col("pk") + 2) % 4), "<=", 2 + F.col("pk") % 6),
        atom("pk % 5 = 0", 3, 1, F.concat(F.lit("v"), F.col("sk") % 2), "any", v(0)),
    )
    confs = some(F.when(F.expr("pk % 2 = 0"), F.struct(n((F.col("sk") + 1) % 4).alias("name"), F.lit("<").alias("op"), (1 + F.col("q") % 7).cast("int").alias("ver"))))
    own = F.struct("name", F.col("ver").cast("int").alias("ver"))
    virtual = F.when(F.expr("q % 3 = 0"), F.struct(F.concat(F.lit("v"), F.col("sk") % 3).alias("name"), F.lit(None).cast("int").alias("ver")))
    provs = some(own, virtual)
    derived = lambda d: d.withColumns({"name": name_of(), "ver": F.col("uid")}).select("*", deps.alias("deps"), confs.alias("confs"), provs.alias("provs"))
    return Universe(p, rows(deps), rows(confs), rows(provs), p.select("repo", "uid", "pk", "sk", "q"), derived, most=8)


def part_graph(spark: SparkSession, sf_dir: str, acyclic: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the parts' repository."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    k, base = F.col("p_partkey"), F.col("p_partkey") - F.col("p_partkey") % 50
    edges = part.where("p_partkey % 4 <> 0").select(k.alias("src"), (base + (k * 7 + 3) % 50).alias("dst"))
    edges = edges.unionByName(part.where("p_size % 3 = 0").select(k.alias("src"), (base + (k * 11 + F.col("p_size")) % 50).alias("dst")))
    edges = edges.where("src <> dst").distinct().join(part.select(k.alias("dst")), "dst", "left_semi")
    edges = edges.select(F.lit(0).alias("repo"), "src", "dst")
    vertices = part.select(F.lit(0).alias("repo"), k.alias("uid"))
    return vertices, edges.where("src > dst") if acyclic else edges


ORDERS_SQL = """WITH fx_pkg AS (
  SELECT l_orderkey AS repo, CAST(l_linenumber AS INT) AS uid, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk,
         CAST(MIN(l_quantity) AS INT) AS q, MIN(l_linestatus) = 'F' AS installed,
         CAST(POWER(2, l_linenumber - 1) AS BIGINT) AS bit
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
fx_dep AS (
  SELECT repo, uid, 1 AS clause, 1 AS alt, CONCAT('n', (pk + 1) % 4) AS name, 'any' AS op, 0 AS ver FROM fx_pkg WHERE pk % 3 <> 0
  UNION ALL SELECT repo, uid, 1, 2, CONCAT('n', sk % 4), '>=', CAST(1 + sk % 7 AS INT) FROM fx_pkg WHERE pk % 3 <> 0
  UNION ALL SELECT repo, uid, 2, 1, CONCAT('n', (pk + 2) % 4), '<=', CAST(2 + pk % 6 AS INT) FROM fx_pkg WHERE sk % 4 = 0
  UNION ALL SELECT repo, uid, 3, 1, CONCAT('v', sk % 2), 'any', 0 FROM fx_pkg WHERE pk % 5 = 0),
fx_conf AS (
  SELECT repo, uid, CONCAT('n', (sk + 1) % 4) AS name, '<' AS op, CAST(1 + q % 7 AS INT) AS ver FROM fx_pkg WHERE pk % 2 = 0),
fx_prov AS (
  SELECT repo, uid, bit, CONCAT('n', pk % 4) AS name, uid AS ver FROM fx_pkg
  UNION ALL SELECT repo, uid, bit, CONCAT('v', sk % 3), CAST(NULL AS INT) FROM fx_pkg WHERE q % 3 = 0),
fx_alt AS (
  SELECT DISTINCT d.repo, d.uid, d.clause, d.alt, p.uid AS target, p.bit FROM fx_dep d JOIN fx_prov p ON p.repo = d.repo AND p.name = d.name
   AND (d.op = 'any' OR p.ver IS NULL OR (d.op = '>=' AND p.ver >= d.ver) OR (d.op = '<=' AND p.ver <= d.ver))),
fx_clause AS (
  SELECT d.repo, d.uid, d.clause, COALESCE(BIT_OR(a.bit), 0) AS mask
  FROM (SELECT DISTINCT repo, uid, clause FROM fx_dep) d LEFT JOIN fx_alt a ON a.repo = d.repo AND a.uid = d.uid AND a.clause = d.clause
  GROUP BY d.repo, d.uid, d.clause),
fx_conflict AS (
  SELECT DISTINCT c.repo, c.uid, p.uid AS other FROM fx_conf c JOIN fx_prov p
    ON p.repo = c.repo AND p.name = c.name AND p.uid <> c.uid AND (p.ver IS NULL OR p.ver < c.ver)),
fx_cand AS (
  SELECT f.repo, t.s FROM (SELECT repo, BIT_OR(bit) AS f FROM fx_pkg GROUP BY repo) f
  JOIN range(128) AS t(s) ON (t.s & f.f) = t.s),
fx_open AS (
  SELECT c.repo, c.s FROM fx_cand c JOIN fx_pkg b ON b.repo = c.repo AND (c.s & b.bit) <> 0
    JOIN fx_clause d ON d.repo = b.repo AND d.uid = b.uid WHERE (c.s & d.mask) = 0),
fx_fight AS (
  SELECT c.repo, c.s FROM fx_cand c JOIN fx_conflict x ON x.repo = c.repo
    JOIN fx_pkg a ON a.repo = x.repo AND a.uid = x.uid JOIN fx_pkg b ON b.repo = x.repo AND b.uid = x.other
  WHERE (c.s & a.bit) <> 0 AND (c.s & b.bit) <> 0),
fx_valid AS (
  SELECT c.repo, c.s FROM fx_cand c LEFT JOIN (SELECT * FROM fx_open UNION SELECT * FROM fx_fight) b ON b.repo = c.repo AND b.s = c.s WHERE b.s IS NULL),
fx_closed AS (
  SELECT c.repo, c.s FROM fx_cand c LEFT JOIN (SELECT DISTINCT * FROM fx_open) b ON b.repo = c.repo AND b.s = c.s WHERE b.s IS NULL),
fx_strong AS (
  SELECT p.repo, p.uid, BIT_AND(v.s) AS strong FROM fx_pkg p JOIN fx_valid v ON v.repo = p.repo AND (v.s & p.bit) <> 0
  GROUP BY p.repo, p.uid)
"""

PARTS_SQL = """WITH RECURSIVE fx_edge AS (
  SELECT DISTINCT x.a, x.b FROM (
    SELECT p_partkey AS a, p_partkey - p_partkey % 50 + (p_partkey * 7 + 3) % 50 AS b FROM part WHERE p_partkey % 4 <> 0
    UNION ALL
    SELECT p_partkey, p_partkey - p_partkey % 50 + (p_partkey * 11 + p_size) % 50 FROM part WHERE p_size % 3 = 0) x
  JOIN part p ON p.p_partkey = x.b WHERE x.a <> x.b),
fx_path(a, b) AS (SELECT a, b FROM fx_edge UNION SELECT r.a, e.b FROM fx_path r JOIN fx_edge e ON r.b = e.a),
fx_dag AS (SELECT * FROM fx_edge WHERE a > b),
fx_dagpath(a, b) AS (SELECT a, b FROM fx_dag UNION SELECT r.a, e.b FROM fx_dagpath r JOIN fx_dag e ON r.b = e.a)
"""
