"""Graph queries over the parts' repository, with recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.operators import graphs
from solvarium.plans.fixtures import PARTS_SQL, part_graph
from solvarium.plans.lineage import cut

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = PARTS_SQL + sql
        return f

    return add


def graph(spark, sf_dir, acyclic=False):
    v, e = part_graph(spark, sf_dir, acyclic)
    return cut(v), cut(e)


@query("SELECT 0 AS repo, a AS src, b AS dst FROM fx_path")
def transitive_closure(spark, sf_dir):
    return graphs.closure(graph(spark, sf_dir)[1])


@query("SELECT a AS root, b AS uid FROM fx_path UNION SELECT p_partkey, p_partkey FROM part")
def dependency_cone(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return graphs.full_cones(v, e).select("root", "uid")


@query("SELECT b AS root, a AS uid FROM fx_path UNION SELECT p_partkey, p_partkey FROM part")
def reverse_cone(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return graphs.full_cones(v, graphs.reverse(e)).select("root", "uid")


@query(
    ", und AS (SELECT a, b FROM fx_edge UNION SELECT b, a FROM fx_edge), w(a, b) AS (SELECT a, b FROM und UNION SELECT w.a, u.b FROM w JOIN und u ON w.b = u.a)"
    " SELECT p_partkey AS uid, least(p_partkey, coalesce(min(w.b), p_partkey)) AS component FROM part LEFT JOIN w ON w.a = p_partkey GROUP BY p_partkey"
)
def connected_components(spark, sf_dir):
    return graphs.components(*graph(spark, sf_dir)).select("uid", "component")


@query("SELECT p_partkey AS uid, least(p_partkey, coalesce(min(x.b), p_partkey)) AS component FROM part LEFT JOIN (SELECT a, b FROM fx_path p WHERE EXISTS (SELECT 1 FROM fx_path q WHERE q.a = p.b AND q.b = p.a)) x ON x.a = p_partkey GROUP BY p_partkey")
def strong_components(spark, sf_dir):
    return graphs.strong_components(*graph(spark, sf_dir)).select("uid", "component")


@query(
    ", scc AS (SELECT p_partkey AS uid, least(p_partkey, coalesce(min(x.b), p_partkey)) AS c FROM part LEFT JOIN (SELECT a, b FROM fx_path p WHERE EXISTS (SELECT 1 FROM fx_path q WHERE q.a = p.b AND q.b = p.a)) x ON x.a = p_partkey GROUP BY p_partkey)"
    " SELECT c AS component, string_agg('p' || uid, '/' ORDER BY 'p' || uid) AS label FROM scc GROUP BY c"
)
def cycle_reduction(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    names = v.withColumn("name", F.concat(F.lit("p"), "uid"))
    return graphs.condensation(v, e, names)[0].select("component", "label")


@query("SELECT a AS src, b AS dst FROM fx_dag e WHERE NOT EXISTS (SELECT 1 FROM fx_dag m JOIN fx_dagpath p ON p.a = m.b WHERE m.a = e.a AND p.b = e.b)")
def transitive_reduction(spark, sf_dir):
    return graphs.transitive_reduction(graph(spark, sf_dir, True)[1]).select("src", "dst")


@query(
    ", lay(a, n) AS (SELECT p_partkey, 0 FROM part UNION SELECT e.a, lay.n + 1 FROM lay JOIN fx_dag e ON e.b = lay.a)"
    " SELECT a AS uid, max(n) AS layer FROM lay GROUP BY a"
)
def partial_order_layers(spark, sf_dir):
    return graphs.layers(*graph(spark, sf_dir, True)).select("uid", "layer")


@query(
    ", d AS (SELECT 'out' AS direction, count(*) AS degree FROM fx_edge GROUP BY a UNION ALL SELECT 'in', count(*) FROM fx_edge GROUP BY b)"
    " SELECT direction, degree, count(*) AS n FROM d GROUP BY ALL"
)
def degree_histogram(spark, sf_dir):
    return graphs.degree_histogram(*graph(spark, sf_dir))


@query("SELECT v AS vertices, e AS edges, e / (v * (v - 1)) AS density FROM (SELECT count(*) AS v FROM part), (SELECT count(*) AS e FROM fx_edge)")
def graph_density(spark, sf_dir):
    return graphs.density(*graph(spark, sf_dir)).select("vertices", "edges", "density")


@query(
    ", k AS (SELECT a, count(*) AS k FROM fx_edge GROUP BY a), t AS (SELECT x.a, count(*) AS t FROM fx_edge x JOIN fx_edge m ON m.a = x.b JOIN fx_edge y ON y.a = x.a AND y.b = m.b GROUP BY x.a)"
    " SELECT p_partkey AS uid, CASE coalesce(k, 0) WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE coalesce(t, 0) / (k * (k - 1)) END AS coefficient"
    " FROM part LEFT JOIN k ON k.a = p_partkey LEFT JOIN t ON t.a = p_partkey"
)
def clustering_coefficient(spark, sf_dir):
    return graphs.clustering(*graph(spark, sf_dir)).select("uid", "coefficient")


@query(
    ", near AS (SELECT a, b FROM fx_edge UNION SELECT x.a, y.b FROM fx_edge x JOIN fx_edge y ON y.a = x.b)"
    " SELECT p_partkey AS uid, count(b) FILTER (WHERE b <> p_partkey) AS n FROM part LEFT JOIN near ON a = p_partkey GROUP BY p_partkey"
)
def two_step_reach(spark, sf_dir):
    return graphs.two_step_reach(*graph(spark, sf_dir)).select("uid", "n")


@query(
    ", far(a, b, n) AS (SELECT a, b, 1 FROM fx_edge UNION SELECT f.a, e.b, f.n + 1 FROM far f JOIN fx_edge e ON e.a = f.b WHERE f.n < 40)"
    " SELECT count(*) AS pairs, CAST(sum(n) AS BIGINT) AS distance_sum FROM (SELECT a, b, min(n) AS n FROM far WHERE a <> b GROUP BY a, b)"
)
def average_distance(spark, sf_dir):
    return graphs.average_distance(graph(spark, sf_dir)[1]).select("pairs", "distance_sum")


@query("SELECT count(*) AS components, max(n) AS largest FROM (SELECT count(*) AS n FROM (SELECT a, min(b) AS c FROM fx_path p WHERE a = b OR EXISTS (SELECT 1 FROM fx_path q WHERE q.a = p.b AND q.b = p.a) GROUP BY a) GROUP BY c)")
def cycle_statistics(spark, sf_dir):
    """Cycles: strong components that hold an edge."""
    paths = cut(graphs.closure(graph(spark, sf_dir)[1]))
    back = paths.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    of = paths.join(back, ["repo", "src", "dst"], "left_semi").groupBy("src").agg(F.min("dst").alias("c"))
    return of.groupBy("c").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
