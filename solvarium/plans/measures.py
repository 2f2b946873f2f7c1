"""Measures, subgraphs, paths and dominators over the parts' repository, with recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.operators import graphs, sinks
from solvarium.plans.fixtures import PARTS_SQL
from solvarium.plans.lineage import cut
from solvarium.plans.parts import graph

QUERIES: dict = {}
SQL: dict = {}
#: A part of the edges, so that some vertices have none and components are small.
THIN = ", thin AS (SELECT a, b FROM fx_edge WHERE a % 3 = 0), und AS (SELECT a, b FROM thin UNION SELECT b, a FROM thin), tw(a, b) AS (SELECT a, b FROM und UNION SELECT tw.a, u.b FROM tw JOIN und u ON tw.b = u.a), tc AS (SELECT p_partkey AS a, least(p_partkey, coalesce(min(tw.b), p_partkey)) AS c FROM part LEFT JOIN tw ON tw.a = p_partkey GROUP BY p_partkey)"
_DEG = ", o AS (SELECT p_partkey AS k, (SELECT count(*) FROM fx_edge WHERE a = p_partkey) AS d_out, (SELECT count(*) FROM fx_edge WHERE b = p_partkey) AS d_in FROM part)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = PARTS_SQL + sql
        return f

    return add


def thin(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return v, cut(e.where("src % 3 = 0"))


@query(_DEG + " SELECT 'in' AS direction, max(d_in) AS highest, avg(d_in) AS average FROM o UNION ALL SELECT 'out', max(d_out), avg(d_out) FROM o")
def degree_extremes(spark, sf_dir):
    return graphs.degree_extremes(*graph(spark, sf_dir)).select("direction", "highest", "average")


@query(_DEG + " SELECT d_in AS in_degree, d_out AS out_degree, count(*) AS n FROM o GROUP BY ALL")
def degree_pairs(spark, sf_dir):
    return graphs.degree_pairs(*graph(spark, sf_dir)).select("in_degree", "out_degree", "n")


@query(
    _DEG + ", s AS (SELECT 'in' AS direction, d_in AS d FROM o UNION ALL SELECT 'out', d_out FROM o)"
    " SELECT direction, (max(d) * count(*) - sum(d)) / CAST(count(*) - 1 AS DOUBLE) / (count(*) - 2) AS centrality FROM s GROUP BY direction"
)
def degree_centrality(spark, sf_dir):
    return graphs.centrality(*graph(spark, sf_dir)).select("direction", "centrality")


@query(THIN + " SELECT count(*) AS components, avg(n) AS average, max(n) AS largest FROM (SELECT count(*) AS n FROM tc GROUP BY c)")
def weak_component_sizes(spark, sf_dir):
    return graphs.component_sizes(graphs.components(*thin(spark, sf_dir))).select("components", "average", "largest")


@query(THIN + " SELECT a AS uid FROM (SELECT a FROM und)  GROUP BY a")
def vertices_with_edges(spark, sf_dir):
    return graphs.without_isolated(*thin(spark, sf_dir)).select("uid")


@query(THIN + " SELECT p_partkey AS uid FROM part WHERE p_partkey NOT IN (SELECT a FROM und)")
def isolated_vertices(spark, sf_dir):
    return graphs.degrees(*thin(spark, sf_dir)).where("in_degree = 0 AND out_degree = 0").select("uid")


@query(THIN + " SELECT a AS src, b AS dst FROM thin JOIN tc USING (a) WHERE c IN (SELECT c FROM tc GROUP BY c HAVING count(*) > 4)")
def edges_of_large_components(spark, sf_dir):
    return graphs.large_components(*thin(spark, sf_dir), 4).select("src", "dst")


@query(" SELECT a AS src, b AS dst FROM fx_edge UNION SELECT b, a FROM fx_edge")
def undirected_edges(spark, sf_dir):
    return graphs.undirected(graph(spark, sf_dir)[1]).select("src", "dst")


@query(" SELECT a AS src, b AS dst FROM fx_edge WHERE a % 2 = 0 AND b % 2 = 0")
def induced_subgraph(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return graphs.induced(e, v.where("uid % 2 = 0")).select("src", "dst")


@query(" SELECT a AS src, b AS dst, CASE WHEN (a + b) % 5 <> 0 THEN 'added' ELSE 'removed' END AS change FROM fx_edge WHERE ((a + b) % 3 <> 0) <> ((a + b) % 5 <> 0)")
def edge_changes(spark, sf_dir):
    e = graph(spark, sf_dir)[1]
    return graphs.edge_diff(e.where("(src + dst) % 3 <> 0"), e.where("(src + dst) % 5 <> 0")).select("src", "dst", "change")


@query(
    ", scc AS (SELECT p_partkey AS uid, least(p_partkey, coalesce(min(x.b), p_partkey)) AS c FROM part LEFT JOIN (SELECT a, b FROM fx_path p WHERE EXISTS (SELECT 1 FROM fx_path q WHERE q.a = p.b AND q.b = p.a)) x ON x.a = p_partkey GROUP BY p_partkey)"
    " SELECT DISTINCT x.c AS src, y.c AS dst FROM fx_edge e JOIN scc x ON x.uid = e.a JOIN scc y ON y.uid = e.b WHERE x.c <> y.c"
)
def cycle_reduction_edges(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return graphs.condensation(v, e, v.withColumn("name", F.col("uid").cast("string")))[1].select("src", "dst")


@query(
    ", far(a, b, c) AS (SELECT a, b, CASE WHEN (a + b) % 5 = 0 THEN 1000 ELSE 0 END FROM fx_dag UNION SELECT f.a, e.b, f.c + CASE WHEN (e.a + e.b) % 5 = 0 THEN 1000 ELSE 0 END FROM far f JOIN fx_dag e ON e.a = f.b)"
    " SELECT a AS src, b AS dst, CAST(min(c) AS BIGINT) AS cost FROM far GROUP BY a, b"
)
def cheapest_paths(spark, sf_dir):
    """Edges whose ends add up to a multiple of five cost 1000, the others nothing."""
    e = graph(spark, sf_dir, True)[1]
    return graphs.cheapest(e.withColumn("cost", F.when((F.col("src") + F.col("dst")) % 5 == 0, 1000).otherwise(0))).select("src", "dst", "cost")


_AVOID = (
    ", entry AS (SELECT p_partkey AS a FROM part WHERE p_partkey NOT IN (SELECT b FROM fx_dag)),"
    " av(r, a) AS (SELECT p_partkey, e.a FROM part JOIN entry e ON e.a - e.a % 50 = p_partkey - p_partkey % 50 AND e.a <> p_partkey UNION SELECT av.r, e.b FROM av JOIN fx_dag e ON e.a = av.a WHERE e.b <> av.r),"
    " dom AS (SELECT q.p_partkey AS q, p.p_partkey AS p FROM part p JOIN part q ON p.p_partkey - p.p_partkey % 50 = q.p_partkey - q.p_partkey % 50 ANTI JOIN av ON av.r = p.p_partkey AND av.a = q.p_partkey),"
    " n AS (SELECT q, count(*) AS n FROM dom GROUP BY q)"
)


@query(_AVOID + " SELECT q AS uid, p AS dominator FROM dom")
def flow_dominators(spark, sf_dir):
    return graphs.dominators(*graph(spark, sf_dir, True)).select("uid", "dominator")


@query(_AVOID + " SELECT dom.q AS uid, arg_max(dom.p, n.n) AS dominator FROM dom JOIN n ON n.q = dom.p WHERE dom.p <> dom.q GROUP BY dom.q")
def immediate_dominators(spark, sf_dir):
    return graphs.immediate_dominators(*graph(spark, sf_dir, True)).select("uid", "dominator")


@query(" SELECT 'dot' AS format, '\"' || a || '\" -> \"' || b || '\";' AS line FROM fx_edge UNION ALL SELECT 'gml', 'node [ id ' || p_partkey || ' ]' FROM part UNION ALL SELECT 'gml', 'edge [ source ' || a || ' target ' || b || ' ]' FROM fx_edge"
       " UNION ALL SELECT 'graphml', '<node id=\"' || p_partkey || '\"/>' FROM part UNION ALL SELECT 'graphml', '<edge source=\"' || a || '\" target=\"' || b || '\"/>' FROM fx_edge")  # fmt: skip
def graph_formats(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    as_ = lambda df, kind: df.select(F.lit(kind).alias("format"), "line")
    return as_(sinks.dot_lines(e), "dot").unionByName(as_(sinks.gml_lines(v, e), "gml")).unionByName(as_(sinks.graphml_lines(v, e), "graphml"))


_TREE = (
    ", two AS (SELECT p.a, min(p.b) AS c FROM fx_path p JOIN fx_path q ON q.a = p.b AND q.b = p.a GROUP BY p.a),"
    " scc AS (SELECT p_partkey AS uid, least(p_partkey, coalesce(c, p_partkey)) AS c FROM part LEFT JOIN two ON a = p_partkey),"
    " ce AS (SELECT DISTINCT x.c AS a, y.c AS b FROM fx_edge e JOIN scc x ON x.uid = e.a JOIN scc y ON y.uid = e.b WHERE x.c <> y.c),"
    " vs AS (SELECT DISTINCT c FROM scc), top AS (SELECT c FROM vs WHERE c NOT IN (SELECT b FROM ce)),"
    " block AS (SELECT p.c AS p, q.c AS q FROM vs p JOIN vs q ON p.c // 50 = q.c // 50),"  # edges stay within blocks of 50
    " free(p, q) AS (SELECT p, q FROM block WHERE q IN (SELECT c FROM top) AND p <> q UNION SELECT f.p, ce.b FROM free f JOIN ce ON ce.a = f.q WHERE ce.b <> f.p),"
    " dom AS (SELECT p, q FROM block WHERE p <> q AND NOT EXISTS (SELECT 1 FROM free f WHERE f.p = block.p AND f.q = block.q)),"
    " n AS (SELECT q, count(*) AS n FROM dom GROUP BY q),"
    " up AS (SELECT dom.q, arg_max(dom.p, coalesce(n.n, 0)) AS dominator FROM dom LEFT JOIN n ON n.q = dom.p GROUP BY dom.q)"
    " SELECT scc.uid, scc.c AS component, up.dominator FROM scc LEFT JOIN up ON up.q = scc.c"
)


@query(_TREE)
def dominator_tree(spark, sf_dir):
    """Of the parts' graph with its cycles."""
    return graphs.dominator_tree(*graph(spark, sf_dir)).select("uid", "component", "dominator")
