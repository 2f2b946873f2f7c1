"""Queries over one small repository an order, and their SQL by enumeration of all package sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.operators import diffs, graphs, model, sat, sinks, translate
from solvarium.plans.fixtures import ORDERS_SQL, order_packages, order_universe
from solvarium.plans.lineage import cut

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = ORDERS_SQL + sql
        return f

    return add


def resolved(spark, sf_dir):
    """(packages, resolved dependencies, conflicts), each written once and read by every step that follows."""
    u = order_universe(spark, sf_dir)
    return u, u.packages, cut(model.resolve_deps(u)), cut(model.resolve_conflicts(u))


def known(status: str):
    """Whether the status is that one; null where it is unknown."""
    return F.when(F.col("status") != "unknown", F.col("status") == status)


@query("SELECT DISTINCT repo, uid, clause, target FROM fx_alt")
def resolved_dependencies(spark, sf_dir):
    return model.resolve_deps(order_universe(spark, sf_dir)).where("target IS NOT NULL")


@query("SELECT repo, uid, clause FROM fx_clause WHERE mask = 0")
def missing_clauses(spark, sf_dir):
    return model.missing_clauses(model.resolve_deps(order_universe(spark, sf_dir)))


@query("SELECT DISTINCT repo, least(uid, other) AS lo, greatest(uid, other) AS hi FROM fx_conflict")
def conflict_pairs(spark, sf_dir):
    return model.resolve_conflicts(order_universe(spark, sf_dir))


@query("SELECT repo, uid, 'n' || (pk % 4) AS name, uid AS ver FROM fx_pkg QUALIFY row_number() OVER (PARTITION BY repo, pk % 4 ORDER BY uid DESC) <= 2")
def latest_two_per_name(spark, sf_dir):
    return model.latest(order_packages(spark, sf_dir), 2).select("repo", "uid", "name", "ver")


@query("SELECT repo, 'n' || (pk % 4) AS name, max(uid) AS ver FROM fx_pkg WHERE installed GROUP BY ALL")
def upgrade_floor(spark, sf_dir):
    return model.upgrade_floor(order_packages(spark, sf_dir))


@query("SELECT DISTINCT repo, uid AS src, target AS dst FROM fx_alt")
def dependency_graph_edges(spark, sf_dir):
    return graphs.dependency_edges(model.resolve_deps(order_universe(spark, sf_dir)))


@query("SELECT DISTINCT repo, uid AS src, target AS dst FROM (SELECT repo, uid, clause, max(target) AS target FROM (SELECT DISTINCT repo, uid, clause, target FROM fx_alt) GROUP BY ALL HAVING count(*) = 1) WHERE uid <> target")
def conjunctive_edges(spark, sf_dir):
    return graphs.conjunctive_edges(model.resolve_deps(order_universe(spark, sf_dir)))


@query("SELECT repo, target AS uid, count(DISTINCT uid) AS n FROM fx_alt WHERE uid <> target GROUP BY ALL")
def reverse_dependency_counts(spark, sf_dir):
    return graphs.reverse_counts(graphs.dependency_edges(model.resolve_deps(order_universe(spark, sf_dir))))


@query(
    ", e AS (SELECT DISTINCT repo, uid AS a, target AS b FROM fx_alt), l1 AS (SELECT repo, uid AS root, uid, 0 AS level FROM fx_pkg),"
    " l2 AS (SELECT DISTINCT repo, root, b AS uid FROM l1 JOIN e USING (repo) WHERE l1.uid = e.a AND b <> root),"
    " l3 AS (SELECT DISTINCT repo, root, b AS uid FROM l2 JOIN e USING (repo) WHERE l2.uid = e.a AND b <> root EXCEPT SELECT * FROM l2)"
    " SELECT * FROM l1 UNION ALL SELECT *, 1 FROM l2 UNION ALL SELECT *, 2 FROM l3"
)
def dependency_cone_depth_three(spark, sf_dir):
    u, packages, deps, _ = resolved(spark, sf_dir)
    return graphs.cone(packages.select("repo", F.col("uid").alias("root"), "uid"), graphs.dependency_edges(deps), depth=3)


@query("SELECT p.repo, p.uid FROM fx_pkg p WHERE NOT EXISTS (SELECT 1 FROM fx_closed v WHERE v.repo = p.repo AND (v.s & p.bit) <> 0)")
def horn_broken(spark, sf_dir):
    return sat.horn_broken(model.resolve_deps(order_universe(spark, sf_dir)))


@query("SELECT repo, uid FROM fx_strong")
def installable_packages(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.check(packages, deps, confs).where("status = 'ok'").select("repo", "uid")


@query("SELECT p.repo, p.uid FROM fx_pkg p ANTI JOIN fx_strong USING (repo, uid)")
def broken_packages(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.check(packages, deps, confs).where("status = 'broken'").select("repo", "uid")


@query(
    "SELECT (SELECT count(*) FROM fx_pkg) AS packages, (SELECT count(*) FROM fx_pkg) - (SELECT count(*) FROM fx_strong) AS broken,"
    " (SELECT count(*) FROM fx_clause WHERE mask = 0) AS missing, (SELECT count(*) FROM (SELECT DISTINCT repo, least(uid, other), greatest(uid, other) FROM fx_conflict)) AS conflicts"
)
def broken_summary(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    said = sat.check(packages, deps, confs).agg(F.count("*").alias("packages"), F.count_if(F.col("status") == "broken").alias("broken"))
    missing = model.missing_clauses(deps).agg(F.count("*").alias("missing"))
    return said.join(missing).join(confs.agg(F.count("*").alias("conflicts")))  # three single rows


@query(
    "SELECT a.repo, a.uid AS lo, b.uid AS hi, EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = a.repo AND (v.s & (a.bit | b.bit)) = (a.bit | b.bit)) AS together"
    " FROM fx_pkg a JOIN fx_pkg b ON a.repo = b.repo AND a.uid < b.uid"
)
def coinstall_pairs(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    pairs = packages.select("repo", F.col("uid").alias("lo")).join(packages.select("repo", F.col("uid").alias("hi")), "repo").where("lo < hi")
    said = sat.coinstallable(pairs, deps, confs)
    return said.select("repo", "lo", "hi", known("ok").alias("together"))


@query(
    "SELECT m.repo, v.s IS NOT NULL AS consistent FROM (SELECT repo, coalesce(bit_or(bit) FILTER (WHERE installed), 0) AS s FROM fx_pkg GROUP BY repo) m"
    " LEFT JOIN fx_valid v ON v.repo = m.repo AND v.s = m.s"
)
def consistent_repositories(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.consistent(packages, deps, confs)


@query("SELECT s.repo, s.uid, p.uid AS dep FROM fx_strong s JOIN fx_pkg p ON p.repo = s.repo AND (s.strong & p.bit) <> 0 AND p.uid <> s.uid")
def strong_dependencies(spark, sf_dir):
    return sat.strong_dependencies_of(order_universe(spark, sf_dir)).where("status = 'broken'").select("repo", "uid", "dep")


@query("SELECT s.repo, p.uid, count(*) AS impact FROM fx_strong s JOIN fx_pkg p ON p.repo = s.repo AND (s.strong & p.bit) <> 0 AND p.uid <> s.uid GROUP BY ALL")
def impact_set_sizes(spark, sf_dir):
    return strong_dependencies(spark, sf_dir).groupBy("repo", F.col("dep").alias("uid")).agg(F.count("*").alias("impact"))


@query(
    "SELECT a.repo, a.uid AS lo, b.uid AS hi FROM fx_strong a JOIN fx_strong b ON a.repo = b.repo AND a.uid < b.uid"
    " JOIN fx_pkg pa ON pa.repo = a.repo AND pa.uid = a.uid JOIN fx_pkg pb ON pb.repo = b.repo AND pb.uid = b.uid"
    " WHERE NOT EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = a.repo AND (v.s & (pa.bit | pb.bit)) = (pa.bit | pb.bit))"
)
def strong_conflicts(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.strong_conflicts(packages, deps, confs).where("status = 'broken'").select("repo", "lo", "hi")


@query(
    "SELECT d.repo, d.uid, d.clause, d.alt FROM fx_dep d JOIN fx_strong USING (repo, uid) JOIN fx_pkg p USING (repo, uid) WHERE NOT EXISTS ("
    " SELECT 1 FROM fx_alt a JOIN fx_valid v ON v.repo = a.repo WHERE a.repo = d.repo AND a.uid = d.uid AND a.clause = d.clause AND a.alt = d.alt"
    " AND (v.s & p.bit) <> 0 AND (v.s & a.bit) <> 0)"
)
def useless_alternatives(spark, sf_dir):
    u, packages, deps, confs = resolved(spark, sf_dir)
    return sat.useless_alternatives(u.deps, u.provs, packages, deps, confs).where("status = 'broken'").drop("status")


@query(
    ", d AS (SELECT repo, p.uid AS dominator, q.uid AS dominated FROM fx_strong s JOIN fx_pkg p USING (repo, uid) JOIN fx_pkg q USING (repo) WHERE (s.strong & q.bit) <> 0 AND q.uid <> p.uid)"
    " SELECT * FROM d x WHERE NOT EXISTS (SELECT 1 FROM d r WHERE r.repo = x.repo AND r.dominated = x.dominated AND r.dominator <> x.dominator"
    " AND NOT EXISTS (SELECT 1 FROM d y WHERE y.repo = r.repo AND y.dominator = r.dominator AND y.dominated = x.dominator)"
    " AND NOT EXISTS (SELECT 1 FROM d z WHERE z.repo = r.repo AND z.dominator = x.dominator AND z.dominated = r.dominator))"
)
def direct_dominators(spark, sf_dir):
    return sat.strong_dominators(order_universe(spark, sf_dir))


@query(
    ", best AS (SELECT repo, uid, row_number() OVER (PARTITION BY repo, pk % 4 ORDER BY uid DESC) = 1 AS after, installed AS before FROM fx_pkg)"
    " SELECT repo, uid, CASE WHEN after THEN 'install' ELSE 'remove' END AS action FROM best WHERE after <> before"
)
def install_remove_diff(spark, sf_dir):
    packages = cut(order_packages(spark, sf_dir))
    return diffs.changes(packages.where("installed"), model.latest(packages)).select("repo", "uid", "action")


@query(
    ", v AS (SELECT repo, 'n' || (pk % 4) AS name, uid, installed, row_number() OVER (PARTITION BY repo, pk % 4 ORDER BY uid DESC) = 1 AS newest FROM fx_pkg),"
    " g AS (SELECT repo, name, count(*) FILTER (WHERE installed) AS nb, max(uid) FILTER (WHERE installed) AS old, max(uid) FILTER (WHERE newest) AS new FROM v GROUP BY ALL)"
    " SELECT repo, name, CASE WHEN nb = 0 THEN 'install' WHEN nb > 1 THEN 'several' WHEN old < new THEN 'upgrade' WHEN old > new THEN 'downgrade' ELSE 'unchanged' END AS action FROM g"
)
def upgrade_summary(spark, sf_dir):
    packages = cut(order_packages(spark, sf_dir))
    return diffs.classify(packages.where("installed"), model.latest(packages)).select("repo", "name", "action")


@query(
    ", want AS (SELECT repo, bit_or(bit) AS m, bit_or(bit) FILTER (WHERE installed) AS have FROM fx_pkg WHERE true GROUP BY repo),"
    " ok AS (SELECT v.repo, bit_count(coalesce(w.have, 0) & ~v.s) AS removed, bit_count(v.s & ~coalesce(w.have, 0)) AS new"
    "  FROM fx_valid v JOIN want w USING (repo) WHERE EXISTS (SELECT 1 FROM fx_pkg p WHERE p.repo = v.repo AND pk % 4 = 1 AND (v.s & p.bit) <> 0))"
    " SELECT repo, CAST(removed AS BIGINT) AS removed, CAST(new AS BIGINT) AS new FROM (SELECT repo, min((removed, new)) AS m FROM ok GROUP BY repo) t, LATERAL (SELECT m[1] AS removed, m[2] AS new)"
)
def optimal_request_counts(spark, sf_dir):
    """Install name n1 in every repository; fewest removals first, then fewest new packages."""
    from solvarium.operators import requests

    u, packages, deps, confs = resolved(spark, sf_dir)
    asked = packages.where("name = 'n1'").select("repo", F.lit("install").alias("action"), F.lit(1).alias("item"), "uid")
    return requests.optimise(packages, deps, confs, asked, ("removed", "new")).where("status = 'ok'").select("repo", "removed", "new")


@query(
    "SELECT c.repo, c.uid, array_to_string(list_prepend(-c.uid, list_sort(list_transform(list_filter(range(0, 7), lambda k: (c.mask & (1 << k)) <> 0), lambda k: k + 1))), ' ') || ' 0' AS line FROM fx_clause c"
    " UNION ALL SELECT DISTINCT repo, 0, '-' || least(uid, other) || ' -' || greatest(uid, other) || ' 0' FROM fx_conflict"
)
def clause_lines(spark, sf_dir):
    _, _, deps, confs = resolved(spark, sf_dir)
    return sinks.clause_lines(deps, confs)


@query(
    ", k AS (SELECT repo, bit_or(bit) AS m FROM fx_pkg WHERE installed AND q % 11 = 0 GROUP BY repo)"
    " SELECT p.repo, p.uid, EXISTS (SELECT 1 FROM fx_valid v LEFT JOIN k ON k.repo = v.repo WHERE v.repo = p.repo AND (v.s & p.bit) <> 0 AND (v.s & coalesce(k.m, 0)) = coalesce(k.m, 0)) AS ok FROM fx_pkg p"
)
def installable_with_keeps(spark, sf_dir):
    """Installed packages with q divisible by 11 keep their version."""
    u, packages, deps, confs = resolved(spark, sf_dir)
    kept = packages.withColumn("keep", F.when(F.col("q") % 11 == 0, "version").otherwise("none"))
    more = cut(deps.unionByName(translate.keep_clauses(kept, u.provs)))
    return sat.check(packages, more, confs, also=translate.GLOBAL).select("repo", "uid", known("ok").alias("ok"))


@query(
    ", c AS (SELECT DISTINCT repo, uid, clause, target FROM fx_alt), n AS (SELECT repo, uid, clause, count(*) AS n FROM c GROUP BY ALL), x AS ("
    " SELECT DISTINCT 'direct' AS kind, repo, uid::VARCHAR AS a, target::VARCHAR AS b FROM c JOIN n USING (repo, uid, clause) WHERE n = 1"
    " UNION ALL SELECT 'or', repo, uid::VARCHAR, 'c' || clause FROM n WHERE n > 1 UNION ALL SELECT 'or', repo, uid || 'c' || clause, target::VARCHAR FROM c JOIN n USING (repo, uid, clause) WHERE n > 1"
    " UNION ALL SELECT 'missing', repo, uid::VARCHAR, clause::VARCHAR FROM fx_clause WHERE mask = 0"
    " UNION ALL SELECT DISTINCT 'conflict', repo, least(uid, other)::VARCHAR, greatest(uid, other)::VARCHAR FROM fx_conflict)"
    " SELECT kind, count(*) AS n FROM x GROUP BY kind"
)
def syntactic_graph_kinds(spark, sf_dir):
    _, _, deps, confs = resolved(spark, sf_dir)
    return graphs.syntactic_edges(deps, confs).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    ", t AS (SELECT d.repo, d.uid, d.clause, string_agg(name || CASE op WHEN 'any' THEN '' ELSE ' ' || op || ' ' || ver END, ' | ' ORDER BY alt) AS cause FROM fx_dep d JOIN fx_clause c USING (repo, uid, clause) WHERE c.mask = 0 GROUP BY ALL)"
    " SELECT cause, count(*) AS packages FROM t GROUP BY cause"
)
def missing_causes(spark, sf_dir):
    """How many packages have a clause that nothing provides, by the clause's text."""
    u, _, deps, _ = resolved(spark, sf_dir)
    broken = cut(model.missing_clauses(deps).select("repo", "uid").distinct())
    found = sat.reasons(deps, u.deps, broken, depth=1)
    return found.groupBy("cause").agg(F.count("*").alias("packages"))


@query("SELECT repo, uid, CAST(dense_rank() OVER (PARTITION BY repo, pk % 4 ORDER BY uid DESC) - 1 AS BIGINT) AS lag FROM fx_pkg")
def version_lag(spark, sf_dir):
    return translate.version_lag(order_packages(spark, sf_dir)).select("repo", "uid", F.col("lag").cast("long").alias("lag"))
