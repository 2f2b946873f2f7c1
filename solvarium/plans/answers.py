"""Selections, diagnoses and requests over one small repository an order, and their SQL by enumeration."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.operators import diffs, evolution, graphs, model, requests, sat, sinks, translate
from solvarium.plans.fixtures import ORDERS_SQL, order_packages, order_universe
from solvarium.plans.lineage import cut
from solvarium.plans.orders import known, resolved

QUERIES: dict = {}
SQL: dict = {}
RECURSIVE = ORDERS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def query(sql: str, recursive: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = (RECURSIVE if recursive else ORDERS_SQL) + sql
        return f

    return add


@query("SELECT repo, uid, other FROM fx_conflict UNION SELECT repo, other, uid FROM fx_conflict")
def conflicts_by_package(spark, sf_dir):
    return model.conflicts_of(model.resolve_conflicts(order_universe(spark, sf_dir)))


@query("SELECT repo, 'n' || (pk % 4) AS name, string_agg(uid::VARCHAR, ',' ORDER BY uid) AS versions FROM fx_pkg GROUP BY ALL")
def names_with_versions(spark, sf_dir):
    return model.names(order_packages(spark, sf_dir)).withColumn("versions", F.array_join("versions", ","))


@query("SELECT p.repo, p.name, 'r' || p.ver AS version, x.uid FROM (SELECT repo, 'n' || (sk % 4) AS name, uid AS ver FROM fx_pkg) p LEFT JOIN fx_pkg x ON x.repo = p.repo AND 'n' || (x.pk % 4) = p.name AND x.uid = p.ver")
def packages_by_real_version(spark, sf_dir):
    p = order_packages(spark, sf_dir).withColumn("version", F.concat(F.lit("r"), "ver"))
    wanted = p.select("repo", F.concat(F.lit("n"), F.col("sk") % 4).alias("name"), "version")
    return model.by_real_version(p, wanted).select("repo", "name", "version", "uid")


@query("SELECT repo, 'n1 (>= 3)' AS selector, uid FROM fx_pkg WHERE pk % 4 = 1 AND uid >= 3 UNION ALL SELECT repo, 'n2', uid FROM fx_pkg WHERE pk % 4 = 2 UNION ALL SELECT repo, 'n3 (<< 5)', uid FROM fx_pkg WHERE pk % 4 = 3 AND uid < 5")
def selected_packages(spark, sf_dir):
    from solvarium.functions.names import parse_formula

    texts = spark.createDataFrame([("n1 (>= 3)",), ("n2",), ("n3 (<< 5)",)], "selector string")
    a = texts.withColumn("a", parse_formula(F.col("selector"))[0][0])
    return model.select(order_packages(spark, sf_dir), a.select("selector", "a.name", "a.op", F.col("a.version").cast("int").alias("ver")))


@query("SELECT repo, uid, 'n' || (pk % 4) AS name FROM fx_pkg WHERE regexp_matches('n' || (pk % 4), '^n[13]$')")
def packages_matching(spark, sf_dir):
    return model.matching(order_packages(spark, sf_dir), "^n[13]$").select("repo", "uid", "name")


@query("SELECT DISTINCT c.repo, c.uid, c.name FROM fx_conf c JOIN fx_prov p ON p.repo = c.repo AND p.name = c.name AND p.uid = c.uid AND (p.ver IS NULL OR p.ver < c.ver)")
def self_conflicts(spark, sf_dir):
    return model.self_conflicts(order_universe(spark, sf_dir))


@query("SELECT DISTINCT d.repo, d.uid, d.clause, d.alt FROM fx_dep d JOIN fx_clause c USING (repo, uid, clause) ANTI JOIN fx_alt a USING (repo, uid, clause, alt) WHERE c.mask <> 0")
def missing_alternatives(spark, sf_dir):
    return model.missing_alternatives(order_universe(spark, sf_dir))


@query("SELECT repo, name, op, ver FROM fx_dep WHERE op <> 'any' UNION SELECT repo, name, op, ver FROM fx_conf UNION SELECT repo, name, '=', ver FROM fx_prov WHERE ver IS NOT NULL")
def mentioned_constraints(spark, sf_dir):
    return model.mentioned(order_universe(spark, sf_dir))


def asked(packages):
    """Install some n1, and no n2."""
    one = packages.where("name = 'n1'").select("repo", F.lit("install").alias("action"), F.lit(1).alias("item"), "uid")
    return one.unionByName(packages.where("name = 'n2'").select("repo", F.lit("remove").alias("action"), F.lit(2).alias("item"), "uid"))


_MASKS = ", m AS (SELECT repo, coalesce(bit_or(bit) FILTER (WHERE pk % 4 = 1), 0) AS one, coalesce(bit_or(bit) FILTER (WHERE pk % 4 = 2), 0) AS two FROM fx_pkg GROUP BY repo HAVING one <> 0)"


@query(_MASKS + " SELECT repo, EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = m.repo AND (v.s & one) <> 0 AND (v.s & two) = 0) AS ok FROM m")
def request_as_package(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    has = packages.where("name = 'n1'").select("repo").distinct()
    dummy, deps, confs = model.with_request(deps, confs, asked(packages).join(has, "repo", "left_semi"))
    return sat.check(dummy, cut(deps), cut(confs)).select("repo", known("ok").alias("ok"))


@query(
    _MASKS + ", h AS (SELECT repo, coalesce(bit_or(bit) FILTER (WHERE installed), 0) AS have FROM fx_pkg GROUP BY repo),"
    " a AS (SELECT v.repo, bit_count(h.have & ~v.s) + bit_count(v.s & ~h.have) AS changed, bit_count(v.s) AS installed FROM fx_valid v JOIN m USING (repo) JOIN h USING (repo) WHERE (v.s & one) <> 0 AND (v.s & two) = 0),"
    " b AS (SELECT repo, min((changed, installed)) AS x FROM a GROUP BY repo)"
    " SELECT m.repo, CASE WHEN b.repo IS NULL THEN 'none' ELSE 'ok' END AS status, CAST(x[1] AS BIGINT) AS changed, CAST(x[2] AS BIGINT) AS installed FROM m LEFT JOIN b USING (repo)"
)
def request_fewest_changes(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    has = packages.where("name = 'n1'").select("repo").distinct()
    return requests.optimise(packages, deps, confs, asked(packages).join(has, "repo", "left_semi"), ("changed", "installed"))


@query(
    "SELECT a.repo, a.uid || ',' || b.uid AS uids, EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = a.repo AND (v.s & (a.bit | b.bit)) = (a.bit | b.bit)) AS together"
    " FROM fx_pkg a JOIN fx_pkg b ON a.repo = b.repo AND a.pk % 4 = 1 AND b.pk % 4 = 3"
)
def coinstall_products(spark, sf_dir):
    """Every n1 with every n3."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    choices = packages.where("name IN ('n1', 'n3')").select("repo", F.when(F.col("name") == "n1", 1).otherwise(2).alias("item"), "uid")
    return sat.coinstall_products(cut(choices), 2, deps, confs).select("repo", F.array_join("uids", ",").alias("uids"), known("ok").alias("together"))


@query("SELECT p.repo, p.uid, s.uid IS NOT NULL AS ok FROM fx_pkg p LEFT JOIN fx_strong s USING (repo, uid) WHERE p.installed AND p.pk % 4 = 2")
def checked_list(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.check(packages.where("installed AND name = 'n2'"), deps, confs).select("repo", "uid", known("ok").alias("ok"))


@query("SELECT 'package' AS kind, count(*) AS n FROM fx_strong UNION ALL SELECT 'dependency', count(*) FROM (SELECT DISTINCT repo, uid, clause, target FROM fx_alt a SEMI JOIN fx_strong USING (repo, uid) WHERE EXISTS (SELECT 1 FROM fx_strong t WHERE t.repo = a.repo AND t.uid = a.target))"
       " UNION ALL SELECT 'conflict', count(*) FROM (SELECT DISTINCT repo, least(uid, other), greatest(uid, other) FROM fx_conflict c SEMI JOIN fx_strong USING (repo, uid) WHERE EXISTS (SELECT 1 FROM fx_strong t WHERE t.repo = c.repo AND t.uid = c.other))")  # fmt: skip
def trimmed_universe(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    p, d, c = sat.trim(packages, deps, confs)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(p, "package").unionByName(count(d.where("target IS NOT NULL"), "dependency")).unionByName(count(c, "conflict"))


@query(
    ", t AS (SELECT DISTINCT a.repo, a.uid, a.clause, a.target FROM fx_alt a JOIN fx_strong x ON x.repo = a.repo AND x.uid = a.uid JOIN fx_strong y ON y.repo = a.repo AND y.uid = a.target)"
    " SELECT DISTINCT repo, uid AS src, target AS dst FROM (SELECT repo, uid, clause, max(target) AS target FROM t GROUP BY ALL HAVING count(*) = 1) WHERE uid <> target"
)
def conjunctive_edges_trimmed(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return graphs.conjunctive_edges(sat.trim(packages, deps, confs)[1])


@query("SELECT p.repo, 'dependency' AS kind, p.uid, c.clause AS other FROM fx_pkg p JOIN fx_clause c USING (repo, uid) JOIN (SELECT repo, coalesce(bit_or(bit) FILTER (WHERE installed), 0) AS s FROM fx_pkg GROUP BY repo) m USING (repo) WHERE p.installed AND (c.mask & m.s) = 0"
       " UNION ALL SELECT DISTINCT x.repo, 'conflict', least(x.uid, x.other), greatest(x.uid, x.other) FROM fx_conflict x JOIN fx_pkg a ON a.repo = x.repo AND a.uid = x.uid AND a.installed JOIN fx_pkg b ON b.repo = x.repo AND b.uid = x.other AND b.installed")  # fmt: skip
def installed_violations(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.violations(packages, deps, confs)


@query("SELECT DISTINCT repo, uid, name, op, ver FROM fx_conf c WHERE NOT EXISTS (SELECT 1 FROM fx_prov p WHERE p.repo = c.repo AND p.name = c.name AND p.uid <> c.uid AND (p.ver IS NULL OR p.ver < c.ver))")
def useless_conflicts(spark, sf_dir):
    u = order_universe(spark, sf_dir)
    return sat.useless_conflicts(u.confs, u.provs)


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT name, op, ver FROM fx_dep d JOIN fx_clause c USING (repo, uid, clause) WHERE c.mask = 0)) AS missing,"
       " (SELECT count(*) FROM (SELECT DISTINCT name, op, ver FROM fx_conf SEMI JOIN fx_conflict USING (repo, uid))) AS conflict,"
       " (SELECT count(*) FROM (SELECT DISTINCT c.repo, c.uid, c.name FROM fx_conf c JOIN fx_prov p ON p.repo = c.repo AND p.name = c.name AND p.uid = c.uid AND (p.ver IS NULL OR p.ver < c.ver))) AS self_conflict")  # fmt: skip
def unique_reasons(spark, sf_dir):
    """How many distinct constraints are missing or in conflict, and how many packages are so with themselves."""
    u, _, deps, confs = resolved(spark, sf_dir)
    missing = u.deps.join(model.missing_clauses(deps), ["repo", "uid", "clause"], "left_semi").select("name", "op", "ver").distinct().agg(F.count("*").alias("missing"))
    real = model.resolve_atoms(u.confs, u.provs).where("target <> uid").select("name", "op", "ver").distinct().agg(F.count("*").alias("conflict"))
    own = model.self_conflicts(u).agg(F.count("*").alias("self_conflict"))
    return missing.join(real).join(own)  # three single rows


@query("SELECT q % 2 = 0 AS foreground, count(*) AS packages, count(*) FILTER (WHERE s.uid IS NULL) AS broken FROM fx_pkg p LEFT JOIN fx_strong s USING (repo, uid) GROUP BY ALL")
def foreground_counts(spark, sf_dir):
    """Packages of even q are in front: each part's size and its broken packages, checked over the whole."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    said = sat.check(packages, deps, confs).join(packages.select("repo", "uid", (F.col("q") % 2 == 0).alias("foreground")), ["repo", "uid"])
    return said.groupBy("foreground").agg(F.count("*").alias("packages"), F.count_if(F.col("status") == "broken").alias("broken"))


@query(", w(repo, root, uid) AS (SELECT repo, uid, uid FROM fx_pkg WHERE installed UNION SELECT w.repo, w.root, a.target FROM w JOIN fx_alt a ON a.repo = w.repo AND a.uid = w.uid JOIN fx_pkg p ON p.repo = a.repo AND p.uid = a.target AND p.installed) SELECT * FROM w", True)
def minimal_installations(spark, sf_dir):
    """What each installed package reaches within the installed ones."""
    _, packages, deps, _ = resolved(spark, sf_dir)
    have = packages.where("installed").select("repo", "uid")
    edges = cut(graphs.induced(graphs.dependency_edges(deps), have))
    return graphs.cone(have.select("repo", F.col("uid").alias("root"), "uid"), edges).select("repo", "root", "uid")


@query(
    ", d AS (SELECT s.repo, s.uid, p.uid AS dep FROM fx_strong s JOIN fx_pkg p ON p.repo = s.repo AND (s.strong & p.bit) <> 0 AND p.uid <> s.uid), e AS (SELECT DISTINCT repo, uid, target FROM fx_alt WHERE uid <> target)"
    " SELECT repo, uid, (SELECT count(*) FROM d WHERE d.repo = p.repo AND d.uid = p.uid) AS strong_out, (SELECT count(*) FROM d WHERE d.repo = p.repo AND d.dep = p.uid) AS strong_in,"
    " (SELECT count(*) FROM e WHERE e.repo = p.repo AND e.uid = p.uid) AS direct_out, (SELECT count(*) FROM e WHERE e.repo = p.repo AND e.target = p.uid) AS direct_in FROM fx_pkg p"
)
def impact_table(spark, sf_dir):
    return sat.impact_of(order_universe(spark, sf_dir))


_DOMINATED = (
    ", d AS (SELECT repo, p.uid AS dominator, q.uid AS dominated FROM fx_strong s JOIN fx_pkg p USING (repo, uid) JOIN fx_pkg q USING (repo) WHERE (s.strong & q.bit) <> 0 AND q.uid <> p.uid)"
    " SELECT x.repo, x.dominator, x.dominated FROM d x WHERE 100 * (SELECT count(*) FROM d r WHERE r.repo = x.repo AND r.dominated = x.dominated AND r.dominator <> x.dominator"
    " AND NOT EXISTS (SELECT 1 FROM d y WHERE y.repo = r.repo AND y.dominator = r.dominator AND y.dominated = x.dominator)"
    " AND NOT EXISTS (SELECT 1 FROM d z WHERE z.repo = r.repo AND z.dominator = x.dominator AND z.dominated = r.dominator)) <= 40 * (SELECT count(*) FROM d u WHERE u.repo = x.repo AND u.dominated = x.dominated)"
)


@query(_DOMINATED)
def dominators_within_forty_percent(spark, sf_dir):
    return sat.strong_dominators(order_universe(spark, sf_dir), 40)


@query(", c AS (SELECT repo, uid, max(target) AS target FROM (SELECT DISTINCT repo, uid, clause, target FROM fx_alt) GROUP BY repo, uid, clause HAVING count(*) = 1),"
       " w(repo, root, uid) AS (SELECT repo, uid, uid FROM fx_pkg UNION SELECT w.repo, w.root, c.target FROM w JOIN c ON c.repo = w.repo AND c.uid = w.uid) SELECT * FROM w", True)  # fmt: skip
def conjunctive_closure(spark, sf_dir):
    _, packages, deps, _ = resolved(spark, sf_dir)
    return graphs.dependency_closure(packages.select("repo", F.col("uid").alias("root"), "uid"), deps, conjunctive=True).select("repo", "root", "uid")


@query("SELECT repo, uid AS root, uid FROM fx_pkg UNION SELECT repo, target, uid FROM fx_alt")
def users_at_depth_two(spark, sf_dir):
    _, packages, deps, _ = resolved(spark, sf_dir)
    edges = cut(graphs.reverse(graphs.dependency_edges(deps)))
    return graphs.cone(packages.select("repo", F.col("uid").alias("root"), "uid"), edges, depth=2).select("repo", "root", "uid")


@query("SELECT DISTINCT repo, uid AS src, target AS dst FROM fx_alt UNION SELECT p.repo, p.uid, e.uid FROM fx_pkg p JOIN fx_pkg e ON e.repo = p.repo AND e.q % 10 = 0 WHERE e.uid <> p.uid")
def edges_with_essentials(spark, sf_dir):
    _, packages, deps, _ = resolved(spark, sf_dir)
    return graphs.with_essentials(graphs.dependency_edges(deps), packages, packages.where("q % 10 = 0"))


@query(
    ", c AS (SELECT DISTINCT repo, uid, clause, target FROM fx_alt), n AS (SELECT repo, uid, clause, count(*) AS n FROM c GROUP BY ALL)"
    " SELECT DISTINCT repo, 'p' || uid AS src, 'p' || target AS dst, 'direct' AS kind FROM c JOIN n USING (repo, uid, clause) WHERE n = 1"
    " UNION ALL SELECT repo, 'p' || uid, 'o' || uid || '.' || clause, 'or' FROM n WHERE n > 1 UNION ALL SELECT repo, 'o' || uid || '.' || clause, 'p' || target, 'or' FROM c JOIN n USING (repo, uid, clause) WHERE n > 1"
    " UNION ALL SELECT repo, 'p' || uid, 'm' || uid || '.' || clause, 'missing' FROM fx_clause WHERE mask = 0 UNION ALL SELECT DISTINCT repo, 'p' || least(uid, other), 'p' || greatest(uid, other), 'conflict' FROM fx_conflict"
)
def syntactic_graph_edges(spark, sf_dir):
    _, _, deps, confs = resolved(spark, sf_dir)
    return graphs.syntactic_edges(deps, confs)


_PLAN = (
    ", after AS (SELECT *, row_number() OVER (PARTITION BY repo, pk % 4 ORDER BY uid DESC) = 1 AS after FROM fx_pkg), a AS (SELECT repo, uid, pk % 4 AS name, CASE WHEN after THEN 'install' ELSE 'remove' END AS action FROM after WHERE after <> installed),"
    " e AS (SELECT DISTINCT repo, uid, target FROM fx_alt), c AS (SELECT repo, uid, other FROM fx_conflict UNION SELECT repo, other, uid FROM fx_conflict)"
    " SELECT x.repo, x.action || ':' || x.uid AS src, y.action || ':' || y.uid AS dst FROM a x JOIN a y USING (repo) WHERE x.uid <> y.uid AND ("
    " (x.action = 'install' AND y.action = 'install' AND EXISTS (SELECT 1 FROM e WHERE e.repo = x.repo AND e.uid = x.uid AND e.target = y.uid))"
    " OR (x.action = 'remove' AND y.action = 'remove' AND EXISTS (SELECT 1 FROM e WHERE e.repo = x.repo AND e.uid = y.uid AND e.target = x.uid))"
    " OR (x.action = 'install' AND y.action = 'remove' AND (x.name = y.name OR EXISTS (SELECT 1 FROM c WHERE c.repo = x.repo AND c.uid = x.uid AND c.other = y.uid))))"
)


@query(_PLAN)
def action_order(spark, sf_dir):
    """Of the move from what is installed to each name's newest version: which action waits for which."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    actions = cut(diffs.changes(packages.where("installed"), model.latest(packages)))
    return diffs.plan_edges(actions, graphs.dependency_edges(deps), confs)


@query("SELECT repo, 'n' || (pk % 4) AS name, count(*) FILTER (WHERE q % 2 = 0) AS one, count(*) FILTER (WHERE q % 3 = 0) AS two, count(*) FILTER (WHERE q % 5 = 0) AS three FROM fx_pkg GROUP BY ALL HAVING one + two + three > 0")
def solutions_side_by_side(spark, sf_dir):
    packages = cut(order_packages(spark, sf_dir))
    return diffs.compare({name: packages.where(f"q % {k} = 0") for name, k in (("one", 2), ("two", 3), ("three", 5))})


@query(_MASKS + ", s AS (SELECT p.repo, bit_or(bit) AS s FROM fx_pkg p WHERE q % 2 = 0 GROUP BY p.repo) SELECT m.repo, v.s IS NOT NULL AND (coalesce(s.s, 0) & one) <> 0 AND (coalesce(s.s, 0) & two) = 0 AS valid"
       " FROM m LEFT JOIN s USING (repo) LEFT JOIN fx_valid v ON v.repo = m.repo AND v.s = coalesce(s.s, 0)")  # fmt: skip
def solution_validity(spark, sf_dir):
    """Whether the packages of even q are an answer to a request for some n1 and no n2."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    has = packages.where("name = 'n1'").select("repo").distinct()
    return diffs.validity(packages.where("q % 2 = 0"), asked(packages).join(has, "repo", "left_semi"), deps, confs)


@query("SELECT p.repo, 'n' || (pk % 4) AS name, count(*) AS held FROM fx_pkg p WHERE installed AND pk % 4 = 1 GROUP BY ALL")
def requested_and_there(spark, sf_dir):
    """Requested packages that are installed already."""
    packages = order_packages(spark, sf_dir)
    return packages.where("installed").join(asked(packages).where("action = 'install'").select("repo", "uid").distinct(), ["repo", "uid"], "left_semi").groupBy("repo", "name").agg(F.count("*").alias("held"))


@query(
    ", n AS (SELECT p.repo, p.uid, p.pk, p.installed, p.q, (SELECT string_agg(t, ', ' ORDER BY clause) FROM (SELECT clause, string_agg(name || CASE op WHEN 'any' THEN '' ELSE ' ' || op || ' ' || ver END, ' | ' ORDER BY alt) AS t FROM fx_dep d WHERE d.repo = p.repo AND d.uid = p.uid GROUP BY clause)) AS deps,"
    " (SELECT string_agg(name || ' ' || op || ' ' || ver, ', ' ORDER BY name, op, ver) FROM fx_conf c WHERE c.repo = p.repo AND c.uid = p.uid) AS confs, (SELECT string_agg(name, ', ' ORDER BY name) FROM fx_prov v WHERE v.repo = p.repo AND v.uid = p.uid AND v.ver IS NULL) AS provs FROM fx_pkg p)"
    " SELECT repo, uid, 'package: n' || (pk % 4) || chr(10) || 'version: ' || uid || coalesce(chr(10) || 'depends: ' || deps, '') || coalesce(chr(10) || 'conflicts: ' || confs, '') || coalesce(chr(10) || 'provides: ' || provs, '') || CASE WHEN installed THEN chr(10) || 'installed: true' ELSE '' END || chr(10) AS stanza FROM n"
)
def universe_document(spark, sf_dir):
    return sinks.document_stanzas(order_universe(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM fx_pkg) || chr(9) || (SELECT count(*) FROM (SELECT DISTINCT repo, uid, target FROM fx_alt)) || chr(9) || (SELECT count(*) FROM (SELECT DISTINCT repo, least(uid, other), greatest(uid, other) FROM fx_conflict)) AS line")
def size_line(spark, sf_dir):
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sinks.size_line(packages, graphs.dependency_edges(deps), confs)


@query(
    ", best AS (SELECT repo, pk % 4 AS n, max(uid) AS new, max(uid) FILTER (WHERE installed) AS old FROM fx_pkg GROUP BY ALL)"
    " SELECT repo, 'Install: n' || n || chr(10) || 'Version: ' || new AS stanza FROM best WHERE old IS NULL OR old <> new"
    " UNION ALL SELECT p.repo, 'Remove: n' || (pk % 4) || chr(10) || 'Version: ' || p.uid FROM fx_pkg p JOIN best b ON b.repo = p.repo AND b.n = p.pk % 4 WHERE p.installed AND p.uid <> b.new AND NOT (b.old IS NULL OR b.old <> b.new)"
)
def answer_stanzas(spark, sf_dir):
    """Install and Remove stanzas of the move to newest versions; a name that is installed anew needs no Remove."""
    packages = cut(order_packages(spark, sf_dir))
    return sinks.answer_stanzas(cut(diffs.changes(packages.where("installed"), model.latest(packages))))


@query("SELECT p.repo, 'n' || (pk % 4) || '=' || uid || '=r' || uid AS line FROM fx_pkg p")
def version_table(spark, sf_dir):
    return sinks.version_lines(order_packages(spark, sf_dir).withColumn("real", F.concat(F.lit("r"), "ver")))


@query(
    ", b AS (SELECT p.repo, p.uid FROM fx_pkg p WHERE NOT EXISTS (SELECT 1 FROM fx_closed v WHERE v.repo = p.repo AND (v.s & p.bit) <> 0)),"
    " e AS (SELECT DISTINCT c.repo, c.uid AS src, a.target AS dst FROM fx_clause c JOIN b ON b.repo = c.repo AND b.uid = c.uid LEFT JOIN (SELECT DISTINCT repo, uid, clause, target FROM fx_alt) a ON a.repo = c.repo AND a.uid = c.uid AND a.clause = c.clause"
    "  WHERE NOT EXISTS (SELECT 1 FROM fx_alt x WHERE x.repo = c.repo AND x.uid = c.uid AND x.clause = c.clause AND NOT EXISTS (SELECT 1 FROM b t WHERE t.repo = x.repo AND t.uid = x.target))),"
    " w(repo, root, uid) AS (SELECT repo, uid, uid FROM b UNION SELECT w.repo, w.root, e.dst FROM w JOIN e ON e.repo = w.repo AND e.src = w.uid WHERE e.dst IS NOT NULL)"
    " SELECT w.repo, w.root, e.src, e.dst, CASE WHEN e.dst IS NULL THEN 'missing' ELSE 'dependency' END AS kind FROM w JOIN e ON e.repo = w.repo AND e.src = w.uid", True
)
def explanation_edges(spark, sf_dir):
    _, _, deps, _ = resolved(spark, sf_dir)
    return sat.explanation(deps, cut(sat.horn_broken(deps)))


@query("SELECT repo, CASE WHEN s.uid IS NULL THEN 'broken' ELSE 'ok' END AS status, count(*) AS n FROM fx_pkg p LEFT JOIN fx_strong s USING (repo, uid) GROUP BY ALL")
def check_history(spark, sf_dir):
    """Every repository as a snapshot: how many of its packages are installable."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.check(packages, deps, confs).groupBy("repo", "status").agg(F.count("*").alias("n"))


@query("SELECT repo, 'q' || (pk % 4) AS k, uid AS target FROM fx_pkg WHERE pk % 4 IN (SELECT y.pk % 4 FROM fx_pkg y WHERE y.repo = fx_pkg.repo AND y.q % 10 = 0)")
def essential_clauses(spark, sf_dir):
    packages = cut(order_packages(spark, sf_dir).withColumn("essential", F.col("q") % 10 == 0))
    said = translate.essential_clauses(packages).join(packages.select("repo", F.col("uid").alias("target"), "name"), ["repo", "target"])
    return said.select("repo", F.concat(F.lit("q"), F.substring("name", 2, 9)).alias("k"), "target")


@query(
    ", ce AS (SELECT DISTINCT repo, uid AS src, target AS dst FROM (SELECT repo, uid, clause, max(target) AS target FROM (SELECT DISTINCT repo, uid, clause, target FROM fx_alt) GROUP BY ALL HAVING count(*) = 1) WHERE uid <> target),"
    " w(repo, root, uid) AS (SELECT repo, uid, uid FROM fx_pkg UNION SELECT w.repo, w.root, e.dst FROM w JOIN ce e ON e.repo = w.repo AND e.src = w.uid),"
    " sc AS (SELECT a.repo, a.uid AS lo, b.uid AS hi FROM (SELECT * FROM fx_strong JOIN fx_pkg USING (repo, uid)) a JOIN (SELECT * FROM fx_strong JOIN fx_pkg USING (repo, uid)) b ON a.repo = b.repo AND a.uid < b.uid"
    "   WHERE NOT EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = a.repo AND (v.s & (a.bit | b.bit)) = (a.bit | b.bit))),"
    " cf AS (SELECT repo, uid, other FROM fx_conflict UNION SELECT repo, other, uid FROM fx_conflict),"
    " r AS (SELECT sc.repo, lo, hi, x.uid AS root_lo, y.uid AS root_hi FROM sc JOIN w x ON x.repo = sc.repo AND x.root = lo JOIN w y ON y.repo = sc.repo AND y.root = hi JOIN cf ON cf.repo = sc.repo AND cf.uid = x.uid AND cf.other = y.uid),"
    " t AS (SELECT *, CASE WHEN lo = root_lo AND hi = root_hi THEN 'explicit' ELSE 'conjunctive' END AS kind FROM r UNION ALL SELECT repo, lo, hi, NULL, NULL, 'other' FROM sc ANTI JOIN r USING (repo, lo, hi))"
    " SELECT repo, root_lo, root_hi, kind, string_agg(lo || '~' || hi, ',' ORDER BY lo, hi) AS pairs FROM t GROUP BY ALL",
    True,
)
def strong_conflict_groups(spark, sf_dir):
    """Strong conflicts by the plain conflict behind them."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    found = sat.strong_conflicts(packages, deps, confs).where("status = 'broken'")
    rows = sat.strong_conflict_roots(found, deps, confs)
    pairs = F.array_join(F.array_sort(F.collect_list(F.concat_ws("~", "lo", "hi"))), ",").alias("pairs")
    return rows.groupBy("repo", "root_lo", "root_hi", "kind").agg(pairs)


@query(
    ", fp AS (SELECT DISTINCT x.repo, least(x.uid, x.other) AS lo, greatest(x.uid, x.other) AS hi FROM fx_conflict x),"
    " fb AS (SELECT fp.*, a.bit | b.bit AS bits FROM fp JOIN fx_pkg a ON a.repo = fp.repo AND a.uid = lo JOIN fx_pkg b ON b.repo = fp.repo AND b.uid = hi),"
    " one AS (SELECT c.repo, c.s, max(lo) AS lo, max(hi) AS hi FROM fx_closed c JOIN fb ON fb.repo = c.repo AND (c.s & bits) = bits GROUP BY ALL HAVING count(*) = 1)"
    " SELECT DISTINCT p.repo, p.uid, one.lo, one.hi FROM fx_pkg p ANTI JOIN fx_strong USING (repo, uid) JOIN one ON one.repo = p.repo AND (one.s & p.bit) <> 0"
)
def decisive_conflicts(spark, sf_dir):
    """Conflicts that alone keep a package out."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    return sat.conflict_reasons(packages, deps, confs).where("alone").select("repo", "uid", "lo", "hi")


_FUTURES = """
, ask AS (SELECT repo, name, op, ver FROM fx_dep WHERE op <> 'any' UNION SELECT repo, name, op, ver FROM fx_conf),
mem AS (SELECT repo, concat('n', pk % 4) AS cluster, uid FROM fx_pkg),
pts AS (SELECT DISTINCT repo, cluster, unnest([2 * v, 2 * v + 1]) AS point FROM (SELECT repo, name AS cluster, ver AS v FROM ask SEMI JOIN (SELECT repo, cluster AS name FROM mem) USING (repo, name) UNION SELECT repo, cluster, uid FROM mem)),
vec AS (SELECT p.repo, p.cluster, p.point, coalesce(string_agg(CASE WHEN a.op IS NULL THEN '' WHEN a.op = '>=' THEN (p.point >= 2 * a.ver)::INT::VARCHAR WHEN a.op = '<=' THEN (p.point <= 2 * a.ver)::INT::VARCHAR ELSE (p.point < 2 * a.ver)::INT::VARCHAR END, '' ORDER BY a.op, a.ver), '') AS x
  FROM pts p LEFT JOIN ask a ON a.repo = p.repo AND a.name = p.cluster GROUP BY ALL),
now AS (SELECT repo, cluster, max(uid) * 2 AS now FROM mem GROUP BY ALL),
goal AS (SELECT v.repo, v.cluster, max(v.point) AS target, string_agg(v.point::VARCHAR, ',' ORDER BY v.point) AS equivalents, any_value(n.now) AS now, bool_or(v.point = n.now) AS same
  FROM vec v JOIN now n USING (repo, cluster) GROUP BY v.repo, v.cluster, v.x),
goals AS (SELECT repo, cluster, target, equivalents FROM goal WHERE target > now AND NOT same),
prov2 AS (SELECT g.repo, g.cluster, g.target, p.uid, p.bit, p.name, CASE WHEN p.name = g.cluster THEN g.target ELSE 2 * p.ver END AS ver FROM goals g JOIN fx_prov p USING (repo)),
mask2 AS (SELECT g.repo, g.cluster, g.target, d.uid, d.clause, coalesce(bit_or(p.bit), 0) AS mask FROM goals g JOIN fx_dep d USING (repo) LEFT JOIN prov2 p ON p.repo = g.repo AND p.cluster = g.cluster AND p.target = g.target AND p.name = d.name
   AND (d.op = 'any' OR p.ver IS NULL OR (d.op = '>=' AND p.ver >= 2 * d.ver) OR (d.op = '<=' AND p.ver <= 2 * d.ver)) GROUP BY ALL),
fight2 AS (SELECT DISTINCT p.repo, p.cluster, p.target, a.bit AS one, p.bit AS two FROM fx_conf c JOIN fx_pkg a USING (repo, uid) JOIN prov2 p ON p.repo = c.repo AND p.name = c.name AND p.uid <> c.uid AND (p.ver IS NULL OR p.ver < 2 * c.ver)),
cand2 AS (SELECT g.repo, g.cluster, g.target, c.s FROM goals g JOIN fx_cand c USING (repo)),
bad2 AS (SELECT c.repo, c.cluster, c.target, c.s FROM cand2 c JOIN mask2 m USING (repo, cluster, target) JOIN fx_pkg p ON p.repo = m.repo AND p.uid = m.uid WHERE (c.s & p.bit) <> 0 AND (c.s & m.mask) = 0
   UNION SELECT c.repo, c.cluster, c.target, c.s FROM cand2 c JOIN fight2 f USING (repo, cluster, target) WHERE (c.s & f.one) <> 0 AND (c.s & f.two) <> 0),
all2 AS (SELECT c.repo, c.cluster, c.target, bit_or(c.s) AS s FROM cand2 c ANTI JOIN bad2 USING (repo, cluster, target, s) GROUP BY ALL)
SELECT g.repo, g.cluster, g.target, g.equivalents, count(x.uid) AS broken
FROM goals g LEFT JOIN all2 a USING (repo, cluster, target) LEFT JOIN (SELECT s.repo, s.uid, p.bit FROM fx_strong s JOIN fx_pkg p USING (repo, uid)) x ON x.repo = g.repo AND (x.bit & coalesce(a.s, 0)) = 0 GROUP BY ALL
"""


@query(_FUTURES)
def challenged_clusters(spark, sf_dir):
    """Packages of one name move together: what each move would break."""
    u = order_universe(spark, sf_dir)
    said = evolution.challenged(u, u.packages.select("repo", F.col("name").alias("cluster"), "uid"))
    return said.select("repo", "cluster", "target", F.array_join("equivalents", ",").alias("equivalents"), F.when(F.col("unknown") == 0, F.col("broken")).alias("broken"))


def outdated_packages(spark, sf_dir):
    """No SQL: the states of all names together are too many to enumerate; tests compare small repositories."""
    u = order_universe(spark, sf_dir)
    clusters = u.packages.select("repo", F.concat(F.lit("s"), F.col("sk") % 2).alias("cluster"), "uid")
    return evolution.outdated(u, clusters).where("status <> 'ok'")


QUERIES["outdated_packages"] = outdated_packages
