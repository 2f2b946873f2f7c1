"""Answers one can act on, and what a repository's conflicts come down to, over one small repository an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.operators import explain, flatten, requests, sat, solutions
from solvarium.plans.answers import asked
from solvarium.plans.fixtures import ORDERS_SQL, order_universe
from solvarium.plans.lineage import cut
from solvarium.plans.orders import known, resolved

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = ORDERS_SQL + sql
        return f

    return add


_HAVE = ", h AS (SELECT repo, coalesce(bit_or(bit) FILTER (WHERE installed), 0) AS have, coalesce(bit_or(bit) FILTER (WHERE pk % 4 = 1), 0) AS one, coalesce(bit_or(bit) FILTER (WHERE pk % 4 = 2), 0) AS two FROM fx_pkg GROUP BY repo)"
_ACTIONS = (
    " SELECT p.repo, p.uid, CASE WHEN NOT installed THEN 'install' WHEN (x.s & bit) <> 0 THEN 'keep' ELSE 'remove' END AS action"
    " FROM fx_pkg p JOIN x USING (repo) WHERE installed OR (x.s & bit) <> 0"
)
_CHANGES = "bit_count(h.have & ~v.s) AS removed, bit_count(v.s & ~h.have) AS new"


@query(
    _HAVE + f", a AS (SELECT v.repo, v.s, {_CHANGES} FROM fx_valid v JOIN h USING (repo) WHERE (v.s & one) <> 0 AND (v.s & two) = 0),"
    " x AS (SELECT repo, min((removed, removed + new, s))[3] AS s FROM a GROUP BY repo)" + _ACTIONS
)
def request_answer(spark, sf_dir):
    """What to install, remove and keep for some n1 and no n2: fewest removals, then changes, then the least total of bits,
    which only one set has."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    has = packages.where("name = 'n1'").select("repo").distinct()
    packages = packages.withColumn("bit", F.expr("shiftleft(1, uid - 1)"))
    return requests.solution(packages, deps, confs, asked(packages).join(has, "repo", "left_semi"), ("removed", "changed", "sum:bit"))


@query(
    _HAVE + ", f AS (SELECT repo, bit_or(bit) AS every, max(uid) FILTER (WHERE installed) AS least, bit_or(bit) FILTER (WHERE uid >= low) AS fit"
    "  FROM (SELECT *, coalesce(max(uid) FILTER (WHERE installed) OVER (PARTITION BY repo), 0) AS low FROM fx_pkg WHERE pk % 4 = 1) GROUP BY repo),"
    " g AS (SELECT repo, bit_or(bit) AS versions, max(bit) AS newest FROM fx_pkg GROUP BY repo, pk % 4),"
    f" a AS (SELECT v.repo, v.s, {_CHANGES}, (SELECT count(*) FROM g WHERE g.repo = v.repo AND (v.s & versions) <> 0 AND (v.s & newest) = 0) AS stale"
    "  FROM fx_valid v JOIN h USING (repo) JOIN f USING (repo) WHERE bit_count(v.s & f.fit) = 1 AND (v.s & every & ~fit) = 0),"
    " x AS (SELECT repo, min((stale, removed, new, s))[4] AS s FROM a GROUP BY repo)" + _ACTIONS
)
def upgrade_answer(spark, sf_dir):
    """Upgrade of n1: exactly one version, no lower than what is there; fewest names that stay behind their newest version,
    then removals, then new packages, then the least total of bits."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    packages = packages.withColumn("bit", F.expr("shiftleft(1, uid - 1)"))
    wanted = packages.where("name = 'n1'").select("repo", F.lit(1).alias("item"), "name").distinct()
    return requests.solution(packages, deps, confs, requests.upgrades(packages, wanted), ("notuptodate", "removed", "new", "sum:bit"))


_ENDS = ", n AS (SELECT p.repo, p.uid, p.bit, c.m FROM fx_pkg p LEFT JOIN (SELECT q.repo, bit_or(q.bit) AS m FROM fx_pkg q SEMI JOIN (SELECT repo, uid FROM fx_conflict UNION SELECT repo, other FROM fx_conflict) e ON e.repo = q.repo AND e.uid = q.uid GROUP BY q.repo) c USING (repo))"


@query(
    _ENDS + ", i AS (SELECT n.repo, n.uid, t.d FROM n JOIN range(128) AS t(d) ON (t.d & coalesce(n.m, 0)) = t.d"
    "  WHERE NOT EXISTS (SELECT 1 FROM fx_closed c WHERE c.repo = n.repo AND (c.s & n.bit) <> 0 AND (c.s & t.d) = 0))"
    " SELECT repo, uid, array_to_string(list_transform(list_filter(range(0, 7), lambda k: (d & (1 << k)) <> 0), lambda k: k + 1), '|') AS clause FROM i"
    " WHERE NOT EXISTS (SELECT 1 FROM i j WHERE j.repo = i.repo AND j.uid = i.uid AND j.d <> i.d AND (j.d & i.d) = j.d)"
)
def flat_clauses(spark, sf_dir):
    """What each package needs of those in conflict: its least clauses over them, which every closed set with it meets."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    found = flatten.clauses_of(flatten.flat_formulas(packages, deps, confs))
    return found.select("repo", "uid", F.array_join("members", "|").alias("clause"))


@query(
    "SELECT a.repo, a.uid AS lo, b.uid AS hi, EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = a.repo AND (v.s & (a.bit | b.bit)) = (a.bit | b.bit)) AS together"
    " FROM fx_pkg a JOIN fx_pkg b ON a.repo = b.repo AND a.uid <= b.uid"
)
def flattened_pairs(spark, sf_dir):
    """Which packages go in, and which two go together, by the flattened repository alone."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    flat, left = flatten.flattened(packages, deps, confs)
    flat, left = cut(flat), cut(left)
    both = packages.select("repo", F.col("uid").alias("lo")).join(packages.select("repo", F.col("uid").alias("hi")), "repo").where("lo <= hi")
    said = sat.solve(sat.pair_requests(both), flat, left)
    return said.select("repo", "req.*", known("ok").alias("together"))


@query(
    _ENDS + " SELECT n.repo, n.uid FROM n WHERE (n.bit & coalesce(n.m, 0)) = 0 AND NOT EXISTS (SELECT 1 FROM fx_valid v WHERE v.repo = n.repo AND NOT EXISTS ("
    "  SELECT 1 FROM fx_valid w WHERE w.repo = n.repo AND (w.s & n.bit) <> 0 AND (v.s & coalesce(n.m, 0) & ~w.s) = 0))"
)
def always_together(spark, sf_dir):
    """Packages that can be added to whatever packages in conflict are in."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    return flatten.buddies(packages, deps, confs)


@query(
    ", u AS (SELECT DISTINCT repo, target AS used, uid AS user FROM fx_alt WHERE uid <> target), x AS (SELECT DISTINCT repo, least(uid, other) AS lo, greatest(uid, other) AS hi FROM fx_conflict),"
    " b AS (SELECT x.repo, lo, hi, a.user AS z FROM x JOIN u a ON a.repo = x.repo AND a.used = lo JOIN u c ON c.repo = x.repo AND c.used = hi AND c.user = a.user),"
    " n AS (SELECT repo, used, count(*) AS n FROM u GROUP BY ALL)"
    " SELECT DISTINCT b.repo, b.lo, b.hi, CASE WHEN l.n = 1 AND h.n = 1 THEN 'simple' ELSE 'shared' END AS kind FROM b JOIN n l ON l.repo = b.repo AND l.used = b.lo JOIN n h ON h.repo = b.repo AND h.used = b.hi"
    " WHERE NOT EXISTS (SELECT 1 FROM u p WHERE p.repo = b.repo AND p.used IN (b.lo, b.hi) AND NOT EXISTS (SELECT 1 FROM b c WHERE c.repo = b.repo AND c.lo = b.lo AND c.hi = b.hi AND c.z = p.user)"
    " AND NOT EXISTS (SELECT 1 FROM u q JOIN b c ON c.repo = q.repo AND c.z = q.used WHERE c.repo = b.repo AND c.lo = b.lo AND c.hi = b.hi AND q.user = p.user))"
)
def conflict_triangles(spark, sf_dir):
    """Conflicts between packages that the same packages use."""
    _, _, deps, confs = resolved(spark, sf_dir)
    return sat.triangles(deps, confs)


_WHY = (
    ORDERS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", b AS (SELECT p.repo, p.uid FROM fx_pkg p WHERE NOT EXISTS (SELECT 1 FROM fx_closed v WHERE v.repo = p.repo AND (v.s & p.bit) <> 0)),"
    " alt AS (SELECT DISTINCT a.repo, a.uid, a.clause, a.target, b.uid IS NULL AS works FROM fx_alt a LEFT JOIN b ON b.repo = a.repo AND b.uid = a.target),"
    " fp AS (SELECT DISTINCT x.repo, least(x.uid, x.other) AS lo, greatest(x.uid, x.other) AS hi FROM fx_conflict x),"
    " fb AS (SELECT fp.*, a.bit | c.bit AS bits FROM fp JOIN fx_pkg a ON a.repo = fp.repo AND a.uid = lo JOIN fx_pkg c ON c.repo = fp.repo AND c.uid = hi),"
    " one AS (SELECT c.repo, c.s, max(lo) AS lo, max(hi) AS hi FROM fx_closed c JOIN fb ON fb.repo = c.repo AND (c.s & bits) = bits GROUP BY ALL HAVING count(*) = 1),"
    " why AS (SELECT DISTINCT p.repo, p.uid AS root, one.lo, one.hi FROM fx_pkg p ANTI JOIN fx_strong USING (repo, uid) JOIN one ON one.repo = p.repo AND (one.s & p.bit) <> 0),"
    " e AS (SELECT 'h' AS g, repo, uid AS src, target AS dst, min(clause) AS clause FROM alt x WHERE NOT EXISTS (SELECT 1 FROM alt y WHERE y.repo = x.repo AND y.uid = x.uid AND y.clause = x.clause AND y.works) GROUP BY ALL"
    "  UNION ALL SELECT 'c', x.repo, x.uid, target, min(clause) FROM alt x ANTI JOIN b ON b.repo = x.repo AND b.uid = x.uid WHERE works GROUP BY ALL),"
    " hole AS (SELECT repo, uid, clause FROM fx_clause WHERE mask = 0),"
    " root AS (SELECT 'h' AS g, repo, uid AS root FROM b UNION SELECT 'c', repo, root FROM why),"
    " w(g, repo, root, uid, n) AS (SELECT g, repo, root, root, 0 FROM root UNION SELECT w.g, w.repo, w.root, e.dst, w.n + 1 FROM w JOIN e ON e.g = w.g AND e.repo = w.repo AND e.src = w.uid WHERE w.n < 7),"
    " far AS (SELECT g, repo, root, uid, min(n) AS n FROM w GROUP BY ALL),"
    " pre AS (SELECT f.g, f.repo, f.root, f.uid, min(e.src) AS src FROM far f JOIN e ON e.g = f.g AND e.repo = f.repo AND e.dst = f.uid JOIN far u ON u.g = f.g AND u.repo = f.repo AND u.root = f.root AND u.uid = e.src AND u.n = f.n - 1 GROUP BY ALL),"
    " lost AS (SELECT f.repo, f.root, f.uid, h.clause FROM far f JOIN hole h ON h.repo = f.repo AND h.uid = f.uid WHERE f.g = 'h'),"
    " back(g, repo, root, src, dst) AS (SELECT p.g, p.repo, p.root, p.src, p.uid FROM pre p WHERE (p.g = 'h' AND EXISTS (SELECT 1 FROM lost l WHERE l.repo = p.repo AND l.root = p.root AND l.uid = p.uid))"
    "   OR (p.g = 'c' AND EXISTS (SELECT 1 FROM why y WHERE y.repo = p.repo AND y.root = p.root AND p.uid IN (y.lo, y.hi)))"
    "  UNION SELECT p.g, p.repo, p.root, p.src, p.uid FROM back k JOIN pre p ON p.g = k.g AND p.repo = k.repo AND p.root = k.root AND p.uid = k.src),"
    " size AS (SELECT repo, uid, clause, count(DISTINCT target) AS n FROM alt GROUP BY ALL),"
    " step AS (SELECT k.repo, k.root, k.src, k.dst, e.clause, s.n FROM back k JOIN e ON e.g = k.g AND e.repo = k.repo AND e.src = k.src AND e.dst = k.dst JOIN size s ON s.repo = e.repo AND s.uid = e.src AND s.clause = e.clause),"
    " drawn AS (SELECT repo, root, 'p' || src AS src, 'p' || dst AS dst, 'dependency' AS kind FROM step WHERE n = 1"
    "  UNION SELECT repo, root, 'p' || src, 'o' || src || '.' || clause, 'or' FROM step WHERE n > 1 UNION SELECT repo, root, 'o' || src || '.' || clause, 'p' || dst, 'or' FROM step WHERE n > 1"
    "  UNION SELECT repo, root, 'p' || uid, 'm' || uid || '.' || clause, 'missing' FROM lost UNION SELECT repo, root, 'p' || lo, 'p' || hi, 'conflict' FROM why)"
)


def explanation_paths(spark, sf_dir):
    """Conflicts without which a package would go in, which are the same for every solver, are the reasons here."""
    return explain.explanation_graph_of(order_universe(spark, sf_dir), alone=True)


def explanation_documents(spark, sf_dir):
    return explain.explanation_documents_of(order_universe(spark, sf_dir), alone=True)


QUERIES |= {"explanation_paths": explanation_paths, "explanation_documents": explanation_documents}
SQL["explanation_paths"] = _WHY + " SELECT * FROM drawn"
SQL["explanation_documents"] = _WHY + (
    " SELECT repo, root, 'digraph {' || chr(10) || string_agg(line, chr(10) ORDER BY line) || chr(10) || '}' AS document FROM ("
    "SELECT repo, root, '\"' || src || '\" -> \"' || dst || '\"' || CASE kind WHEN 'conflict' THEN ' [color=red,dir=none]' WHEN 'missing' THEN ' [style=dotted]' ELSE '' END || ';' AS line FROM drawn) GROUP BY repo, root"
)


@query(
    ", l AS (SELECT p.repo, p.uid FROM fx_pkg p SEMI JOIN (SELECT v.repo, b.uid FROM fx_closed v JOIN fx_pkg b ON b.repo = v.repo AND (v.s & b.bit) <> 0) c ON c.repo = p.repo AND c.uid = p.uid),"
    " e AS (SELECT DISTINCT repo, uid AS src, target AS dst FROM fx_alt SEMI JOIN l USING (repo, uid) WHERE (repo, target) IN (SELECT (repo, uid) FROM l)),"
    " w(repo, root, uid) AS (SELECT repo, uid, uid FROM l UNION SELECT w.repo, w.root, e.dst FROM w JOIN e ON e.repo = w.repo AND e.src = w.uid),"
    " cone AS (SELECT w.repo, root AS uid, bit_or(bit) AS cone FROM w JOIN fx_pkg p ON p.repo = w.repo AND p.uid = w.uid GROUP BY w.repo, root)"
    " SELECT p.repo, p.uid, count(*) AS n, md5(string_agg(CAST(v.s AS VARCHAR), ',' ORDER BY v.s)) AS digest FROM cone JOIN fx_pkg p USING (repo, uid)"
    " JOIN fx_valid v ON v.repo = p.repo AND (v.s & p.bit) <> 0 AND (v.s & cone) = v.s GROUP BY p.repo, p.uid"
)
def solution_counts(spark, sf_dir):
    """How many sets of each package's cone install it, and a digest of them all."""
    _, packages, deps, confs = resolved(spark, sf_dir)
    none = F.array().cast("array<int>")
    asked = packages.select("repo", F.col("uid").alias("req"), F.array("uid").alias("need"), none.alias("forbid"))
    found = solutions.all_solutions(asked, deps, confs)
    bits = F.aggregate("members", F.lit(0).cast("long"), lambda a, x: a + F.pow(F.lit(2), x - 1).cast("long"))
    held = found.groupBy("repo", F.col("req").alias("uid")).agg(F.array_sort(F.collect_list(bits)).alias("sets"))
    return held.select("repo", "uid", F.size("sets").cast("long").alias("n"), F.md5(F.array_join(F.col("sets").cast("array<string>"), ",")).alias("digest"))


SQL["solution_counts"] = SQL["solution_counts"].replace("WITH ", "WITH RECURSIVE ", 1)
