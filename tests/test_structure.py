import random

from pyspark.sql import functions as F
from test_flatten import tables

from solvarium.operators import explain, graphs, sat


def test_strong_conflicts_equal_enumeration_with_fewer_requests(spark):
    packages, resolved, fights, each = tables(spark, range(200, 250))
    want = set()
    for repo, (_, _, sets) in each.items():
        fine = {p for p in range(7) if any(p in s for s in sets)}
        want |= {(repo, a, b, "broken") for a in fine for b in fine if a < b and not any({a, b} <= s for s in sets)}
    assert {tuple(r) for r in sat.strong_conflicts(packages, resolved, fights).collect()} == want and want
    models = sat.check(packages, resolved, fights, with_model=True)
    asked = sat.strong_conflict_requests(packages, resolved, fights)[1]
    assert asked.count() <= sat._crossing(models, fights).count()


def test_triangles_equal_their_definition(spark):
    packages, resolved, fights, each = tables(spark, range(300, 360))
    want = set()
    for repo, (clauses, conflicts, _) in each.items():
        users = {q: {p for p, _, any_ in clauses if q in any_ and p != q} for q in range(7)}
        for x, y in conflicts:
            both = users[x] & users[y]
            above = set().union(*(users[z] for z in both))
            if both and (users[x] ^ users[y]) <= above:
                want.add((repo, x, y, "simple" if len(users[x]) == len(users[y]) == 1 else "shared"))
    assert {tuple(r) for r in sat.triangles(resolved, fights).collect()} == want and len({w[3] for w in want}) == 2


def test_dominator_trees_of_graphs_with_cycles(spark):
    r, edges, want = random.Random(8), [], set()
    for repo in range(30):
        n = 8
        own = {(a, b) for a in range(n) for b in range(n) if a != b and r.random() < 0.17}
        edges += [(repo, a, b) for a, b in own]

        def reach(start, without=()):
            seen, todo = set(), [s for s in start if s not in without]
            while todo:
                a = todo.pop()
                if a not in seen:
                    seen.add(a)
                    todo += [b for x, b in own if x == a and b not in without]  # noqa: B023
            return seen

        comp = {v: min(w for w in reach([v]) if v in reach([w])) for v in range(n)}
        members = {c: {v for v in comp if comp[v] == c} for c in set(comp.values())}
        start = [c for c in members if not any(comp[a] != c and comp[b] == c for a, b in own)]
        doms = {c: {d for d in members if d == c or c not in {comp[v] for v in reach([m for s in start for m in members[s]], members[d])}} for c in members}
        for v, c in comp.items():
            above = [d for d in doms[c] if d != c]
            want.add((repo, v, c, max(above, key=lambda d: len(doms[d])) if above else None))
    df = spark.createDataFrame(edges, "repo int, src int, dst int")
    vertices = spark.createDataFrame([(k, v) for k in range(30) for v in range(8)], "repo int, uid int")
    got = {tuple(x) for x in graphs.dominator_tree(vertices, df).collect()}
    assert got == want and any(w[1] != w[2] for w in want) and any(w[3] is not None for w in want)


def test_explanations_lead_to_reasons_that_suffice(spark):
    """Every path ends in a missing clause or a conflict, and each broken package has a graph, no other has one."""
    packages, resolved, fights, each = tables(spark, range(400, 440))
    graph = explain.explanation_graph(packages, resolved, fights)
    rows = graph.collect()
    by = {}
    for x in rows:
        by.setdefault((x.repo, x.root), []).append(x)
    broken = {(repo, p) for repo, (_, _, sets) in each.items() for p in range(7) if not any(p in s for s in sets)}
    assert set(by) == broken
    for (repo, root), own in by.items():
        starts, ends = {x.src for x in own}, {x.dst for x in own}
        assert f"p{root}" in starts
        assert all(v == f"p{root}" or v in ends or any(x.kind == "conflict" and v in (x.src, x.dst) for x in own) for v in starts)
        assert all(v in starts or v[0] == "m" or any(x.kind == "conflict" and x.dst == v for x in own) for v in ends)
        assert any(x.kind in ("missing", "conflict") for x in own)
    docs = explain.explanation_documents(graph).collect()
    assert len(docs) == len(broken) and all(d.document.startswith("digraph {\n") and d.document.endswith("\n}") for d in docs)
    none = explain.explanation_graph(packages.limit(0), resolved.limit(0), fights.limit(0))
    assert none.where(F.lit(True)).count() == 0
