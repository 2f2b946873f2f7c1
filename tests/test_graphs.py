import random

from solvarium.operators import graphs


def reach(edges, start):
    seen, todo = set(), [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_strong_components_equal_reachability(spark):
    """Random graphs of several densities, a repository each; loops, repeated edges, and ends that are no vertices."""
    r, vertices, edges, want = random.Random(2), [], [], set()
    for repo, (n, m) in enumerate([(1, 0), (12, 14), (20, 20), (20, 26), (15, 40)]):
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        vertices += [(repo, u) for u in range(n)]
        edges += [(repo, a, b) for a, b in pairs + pairs[:2]] + [(repo, 0, n + 5)]
        out = {}
        for a, b in pairs:
            out.setdefault(a, set()).add(b)
        to = {u: reach(out, u) for u in range(n)}
        want |= {(repo, u, min([v for v in to[u] if u in to[v]] + [u])) for u in range(n)}
    v, e = spark.createDataFrame(vertices, "repo int, uid int"), spark.createDataFrame(edges, "repo int, src int, dst int")
    got = [tuple(x) for x in graphs.strong_components(v, e).collect()]
    assert len(got) == len(vertices) and set(got) == want
    none = graphs.strong_components(v.limit(0), e.limit(0))
    assert none.columns == ["repo", "uid", "component"] and none.count() == 0


def test_rounds_of_strong_components_send_no_table_through_the_driver(spark, monkeypatch):
    """Whatever its size, a table of a round is shuffled, not broadcast; two cycles, one of them behind a chain."""
    from solvarium.operators import graphs

    plans, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    v = cut(spark.createDataFrame([(0, k) for k in range(6)], "repo long, uid int"))
    e = cut(spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 2, 3), (0, 3, 4), (0, 4, 5), (0, 5, 4)], "repo long, src int, dst int"))
    got = {(r.uid, r.component) for r in graphs.strong_components(v, e).collect()}
    assert got == {(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (5, 4)}
    assert plans and not any("Broadcast" in p for p in plans)


def test_condensation_sends_no_table_through_the_driver(spark):
    from solvarium.operators import graphs

    v = spark.createDataFrame([(0, k) for k in range(3)], "repo long, uid int")
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 1, 2)], "repo long, src int, dst int")
    label, between = graphs.condensation(v, e, v.withColumn("name", v.uid.cast("string")))
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in (label, between))
    assert {tuple(r) for r in label.collect()} == {(0, 0, "0/1"), (0, 2, "2")} and [tuple(r) for r in between.collect()] == [(0, 0, 2)]


def test_layers_and_dominator_trees_send_no_table_through_the_driver(spark, monkeypatch):
    from solvarium.operators import graphs

    plans, cut = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    v = cut(spark.createDataFrame([(0, k) for k in range(4)], "repo long, uid int"))
    e = cut(spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 1, 3), (0, 2, 3)], "repo long, src int, dst int"))
    assert {(r.uid, r.dominator) for r in graphs.dominator_tree(v, e).collect()} == {(0, None), (1, 0), (2, 0), (3, 0)}
    assert plans and not any("Broadcast" in p for p in plans)
