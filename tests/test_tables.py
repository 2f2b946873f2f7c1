import random

from solvarium.operators import explain, requests, sat, solutions


def universe(spark, many=25, n=6):
    r = random.Random(4)
    packages = [(repo, p, r.choice("abc"), p, r.random() < 0.5, r.randint(0, 9)) for repo in range(many) for p in range(n)]
    deps = [(repo, p, c, q) for repo in range(many) for p in range(n) for c in range(r.choice([0, 1])) for q in r.sample([None, *range(n)], r.choice([1, 2])) if q is not None]
    fights = [(repo, *sorted(r.sample(range(n), 2))) for repo in range(many) for _ in range(2)]
    wanted = [(repo, action, k, p) for repo in range(many) for k, action in enumerate(("install", "upgrade", "remove")) for p in r.sample(range(n), 2 if k < 2 else 1)]
    frame = spark.createDataFrame
    return (
        frame(packages, "repo long, uid int, name string, ver int, installed boolean, size int"),
        frame(deps, "repo long, uid int, clause int, target int"),
        frame(sorted(set(fights)), "repo long, lo int, hi int"),
        frame(wanted, "repo long, action string, item int, uid int"),
    )


def test_requests_of_narrow_repositories_take_no_components(spark, monkeypatch):
    """The same least counts as by components, whatever the criteria, without one of their joins."""
    args = universe(spark)
    for criteria in (("removed", "changed"), ("notuptodate", "sum:size", "new"), ("installed",)):
        rows = lambda: sorted(map(str, requests.optimise(*args, criteria).collect()))  # noqa: B023, E731
        with monkeypatch.context() as m:
            m.setattr(requests.tables, "told", lambda task, schema, *tables: (spark.createDataFrame([], schema), args[0].select("repo").distinct()))
            want = rows()
        with monkeypatch.context() as m:
            m.setattr(requests, "_answers_joined", None)
            assert rows() == want and len(want) == 25 and any("ok" in r for r in want) and any("none" in r for r in want)


def test_solutions_of_narrow_repositories_take_no_rounds(spark, monkeypatch, tmp_path):
    packages, deps, fights, _ = universe(spark)
    asked = packages.selectExpr("repo", "uid AS req", "array(uid) AS need", "array(0) AS forbid")
    rows = lambda **k: sorted(str((r.repo, r.req, r.status, list(r.members))) for r in solutions.all_solutions(asked, deps, fights, **k).collect())
    want = rows(path=str(tmp_path / "rounds"))
    monkeypatch.setattr(solutions, "_rounds", None)
    assert rows() == want and len(want) > 20


def test_explanations_of_narrow_repositories_take_no_walks(spark, monkeypatch):
    """The same graphs, and least sets of conflicts behind them, as by joins."""
    packages, deps, fights, _ = universe(spark)
    deps = deps.selectExpr("repo", "uid", "clause", "CASE WHEN repo % 3 = 0 AND uid = 2 THEN null ELSE target END AS target").distinct()
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(sat._conflict_reasons_joined(packages, deps, fights))
    reasons = spark.createDataFrame(sat._conflict_reasons_joined(packages, deps, fights).collect())
    graph = rows(explain._graph_joined(deps, reasons.selectExpr("repo", "uid AS root", "lo", "hi")))
    monkeypatch.setattr(sat, "_conflict_reasons_joined", None)
    monkeypatch.setattr(explain, "_graph_joined", None)
    assert rows(sat.conflict_reasons(packages, deps, fights)) == want and want
    assert rows(explain.explanation_graph(packages, deps, fights)) == graph and {"missing", "conflict", "dependency"} <= {w for r in graph for w in r.split("'")}
