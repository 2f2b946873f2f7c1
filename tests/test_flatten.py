import itertools
import random

from pyspark.sql import functions as F

from solvarium.operators import flatten, sat
from test_operators import random_repository, valid_sets


def tables(spark, repos):
    packages, resolved, fights, each = [], [], [], {}
    for repo in repos:
        clauses, conflicts = random_repository(repo + 7000)
        packages += [(repo, i) for i in range(7)]
        resolved += [(repo, p, c, t) for p, c, any_ in clauses for t in (any_ or (None,))]
        fights += [(repo, a, b) for a, b in conflicts]
        each[repo] = clauses, conflicts, list(valid_sets(clauses, conflicts))
    p = spark.createDataFrame(packages, "repo long, uid int")
    d = spark.createDataFrame(resolved, "repo long, uid int, clause int, target int")
    return p, d, spark.createDataFrame(fights, "repo long, lo int, hi int"), each


def test_flattened_repositories_hold_the_same_sets(spark):
    packages, resolved, fights, each = tables(spark, range(60))
    flat, left = flatten.flattened(packages, resolved, fights)
    deps, confs = {}, {}
    for r in flat.collect():
        deps.setdefault(r.repo, {}).setdefault((r.uid, r.clause), set()).update([] if r.target is None else [r.target])
    for r in left.collect():
        confs.setdefault(r.repo, set()).add((r.lo, r.hi))
    fewer = 0
    for repo, (_, conflicts, sets) in each.items():
        pairs = confs.get(repo, set())
        assert pairs <= conflicts
        fewer += pairs != conflicts
        ends = {x for c in conflicts for x in c}
        assert all(m <= ends for m in deps.get(repo, {}).values())
        small = list(valid_sets([(u, c, tuple(m)) for (u, c), m in deps.get(repo, {}).items()], pairs))
        for k in (1, 2, 3):
            for group in itertools.combinations(range(7), k):
                assert any(set(group) <= s for s in small) == any(set(group) <= s for s in sets), (repo, group)
    assert fewer > 2


def test_buddies_go_with_whatever_is_in(spark):
    packages, resolved, fights, each = tables(spark, range(100, 160))
    got = {(r.repo, r.uid) for r in flatten.buddies(packages, resolved, fights).collect()}
    want = set()
    for repo, (_, conflicts, sets) in each.items():
        ends = {x for c in conflicts for x in c}
        for p in set(range(7)) - ends:
            if all(any(p in t and s & ends <= t for t in sets) for s in sets):
                want.add((repo, p))
    assert got == want and 0 < len(got) < 420


def test_greatest_sets_equal_enumeration():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 7)
        conflicts = [tuple(sorted(r.sample(range(n), 2))) for _ in range(r.randint(0, 8)) if n > 1]
        needs = {p: [tuple(r.sample(range(n), r.randint(0, min(n, 2))))] for p in range(n) if r.random() < 0.3}
        every = [frozenset(i for i in range(n) if k >> i & 1) for k in range(1 << n)]
        fine = [s for s in every if not any(a in s and b in s for a, b in conflicts) and all(set(c) & s for p in s for c in needs.get(p, ()))]
        got = list(flatten.greatest_sets(list(range(n)), conflicts, needs))
        assert len(got) == len(set(got)) and set(got) == {s for s in fine if not any(s < t for t in fine)}


def test_large_groups_of_conflicts_stay_linear_where_answers_are_few(spark):
    """A user of each of 400 packages that exclude each other, in one group: 400 greatest sets of one member."""
    n = 400
    packages = spark.range(2 * n).select(F.lit(0).alias("repo"), F.col("id").cast("int").alias("uid"))
    deps = spark.createDataFrame([(0, n + k, 1, k) for k in range(n)], "repo int, uid int, clause int, target int")
    fights = spark.createDataFrame([(0, a, b) for a in range(n) for b in range(a + 1, n)], "repo int, lo int, hi int")
    assert flatten.buddies(packages, deps, fights).count() == 0
    free = deps.where("uid > 600")
    assert flatten.buddies(packages, free, fights).count() == 201
    assert sat.horn_broken(free).count() == 0


def test_empty_repositories(spark):
    packages, deps, fights = (spark.createDataFrame([], s) for s in ("repo long, uid int", "repo long, uid int, clause int, target int", "repo long, lo int, hi int"))
    flat, left = flatten.flattened(packages, deps, fights)
    assert flat.count() == left.count() == flatten.buddies(packages, deps, fights).count() == 0


def test_narrow_repositories_take_no_rounds(spark, monkeypatch):
    """Formulas, packages that go with everything and strong conflicts are told by truth tables, as by joins."""
    packages, resolved, fights, _ = tables(spark, range(200, 230))
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(f(packages, resolved, fights)) for f in (flatten._formulas_joined, sat._strong_conflicts_joined)]
    assert all(want)
    for module, name in ((flatten, "_formulas_joined"), (flatten, "_buddies_joined"), (sat, "_strong_conflicts_joined")):
        monkeypatch.setattr(module, name, None)
    assert [rows(f(packages, resolved, fights)) for f in (flatten.flat_formulas, sat.strong_conflicts)] == want
    assert flatten.buddies(packages, resolved, fights).count()


def test_forced_conflicts_are_not_asked(spark):
    """In a repository too wide for a table, what both of a pair force needs no search; a choice does."""
    deps = [(0, k, 1, 1) for k in range(10, 20)] + [(0, k, 1, 2) for k in range(20, 30)] + [(0, 30, 1, 1), (0, 30, 1, 3), (0, 31, 1, 2)]
    packages = spark.createDataFrame([(0, k) for k in (1, 2, 3, *range(10, 32))], "repo long, uid int")
    deps = spark.createDataFrame(deps, "repo long, uid int, clause int, target int")
    fights = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "repo long, lo int, hi int")
    asked = sat.strong_conflict_requests(packages, deps, fights)[1]
    assert asked.where("sure").count() and asked.where("NOT sure").count()
    got = {(r.lo, r.hi) for r in sat.strong_conflicts(packages, deps, fights).collect()}
    ones, twos = {1, *range(10, 20)}, {2, 31, *range(20, 30)}
    assert got == {tuple(sorted((a, b))) for a in ones | {3, 30} for b in twos}


def test_hot_conflicts_and_classes_are_dealt_over_keys(spark, monkeypatch):
    """No key of a join holds all that crosses one conflict, nor all of one class; pairs are the same."""
    deps = [(0, k, 1, 1) for k in range(10, 60)] + [(0, k, 1, 2) for k in range(60, 90)] + [(0, k, 2, 3) for k in range(10, 40)]
    packages = spark.createDataFrame([(0, k) for k in (1, 2, 3, *range(10, 90))], "repo long, uid int")
    deps = spark.createDataFrame(deps, "repo long, uid int, clause int, target int")
    fights = spark.createDataFrame([(0, 1, 2)], "repo long, lo int, hi int")
    rows = lambda df: sorted(tuple(r) for r in df.select("lo", "hi", "status").collect())
    want = [(min(a, b), max(a, b), "broken") for a in (1, *range(10, 60)) for b in (2, *range(60, 90))]
    assert rows(sat.strong_conflicts(packages, deps, fights)) == sorted(want)
    monkeypatch.setattr(sat, "SPREAD", 100)
    monkeypatch.setattr(sat, "CLASS", 10)
    each = deps.selectExpr("repo", "uid AS root", "target AS uid")
    assert [tuple(r) for r in sat._shares(each, fights).collect()] == [(0, 1, 2, 15)]
    assert rows(sat.strong_conflicts(packages, deps, fights)) == sorted(want)
