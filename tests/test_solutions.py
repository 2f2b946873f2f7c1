import glob
import os

import pytest
from test_operators import random_repository, valid_sets

from solvarium.operators import sat
from solvarium.operators.solutions import all_solutions, follow

REQUESTS = "repo int, req int, need array<int>, forbid array<int>"


def cone_of(need, clauses):
    """What the need leads to over packages that could be met without conflicts."""
    fine = set().union(*valid_sets(clauses, []))
    seen, todo = set(need), list(need)
    while todo:
        p = todo.pop()
        for q in (q for owner, _, any_ in clauses if owner == p for q in any_):
            if q in fine and q not in seen:
                seen.add(q)
                todo.append(q)
    return seen


def test_all_solutions_equal_enumeration_over_rounds(spark):
    deps, confs, asked, want = [], [], [], set()
    for repo in range(25):
        clauses, conflicts = random_repository(repo)
        sets = list(valid_sets(clauses, conflicts))
        deps += [(repo, p, c, t) for p, c, any_ in clauses for t in any_ or (None,)]
        confs += [(repo, a, b) for a, b in conflicts]
        for req, (need, forbid) in enumerate([([p], []) for p in range(7)] + [([0, 1], []), ([2], [3])]):
            asked.append((repo, req, need, forbid))
            cone = cone_of(need, clauses)
            want |= {(repo, req, tuple(sorted(s))) for s in sets if set(need) <= s <= cone and not s & set(forbid)}
    deps = spark.createDataFrame(deps, "repo int, uid int, clause int, target int")
    confs = spark.createDataFrame(confs, "repo int, lo int, hi int")
    got = all_solutions(spark.createDataFrame(asked, REQUESTS), deps, confs, sat.horn_broken(deps), searches=4).collect()
    assert {r.status for r in got} == {"ok"}
    assert len(got) == len(want) and {(r.repo, r.req, tuple(r.members)) for r in got} == want


def test_many_solutions_of_one_request_and_going_on_after_a_failure(spark, tmp_path):
    """Six choices of one or both of two; two of the first four go not together: 9 - 4 ways for those, 3 for each other choice."""
    deps = spark.createDataFrame([(0, 0, c, 2 * c + k) for c in range(1, 7) for k in (0, 1)], "repo int, uid int, clause int, target int")
    confs = spark.createDataFrame([(0, 2, 4)], "repo int, lo int, hi int")
    asked = spark.createDataFrame([(0, 1, [0], [])], REQUESTS)
    run = lambda: sorted(tuple(r.members) for r in all_solutions(asked, deps, confs, sat.horn_broken(deps), 8, f"{tmp_path}/s").collect())
    got = run()
    assert len(got) == len(set(got)) == (3 * 3 - 2 * 2) * 3**4
    rounds = sorted(glob.glob(f"{tmp_path}/s/round=*"), key=lambda p: int(p.rsplit("=", 1)[1]))
    assert len(rounds) > 2
    times = os.path.getmtime(f"{rounds[0]}/_SUCCESS")
    os.remove(f"{rounds[-1]}/_SUCCESS")
    assert run() == got and os.path.getmtime(f"{rounds[0]}/_SUCCESS") == times


def test_solutions_of_nothing_and_beyond_the_budget(spark):
    deps = spark.createDataFrame([(0, 1, 1, None)], "repo int, uid int, clause int, target int")
    confs = spark.createDataFrame([], "repo int, lo int, hi int")
    broken = sat.horn_broken(deps)
    assert all_solutions(spark.createDataFrame([], REQUESTS), deps, confs, broken).collect() == []
    assert all_solutions(spark.createDataFrame([(0, 1, [1], [])], REQUESTS), deps, confs, broken).collect() == []
    alone = all_solutions(spark.createDataFrame([(0, 2, [2], [])], REQUESTS), deps, confs, broken).collect()
    assert [(r.req, r.status, r.members) for r in alone] == [(2, "ok", [2])]
    with pytest.raises(ValueError):
        all_solutions(spark.createDataFrame([], REQUESTS), deps, confs, broken, searches=0)
    hard = {0: [(1, 2), (3, 4)], 1: [(3,)], 2: [(3,)]}
    found, open_, unknown = follow([0], [], hard, {3: {1, 2}, 1: {3}, 2: {3}}, 10, budget=(0, 0))
    assert not found and not open_ and unknown == [([0], [])]
