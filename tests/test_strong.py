import pytest

from solvarium.operators import explain, graphs, model, sat
from solvarium.plans.lineage import cut
from test_futures import universe


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def joined(u):
    """(strong dependencies, edges, packages) by joins."""
    packages, resolved, conflicts = model.resolved(u)
    return cut(sat._strong_dependencies_joined(packages, resolved, conflicts)), graphs.dependency_edges(resolved), packages


def wanted(u):
    strong, edges, packages = joined(u)
    closed = strong.selectExpr("repo", "uid AS src", "dep AS dst")
    impact = sat.impact(strong, edges, packages.select("repo", "uid").distinct())
    return [rows(strong), rows(impact), rows(graphs.direct_dominators(closed)), rows(graphs.direct_dominators_within(closed, 40))]


def found(u):
    return [rows(sat.strong_dependencies_of(u)), rows(sat.impact_of(u)), rows(sat.strong_dominators(u)), rows(sat.strong_dominators(u, 40))]


def test_strong_dependencies_of_narrow_repositories_take_no_joins(spark, monkeypatch):
    """The same strong dependencies, impact and dominators as by joined cones, from tables or from records."""
    u, _ = universe(spark, [1, 2, 5, 6, 7, 8] * 8)
    want = wanted(u)
    parts = model.resolved(u)
    monkeypatch.setattr(sat, "_strong_dependencies_joined", None)
    monkeypatch.setattr(sat, "_cones", None)
    assert found(u) == want and min(map(len, want)) > 10
    assert rows(sat.strong_dependencies(*parts)) == want[0]


@pytest.mark.parametrize("small", [2048, 25])
def test_strong_dependencies_of_wider_and_crowded_repositories_are_whole(spark, monkeypatch, small):
    u, _ = universe(spark, [5, 12, 3, 9, 0, 8])
    want = wanted(u)
    monkeypatch.setattr(sat.bits, "SMALL", small)
    assert found(u) == want and rows(sat.strong_dependencies(*model.resolved(u))) == want[0]


def test_impact_counts_packages_without_a_repository(spark):
    u, _ = universe(spark, [3])
    lost = spark.createDataFrame([(None, 1, "a", 1), (0, None, "a", 1)], u.packages.schema)
    more = model.Universe(u.packages.unionByName(lost), u.deps, u.confs, u.provs)
    assert rows(sat.impact_of(more)) == sorted(rows(sat.impact_of(u)) + rows(lost.selectExpr("repo", "uid", *[f"0 AS {c}" for c in ("strong_out", "strong_in", "direct_out", "direct_in")])))


def test_explanations_of_universes_are_told_at_once(spark, monkeypatch):
    """The same graphs and documents as from tables; a wide repository's go by joins, and only by them."""
    for sizes in ([1, 4, 6, 7, 8] * 6, [5, 12, 6]):
        u, _ = universe(spark, sizes)
        parts = model.resolved(u)
        reasons = cut(sat.conflict_reasons(*parts))
        for alone in (False, True):
            graph = cut(explain.explanation_graph(*parts, reasons.where("alone") if alone else reasons))
            want = rows(graph), rows(explain.explanation_documents(graph))
            with monkeypatch.context() as m:
                if 12 not in sizes:
                    m.setattr(explain, "explanation_graph", None)
                    m.setattr(explain, "explanation_documents", None)
                assert (rows(explain.explanation_graph_of(u, alone)), rows(explain.explanation_documents_of(u, alone))) == want
            assert len(want[1]) > 2
