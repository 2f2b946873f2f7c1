from solvarium.operators import evolution, futures
from test_futures import universe


def rows(df):
    return sorted(map(str, df.select("repo", "uid", "status").collect()))


def test_narrow_repositories_write_no_futures(spark, monkeypatch):
    """The same as by the tables of future(), which nobody makes; packages are in several clusters, or provide names that a
    package of their cluster has."""
    u, members = universe(spark, [1, 2, 5, 6, 7, 8] * 4)
    want = rows(evolution._outdated_joined(u, members))
    monkeypatch.setattr(evolution, "future", None)
    assert rows(evolution.outdated(u, members)) == want and len({r.split("status=")[1] for r in want}) == 2


def test_wider_and_crowded_repositories_are_whole(spark, monkeypatch):
    u, members = universe(spark, [5, 12, 3])
    want = rows(evolution._outdated_joined(u, members))
    assert rows(evolution.outdated(u, members)) == want
    monkeypatch.setattr(futures, "MOST", 20)
    monkeypatch.setattr(evolution.bits, "SMALL", 50)
    assert rows(evolution.outdated(u, members)) == want
