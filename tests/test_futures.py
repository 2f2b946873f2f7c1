import random

from solvarium.operators import evolution, model

OPS = ("any", "=", "!=", ">=", ">", "<=", "<")


def universe(spark, sizes):
    """Repositories of so many packages, of names a, b and c, which also provide v and w, with or without a version."""
    r = random.Random(7)
    packages = [(repo, p, r.choice("abc"), r.randint(1, 5)) for repo, n in enumerate(sizes) for p in range(n)]
    atom = lambda: (r.choice("abcvwx"), r.choice(OPS), r.randint(1, 5))
    deps = [(repo, p, c, a, *atom()) for repo, p, _, _ in packages for c in range(r.choice([0, 1, 2])) for a in range(r.choice([1, 2]))]
    confs = [(repo, p, *atom()) for repo, p, _, _ in packages if r.random() < 0.5]
    provs = [(repo, p, n, v) for repo, p, n, v in packages] + [(repo, p, r.choice("vw"), r.choice([None, 1, 3])) for repo, p, _, _ in packages if r.random() < 0.5]
    members = [(repo, k, p) for repo, p, _, _ in packages for k in {p % 3, *([1] if r.random() < 0.2 else [])}]
    frame = spark.createDataFrame
    u = model.Universe(
        frame(packages, "repo long, uid int, name string, ver int"),
        frame(deps, "repo long, uid int, clause int, alt int, name string, op string, ver int"),
        frame(confs, "repo long, uid int, name string, op string, ver int"),
        frame(provs, "repo long, uid int, name string, ver int"),
    )
    return u, frame(members, "repo long, cluster long, uid int")


def rows(df):
    return sorted(map(str, df.select("repo", "cluster", "target", "equivalents", "broken", "unknown").collect()))


def test_futures_of_narrow_repositories_take_no_joins(spark, monkeypatch):
    """The same as by joins, with clusters of several names and packages in several clusters."""
    u, members = universe(spark, [1, 2, 5, 6, 7, 8] * 5)
    want = rows(evolution._challenged_joined(u, members))
    monkeypatch.setattr(evolution, "_challenged_joined", None)
    assert rows(evolution.challenged(u, members)) == want
    assert len(want) > 50 and sum("broken=0" not in r for r in want) > 5


def test_futures_of_wider_and_crowded_repositories_are_whole(spark, monkeypatch):
    u, members = universe(spark, [5, 12, 3, 9])
    want = rows(evolution._challenged_joined(u, members))
    assert rows(evolution.challenged(u, members)) == want
    monkeypatch.setattr(evolution.bits, "SMALL", 25)
    assert rows(evolution.challenged(u, members)) == want
