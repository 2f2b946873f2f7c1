import random

from solvarium.operators import model, sat
from solvarium.streaming import history as kept
from solvarium.streaming.snapshots import arrivals

SCHEMA = kept.record_schema()


def record(repo, uid, at, gone=False, deps=(), confs=(), provs=()):
    """Package uid is called n<uid>; deps are lists of names."""
    atoms = [(c, a, name, "any", 0) for c, any_ in enumerate(deps) for a, name in enumerate(any_)]
    return (repo, uid, at, gone, f"n{uid}", 1, atoms, [(name, "any", 0) for name in confs], [(f"n{uid}", 1), *((name, None) for name in provs)])


def batch_status(spark, rows):
    u = kept.universe(spark.createDataFrame(rows, SCHEMA))
    said = sat.check(u.packages, model.resolve_deps(u), model.resolve_conflicts(u))
    return {(r.repo, r.uid): r.status for r in said.collect()}


def waves(seed, n=6, count=3):
    """Waves of random records, some late, some that leave, and what stands after each wave."""
    r, stands, out = random.Random(seed), {}, []
    for at in range(1, count + 1):
        rows = {}
        for repo in (0, 1):
            for uid in r.sample(range(n), 3):
                names = [f"n{i}" for i in range(n + 1)] + ["v"]
                deps = [r.sample(names, r.choice([1, 2])) for _ in range(r.choice([0, 1, 2]))]
                when = at * 10 - r.choice([0, 0, 0, 15])
                rows[repo, uid] = record(repo, uid, when, r.random() < 0.2, deps, r.sample(names, r.choice([0, 0, 1])), r.choice([(), ("v",)]))
        for key, row in rows.items():
            if key not in stands or row[2] > stands[key][2]:
                stands[key] = row
        out.append((list(rows.values()), [row for row in stands.values() if not row[3]]))
    return out


def test_the_stream_equals_the_batch_check(spark, tmp_path):
    files, path, marks = (f"{tmp_path}/{k}" for k in ("in", "out", "marks"))
    for b, (rows, stands) in enumerate(waves(3)):
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(files)
        kept.keep(arrivals(spark, files, SCHEMA, 1000), path, marks, every=2).awaitTermination()
        want = batch_status(spark, stands)
        assert {(r.repo, r.uid): r.status for r in kept.standing(spark, path).collect()} == want
        for r in kept.history(spark, path).where(f"batch = {b}").collect():
            assert r.n == sum(1 for k, s in want.items() if k[0] == r.repo and s == r.status)
    kept.keep(arrivals(spark, files, SCHEMA, 1000), path, marks, every=2).awaitTermination()  # nothing came
    assert kept.history(spark, path).agg({"batch": "max"}).first()[0] == 2


def test_only_what_is_touched_is_checked_again_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    first = [record(0, 1, 1, deps=[["n2"]]), record(0, 2, 1), record(0, 3, 1, deps=[["n4"]]), record(0, 5, 1), record(1, 1, 1)]
    second = [record(0, 4, 1), record(0, 2, 1, gone=True), record(0, 5, 0, gone=True)]  # one new, two not newer
    third = [record(0, 2, 2, gone=True), record(0, 2, 2), (None, 1, 1, *record(0, 1, 1)[3:]), (0, 9, None, *record(0, 9, 1)[3:])]
    for b, rows in enumerate((first, second, second, third)):
        b = min(b, 1) if b < 3 else 2  # the second batch comes twice, as after a failure
        kept.apply(spark.createDataFrame(rows, SCHEMA), b, path, every=2)
    again = {b: {(r.repo, r.uid): r.status for r in kept.checked(spark, path).where(f"batch = {b}").collect()} for b in range(3)}
    assert again[0] == {(0, 1): "ok", (0, 2): "ok", (0, 3): "broken", (0, 5): "ok", (1, 1): "ok"}
    assert again[1] == {(0, 3): "ok", (0, 4): "ok"}
    assert again[2] == {(0, 1): "broken", (0, 2): None}
    refused = spark.read.parquet(f"{path}/refused").groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in refused} == {1: 2, 2: 3}
    assert {(r.repo, r.status, r.n) for r in kept.history(spark, path).where("batch = 2").collect()} == {(0, "ok", 3), (0, "broken", 1)}


def test_an_empty_batch_and_null_arrays(spark, tmp_path):
    path = f"{tmp_path}/out"
    kept.apply(spark.createDataFrame([], SCHEMA), 0, path)
    kept.apply(spark.createDataFrame([(0, 1, 1, None, None, None, None, None, None)], SCHEMA), 1, path)
    assert [(r.repo, r.uid, r.status) for r in kept.standing(spark, path).collect()] == [(0, 1, "ok")]


def test_small_repositories_take_no_joins_and_crowded_ones_are_whole(spark, tmp_path, monkeypatch):
    """The same by tasks, by joins, and with a repository of either kind, also once the state is written whole."""
    made = waves(9)
    said = {}
    for way, small in (("tasks", 2048), ("joins", 0), ("both", 40)):
        with monkeypatch.context() as m:
            m.setattr(kept.bits, "SMALL", small)
            if way == "tasks":
                m.setattr(kept, "_joined", None)
            for b, (rows, _) in enumerate(made):
                if way == "both":  # repository 1 says more than a task should hold
                    rows = [(*r[:8], r[8] + [(f"w{k}", None) for k in range(20)]) if r[0] == 1 else r for r in rows]
                kept.apply(spark.createDataFrame(rows, SCHEMA), b, f"{tmp_path}/{way}", every=2)
        parts = [kept.history(spark, f"{tmp_path}/{way}"), kept.checked(spark, f"{tmp_path}/{way}"), spark.read.parquet(f"{tmp_path}/{way}/refused").select("batch", "repo", "uid", "at")]
        said[way] = [sorted(map(str, df.collect())) for df in parts]
        assert {(r.repo, r.uid): r.status for r in kept.standing(spark, f"{tmp_path}/{way}").collect()} == batch_status(spark, made[-1][1])
    assert said["tasks"] == said["joins"] == said["both"] and all(said["tasks"])
