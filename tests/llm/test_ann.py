import numpy as np
import pytest
from pyspark.sql import functions as F

from solvarium.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    good = {}
    for i, x in rows:
        if i is not None and x and None not in x and np.isfinite(x).all() and any(x) and len(x) == 8:
            good.setdefault(i, []).append(np.array(x, np.float32).astype(float))
    out = {}
    for q in queries:
        if q in good:
            s = {i: max((a * b).sum() for a in good[q] for b in v) for i, v in good.items() if i != q}
            out[q] = sorted(s.items(), key=lambda t: (-t[1], t[0]))[:k]
    return out


def random_rows(n, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 8))
    x = centres[r.integers(12, size=n)] + 0.5 * r.normal(size=(n, 8))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


def test_small_table_gives_all_exactly(spark):
    rows = random_rows(300)
    rows += [(1000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [float("inf")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [1.0]), (None, [1.0] * 8), (20, rows[20][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows, [i for i in {i for i, _ in rows} if i is not None and i % 20 == 0], 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame(random_rows(5), SCHEMA)
    assert ann.search(df, df.where("vec_id = 0")).count() == 4
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    one = df.where("vec_id = 0")
    assert ann.search(one, one).count() == 0


@pytest.mark.parametrize("hot", [0, 3000])
def test_recall(spark, hot):
    rows = random_rows(6000)
    rows += [(10_000 + i, rows[1][1]) for i in range(hot)]
    df = spark.createDataFrame(rows, SCHEMA)
    queries = list(range(0, 6000, 200))
    got = {}
    for r in ann.search(df, df.where(F.col("vec_id").isin(queries))).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(rows, queries, 20)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in queries) >= 0.9 * 20 * len(queries)


def test_parts_are_balanced():
    x = np.array([v for _, v in random_rows(1000)])
    label = ann.balanced_parts(x, ann.neighbour_graph(x, 5), 8)
    assert np.bincount(label, minlength=8).max() <= np.ceil(ann.SLACK * 125)
