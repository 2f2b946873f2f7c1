import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvarium.llm import quality

WORDS = "river stone letter window garden market winter summer table yellow simple second morning paper music".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(r, n):
    return " ".join(r.choice(["$$$", "click!!", "x9x9", "BUY", "http://a.b/c?d=1"]) for _ in range(n))


def test_gradients_equal_finite_differences():
    r = np.random.default_rng(1)
    passages = np.array([1, 3, 2])
    x = r.normal(0, 1, (6, quality.WIDTH))
    y = np.array([1.0, 0.0, 1.0])
    p = {"W": r.normal(0, 0.1, (quality.WIDTH, 4)), "b": r.normal(0, 0.1, 4), "V": r.normal(0, 1, (4, 3)), "U": r.normal(0, 1, (4, 3)), "w": r.normal(0, 1, 3), "c": r.normal(0, 1, 4), "d": np.array([0.1])}
    model = quality.Model(p, np.zeros(quality.WIDTH), np.ones(quality.WIDTH))

    def loss():
        s = model.forward(x, passages)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    f = model.forward(x, passages)
    g = quality._gradient(p, f, x, f["score"] - y)
    for name, w in p.items():
        for at in list(np.ndindex(w.shape))[:: max(1, w.size // 12)]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def slow_features(text):
    """encode() of one text, by a loop over passages and words."""
    codes, words = quality._Codes(), []
    for w in text.split():
        words += [w[k : k + quality.LONGEST] for k in range(0, len(w), quality.LONGEST)]
    rows = []
    for a in range(0, max(1, len(words)), quality.WORDS):
        own = words[a : a + quality.WORDS]
        code = [codes[w] for w in own]
        k = max(1, len(own))
        x = np.zeros(quality.WIDTH)
        for c in code:
            x[c & 0xFF] += 1 / k
            x[quality.SHAPES + (c >> 16) % quality.LEXICAL] += 1 / k
        x = np.sqrt(x)
        sizes = [len(w) for w in own]
        mean = sum(sizes) / k
        repeats = sum(codes[u] == codes[v] for u, v in zip(words[max(0, a - 1) :], own if a else own[1:]))
        x[-9:] = [mean / 8, np.sqrt(max(0, sum(n * n for n in sizes) / k - mean * mean)) / 4, repeats / k, len({w.lower() for w in own}) / k, np.log1p(len(own)) / 4, np.log1p(len(words)) / 8, np.log1p(len(words) / (text.count(b"\n") + 1)) / 4, len(words) < 12, 1]
        rows.append(x)
    return np.array(rows)


def test_scores_equal_a_loop_over_documents():
    r = random.Random(2)
    texts = [prose(r, n).encode() for n in (1, 63, 64, 65, 400)] + [b"", b" \n ", b"ab" * 500, junk(r, 90).encode(), "日本語".encode() * 80, b"a a A b\nb"]
    x, n = quality.encode(texts, quality._Codes())
    at = np.cumsum(n) - n
    g = np.random.default_rng(3)
    p = {"W": g.normal(0, 0.3, (quality.WIDTH, 5)), "b": g.normal(0, 1, 5), "V": g.normal(0, 1, (5, 3)), "U": g.normal(0, 1, (5, 3)), "w": g.normal(0, 1, 3), "c": g.normal(0, 1, 5), "d": np.array([0.2])}
    model = quality.Model(p, np.full(quality.WIDTH, 0.1), np.full(quality.WIDTH, 0.5))
    got = model.score(x, n)
    for i, t in enumerate(texts):
        want = slow_features(t)
        assert np.allclose(x[at[i] : at[i] + n[i]], want, atol=1e-5), t[:30]
        h = [np.tanh((v - 0.1) / 0.5 @ p["W"] + p["b"]) for v in want]
        e = [float(np.exp((np.tanh(v @ p["V"]) / (1 + np.exp(-v @ p["U"]))) @ p["w"])) for v in h]
        z = sum(a * v for a, v in zip(e, h)) / sum(e)
        assert got[i] == pytest.approx(float(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))), rel=1e-4)


def test_words_count_and_not_their_shapes_alone():
    """Two kinds of text of equal shapes and lengths that differ only in which words they hold."""
    r = random.Random(4)
    one, two = ["stone", "river", "table"], ["lemon", "cider", "candy"]
    texts = [" ".join(r.choice(one if k % 2 else two) for _ in range(80)).encode() for k in range(200)]
    x, n = quality.encode(texts, quality._Codes())
    y = np.array([k % 2 for k in range(200)], np.float32)
    cut = int(n[:150].sum())
    model = quality.fit(x[:cut], n[:150], y[:150])
    assert ((model.score(x[cut:], n[150:]) >= 0.5) == (y[150:] == 1)).all()


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("old")).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_query_learns_and_handles_odd_rows(spark, tmp_path):
    r = random.Random(5)
    docs = [(i, prose(r, r.randrange(20, 200)) if i % 2 else junk(r, r.randrange(20, 200))) for i in range(400)]
    odd = [(1000, None), (1001, ""), (None, "a text of a null id"), (1002, "word " * 200_000), (1003, "x" * 1_000_000), docs[0], docs[1]]
    labels = [(i, i % 2, 0) for i in range(300)] + [(0, 0, 0), (1, None, 0), (None, 1, 0), (5000, 1, 0)]
    tables(spark, tmp_path, docs + odd, labels)
    rows = quality.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + len(odd)
    by = {}
    for x in rows:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        by.setdefault(x.doc_id, []).append(x.score)
    assert len(set(by[0])) == 1 and len(by[0]) == 2  # a repeated row has the same score
    assert all((by[i][0] >= 0.5) == bool(i % 2) for i in range(300, 400))  # never labelled
    assert {x.doc_id: x.held_out for x in rows if x.doc_id == 1000} is not None
    again = {x.doc_id: x.score for x in quality.query(spark, str(tmp_path)).collect()}
    assert all(again[k] == pytest.approx(v[0]) for k, v in by.items())


def test_no_labels_and_no_documents(spark, tmp_path):
    tables(spark, tmp_path / "a", [(1, "x"), (2, None)], [])
    assert {x.score for x in quality.query(spark, str(tmp_path / "a")).collect()} == {0.5}
    tables(spark, tmp_path / "b", [], [(1, 1, 0)])
    assert quality.query(spark, str(tmp_path / "b")).count() == 0


def test_held_out_labels_are_never_read(spark):
    import zlib

    df = spark.range(200).select("id", quality.held_out(F.col("id")).alias("h"))
    assert all(x.h == (zlib.crc32(str(x.id).encode()) % 3 == 1) for x in df.collect())


def test_columns_of_clashing_names_are_kept(spark):
    docs = spark.createDataFrame([(1, "a", 7, "b")], "doc_id long, text string, `__raw0` int, label string")
    out = quality.score(docs, quality.Model(None, np.zeros(1), np.ones(1)))
    assert out.columns == [*docs.columns, "score"] and out.first()[2] == 7
