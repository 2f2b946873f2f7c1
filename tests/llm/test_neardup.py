import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from solvarium.llm import graph, neardup
from solvarium.llm._shared import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return {(d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    shared = say(60)
    out = []
    for _ in range(40):
        base = say(r.choice([6, 30, 100, 300]))
        out.append(base)
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            copy = list(r.choice([base, out[-1]]))
            for _ in range(r.choice([0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = f"x{r.randrange(100)}"
            out.append(copy)
        out.append(base[:10] + shared)
    texts = [" ".join(x) for x in out]
    texts += [t.upper() for t in texts[:5]] + ["", None, " \n", "one two", "ONE  two", "one two three four five", "é ü", "É ü"]
    ids = r.sample(range(100_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in neardup.query(spark, str(tmp_path)).collect()} == brute(rows)


def test_large_group_of_copies_is_one_component(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(300)]
    for i in range(300, 600):
        copy = list(base)
        copy[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [x.doc_id for x in out.where("kept").collect()] == [0]


def test_dedup_keeps_columns_and_clean_documents(spark):
    rows = corpus(3) + [(None, "a null id of its own text"), (7_000_000, "again " * 9), (7_000_000, "again " * 9)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    out = neardup.deduplicated(docs)
    assert out.columns == docs.columns
    kept = {d for d, _, _, k in brute(corpus(3)) if k}
    assert {x.doc_id for x in out.collect()} == kept | {None, 7_000_000}


def test_rows_with_a_null_id_are_decided_each(spark):
    rows = [(1, "one two three four five six"), (None, "One two three four five six"), (None, "own words of a null id here"), (None, "own words of a null id here"), (None, None), (2, "")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, rows[2][1]), (1, rows[0][1]), (2, "")]
    named = spark.createDataFrame([(str(i) if i else None, t) for i, t in rows], "doc_id string, text string")
    assert neardup.deduplicated(named).count() == 4


@pytest.mark.parametrize("seed, templates, copies", [(1, 40, 60), (2, 4, 600)])
def test_templates_of_which_some_copies_link(spark, seed, templates, copies):
    """Texts that share a template and differ in two words at random places: around the limit, in many components."""
    r = random.Random(seed)
    rows = []
    for t in range(templates):
        base = [f"t{t}w{i}" for i in range(100)]
        for c in range(copies):
            words = list(base)
            for at in r.sample(range(100), r.choice([1, 2, 2, 3, 4])):
                words[at] = f"x{t}-{c}-{at}"
            rows.append((len(rows), " ".join(words)))
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for t in range(templates):  # texts of two templates share no shingle
        own = rows[t * copies : (t + 1) * copies]
        assert {d: got[d] for d, _ in own} == {d: c for d, _, c, _ in brute(own)}


def test_empty_table(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in neardup.near_duplicates(none).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_components_of_paths_and_stars(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    names = list(range(6000))
    r.shuffle(names)
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {x.node: x.label for x in graph.components(df, Scratch(spark, "test"), "t").collect()}
    path, star = [names[i] for i in range(301)], [names[1000 + i] for i in range(200)]
    assert got == {n: min(path) for n in path} | {n: min(star) for n in star}


def test_signatures_estimate_similarity():
    words = neardup._Words()
    a = neardup.shingles(b" ".join(b"w%d" % i for i in range(400)), words)
    b = neardup.shingles(b" ".join(b"w%d" % i for i in range(100, 500)), words)
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = (np.frombuffer(neardup.signature(s), np.uint8).reshape(neardup.TREES, neardup.KEY) for s in (a, b))
    same = np.mean([(x[t, 4 + 2 * k : 6 + 2 * k] == y[t, 4 + 2 * k : 6 + 2 * k]).all() for t in range(neardup.TREES) for k in range(neardup.DEPTH - 1)])
    assert abs(same - want) < 0.15


def test_large_group_around_the_limit(spark):
    """Many copies of one text with 3 to 8 changed words each: most pairs lie around the limit."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for k in range(900):
        words = list(base)
        for at in rng.choice(200, size=rng.integers(3, 9), replace=False):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = neardup._Words()
    sets = [neardup.shingles(t.encode(), words) for t in texts]
    h, at = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    m = np.zeros((len(sets), len(h)), np.float32)
    m[np.repeat(np.arange(len(sets)), sizes), at] = 1
    common = (m @ m.T).astype(np.int64)
    near = 100 * common >= 75 * (sizes[:, None] + sizes - common)
    label, before = np.arange(len(sets)), None
    while before is None or (label != before).any():
        before, label = label, np.where(near, label, len(sets)).min(axis=1)
    assert got == dict(enumerate(label.tolist()))
