import os

import pytest
from pyspark.sql import functions as F

from solvarium.operators import documents
from solvarium.sources import stanzas


def test_files_hold_their_stanzas_in_order_and_the_manifest_tells_damage(spark, tmp_path):
    names = ["b", "a/b", "50% + c", "ä", None]
    rows = [(names[k % 5] if k < 400 else "b", k, f"Package: p{k}\n\n  \nX: {k}\n\n") for k in range(900)] + [("b", 5000, None), ("b", 5001, " \n ")]
    df = spark.createDataFrame(rows, "repo string, k int, stanza string").repartition(7)
    path = f"{tmp_path}/out"
    manifest = documents.write_documents(df, path, ("k",), most=50)
    assert manifest.agg(F.sum("stanzas")).first()[0] == 900 and manifest.agg(F.max("stanzas")).first()[0] <= 50
    assert os.listdir(tmp_path) == ["out"]  # the temporary name is gone
    got = {}
    for folder in sorted(f for f in os.listdir(path) if f.startswith("repo=")):
        for name in sorted(n for n in os.listdir(f"{path}/{folder}") if n.endswith(".txt")):
            got.setdefault(folder, []).extend(s for s in open(f"{path}/{folder}/{name}").read().split("\n\n") if s)
    want = {}
    for repo, k, _ in rows[:900]:
        want.setdefault(repo or "none", []).append(f"Package: p{k}\nX: {k}")
    assert sorted(got.values()) == sorted(want.values())
    back = documents.read_documents(spark, path).groupBy("repo").count().collect()
    assert {r.repo: r["count"] for r in back} == {k: len(v) for k, v in want.items()}
    assert documents.damaged(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        documents.write_documents(df, path, ("k",))
    files = [os.path.join(d, n) for d, _, all_ in os.walk(f"{path}/repo=b") for n in sorted(all_) if n.endswith(".txt")]
    os.remove(files[0])
    for f in (files[1], f"{path}/repo=b/more.txt"):
        with open(f, "a") as out:
            out.write("Package: new\n\n")
    crc = os.path.join(os.path.dirname(files[1]), f".{os.path.basename(files[1])}.crc")
    os.remove(crc)  # the local file system would refuse the changed file by itself
    assert sorted(r.why for r in documents.damaged(spark, path).collect()) == ["changed", "missing", "not listed"]
    assert documents.read_documents(spark, path).where("file LIKE '%more.txt'").count() == 0


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "repo int, k int, stanza string")
    assert documents.write_documents(empty, f"{tmp_path}/out", ("k",)).count() == 0
    assert documents.read_documents(spark, f"{tmp_path}/out").count() == 0 == documents.damaged(spark, f"{tmp_path}/out").count()


def test_control_stanzas_read_again_are_the_same_records(spark):
    texts = [
        "Package: a\nVersion: 1:2-3\nArchitecture: all\nDepends: b (<< 2) | c:any (>= 1), d (= 0)\nBreaks: e (>> 1)\nProvides: v (= 1), w",
        "Package: b\nVersion: 1\nArchitecture: amd64\nMulti-Arch: same\nEssential: yes\nSource: s (2)\nStatus: install ok installed",
        "Package: c\nVersion: 1\nSource: s",
        "Package: d\nVersion: 1\nArchitecture: i386\nPre-Depends: a\nRecommends: b, c\nSuggests: x\nEnhances: y\nReplaces: z (<= 4)\nConflicts: a (< 1)",
    ]
    read = lambda df: stanzas.debian_packages(df.select(stanzas.fields(F.col("stanza")).alias("fields")))
    typed = read(spark.createDataFrame([(t,) for t in texts], "stanza string"))
    printed = documents.control_stanzas(typed)
    assert sorted(map(str, read(printed).collect())) == sorted(map(str, typed.collect()))
    assert any("Depends: b (<< 2) | c:any (>= 1), d (= 0)" in r.stanza for r in printed.collect())
