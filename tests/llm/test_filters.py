import itertools
import random
import re

import duckdb
from pyspark.sql import functions as F

from solvarium.llm import filters


def mask(row, rows):
    text = row["text"] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    same = [r["doc_id"] for r in rows if (r["text"] or "") == text and r["doc_id"] is not None]
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search("[#$%&*|]", text)),
        row["doc_id"] is not None and any(d < row["doc_id"] for d in same),
    )
    return {f for f, bad in zip("ABCDE", fails) if bad}


def brute(rows, labels):
    good = {x["doc_id"] for x in labels if x["quality"] == 1 and x["doc_id"] is not None}
    toxic = {x["doc_id"] for x in labels if x["toxic"] == 1 and x["doc_id"] is not None}
    out, parts = [], {}
    for r in rows:
        parts.setdefault(r["lang"] or "", []).append((mask(r, rows), r["doc_id"] in good, r["doc_id"] in toxic))
    for part, docs in parts.items():
        shapley, steps = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                shapley[f] += len(gone)
                failing = sum(f in d[0] for d in docs)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), failing - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def tables(spark, tmp_path):
    r = random.Random(2)
    texts = [None, "", " ", "a # b", "Shouting TEXT HERE", "copy of a text", " ".join(f"w{i}" for i in range(120)), "the " * 130, " ".join("ab" * 3 for _ in range(120)), " ".join(f"W{i}$" for i in range(150)), "x\x0by " * 60]
    rows = [{"doc_id": r.choice([None, *range(60)]), "text": r.choice(texts), "lang": r.choice(["en", "de", None, ""]), "part": "clash"} for _ in range(300)]
    labels = [{"doc_id": r.choice([None, *range(60)]), "quality": r.choice([0, 1, None]), "toxic": r.choice([0, 1, None])} for _ in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, part string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, labels


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows, labels = tables(spark, tmp_path)
    got = filters.query(spark, str(tmp_path))
    said = sorted(map(tuple, got.collect()))
    assert said == brute(rows, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(filters.ORACLE)
    assert want.columns == got.columns and sorted(want.fetchall()) == said


def test_each_order_once_by_single_swaps():
    seen = list(filters.transpositions(5))
    assert len({o for o, _ in seen}) == len(seen) == 120
    for (a, _), (b, at) in itertools.pairwise(seen):
        assert a[at] == b[at + 1] and a[at + 1] == b[at] and a[:at] == b[:at] and a[at + 2 :] == b[at + 2 :]


def test_shapley_sums_to_what_any_order_removes():
    r = random.Random(1)
    counts = {m: (n := r.randint(0, 50), n // 2, n // 3) for m in range(32)}
    said = filters.audit(counts)
    gone = sum(c[0] for m, c in counts.items() if m)
    assert sum({row[0][row[1] - 1]: row[8] for row in said}.values()) == 120 * gone
    assert all(row[2] == counts[0][0] for row in said if row[1] == 5)


def test_one_text_of_many_rows_is_counted_not_collected(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(c.part, c.mask): c.n for c in filters.cells(docs, labels).collect()}
    assert got == {("en", 1): 1, ("en", 17): 2499, ("", 17): 2500}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.interactions(filters.cells(docs, labels)).count() == 0
