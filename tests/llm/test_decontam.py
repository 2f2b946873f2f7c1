import hashlib
import random
import re

from pyspark.sql import functions as F

from solvarium.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(text, items, window=10):
    said, hit, which = brute_words(text), set(), set()
    for item, t in items:
        w = brute_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            for i in range(len(said) - k + 1):
                if said[i : i + k] == w[j : j + k]:
                    hit |= set(range(i, i + k))
                    which.add(str(item))
    return said, hit, sorted(which)




def test_automaton_equals_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        vocab = [f"w{i}" for i in range(r.choice([2, 3, 8, 40]))]
        items = [(i, " ".join(r.choices(vocab, k=r.choice([0, 1, 3, 9, 10, 11, 14, 25])))) for i in range(8)]
        items += [(3, items[3][1]), (98, items[5][1])]
        own = decontam.Automaton([(i, decontam.words(t)) for i, t in items], 10)
        for _ in range(5):
            text = " ".join([*r.choices(vocab, k=30), r.choice(items)[1].title(), *r.choices(vocab, k=12)])
            said, hit, which = brute(text, items)
            spans, found = own.hits(decontam.words(text))
            assert {p for a, b in spans for p in range(a, b)} == hit
            assert sorted({str(x) for x in found}) == which
            assert [w.decode() for w in decontam.words(text)] == said


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short-item HERE"), (3, None), (4, "..."), (10, "ünï çode naïve")]
DOCS = [
    (0, None),
    (1, ""),
    (2, "clean words only"),
    (3, "x, ONE two three four five: six seven eight nine ten! y"),
    (4, "a short item here b ünï, ÇODE ünï çode naïve"),
    (4, "a short item here b ünï, ÇODE ünï çode naïve"),
    (5, "one two three four five six seven eight nine"),
    (6, "pad " * 40000 + "two three four five six seven eight nine ten eleven"),
]


def test_blocks_give_the_same_as_one(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("items", F.lit(7))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("spans", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, decontam.query(spark, str(tmp_path)).collect()))
    want = []
    for doc, text in DOCS:
        said, hit, which = brute(text, ITEMS)
        want.append((doc, len(said), len(hit), len(which), hashlib.sha256(",".join(which).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want)
    one = decontam.find_contamination(docs, bench).select("doc_id", "spans", F.array_sort("items")).collect()
    many = decontam.find_contamination(docs, bench, block_words=3).select("doc_id", "spans", F.array_sort("items")).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_removal(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in DOCS], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = decontam.remove(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 5]
    cut = {r.doc_id: r.text for r in decontam.remove(docs, bench, max_coverage=0.9).collect()}
    assert cut[3] == "x, ! y" and cut[2] == "clean words only" and cut[0] is None and cut[6] == "pad " * 40000
    assert cut[4] == "a  b ünï, ÇODE "


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove(docs, bench).count() == len(DOCS)
    assert decontam.find_contamination(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_items_longer_than_a_block_and_many_blocks(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([3, 12, 90, 400])))) for i in range(12)]
    docs = []
    for i in range(60):
        w = r.choice(items)[1].split()
        at = r.randrange(len(w))
        docs.append((i, " ".join(r.choices(vocab, k=20) + w[at : at + r.choice([9, 10, 30, 200])] + r.choices(vocab, k=5))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (25, 40, 100_000):
        got = {x.doc_id: x for x in decontam.find_contamination(df, bench, block_words=block).collect()}
        for i, text in docs:
            said, hit, which = brute(text, items)
            assert {p for x in got[i].spans for p in range(x.start, x.end)} == hit
            assert (got[i].words, sorted(got[i]["items"])) == (len(said), which)
