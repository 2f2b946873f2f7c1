import random

import corpus_pipeline
from pyspark.sql import functions as F

from solvarium.llm import secrets

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ran", "vel", "dor", "pi", "to") for c in ("s", "ly", "den", "", "ra")]


def say(seed, n):
    return random.Random(seed).choices(WORDS, k=n)


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    good = {i: say(i + 1, 80 + i) for i in range(60)}
    bad = {100 + i: [w for w in say(i + 7, 12) for _ in range(9)] for i in range(60)}
    rows = {i: " ".join(w) for i, w in (good | bad).items()}
    rows[200], rows[201] = rows[3], rows[4].upper()
    rows[202] = " ".join(good[5][:83] + ["changed", "ending"])
    bench = " ".join(say(999, 12))
    rows[203] = " ".join(say(555, 50)) + " " + bench + " " + " ".join(say(556, 50))
    rows[204] = " ".join(say(700, 60)) + " password = Zx9Qw3Er7Ty1Ui5Op " + " ".join(say(701, 30))
    rows[205], rows[206] = None, ""
    d = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, bench), (1, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(i, int(i in good), 0) for i in good | bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        was = out
        out = stage(spark, out, d)
        if k < 4:
            assert out.columns == was.columns
        out.write.parquet(f"{d}/out{k}")
        out = spark.read.parquet(f"{d}/out{k}")
        seen.append({r.doc_id: r for r in out.collect()})
    # good documents pass, repetitive ones don't
    assert set(good) | {200, 201, 202, 203, 204} <= set(seen[0]) and not set(bad) & set(seen[0])
    assert set(seen[0]) - set(seen[1]) == {200, 201, 202}
    assert set(seen[1]) - set(seen[2]) == {203}
    assert set(seen[2]) == set(seen[3]) and "[SECRET]" in seen[3][204].text and seen[3][204].n_chars == len(seen[3][204].text)
    assert all(seen[3][i] == seen[2][i] for i in seen[3] if i != 204)
    assert set(seen[4]) == set(seen[3])
    whole = corpus_pipeline.run(spark, d)
    assert sorted(whole.select("doc_id", "piece", "length", "ids_crc32").collect()) == sorted(out.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert secrets.find_secrets(out.limit(0).select(F.lit("").alias("text"))).count() == 0


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(30)]
    texts += [None, "", texts[0], "token = abcdefghij0123456789", texts[3] + " " + texts[4]]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    plain = "doc_id long, text string, lang string, source string, n_chars long"
    benchmark = spark.createDataFrame([("b", texts[4])], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    extra = ["score", "spans", "kept", "component_id", "piece", "start", "length", "sequence_id", "offset", "ids", "at", "features"]
    said = {}
    for name, more, some in (("plain", [], rows), ("more", extra, rows), ("none", extra, [])):
        out = tmp_path / name
        df = spark.createDataFrame(some, plain)
        for k, c in enumerate(more):
            df = df.withColumn(c, F.lit(k if k % 2 else f"x{k}"))
        df.write.parquet(f"{out}/documents.parquet")
        benchmark.write.parquet(f"{out}/benchmark.parquet")
        labels.write.parquet(f"{out}/labels.parquet")
        got = corpus_pipeline.run(spark, str(out))
        said[name] = sorted(map(tuple, got.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert said["plain"] == said["more"] and said["none"] == []
    ids = {x[0] for x in said["plain"]}
    assert 4 not in ids and 34 not in ids and {30, 31, 0} <= ids and 32 not in ids
