import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvarium.llm import packing, tokens

TEXTS = [None, "", "Hello there", "a <|endoftext|> b", "word " * 3000, "x", "ünï cödé 日本", " \n"]


def test_counts_equal_the_tokenizers(spark, tmp_path):
    rows = [(i, t, 5) for i, t in enumerate(TEXTS * 5)] + [(2, "again", 1), (None, "no id", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(packing.tokenizer_path())
    plain.encode_special_tokens = True
    want = Counter((i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert Counter(tuple(r) for r in tokens.query(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("block_bytes", [2, 6, 40, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block_bytes):
    r = random.Random(block_bytes)
    want, rows = [], []
    for k in range(6):
        lengths = [r.choice([0, 0, 1, 5, 30, 200]) for _ in range(r.choice([0, 1, 12]))]
        open_ = r.choice([0, 0, 7])
        ids = [x for n in lengths for x in [r.randrange(1000) for _ in range(n)] + [9999]] + [1] * open_
        data = np.array(ids, dtype="<u2").tobytes()
        (tmp_path / f"f{k}").write_bytes(data)
        rows.append((f"f{k}", len(data)))
        want += [(f"f{k}", i, n, True) for i, n in enumerate(lengths)] + ([(f"f{k}", len(lengths), open_, False)] if open_ else [])
    got = tokens.scan(spark.createDataFrame(rows, tokens.FILES), f"file://{tmp_path}", separator=9999, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_files_roll_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    files, order = tokens.write(docs.coalesce(1), f"file://{tmp_path}/t", roll_bytes=64)
    assert files.count() == 7 and order.count() == 50
    assert tokens.scan(files, f"file://{tmp_path}/t").where("n_tokens = 3").count() == 50
    files, order = tokens.write(docs.where(F.lit(False)), f"file://{tmp_path}/u")
    assert files.count() == 0 and tokens.scan(files, f"file://{tmp_path}/u").count() == 0


def test_folders_named_the_hadoop_way_become_uris(spark, monkeypatch):
    from solvarium.llm import _shared

    for given, want in (("/a/b", "file:///a/b"), ("file:/a/b", "file:///a/b"), ("file:///a/b", "file:///a/b"), ("hdfs://n/a", "hdfs://n/a")):
        monkeypatch.setattr(_shared, "shared_dir", lambda _, given=given: given)
        assert _shared.shared_uri(spark) == want
