import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from solvarium.llm import packing

TEXTS = [None, "", " \t\n\x0b\x0c\r ", "Hello, World's 12 <|endoftext|>x é́  \x85 a\x1cb İSTANBUL ΣΑΣ", "it's they'll 'tis don't", "word " * 300, "日本語 text　mixed \U0001f600", "x" * 5000, "á ́b ''' <|startoftext|> <|end oftext|>"]


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


def sound(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_chunks_give_the_tokenizers_ids():
    path = packing.tokenizer_path()
    plain, own = Tokenizer.from_file(path), packing._Encoder(path)
    r = random.Random(3)
    some = [c for t in TEXTS if t for c in t] + list('abcAB,.,. ') + list("\t\n\r\x0b\x0c\x1c\x1f\x85 ﻿​'sStTdD")
    texts = [t or "" for t in TEXTS] + ["".join(r.choices(some, k=r.randint(1, 80))) for _ in range(2000)]
    texts += ["Word, word. word., WORD.. ñ, ñandú. 1, a1. <|ENDOFTEXT|> <|endoftext|>, x", "İ, i̇. ǅ ǆ. ß, ﬁ."]
    for text, ids in [*zip(texts, own(texts)), *((t, own([t])[0]) for t in texts)]:
        assert ids == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


def test_sweep_is_best_fit_decreasing():
    for seed in range(200):
        r = random.Random(seed)
        capacity = r.choice([7, 16, 100])
        lengths = [r.randint(1, capacity if seed % 2 else max(1, capacity // 3)) for _ in range(r.randint(1, 120))]
        used = Counter()
        spots = {}
        for length, rank, count, seq, offset in packing.sweep(list(Counter(lengths).items()), capacity):
            for k in range(count):
                assert (length, rank + k) not in spots
                spots[length, rank + k] = (seq + k, offset)
                used[seq + k] += length
        assert Counter(n for n, _ in spots) == Counter(lengths)
        assert max(used.values()) <= capacity
        for s in used:
            at = 0
            for offset, length in sorted((o, n) for (n, _), (q, o) in spots.items() if q == s):
                assert offset == at
                at += length
        assert len(used) == best_fit_decreasing(lengths, capacity)


def test_query_over_hard_documents(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1), (None, "no id", 1)]
    rows += [(100 + i, " ".join(r.choices(["alpha", "beta", "qxzw"], k=r.choice([3, 40, 900, 4095, 4096, 9000]))), 2) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.query(spark, str(tmp_path)).collect()
    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for doc, text, _ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want.append((doc, k // 4096, k, len(own), zlib.crc32(own.tobytes())))
    assert Counter(tuple(x)[:5] for x in got) == Counter(want)
    assert sound(got, 4096) == best_fit_decreasing([w[3] for w in want], 4096)


def test_packed_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "one two three") for i in range(50)], "doc_id long, text string")
    out = packing.pack(docs, capacity=10).collect()
    assert sound(out, 10) == 25 and all(len(r.ids) == 4 * r.length for r in out)
    assert packing.pack(docs.where(F.lit(False))).count() == 0
