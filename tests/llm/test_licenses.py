import random
import re
import time

import duckdb

from solvarium.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    """Every rule over the whole text, without the gate by words; (bases, detections)."""
    w = words(text)
    spaced = " " + "  ".join(w) + " "
    at = lambda i: spaced[:i].count(" ") // 2
    bases = sorted((i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)
    found = [(at(m.start()), at(m.end()), r.rank, r.kind, r.label) for r in licenses.rules() for m in re.finditer(r.pattern, spaced)]
    keep = []
    for a, b, rank, kind, label in found:
        others = [e for e in found if e[2] != rank and e[0] <= a and e[1] >= b]
        if not any(e[3] < kind or e[3] == kind and (e[1] - e[0] > b - a or e[2] < rank) for e in others):
            keep.append((a, b, rank, kind, label))
    return len(w), bases, sorted(keep)


def sample(pattern, r):
    """A text that the expression matches: groups, optional parts, alternatives and classes at random."""
    import re._parser as parser

    def draw(nodes):
        out = ""
        for op, arg in nodes:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                out += "".join(draw(inner) for _ in range(r.randint(low, min(high, low + 2))))
            elif name == "SUBPATTERN":
                out += draw(arg[3])
            elif name == "BRANCH":
                out += draw(r.choice(arg[1]))
            elif name == "IN":
                kind, what = r.choice(arg)
                out += chr(what) if str(kind) == "LITERAL" else chr(r.randint(*what))
            else:
                raise AssertionError(name)
        return out

    return draw(parser.parse(pattern))


TEXTS = [
    None,
    "",
    " \x00\t--- ",
    "plain words, and no more",
    "The MIT License (MIT). Apache License; apache LICENSE, mit  licenseé émit license",
    "Licensed under the Apache License, Version 2.0. See http://www.apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later\nThis is under the GNU General Public License, version 2 or any later version.",
    "GNU Lesser General Public License v2.1, GNU General Public License version 3; the general public license",
    "Released under the terms of the BSD 3-Clause License. All rights reserved. CC BY-NC-SA 4.0",
    "mit license " * 300 + "general public license",
    "general public general public license license 中文 MIT Licence",
]


def test_equals_brute_force(spark):
    r = random.Random(4)
    made = [" ".join(sample(rule.pattern, r) for rule in r.sample(licenses.rules(), 4)) for _ in range(150)]
    texts = TEXTS + made
    df = spark.createDataFrame([(i, t, "own", 5) for i, t in enumerate(texts)], "doc_id long, text string, label string, detections int")
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n, bases, found = brute(text)
        assert got[i].n_words == n and got[i].label == "own"
        assert [tuple(b) for b in got[i].bases] == bases, text
        assert [tuple(d) for d in got[i].detections] == sorted(found, key=lambda d: (d[0], -d[1], d[2])), text


def test_the_gate_by_words_loses_no_match():
    r = random.Random(9)
    rules = licenses.rules()
    assert len(rules) > 300 and len({x.rank for x in rules}) == len(rules)
    for rule in rules:
        for _ in range(20):
            assert set(rule.need) <= set(sample(rule.pattern, r).split()), rule


def test_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[5]), (4, TEXTS[4])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(licenses.oracle())
    assert got.columns == want.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    said = {x.doc_id: x for x in got.collect()}
    assert (said[4].n_base, said[4].first_word, said[4].last_word, said[4].base_labels) == (3, 1, 6, "apache,mit")
    assert said[6].score == 1.0 and "gpl-2.0-or-later" in said[6].labels.split(",") and "gpl" in said[6].base_labels


def test_many_detections_in_one_text_take_time_in_proportion(spark):
    text = "Licensed under the Apache License, Version 2.0. MIT License. GNU GPL v3. " * 4000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licenses.scan(df.limit(0)).collect()
    began = time.time()
    row = licenses.scan(df).first()
    assert len(row.bases) == 8000 and len(row.detections) == 12000
    assert time.time() - began < 30


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert licenses.scan(df).columns == ["doc_id", "text", "n_words", "bases", "detections"]
    assert licenses.scan(df).count() == 0
