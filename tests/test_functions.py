import random

from pyspark.sql import functions as F

from solvarium.functions import names, versions

# Versions in ascending order, by the published rule: epoch, then runs of digits as numbers, then other runs, where `~` is
# below the end, the end below letters, and letters below signs; then the revision likewise.
ASCENDING = [
    f"{epoch}{number}{tail}-{revision}" for epoch in ("", "3:", "12:") for number in ("7", "31") for tail in ("~~", "~~k", "~", "~k", "", "k", "k8", "m", "+", ".", ".0k") for revision in ("1~", "1", "2", "10")
]
EQUAL = [("0:31", "31"), ("007", "7"), ("7k00", "7k"), ("7-0", "7"), ("0003:7.010-1", "3:7.10-1")]
PATTERNS = ["any", "all", "amd64", "armhf", "linux-any", "hurd-any", "kfreebsd-any", "any-amd64", "any-arm", "any-s390x", "any-any", "linux-riscv99", "unlisted"]
RANGES = {
    "1.2.3": "= 1.2.3", " 2.2.3-4 ": "= 2.2.3-4", "v5.2.3": "= 5.2.3", "v=34.2.3": "= 34.2.3", "*": ">= 0.0.0", "== 0.5.1": "= 0.5.1", "*.*.*": ">= 0.0.0",
    "1.x": ">= 1.0.0,< 2.0.0", "x": ">= 0.0.0", "0.1": ">= 0.1.0,< 0.2.0", "0.1.": ">= 0.1.0,< 0.2.0", "0.": ">= 0.0.0,< 1.0.0", "2.X.X": ">= 2.0.0,< 3.0.0",
    "~1.2.3": ">= 1.2.3,< 1.3.0", "~1": ">= 1.0.0,< 2.0.0", "~1.2.3-beta.2": ">= 1.2.3-beta.2,< 1.3.0", "~1.1.*": ">= 1.1.0,< 1.2.0",
    "^1.2": ">= 1.2.0,< 2.0.0", "^0.0.x": ">= 0.0.0,< 0.1.0", "^0.0": ">= 0.0.0,< 0.1.0", "^*": ">= 0.0.0", "^0.0.3": ">= 0.0.3,< 0.0.4", "^0.2.3": ">= 0.2.3,< 0.3.0",
    ">= 1.2.7": ">= 1.2.7", "1.0.0 - 2.9": ">= 1.0.0,< 2.9.0",
}


def test_debian_order(spark):
    shuffled = random.Random(3).sample(list(enumerate(ASCENDING)), len(ASCENDING))
    df = spark.createDataFrame(shuffled, "place int, v string")
    assert [r.place for r in df.orderBy(versions.debian_key(F.col("v"))).collect()] == list(range(len(ASCENDING)))
    same = spark.createDataFrame(EQUAL, "a string, b string")
    assert same.where(versions.debian_key(F.col("a")) != versions.debian_key(F.col("b"))).isEmpty()


def test_debian_parts(spark):
    v = F.col("v")
    row = spark.createDataFrame([("2:1.0-a-3+b2",)], "v string").select(versions.epoch(v), versions.upstream(v), versions.revision(v), versions.binnmu(v), versions.strip_epoch_binnmu(v)).first()
    assert tuple(row) == ("2", "1.0-a", "3+b2", "b2", "1.0-a-3")


def test_semver_order(spark):
    up = ["0.9.9", "1.0.0-1", "1.0.0-2", "1.0.0-alpha", "1.0.0-b", "1.0.0-alpha.1", "1.0.0", "1.0.1", "v1.1", "2"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in random.Random(1).sample(up, len(up))], "v string").orderBy(versions.semver_key(F.col("v"))).collect()]
    assert got == up


def test_numbers(spark):
    df = spark.createDataFrame([(f"{i % 40:03d}",) for i in range(100)] + [(None,)], "k string")
    got = {r.k: r.number for r in versions.dense_numbers(df, "k", step=2).collect()}
    assert got == {f"{i:03d}": 1 + 2 * i for i in range(40)} | {None: None}


def test_names_come_back(spark):
    every = ["", "a", "|", "%", "a[b_c|d?e]f", "/bin/bash__", "".join(map(chr, range(1, 127))), "é+"]
    df = spark.createDataFrame([(s,) for s in every], "s string").withColumn("e", names.encode(F.col("s")))
    got = {r.s: (r.e, r.d) for r in df.withColumn("d", names.decode(F.col("e"))).collect()}
    assert all(got[s][1] == s for s in every)
    assert got["a[b_c|d?e]f"][0] == "a%5bb%5fc%7cd%3fe%5df" and got["/bin/bash__"][0] == "/bin/bash%5f%5f"


def test_architectures(spark):
    """Every listed architecture, and one that is not, against patterns of system and cpu."""
    known = {a: t.split("-") for a, t in names.architectures().items()} | {"unlisted": None}
    df = spark.createDataFrame([(p, r) for p in PATTERNS for r in known], "p string, r string")
    for x in names.match_architectures(df, "p", "r").collect():
        system, _, cpu = x.p.rpartition("-")
        own, want = known[x.r], x.p in ("any", "all", x.r) or known[x.r] is not None and known.get(x.p) == known[x.r]
        if own and system and "any" in (system, cpu):
            want |= system in ("any", own[2]) and cpu in ("any", own[3])
        assert x.matches == want or not own, x


def test_npm_ranges(spark):
    df = spark.createDataFrame(list(RANGES.items()), "t string, want string")
    got = df.withColumn("got", F.array_join(F.transform(names.npm_range(F.col("t")), lambda a: F.concat_ws(" ", a["op"], a["version"])), ","))
    assert [(r.t, r.want, r.got) for r in got.collect() if r.want != r.got] == []


def test_formula(spark):
    text = "a (>= 1.2) | b:any, c (<< 3), d"
    df = spark.createDataFrame([(text,), ("",)], "t string").select(names.parse_formula(F.col("t")).alias("f"))
    one, none = df.collect()
    assert [[(a.name, a.arch, a.op, a.version) for a in c] for c in one.f] == [[("a", None, ">=", "1.2"), ("b", "any", None, None)], [("c", None, "<", "3")], [("d", None, None, None)]]
    assert none.f == []
    assert df.select(names.print_formula(F.col("f"))).first()[0] == "a (>= 1.2) | b:any, c (< 3), d"


def test_last_characters_of_lists_stay(spark):
    """Digits at the end of a clause are no padding, whichever place it has."""
    df = spark.createDataFrame([("a1, b1 , c11, d0 | e1",)], "t string")
    got = df.select(F.transform(F.flatten(names.parse_formula(F.col("t"))), lambda a: a["name"]).alias("n"), names.parse_build_formula(F.col("t")).alias("b")).first()
    assert got.n == ["a1", "b1", "c11", "d0", "e1"] == [a.name for c in got.b for a in c]


def test_cnf(spark):
    df = spark.sql("SELECT array(array('a', 'b'), array('c'), array('d', 'e')) AS d")
    assert sorted(map(tuple, df.select(names.dnf_to_cnf(F.col("d"), "string")).first()[0])) == [("a", "c", "d"), ("a", "c", "e"), ("b", "c", "d"), ("b", "c", "e")]


def test_rpm_and_parts(spark):
    up = ["1.0", "1.0.1", "1.0.a", "1.1", "1.10", "1:0.1"]
    df = spark.createDataFrame([(v,) for v in up], "v string")
    got = [r.v for r in df.orderBy(versions.rpm_key(F.col("v"))).collect()]
    assert got == ["1.0", "1.0.a", "1.0.1", "1.1", "1.10", "1:0.1"]


def test_rpm_ranges_overlap_where_some_version_is_in_both(spark):
    ops = {"=": lambda p, v: p == v, ">=": lambda p, v: p >= v, ">": lambda p, v: p > v, "<=": lambda p, v: p <= v, "<": lambda p, v: p < v}
    rows = [(a, str(v), b, str(w), any(ops[a](p / 2, v) and ops[b](p / 2, w) for p in range(10))) for a in ops for b in ops for v in (1, 2, 3) for w in (1, 2, 3)]
    rows += [("=", "2", "=", "2-1", True), ("=", "2-1", ">", "2", False), ("=", "2-1", ">", "2-0", True), ("=", "1:1", "<", "2", False), ("=", "0:1", "=", "1-7", True)]
    df = spark.createDataFrame(rows, "a string, v string, b string, w string, want boolean")
    key = lambda c: versions.rpm_key(F.col(c))
    assert df.where(versions.rpm_overlaps(F.col("a"), key("v"), F.col("b"), key("w")) != F.col("want")).collect() == []
