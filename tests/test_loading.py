import bz2
import gzip

import duckdb
import pytest

from solvarium.plans import formats
from solvarium.sources import loading


def stanza(name, more=""):
    return f"Package: {name}\nVersion: 1\nArchitecture: all\n{more}"


def test_codecs_are_told_by_first_bytes(spark, tmp_path):
    long = "\n".join(stanza(f"n{i}", f"Depends: {'x' * 300}\n") for i in range(9000))  # several chunks
    files = {"plain": stanza("a").encode(), "untrue.gz": stanza("b").encode(), "untrue.bz2": gzip.compress(stanza("c").encode()), "none": bz2.compress(stanza("d").encode()),
             "true.gz": gzip.compress(stanza("e").encode()), "true.bz2": bz2.compress(stanza("f").encode()), "two": gzip.compress(stanza("g").encode() + b"\n") + gzip.compress(stanza("h").encode()),
             "long": gzip.compress(long.encode()), "empty": b"", "again": stanza("a").encode(), "a[1]{b}": stanza("i").encode()}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = [r.name for r in loading.load(spark, [f"deb://{tmp_path}"]).select("name").collect()]
    assert sorted(got) == sorted([*"abcdefghi", *[f"n{i}" for i in range(9000)]])
    one = loading.load(spark, [f"deb://{tmp_path}/untrue*", f"deb://{tmp_path}/untrue.gz"])
    assert sorted(r.name for r in one.collect()) == ["b", "c"]
    assert loading.load(spark, [f"deb://file:{tmp_path}/plain"]).first().name == "a"
    assert loading.load(spark, [f"deb://{tmp_path}/empty"]).count() == 0


def test_formats(spark, tmp_path):
    (tmp_path / "cat").write_bytes(gzip.compress(b"c0 1.0 foo c3 c4 c5 a|b c7 none\nc0 1.0 foo c3 c4 c5 a|b c7 none\n"))
    assert [tuple(r) for r in loading.load(spark, [f"csw://{tmp_path}/cat"]).collect()] == [("foo", "1.0", ["a", "b"], [])]
    (tmp_path / "syn").write_bytes(bz2.compress(b"@provides@p\n@info@foo-bar-1.2-3mdv.i586@0@1@G\n@info@baz-1-1.noarch@0@1@G\n"))
    assert {r.name for r in loading.load(spark, [f"synthesis://{tmp_path}/syn"]).collect()} == {"foo-bar", "baz"}
    (tmp_path / "uni").write_text("package: a\nversion: 2\ninstalled: true\n\npackage: a\nversion: 3\n")
    assert {(r.ver, r.installed) for r in loading.load(spark, [f"cudf://{tmp_path}/uni"]).collect()} == {(2, True), (3, False)}
    assert loading.guess_format(["npm://a", "deb://b"]) == "npm"


def test_what_is_an_error(spark, tmp_path):
    (tmp_path / "x").write_bytes(loading.MAGIC["xz"] + b"\0")
    (tmp_path / "y").write_text(stanza("a"))
    for uris in ([f"deb://{tmp_path}/x"], [f"zip://{tmp_path}/y"], [f"{tmp_path}/y"], [], [f"deb://{tmp_path}/y", f"pef://{tmp_path}/y"]):
        with pytest.raises(ValueError):
            loading.load(spark, uris)
    with pytest.raises(FileNotFoundError):
        loading.load(spark, [f"deb://{tmp_path}/nothing*"])


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{sf}/part.parquet')")
    want = con.execute(formats.SQL["loaded_packages"]).fetchall()
    got = formats.QUERIES["loaded_packages"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
