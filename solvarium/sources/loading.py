"""Package lists by `scheme://path`, merged into one typed table; a file's first bytes say how it is compressed.

Files whose name and first bytes agree go through Spark's text reader, which splits plain and bzip2 files over tasks. The
others (compressed without the ending, or an ending that is untrue) are read whole by the binary reader, one row a file,
and unpacked in the task a megabyte at a time; such a file can have up to 2 GB. Spark lists and opens all paths, so they
may be in any store it knows (`deb://viewfs://cluster/lists/*`).

Defined cases: empty files are skipped, also where all are empty; xz files and unknown schemes are errors; so are paths
that match nothing, and URIs of several schemes in one call. Of records with one key one stays, in whatever files.
"""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvarium.sources import stanzas

#: How each scheme's files are apart (None: a file is one text), how records become a table, and their key.
SCHEMES = {
    "deb": ("\n\n", stanzas.debian_packages, ("name", "version", "arch")),
    "debsrc": ("\n\n", stanzas.debian_sources, ("name", "version")),
    "edsp": ("\n\n", lambda s: stanzas.scenario(s)[1], ("name", "version", "arch")),
    "pef": ("\n\n", stanzas.pef_packages, ("name", "version")),
    "eclipse": ("\n\n", stanzas.pef_packages, ("name", "version")),
    "opam": ("\n\n", stanzas.opam_packages, ("name", "version", "switch")),
    "npm": ("\n\n", stanzas.read_npm, ("name", "version")),
    "cudf": ("\n\n", stanzas.universe_document, ("name", "ver")),
    "csw": ("\n", stanzas.catalog, ("name", "version")),
    "synthesis": (None, stanzas.synthesis, ("name", "version", "release", "arch")),
}
# The first bytes of compressed files.
MAGIC = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ"}
_CODECS = {"GzipCodec": "gzip", "BZip2Codec": "bzip2"}
_CHUNK = 1 << 20


def scheme_of(uri: str) -> tuple[str, str]:
    """(scheme, path) of `scheme://path`; the path may have a scheme of its own."""
    scheme, found, path = uri.partition("://")
    if not found or scheme not in SCHEMES:
        raise ValueError(f"unknown format: {uri!r}")
    return scheme, path


def guess_format(uris: list[str]) -> str:
    """The format of a list is its first URI's."""
    if not uris:
        raise ValueError("no input to guess a format from")
    return scheme_of(uris[0])[0]


def _files(spark: SparkSession, path: str) -> Iterator[tuple[str, str, str]]:
    """(file, codec by its first bytes, codec by its name) of the non-empty files that a path, pattern or folder names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs, codecs = top.getFileSystem(conf), jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    todo = list(fs.globStatus(top) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        status = todo.pop()
        at = status.getPath()
        if status.isDirectory():
            todo += [s for s in fs.listStatus(at) if s.getPath().getName()[0] not in "._"]
        elif status.getLen():
            stream = fs.open(at)
            try:
                first = bytes(b for b in (stream.read() for _ in range(max(map(len, MAGIC.values())))) if b >= 0)
            finally:
                stream.close()
            codec = codecs.getCodec(at)
            named = "plain" if codec is None else _CODECS.get(codec.getClass().getSimpleName(), "other")
            yield at.toString(), next((k for k, m in MAGIC.items() if first.startswith(m)), "plain"), named


def _unpack(sep: str | None):
    """Of binary files: their records, read through whatever their first bytes ask for."""

    def records(stream) -> Iterator[str]:
        if sep is None:
            yield stream.read().decode("utf-8", "replace")
            return
        end, rest = sep.encode(), b""
        while chunk := stream.read(_CHUNK):
            *done, rest = (rest + chunk).split(end)
            yield from (r.decode("utf-8", "replace") for r in done)
        if rest:
            yield rest.decode("utf-8", "replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                raw = io.BytesIO(content)
                opened = gzip.GzipFile(fileobj=raw) if content.startswith(MAGIC["gzip"]) else bz2.BZ2File(raw) if content.startswith(MAGIC["bzip2"]) else raw
                out, size = [], 0
                for r in records(opened):
                    out.append(r)
                    size += len(r)
                    if size > _CHUNK:
                        yield pd.DataFrame({"value": out})
                        out, size = [], 0
                yield pd.DataFrame({"value": out}, dtype=object)

    return run


def read_texts(spark: SparkSession, paths: list[str], sep: str | None) -> DataFrame:
    """(value) of all records of the files that `paths` name."""
    files = [f for p in dict.fromkeys(paths) for f in _files(spark, p)]
    if bad := [f for f, codec, _ in files if codec == "xz"]:
        raise ValueError(f"xz is not supported: {bad[0]}")
    plain = sorted({f for f, codec, named in files if codec == named})
    other = sorted({f for f, codec, named in files if codec != named})
    out = spark.createDataFrame([], "value string")
    literal = lambda names: [_escaped(n) for n in names]
    if plain:
        reader = spark.read.option("wholetext", True) if sep is None else spark.read.option("lineSep", sep)
        out = out.unionByName(reader.text(literal(plain)))
    if other:
        whole = spark.read.format("binaryFile").load(literal(other)).select("content")
        out = out.unionByName(whole.mapInPandas(_unpack(sep), "value string"))
    return out


def _escaped(name: str) -> str:
    """A file's name with the signs of patterns taken literally."""
    return "".join("\\" + c if c in "{}[]*?\\" else c for c in name)


def load(spark: SparkSession, uris: list[str]) -> DataFrame:
    """The records of all URIs, which must have one scheme, as its typed table; one row a key."""
    scheme = guess_format(uris)
    sep, typed, key = SCHEMES[scheme]
    if other := [u for u in uris if scheme_of(u)[0] != scheme]:
        raise ValueError(f"cannot handle input {other[0]!r} beside {scheme}")
    rows = read_texts(spark, [scheme_of(u)[1] for u in uris], sep)
    if sep == "\n\n":
        rows = rows.select(stanzas.fields(F.col("value")).alias("fields")).where(F.size("fields") > 0)
    return typed(rows).dropDuplicates(list(key))
