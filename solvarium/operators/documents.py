"""Documents of stanzas, a folder a repository: printed by expressions, written in order under a name of their own with a
manifest, and read back against it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvarium.functions.names import print_formula
from solvarium.plans.lineage import cut
from solvarium.sources.stanzas import FORMULAS

MANIFEST = "_manifest"  # the readers of files leave out names that start with an underscore
_GAP = "\n\n"


def control_stanzas(packages: DataFrame, *keep: str) -> DataFrame:
    """(*keep, stanza) of records as stanzas.debian_packages() gives them; read again they give the same records, but for
    extra fields. Fields that are null or say nothing are left out; `<` and `>` are printed as strict, `<<` and `>>`."""
    strict = lambda op: F.when(op == "<", "<<").when(op == ">", ">>").otherwise(op)
    formula = lambda c: print_formula(F.transform(c, lambda any_: F.transform(any_, lambda a: a.withField("op", strict(a["op"])))))
    source = F.when(F.col("source_version") != F.col("version"), F.concat("source", F.lit(" ("), "source_version", F.lit(")"))).when(F.col("source") != F.col("name"), F.col("source"))
    values = {
        "Package": F.col("name"),
        "Version": F.col("version"),
        "Architecture": F.col("arch"),
        "Multi-Arch": F.when(F.col("multiarch") != "no", F.col("multiarch")),
        "Essential": F.when(F.col("essential"), "yes"),
        "Source": source,
        "Status": F.when(F.col("installed"), "install ok installed"),
    } | {k: F.nullif(formula(F.col(k.lower().replace("-", "_"))), F.lit("")) for k in FORMULAS}
    lines = [F.concat(F.lit(f"{k}: "), F.regexp_replace(v, "\n", "\n ")) for k, v in values.items()]
    return packages.select(*keep, F.concat_ws("\n", *lines).alias("stanza"))


def _plain(c):
    """Text without its %xx; a plus sign stays one."""
    return F.url_decode(F.regexp_replace(c, r"\+", "%2B"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, folder, text) of each stanza that stands under `path`."""
    rows = spark.read.option("lineSep", _GAP).option("recursiveFileLookup", "true").text(path)
    at = _plain(F.col("_metadata.file_path"))  # paths come as URIs, and folders of partitions have escapes of their own
    return rows.select(F.regexp_extract(at, "([^/]+/[^/]+)$", 1).alias("file"), F.regexp_extract(at, "([^/]+)/[^/]+$", 1).alias("folder"), F.col("value").alias("text"), F.col("_metadata.file_size").alias("bytes"))


def _entries(rows: DataFrame) -> DataFrame:
    """(file, stanzas, bytes, digest); the digest is the sum of the stanzas' hashes."""
    return rows.groupBy("file").agg(F.count("*").alias("stanzas"), F.max("bytes").alias("bytes"), F.sum(F.xxhash64("text").cast("decimal(38,0)")).alias("digest"))


def write_documents(stanzas: DataFrame, path: str, order: tuple[str, ...], most: int = 1_000_000) -> DataFrame:
    """Writes stanzas(repo, stanza, *order) under `path`, which must not be there yet; the manifest: (file, stanzas, bytes,
    digest).

    Repositories have folders repo=..., repo=none for null. A folder's files, in the order of their names, hold its
    stanzas in `order`, at most `most` a file; a large repository is shared among tasks. Everything is written under a
    temporary name beside `path`, read again for the manifest, and renamed once that is written, so that `path` is whole
    or not there. Stanzas that are null or blank are left out; an empty line inside one would cut it, so those are made
    one line end.
    """
    spark, temp = stanzas.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}.tmp"
    jvm, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    fs = jvm(path).getFileSystem(conf)
    if fs.exists(jvm(path)):
        raise FileExistsError(path)
    text = F.regexp_replace(F.regexp_replace("stanza", r"\n([ \t]*\n)+", "\n"), r"^([ \t]*\n)+|\s+$", "")
    # A partition column that can be null would be sorted once more by the writer, which the order wouldn't survive.
    folder = F.coalesce(F.col("repo").cast("string"), F.lit("none"))
    rows = cut(stanzas.select(folder.alias("repo"), text.alias("text"), F.struct(*order).alias("order")).where(F.col("text").rlike(r"\S")))
    rows = rows.withColumn("repo", F.coalesce("repo", F.lit("none"))).repartitionByRange("repo", "order").sortWithinPartitions("repo", "order", "text")
    rows.select("repo", "text").write.option("lineSep", _GAP).option("maxRecordsPerFile", most).partitionBy("repo").text(temp)
    _entries(_files(spark, temp)).write.parquet(f"{temp}/{MANIFEST}")
    if not fs.rename(jvm(temp), jvm(path)):
        raise OSError(f"could not rename {temp} to {path}")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, stanzas bigint, bytes bigint, digest decimal(38,0)").parquet(f"{path}/{MANIFEST}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(repo as text, file, stanza) of the files that the manifest names."""
    listed = read_manifest(spark, path).select("file")
    return _files(spark, path).join(listed, "file", "left_semi").select(_plain(F.regexp_replace("folder", "^repo=", "")).alias("repo"), "file", F.col("text").alias("stanza"))


def damaged(spark: SparkSession, path: str) -> DataFrame:
    """(file, why): files that are missing, changed, or not in the manifest."""
    is_ = _entries(_files(spark, path)).select("file", F.struct("stanzas", "bytes", "digest").alias("is"))
    both = read_manifest(spark, path).select("file", F.struct("stanzas", "bytes", "digest").alias("was")).join(is_, "file", "full")
    why = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "not listed").when(F.col("is") != F.col("was"), "changed")
    return both.select("file", why.alias("why")).where("why IS NOT NULL")
