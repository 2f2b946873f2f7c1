"""The history of checks as a stream: package records arrive, and only what they touch is checked again.

A record is (repo, uid, at, gone, name, ver, deps, confs, provs), the last three as arrays of structs. `at` orders the
records of a package; gone: the package leaves. A micro-batch b writes, each under batch=b, so that a batch that is
repeated after a failure overwrites its own rows only:
- records: the ones it applied. The newest of a (repo, uid) stands for it; a package that left keeps its last record, so
  that a record that comes late doesn't bring it back.
- status: (repo, uid, status) of the packages that it checked again; null for those that left.
- counts: (repo, status, n) of every repository that it touched.
- refused: records that change nothing: repo, uid or at null, or not newer than what the package has. Of two with equal
  `at` the first to come stays; within a batch, one that leaves goes before others, then the greatest name and version.

A package's status hangs on its cone, so those that reach a changed package, by the clauses and names of before or after,
are checked again, on the cones of their own. Every `every` batches, records and status are written whole, and a batch
reads back no further than that. Repositories of up to bits.SMALL rows of records go through one shuffle, many at once in
a task (touched); larger ones by joins, with the same results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from solvarium.operators import atoms, bits, model, sat
from solvarium.operators.graphs import cone, dependency_edges
from solvarium.operators.model import Universe, resolve_conflicts, resolve_deps
from solvarium.plans.lineage import cut
from solvarium.streaming import touched


def record_schema(repo: str = "bigint") -> str:
    """The columns of a record, for repositories of that type."""
    return (
        f"repo {repo}, uid int, at bigint, gone boolean, name string, ver int, deps array<struct<clause: int, alt: int, name: string, op: string, ver: int>>,"
        " confs array<struct<name: string, op: string, ver: int>>, provs array<struct<name: string, ver: int>>"
    )


def records(u: Universe, at, gone) -> DataFrame:
    """A universe as one record a package; `at` and `gone` are columns of its packages."""
    rows = model.records(u).join(u.packages.select("repo", "uid", at.cast("bigint").alias("at"), gone.alias("gone")), ["repo", "uid"])
    return rows.select("repo", "uid", "at", "gone", "name", F.col("ver").cast("int").alias("ver"), "deps", "confs", "provs")


def universe(rows: DataFrame) -> Universe:
    """The tables of the records' packages; null arrays are empty."""
    of = lambda c: rows.select("repo", "uid", F.explode(c).alias("x")).select("repo", "uid", "x.*")
    return Universe(rows.select("repo", "uid", "name", "ver"), of("deps"), of("confs"), of("provs"))


def _folders(path: str, table: str, before: int, every: int) -> list[str]:
    """Folders that hold the state before a batch: the last whole one and what came after it."""
    last = before - 1
    return [f"{path}/{table}/batch={b}" for b in range(last - last % every, last + 1)] if before else []


def _rows(spark: SparkSession, path: str, table: str, schema: str, before: int, every: int, repos: DataFrame | None = None) -> DataFrame:
    """The state's rows before that batch, each with its batch, of some repositories or all."""
    folders = _folders(path, table, before, every)
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch int")
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", f"{path}/{table}").parquet(*folders)
    return rows if repos is None else rows.join(repos, "repo", "left_semi")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest row of each (repo, uid)."""
    fields = [c for c in rows.columns if c not in ("repo", "uid", "batch")]
    newest = rows.groupBy("repo", "uid").agg(F.max_by(F.struct(*fields), "batch").alias("x"))
    return newest.select("repo", "uid", "x.*")


def apply(batch: DataFrame, b: int, path: str, every: int = 16) -> None:
    """What one micro-batch writes; see the module."""
    spark, kind = batch.sparkSession, batch.schema["repo"].dataType.simpleString()
    schema, marks = record_schema(kind), f"repo {kind}, uid int, status string"
    columns = ["repo", "uid", "at", "gone", "name", "ver", "deps", "confs", "provs"]
    came = cut(batch.select(*columns).withColumn("gone", F.coalesce("gone", F.lit(False))))
    fine = F.col("repo").isNotNull() & F.col("uid").isNotNull() & F.col("at").isNotNull()
    good, bad = came.where(fine), came.where(~fine)
    whole = b % every == 0  # then all that stands is written, not only what changes
    repos = None if whole else good.select("repo").distinct()
    stood = [_rows(spark, path, table, k, b, every, repos) for table, k in (("records", schema), ("status", marks))]

    crowd = atoms.crowded(good.unionByName(stood[0].drop("batch")))
    small, large = bits.split(crowd, good, *stood)
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    kinds = {f.name: f.dataType for f in came.schema} | {"status": "string", "batch": "int"}
    rows = lambda df, k: df.select(F.lit(k).alias("kind"), *[F.col(c) if c in df.columns else none(c, t) for c, t in kinds.items()])
    stream = rows(small[1], touched.STATE).unionByName(rows(small[2], touched.MARK)).unionByName(rows(small[0], touched.CAME))
    stream = stream.repartition("repo").sortWithinPartitions("repo", "kind", "uid", "batch", "at", "gone", "name", "ver")
    out = cut(stream.mapInArrow(touched.followed(whole, sat.BUDGET), f"part string, {schema}, status string, n bigint"))
    fields = {"records": columns, "refused": columns, "checked": ["repo", "uid", "status"], "status": ["repo", "uid", "status"], "counts": ["repo", "status", "n"]}
    parts = {part: out.where(F.col("part") == part).select(*cols) for part, cols in fields.items()}
    parts["refused"] = parts["refused"].unionByName(bad)
    if large:
        for part, df in _joined(*large, whole).items():
            parts[part] = parts[part].unionByName(df.select(*fields[part]))
    for part, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{part}/batch={b}")


def _joined(came: DataFrame, records: DataFrame, status: DataFrame, whole: bool) -> dict[str, DataFrame]:
    """What apply() writes, by joins, of repositories that no task should hold."""
    came = cut(came.withColumn("ticket", F.expr("uuid()")))
    old, known = cut(_newest(records)), _newest(status)
    top = came.groupBy("repo", "uid").agg(F.max(F.struct("at", "gone", "name", "ver", "ticket")).alias("top"))
    top = top.select("repo", "uid", "top.at", "top.ticket").join(old.select("repo", "uid", F.col("at").alias("has")), ["repo", "uid"], "left")
    taken = cut(top.where("has IS NULL OR at > has").select("ticket"))
    new = cut(came.join(taken, "ticket", "left_semi").drop("ticket"))

    changed = new.select("repo", "uid")
    stays = old.join(changed, ["repo", "uid"], "left_anti")
    here = changed.select("repo").distinct()
    now = cut(stays.unionByName(new).where("NOT gone").join(here, "repo", "left_semi"))
    both = universe(now.unionByName(old.where("NOT gone").join(changed, ["repo", "uid"], "left_semi")))
    edges = cut(dependency_edges(resolve_deps(both)).select("repo", "src", "dst").distinct())
    back = edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))
    again = cut(cone(changed, back, keys=()).select("repo", "uid").join(now, ["repo", "uid"], "left_semi"))
    inside = cut(cone(again, edges, keys=()).select("repo", "uid").join(now, ["repo", "uid"], "left_semi"))

    u = universe(now)
    deps = cut(resolve_deps(Universe(u.packages, u.deps.join(inside, ["repo", "uid"], "left_semi"), u.confs, u.provs)))
    lo, hi = (inside.withColumnRenamed("uid", c) for c in ("lo", "hi"))
    fights = cut(resolve_conflicts(u).join(lo, ["repo", "lo"], "left_semi").join(hi, ["repo", "hi"], "left_semi"))
    left = new.where("gone").select("repo", "uid", F.lit(None).cast("string").alias("status"))
    said = cut(sat.check(again, deps, fights).select("repo", "uid", "status").unionByName(left))
    known = known.join(said, ["repo", "uid"], "left_anti").unionByName(said)
    live = known.where("status IS NOT NULL").join(here, "repo", "left_semi")
    return {
        "records": stays.unionByName(new) if whole else new,
        "refused": came.join(taken, "ticket", "left_anti").drop("ticket"),
        "checked": said,
        "status": known if whole else said,
        "counts": live.groupBy("repo", "status").agg(F.count("*").alias("n")),
    }


def keep(stream: DataFrame, path: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Follows a stream of records until nothing more is there; started again with the same folders it goes on. Without
    files that came since, nothing is written."""
    if every < 1:
        raise ValueError("every must be 1 or more")
    run = lambda batch, b: apply(batch, b, path, every)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, path: str, repo: str = "bigint") -> DataFrame:
    """(batch, repo, status, n): counts of each repository after each batch that touched it. A repository that has lost
    its last package has no row of that batch."""
    return spark.read.schema(f"repo {repo}, status string, n bigint, batch int").parquet(f"{path}/counts")


def checked(spark: SparkSession, path: str, repo: str = "bigint") -> DataFrame:
    """(batch, repo, uid, status) of what each batch checked again; status null: the package left."""
    return spark.read.schema(f"repo {repo}, uid int, status string, batch int").parquet(f"{path}/checked")


def standing(spark: SparkSession, path: str, repo: str = "bigint") -> DataFrame:
    """(repo, uid, status) of all packages that are there after the last batch."""
    rows = checked(spark, path, repo)
    return rows.groupBy("repo", "uid").agg(F.max_by("status", "batch").alias("status")).where("status IS NOT NULL")
