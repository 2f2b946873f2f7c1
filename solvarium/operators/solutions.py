"""All solutions of requests: every closed, peaceful set within a request's cone that meets it, a row each.

A branch is a request with more packages that must be in or out. It has a solution or it is dead; what else it holds is
split by that solution: the k-th part agrees with it on the packages before the k-th of the cone and differs on that one.
Parts never overlap, so no solution comes twice and none has to be remembered to keep it out. A task follows a branch for
so many searches, and what it leaves open is written and dealt out anew in the next round: the solutions of one request
are no single row, task or round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvarium.operators import bits, sat, tables
from solvarium.plans.lineage import cut, new_path


def split(need: list[int], forbid: list[int], model: set[int], cone: list[int]) -> list[tuple[list[int], list[int]]]:
    """The branches of a branch's other solutions."""
    out, inside, outside = [], list(need), list(forbid)
    fixed = {*need, *forbid}
    for p in cone:
        if p in fixed:
            continue
        if p in model:
            out.append((list(inside), [*outside, p]))
            inside.append(p)
        else:
            out.append(([*inside, p], list(outside)))
            outside.append(p)
    return out


def follow(need: list[int], forbid: list[int], clauses: dict, conflicts: dict, searches: int, budget=sat.BUDGET):
    """What some searches find in a branch: solutions, branches left open, and branches that the budget doesn't tell."""
    cone = sorted({*need, *forbid, *clauses}.union(q for own in clauses.values() for c in own for q in c))
    found, unknown, open_ = [], [], [(need, forbid)]
    while open_ and searches > 0:
        branch, searches = open_.pop(), searches - 1
        model = sat.search(*branch, clauses, conflicts, budget)
        if isinstance(model, set):
            found.append(sorted(model))
            open_.extend(split(*branch, model, cone))
        elif model is not None:
            unknown.append(branch)
    return found, open_, unknown


def _written(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _listed(x, sets):
    """The task that lists the solutions of requests whose repositories a truth table covers."""
    at = np.flatnonzero(sets.narrow[x.run])
    run = x.run[at]
    held = sets.valid[run] & tables.ALL[tables.low(x.need[at])] & ~tables.SOME[tables.low(x.bar[at])]
    row, found = tables.listed(held & ~tables.SOME[255 & ~tables.low(x.inside[at])])
    lists = bits.listed(*tables.members(x, run[row], found), np.ones(len(row), bool))
    return run[row], x.column("req", at[row]), lists


def all_solutions(requests: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame | None = None, searches: int = 256, path: str | None = None) -> DataFrame:
    """(repo, req, status, members) for requests(repo, req, need ARRAY<INT>, forbid ARRAY<INT>), req unique in repo:
    status ok with a solution's members in order; or unknown, members null, for a branch beyond sat.BUDGET. A request
    without a solution has no row. A cone goes over packages that the Horn stage leaves, as in sat.check.

    Repositories that a truth table covers are listed at once, others in rounds. With `path`, rounds are written there,
    as in _rounds(), for all of them alike.
    """
    if searches < 1:
        raise ValueError("searches must be 1 or more")
    if path:
        return _rounds(requests, resolved, conflicts, cut(sat.horn_broken(resolved)) if broken is None else broken, searches, path)
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    requests = cut(requests.select("repo", "req", "need", "forbid"))
    found, rest = tables.told(_listed, f"repo {kinds['repo']}, req {kinds['req']}, members array<int>", resolved, conflicts, requests)
    found = found.select("repo", "req", F.lit("ok").alias("status"), "members")
    if rest is None:
        return found
    requests, resolved, conflicts = (cut(t.join(rest, "repo", "left_semi")) for t in (requests, resolved, conflicts))
    return found.unionByName(_rounds(requests, resolved, conflicts, cut(sat.horn_broken(resolved)) if broken is None else broken, searches, None))


def _rounds(requests: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame, searches: int = 256, path: str | None = None) -> DataFrame:
    """all_solutions() by searches. With `path`, rounds are written there, and a call that finds complete rounds of the
    same request table goes on after the last of them.

    Branches of one request are spread over tasks: its clauses are given out once for each 64 of them.
    """
    spark, path, limit = requests.sparkSession, path or new_path(requests.sparkSession, "solutions"), sat.BUDGET
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    found = f"repo {kinds['repo']}, req {kinds['req']}, status string, members array<int>, need array<int>, forbid array<int>"
    atoms = "clauses array<struct<uid: int, any: array<int>>>, pairs array<struct<lo: int, hi: int>>"
    if not _written(spark, f"{path}/cones"):
        asked = cut(requests.select("repo", "req", "need", "forbid"))
        dead, inside, fights, live = sat._cones(asked, resolved, conflicts, broken)
        open_ = asked.join(dead, ["repo", "req"], "left_anti")
        rows = sat._rows(open_, inside, fights, live)
        rows.select("repo", "req", "need", "forbid", F.col("clauses").cast("array<struct<uid: int, any: array<int>>>"), F.col("pairs").cast("array<struct<lo: int, hi: int>>")).write.mode("overwrite").parquet(f"{path}/cones")
    cones = spark.read.schema(f"repo {kinds['repo']}, req {kinds['req']}, need array<int>, forbid array<int>, {atoms}").parquet(f"{path}/cones")

    def run(batches):
        for batch in batches:
            for k, r in enumerate(batch.to_pylist()):
                sets, open_, unknown = follow(r["need"], r["forbid"], *sat._tables(r), searches, limit)
                rest = [(None, *b) for b in open_] + [("unknown", *b) for b in unknown]
                n, ints = len(sets) + len(rest), pa.list_(pa.int32())
                key = [batch.column(c).take(pa.array([k] * n, pa.int64())) for c in (0, 1)]
                said = pa.array(["ok"] * len(sets) + [s for s, _, _ in rest], pa.string())
                sides = [pa.array([None] * len(sets) + [x[i] for x in rest], ints) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays([*key, said, pa.array(sets + [None] * len(rest), ints), *sides], names=["repo", "req", "status", "members", "need", "forbid"])

    open_, round_ = cones.select("repo", "req", "need", "forbid"), 0
    while not open_.isEmpty():
        out = f"{path}/round={round_}"
        if not _written(spark, out):
            share = open_.groupBy("repo", "req").agg(F.ceil(F.count("*") / 64).cast("int").alias("shares"))
            dealt = cones.select("repo", "req", "clauses", "pairs").join(share, ["repo", "req"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
            branch = open_.join(share, ["repo", "req"]).withColumn("share", F.pmod(F.xxhash64("need", "forbid"), F.col("shares")).cast("int")).drop("shares")
            work = branch.join(dealt, ["repo", "req", "share"]).select("repo", "req", "need", "forbid", "clauses", "pairs")
            work.mapInArrow(run, found).write.mode("overwrite").parquet(out)
        open_, round_ = spark.read.schema(found).parquet(out).where("status IS NULL").select("repo", "req", "need", "forbid"), round_ + 1
    if not round_:
        return spark.createDataFrame([], found).drop("need", "forbid")
    rounds = [f"{path}/round={k}" for k in range(round_)]
    return spark.read.schema(found).parquet(*rounds).where("status IS NOT NULL").select("repo", "req", "status", "members")
