"""Differences between two installations: what comes and goes, and what kind of change each name sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, uid, name, ver, action): install for what only `after` has, remove for what only `before` has."""
    cols = ["repo", "uid", "name", "ver"]
    came = after.join(before.select("repo", "uid"), ["repo", "uid"], "left_anti").select(*cols, F.lit("install").alias("action"))
    went = before.join(after.select("repo", "uid"), ["repo", "uid"], "left_anti").select(*cols, F.lit("remove").alias("action"))
    return came.unionByName(went)


def classify(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, name, old, new, action) by name: install, remove, upgrade, downgrade, unchanged, or several where either
    side holds more than one version."""
    one = before.select("repo", "name", "ver", F.lit(True).alias("was")).unionByName(after.select("repo", "name", "ver", F.lit(False).alias("was")))
    g = one.groupBy("repo", "name").agg(
        F.count_if("was").alias("n_old"),
        F.count_if(~F.col("was")).alias("n_new"),
        F.max(F.when(F.col("was"), F.col("ver"))).alias("old"),
        F.max(F.when(~F.col("was"), F.col("ver"))).alias("new"),
    )
    action = (
        F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), "several")
        .when(F.col("n_old") == 0, "install")
        .when(F.col("n_new") == 0, "remove")
        .when(F.col("old") < F.col("new"), "upgrade")
        .when(F.col("old") > F.col("new"), "downgrade")
        .otherwise("unchanged")
    )
    return g.select("repo", "name", "old", "new", action.alias("action"))


def plan_edges(actions: DataFrame, edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, src, dst) between actions (repo, uid, name, action): dst must be done before src.

    Installing waits for the dependencies that are installed too, and for the removal of other versions of the name and
    of what it conflicts with; removing waits for the removal of what depends on it.
    """
    node = F.concat_ws(":", "action", "uid")
    a = actions.select("repo", "uid", "name", "action", node.alias("node"))
    new, old = a.where("action = 'install'"), a.where("action = 'remove'")
    as_ = lambda df, c: df.select("repo", F.col("uid").alias(c), F.col("node").alias(f"n_{c}"), F.col("name").alias(f"m_{c}"))
    needs = edges.join(as_(new, "src"), ["repo", "src"]).join(as_(new, "dst"), ["repo", "dst"])
    frees = edges.join(as_(old, "src"), ["repo", "src"]).join(as_(old, "dst"), ["repo", "dst"])
    both = conflicts.select("repo", F.col("lo").alias("src"), F.col("hi").alias("dst")).unionByName(conflicts.select("repo", F.col("hi").alias("src"), F.col("lo").alias("dst")))
    clears = both.join(as_(new, "src"), ["repo", "src"]).join(as_(old, "dst"), ["repo", "dst"])
    same = as_(new, "src").join(as_(old, "dst"), "repo").where("m_src = m_dst")
    pick = lambda df, x, y: df.select("repo", F.col(x).alias("src"), F.col(y).alias("dst"))
    out = pick(needs, "n_src", "n_dst").unionByName(pick(frees, "n_dst", "n_src")).unionByName(pick(clears, "n_src", "n_dst")).unionByName(pick(same, "n_src", "n_dst"))
    return out.where("src <> dst").distinct()


def compare(solutions: dict[str, DataFrame]) -> DataFrame:
    """(repo, name, one column for each solution): how many versions of a name each of some installations holds."""
    rows = None
    for which, df in solutions.items():
        own = df.select("repo", "name", *[F.lit(int(c == which)).alias(c) for c in solutions])
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("repo", "name").agg(*[F.sum(c).alias(c) for c in solutions])


def validity(solution: DataFrame, request: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, valid) for each repository with a request(repo, action, item, uid): whether the packages of `solution` meet
    their clauses, hold no pair in conflict, and answer every item."""
    from solvarium.operators.sat import violations

    have = solution.select("repo", "uid", F.lit(True).alias("installed"))
    bad = violations(have, resolved, conflicts).select("repo")
    held = request.join(have.withColumn("there", F.lit(True)), ["repo", "uid"], "left").groupBy("repo", "action", "item").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("there"))
    bad = bad.unionByName(held.where((F.col("action") == "install") != F.col("there")).select("repo")).distinct().withColumn("bad", F.lit(True))
    return request.select("repo").distinct().join(bad, "repo", "left").select("repo", F.col("bad").isNull().alias("valid"))
