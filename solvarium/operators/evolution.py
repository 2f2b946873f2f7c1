"""Futures of a repository: which versions matter, ranges between them, and clusters that move together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvarium.functions.versions import dense_numbers
from solvarium.operators import atoms, bits, futures, sat
from solvarium.operators.graphs import cone, reverse
from solvarium.operators.model import Universe, records, resolve_conflicts, resolve_deps, together, within
from solvarium.plans.lineage import cut


def ranges(versions: DataFrame, bottom: bool = True) -> DataFrame:
    """(name, kind, lo, hi) of versions(name, ver): eq for each, in between neighbours, hi above the last and, with
    `bottom`, lo under the first."""
    w = Window.partitionBy("name").orderBy("ver")
    v = versions.select("name", "ver").distinct().select("name", "ver", F.lead("ver").over(w).alias("next"), F.lag("ver").over(w).alias("last"))
    none = F.lit(None).cast(versions.schema["ver"].dataType)
    row = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"))
    each = [row("eq", F.col("ver"), F.col("ver")), F.when(F.col("next").isNotNull(), row("in", F.col("ver"), F.col("next"))).otherwise(row("hi", F.col("ver"), none))]
    if bottom:
        each.append(F.when(F.col("last").isNull(), row("lo", none, F.col("ver"))))
    return v.select("name", F.explode(F.array_compact(F.array(*each))).alias("r")).select("name", "r.*")


def outcomes(points: DataFrame, constraints: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """`points`(*by, point) with `own` and `passed`: two points give every one of constraints(*by, op, ver) the same outcome
    just where they agree in both. Points are doubled: versions even, gaps odd.

    An order constraint changes its outcome at one place, an equality only at its own version. So a running count of
    those places tells points apart, without a row for each point and constraint.
    """
    c = constraints.select(*by, "op", (F.col("ver") * 2).alias("v"))
    turn = F.when(F.col("op").isin(">=", "<"), F.col("v")).when(F.col("op").isin(">", "<="), F.col("v") + 1)
    turns = c.select(*by, turn.alias("point")).where("point IS NOT NULL").distinct().withColumn("turn", F.lit(1))
    single = c.where(F.col("op").isin("=", "!=")).select(*by, F.col("v").alias("point")).distinct().withColumn("own", F.col("point"))
    out = points.join(turns, [*by, "point"], "left").join(single, [*by, "point"], "left")
    return out.withColumn("passed", F.count("turn").over(Window.partitionBy(*by).orderBy("point"))).drop("turn")


def discriminants(constraints: DataFrame) -> DataFrame:
    """(name, point, equivalents) of constraints(name, op, ver), ver dense from 1 within the name: one point for each
    vector of outcomes, the greatest, with all points of the same outcomes."""
    top = constraints.groupBy("name").agg(F.max("ver").alias("top"))
    points = top.select("name", F.explode(F.sequence(F.lit(1), F.col("top") * 2 + 1)).alias("point"))
    said = outcomes(points, constraints).groupBy("name", "own", "passed")
    return said.agg(F.max("point").alias("point"), F.array_sort(F.collect_list("point")).alias("equivalents")).drop("own", "passed")


def targets(constraints: DataFrame, present: DataFrame) -> DataFrame:
    """(repo, cluster, target, equivalents) of constraints(repo, cluster, op, ver) on the names of a cluster and the versions
    present(repo, cluster, ver): doubled points that the cluster may move to. Points not above what is there, and
    those with the outcomes of what is there, are none."""
    by = ("repo", "cluster")
    c = constraints.where("op <> 'any' AND ver IS NOT NULL")
    each = c.select(*by, "ver").unionByName(present.select(*by, "ver")).distinct()
    points = each.select(*by, F.explode(F.array(F.col("ver") * 2, F.col("ver") * 2 + 1)).alias("point"))
    said = outcomes(points, c, by).groupBy(*by, "own", "passed").agg(F.max("point").alias("target"), F.array_sort(F.collect_list("point")).alias("equivalents"))
    now = present.groupBy(*by).agg((F.max("ver") * 2).alias("now"))
    return said.join(now, list(by)).where("target > now AND NOT array_contains(equivalents, now)").select(*by, "target", "equivalents")


def _asked(u: Universe) -> DataFrame:
    """(repo, name, op, ver) that dependencies, conflicts and provided names other than a package's own mention."""
    own = u.packages.select("repo", "uid", "name")
    op = F.when(F.col("ver").isNull(), "any").otherwise("=").alias("op")
    provided = u.provs.join(own, ["repo", "uid", "name"], "left_anti").select("repo", "name", op, "ver")
    return provided.unionByName(u.deps.select("repo", "name", "op", "ver")).unionByName(u.confs.select("repo", "name", "op", "ver")).distinct()


def _moves(u: Universe, own: DataFrame) -> DataFrame:
    """targets() of the clusters of own(repo, cluster, uid, name, ver)."""
    named = own.select("repo", "cluster", "name").distinct()
    return cut(targets(_asked(u).join(named, ["repo", "name"]).select("repo", "cluster", "op", "ver").distinct(), own))


def _listed(u: Universe, members: DataFrame, schema, task) -> tuple[DataFrame, DataFrame | None]:
    """What task(number) tells of records and members in one shuffle, as schema(kinds of members, number); number: the type
    of versions. And (repo) of those that are wide or crowded, None if there is none."""
    rows, members = records(u), members.select("repo", "cluster", "uid").where("repo IS NOT NULL AND cluster IS NOT NULL AND uid IS NOT NULL")
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    crowd = atoms.crowded_of(u)
    versions = [rows.schema["ver"].dataType, *(rows.schema[c].dataType.elementType["ver"].dataType for c in rows.columns[4:])]
    number = "bigint" if any(v.simpleString() == "bigint" for v in versions) else "int"
    said = cut(together(u, crowd, members).mapInArrow(task(number), schema(kinds, number)))
    out, rest = said.where("NOT wide").drop("wide"), said.where("wide").select("repo")
    rest = None if rest.isEmpty() else rest
    if crowd is not None:
        rest = crowd if rest is None else rest.unionByName(crowd)
    return out, rest


def challenged(u: Universe, members: DataFrame) -> DataFrame:
    """(repo, cluster, target, equivalents, broken, unknown) of members(repo, cluster, uid): for each future in which all of
    a cluster has moved to a target, how many packages that can be installed now could not be any more.

    Repositories of up to tables.WIDTH packages are told by truth tables in one shuffle, wider ones by joins.
    """
    schema = lambda kinds, number: f"repo {kinds['repo']}, cluster {kinds['cluster']}, target {number}, equivalents array<{number}>, broken bigint, unknown bigint, wide boolean"
    out, rest = _listed(u, members, schema, lambda number: futures.told(number == "int"))
    if rest is None:
        return out
    return out.unionByName(_challenged_joined(within(u, rest), members.join(rest, "repo", "left_semi")))


def _challenged_joined(u: Universe, members: DataFrame) -> DataFrame:
    """challenged() by joins. A future is a value of `repo`, so one check answers for all. It holds what the move can touch and no more: packages
    that lead to the cluster by names, whatever the versions, and what these lead to.
    """
    own = cut(u.packages.select("repo", "uid", "name", "ver").join(members.select("repo", "cluster", "uid"), ["repo", "uid"]))
    goals = _moves(u, own)
    provided = u.provs.select("repo", "name", F.col("uid").alias("dst"))
    edges = cut(u.deps.select("repo", F.col("uid").alias("src"), "name").distinct().join(provided, ["repo", "name"]).select("repo", "src", "dst").distinct())
    moved = own.select("repo", "cluster", "uid").join(goals, ["repo", "cluster"], "left_semi")
    hit = cut(cone(moved, reverse(edges), keys=("cluster",)).select("repo", "cluster", "uid"))
    part = cut(cone(hit, edges, keys=("cluster",)).select("repo", "cluster", "uid"))
    now = sat.check(hit.select("repo", "uid").distinct(), cut(resolve_deps(u)), cut(resolve_conflicts(u))).where("status = 'ok'").select("repo", "uid")

    future = F.concat_ws("~", "repo", "cluster", "target").alias("future")
    futures = goals.select("repo", "cluster", "target", future)
    whole = cut(futures.join(part, ["repo", "cluster"]))
    of = lambda df, *cols: whole.join(df, ["repo", "uid"]).select(F.col("future").alias("repo"), "uid", *cols)
    twice = (F.col("ver") * 2).alias("ver")
    mine = own.select("repo", "cluster", "uid", "name", F.lit(True).alias("mine"))
    provs = whole.join(u.provs, ["repo", "uid"]).join(mine, ["repo", "cluster", "uid", "name"], "left")
    provs = provs.select(F.col("future").alias("repo"), "uid", "name", F.when(F.col("mine"), F.col("target")).otherwise(twice).alias("ver"))
    then = Universe(of(u.packages, "name"), of(u.deps, "clause", "alt", "name", "op", twice), of(u.confs, "name", "op", twice), provs)
    asked = futures.join(cut(now).join(hit, ["repo", "uid"]), ["repo", "cluster"]).select(F.col("future").alias("repo"), "uid")
    said = sat.check(asked, cut(resolve_deps(then)), cut(resolve_conflicts(then))).groupBy(F.col("repo").alias("future"))
    said = said.agg(F.count_if(F.col("status") == "broken").alias("broken"), F.count_if(F.col("status") == "unknown").alias("unknown"))
    out = goals.withColumn("future", future).join(said, "future", "left").na.fill(0, ["broken", "unknown"])
    return out.select("repo", "cluster", "target", "equivalents", "broken", "unknown")


def future(u: Universe, members: DataFrame, first: int = 1) -> Universe:
    """One universe of all that members(repo, cluster, uid) may become, versions doubled: beside the packages, a dummy for
    each member and target above it, which needs nothing, provides what the member does, and is in conflict with
    all of its name. Clusters of several members move together: each state of a cluster provides a version of a
    name of its own and is in conflict with its other versions. A name that is asked for, or only provided, and
    that no package has becomes a package of version `first`, a cluster by itself. New packages have uids under -2.
    """
    packages = u.packages.select("repo", "uid", "name", "ver")
    own = packages.join(members.select("repo", "cluster", "uid"), ["repo", "uid"]).withColumn("cluster", F.concat(F.lit("c"), "cluster"))
    lone = _asked(u).select("repo", "name").distinct().join(packages.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    lone = lone.select("repo", F.lit(None).cast("int").alias("uid"), "name", F.lit(first).alias("ver"), F.concat(F.lit("n"), "name").alias("cluster"))
    own = cut(own.unionByName(lone.select(*own.columns)))
    goals = _moves(u, own).select("repo", "cluster", "target")
    made = own.join(goals, ["repo", "cluster"]).where(F.col("target") > F.col("ver") * 2)
    made = made.unionByName(own.where("uid IS NULL").withColumn("target", F.col("ver") * 2))
    made = made.withColumn("__key", F.concat_ws("~", "repo", "cluster", "target", F.coalesce(F.col("uid").cast("string"), F.col("name"))))
    made = cut(dense_numbers(made, "__key", "n").withColumn("new", (-2 - F.col("n")).cast("int")))

    twice = (F.col("ver") * 2).alias("ver")
    several = own.where("uid IS NOT NULL").groupBy("repo", "cluster").count().where("count > 1").select("repo", "cluster")
    state = own.select("repo", "cluster", "uid", F.lit(0).alias("ver")).unionByName(made.select("repo", "cluster", F.col("new").alias("uid"), F.col("target").alias("ver")))
    state = state.join(several, ["repo", "cluster"]).select("repo", "uid", F.concat(F.lit("src/"), "cluster").alias("name"), F.col("ver").cast("int").alias("ver"))
    others = u.provs.join(packages.select("repo", "uid", "name"), ["repo", "uid", "name"], "left_anti")
    theirs = made.select("repo", "uid", F.col("new")).join(others, ["repo", "uid"]).select("repo", F.col("new").alias("uid"), "name", twice)
    new = made.select("repo", F.col("new").alias("uid"), "name", F.col("target").cast("int").alias("ver"))
    return Universe(
        packages.select("repo", "uid", "name", twice).unionByName(new),
        u.deps.withColumn("ver", twice),
        u.confs.select("repo", "uid", "name", "op", twice).unionByName(new.select("repo", "uid", "name", F.lit("any").alias("op"), F.lit(0).alias("ver"))).unionByName(state.select("repo", "uid", "name", F.lit("!=").alias("op"), "ver")),
        u.provs.select("repo", "uid", "name", twice).unionByName(new).unionByName(theirs).unionByName(state),
    )


def outdated(u: Universe, members: DataFrame) -> DataFrame:
    """(repo, uid, status) of every package in future(): one that is broken there can't be installed, whatever the others
    become, until it changes itself. Repositories that may become up to futures.MOST packages are put together and checked
    in a task, after one shuffle; larger ones by joins."""
    schema = lambda kinds, number: f"repo {kinds['repo']}, uid int, status string, wide boolean"
    out, rest = _listed(u, members, schema, lambda number: futures.outdated(sat.BUDGET, 1))
    if rest is None:
        return out
    return out.unionByName(_outdated_joined(within(u, rest), members.join(rest, "repo", "left_semi")))


def _outdated_joined(u: Universe, members: DataFrame) -> DataFrame:
    """outdated() by the tables of future()."""
    then = future(u, members)
    return sat.check(u.packages.select("repo", "uid"), cut(resolve_deps(then)), cut(resolve_conflicts(then)))


def clusters(packages: DataFrame) -> DataFrame:
    """(source, source_ver, norm, packages, lowest, highest, members) of packages(source, source_ver, norm, key): what is
    built from one source version and carries the same normalised version, members by key in order."""
    return packages.groupBy("source", "source_ver", "norm").agg(F.count("*").alias("packages"), F.min("key").alias("lowest"), F.max("key").alias("highest"), F.array_sort(F.collect_list("key")).alias("members"))


def versions_of(constraints: DataFrame) -> DataFrame:
    """(name, ver): every version that constraints(name, op, ver) name, once."""
    return constraints.where("ver IS NOT NULL").select("name", "ver").distinct()


def aligned(version: Column, like: Column) -> Column:
    """`version` under the epoch of `like`, or without one where that has none."""
    bare = F.regexp_replace(version, "^[^:]*:", "")
    return F.when(like.contains(":"), F.concat(F.substring_index(like, ":", 1), F.lit(":"), bare)).otherwise(bare)


def migrated(packages: DataFrame, target: str, version: str = "version", name: str = "name") -> DataFrame:
    """`packages` with `version` moved under the epoch that the name's highest sort key (`target`) carries."""
    w = Window.partitionBy(name)
    return packages.withColumn(version, aligned(F.col(version), F.max_by(version, target).over(w)))


def epoch_products(packages: DataFrame) -> DataFrame:
    """(name, version): every normalised version of packages(name, version) under every epoch that the name has."""
    bare = F.regexp_replace(F.regexp_replace("version", "^[^:]*:", ""), r"\+b[0-9]+$", "")
    each = packages.select("name", F.when(F.col("version").contains(":"), F.concat(F.substring_index("version", ":", 1), F.lit(":"))).otherwise("").alias("epoch"), bare.alias("bare"))
    g = each.groupBy("name").agg(F.collect_set("epoch").alias("epochs"), F.collect_set("bare").alias("bares"))
    out = g.select("name", F.explode("epochs").alias("epoch"), "bares").select("name", "epoch", F.explode("bares").alias("bare"))
    return out.select("name", F.concat("epoch", "bare").alias("version"))
