"""The relational model of package repositories.

A universe is a set of narrow tables; `repo` keys every one of them, so one plan answers for many repositories
(snapshots, futures, foreground and background sets) at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.plans.lineage import cut


#: The columns of records().
RECORD = ["repo", "uid", "name", "ver", "deps", "confs", "provs"]


@dataclass(frozen=True)
class Universe:
    """packages(repo, uid, name, ver, installed, ...); deps(repo, uid, clause, alt, name, op, ver): a clause is the
    disjunction of its alternatives; confs(repo, uid, name, op, ver); provs(repo, uid, name, ver): what a package
    provides, itself included, ver null for an unversioned virtual name. `source`, where it is at hand: narrow rows (repo,
    uid, ...), of which `derived` makes records() one by one, its other columns kept, with at most so many alternatives, conflicts and
    provided names each, itself counted."""

    packages: DataFrame
    deps: DataFrame
    confs: DataFrame
    provs: DataFrame
    source: DataFrame | None = None
    derived: Callable[[DataFrame], DataFrame] | None = None
    most: int | None = None


def records(u: Universe) -> DataFrame:
    """(repo, uid, name, ver, deps, confs, provs): a row a package, what it says as arrays of structs."""
    keys, columns = ["repo", "uid"], RECORD
    if u.source is not None:
        return u.derived(u.source).select(*columns)
    gather = lambda df, name, *cols: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = u.packages.select("repo", "uid", "name", "ver").join(gather(u.deps, "deps", "clause", "alt", "name", "op", "ver"), keys, "left")
    return out.join(gather(u.confs, "confs", "name", "op", "ver"), keys, "left").join(gather(u.provs, "provs", "name", "ver"), keys, "left").select(*columns)


def together(u: Universe, crowd: DataFrame | None, members: DataFrame | None = None) -> DataFrame:
    """records() with a repository and a uid, but for those of crowd(repo): a repository's rows together and in order. What
    they are derived from is shuffled and sorted in their place. With members(repo, cluster, uid) also `kind`, 0, `cluster`,
    null, and after a repository's records a row of kind 1 for each member."""
    source, columns, order = u.source if u.source is not None else records(u), RECORD, ["repo", "uid"]
    source = source.where("repo IS NOT NULL AND uid IS NOT NULL")
    if members is not None:
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        given = [F.col(f.name) if f.name in order else none(f.name, f.dataType) for f in source.schema]
        source = source.select("*", F.lit(0).alias("kind"), none("cluster", members.schema["cluster"].dataType))
        source = source.unionByName(members.select(*given, F.lit(1).alias("kind"), "cluster"))
        columns, order = [*RECORD, "kind", "cluster"], ["repo", "kind", "uid"]
    if crowd is not None:
        source = source.join(crowd, "repo", "left_anti")
    source = source.repartition("repo").sortWithinPartitions(*order)
    out = u.derived(source) if u.source is not None else source
    if members is not None:  # nothing is derived for a member
        out = out.withColumns({c: F.when(F.col("kind") == 0, F.col(c)) for c in RECORD[4:]})
    return out.select(*columns)


def satisfies(have: Column, op: Column, want: Column) -> Column:
    """Whether version `have` meets the constraint; an unversioned provide (null) meets any."""
    return (
        have.isNull()
        | (op == "any")
        | ((op == "=") & (have == want))
        | ((op == "!=") & (have != want))
        | ((op == ">=") & (have >= want))
        | ((op == ">") & (have > want))
        | ((op == "<=") & (have <= want))
        | ((op == "<") & (have < want))
    )


def resolve_atoms(atoms: DataFrame, provs: DataFrame) -> DataFrame:
    """`atoms` joined to the packages that provide them, as `target`; the equi-join is on (repo, name)."""
    p = provs.select("repo", "name", F.col("uid").alias("target"), F.col("ver").alias("have"))
    return atoms.join(p, ["repo", "name"]).where(satisfies(F.col("have"), F.col("op"), F.col("ver"))).drop("have")


def resolve_deps(u: Universe) -> DataFrame:
    """(repo, uid, clause, target), one row with a null target for a clause that nothing provides."""
    from pyspark.sql import Window

    p = u.provs.select(F.col("repo").alias("__repo"), F.col("name").alias("__name"), F.col("uid").alias("target"), F.col("ver").alias("have"))
    on = (F.col("repo") == F.col("__repo")) & (F.col("name") == F.col("__name")) & satisfies(F.col("have"), F.col("op"), F.col("ver"))
    found = u.deps.join(p, on, "left").select("repo", "uid", "clause", "target")
    met = F.count("target").over(Window.partitionBy("repo", "uid", "clause"))
    return found.withColumn("met", met).where("met = 0 OR target IS NOT NULL").select("repo", "uid", "clause", "target").distinct()


def missing_clauses(resolved: DataFrame) -> DataFrame:
    return resolved.where("target IS NULL").select("repo", "uid", "clause")


def resolve_conflicts(u: Universe) -> DataFrame:
    """(repo, lo, hi): pairs in conflict, either way round, a package's conflict with itself left out."""
    found = resolve_atoms(u.confs, u.provs).where("target <> uid")
    return found.select("repo", F.least("uid", "target").alias("lo"), F.greatest("uid", "target").alias("hi")).distinct()


def resolved(u: Universe) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packages, resolved dependencies, conflicts), each written once."""
    return u.packages, cut(resolve_deps(u)), cut(resolve_conflicts(u))


def within(u: Universe, repos: DataFrame) -> Universe:
    """The repositories of the universe that repos(repo) names."""
    return Universe(*(t.join(repos, "repo", "left_semi") for t in (u.packages, u.deps, u.confs, u.provs)))


def latest(packages: DataFrame, n: int = 1) -> DataFrame:
    """The n highest versions of each name, by a top-k per group."""
    from pyspark.sql import Window

    w = Window.partitionBy("repo", "name").orderBy(F.desc("ver"), "uid")
    return packages.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def upgrade_floor(packages: DataFrame) -> DataFrame:
    """(repo, name, ver): what an upgrade must reach, the highest installed version of a name."""
    return packages.where("installed").groupBy("repo", "name").agg(F.max("ver").alias("ver"))


def conflicts_of(conflicts: DataFrame) -> DataFrame:
    """(repo, uid, other): both ends of each pair in conflict."""
    a, b = F.struct(F.col("lo").alias("uid"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("uid"), F.col("lo").alias("other"))
    return conflicts.select("repo", F.explode(F.array(a, b)).alias("c")).select("repo", "c.*")


def names(packages: DataFrame) -> DataFrame:
    """(repo, name, versions): each name once, its versions in order."""
    return packages.groupBy("repo", "name").agg(F.array_sort(F.collect_set("ver")).alias("versions"))


def by_real_version(packages: DataFrame, wanted: DataFrame, version: str = "version") -> DataFrame:
    """`wanted`(repo, name, version as text) with the uid that carries it, or null."""
    real = packages.select("repo", "name", version, "uid").dropDuplicates(["repo", "name", version])
    return wanted.join(real, ["repo", "name", version], "left")


def latest_by_key(packages: DataFrame, key: str, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """The rows of each name that carry its greatest sort key."""
    top = packages.groupBy(*by).agg(F.max(key).alias("__top"))
    return packages.join(top, list(by)).where(F.col(key) == F.col("__top")).drop("__top")


def select(packages: DataFrame, selectors: DataFrame) -> DataFrame:
    """(repo, selector, uid): real packages that selectors(selector, name, op, ver) name."""
    found = packages.select("repo", "uid", "name", F.col("ver").alias("have")).join(selectors, "name")
    return found.where(satisfies(F.col("have"), F.coalesce("op", F.lit("any")), F.col("ver"))).select("repo", "selector", "uid")


def matching(packages: DataFrame, pattern: str) -> DataFrame:
    """Packages whose name holds a match of the regular expression."""
    return packages.where(F.col("name").rlike(pattern))


def self_conflicts(u: Universe) -> DataFrame:
    """(repo, uid, name): conflicts of a package with something that it provides itself."""
    return resolve_atoms(u.confs, u.provs).where("target = uid").select("repo", "uid", "name").distinct()


def missing_alternatives(u: Universe) -> DataFrame:
    """(repo, uid, clause, alt): alternatives that nothing provides, in clauses that something else meets."""
    keys = ["repo", "uid", "clause", "alt"]
    found = resolve_atoms(u.deps, u.provs).select(*keys).distinct()
    met = found.select("repo", "uid", "clause").distinct()
    return u.deps.select(*keys).distinct().join(found, keys, "left_anti").join(met, ["repo", "uid", "clause"], "left_semi")


def mentioned(u: Universe) -> DataFrame:
    """(repo, name, op, ver): every constraint that a dependency, a conflict or a provide mentions, once."""
    provided = u.provs.where("ver IS NOT NULL").select("repo", "name", F.lit("=").alias("op"), "ver")
    asked = [d.where("op <> 'any'").select("repo", "name", "op", "ver") for d in (u.deps, u.confs)]
    return asked[0].unionByName(asked[1]).unionByName(provided).distinct()


def with_request(resolved: DataFrame, conflicts: DataFrame, request: DataFrame, uid: int = -2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A pseudo-package for request(repo, action, item, uid): it depends on one of each install item's packages and is in
    conflict with all that remove items name. Returns it as (repo, uid), and the clauses and conflicts with its own."""
    clause = request.where("action = 'install'").select("repo", F.lit(uid).alias("uid"), F.col("item").alias("clause"), F.col("uid").alias("target"))
    fight = request.where("action = 'remove'").select("repo", F.lit(uid).alias("lo"), F.col("uid").alias("hi")).distinct()
    dummy = request.select("repo", F.lit(uid).alias("uid")).distinct()
    return dummy, resolved.unionByName(clause.select(*resolved.columns)), conflicts.unionByName(fight)
