"""From raw package records to a universe: version numbers, virtual names, self conflicts, keeps and global constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.functions import names, versions
from solvarium.operators.model import Universe

#: The pseudo-package that carries keeps and global constraints; asking for it asks for all of them.
GLOBAL = -1
VIRTUAL, VERSIONED = "--virtual-", "--virtual--versioned-"


def _explode(packages: DataFrame, *formulas: str, also: tuple[str, ...] = ()) -> DataFrame:
    """(repo, uid, *also, clause, alt, name, arch, op, version) of several formula columns, clauses numbered across them."""
    whole = F.concat(*[F.coalesce(F.col(f), F.array().cast(names.ATOMS)) for f in formulas])
    clauses = packages.select("repo", "uid", *also, F.posexplode(whole).alias("clause", "any"))
    return clauses.select("repo", "uid", *also, "clause", F.posexplode("any").alias("alt", "a")).select("repo", "uid", *also, "clause", "alt", "a.*")


def at_arch(name: Column, arch: Column, native: str) -> Column:
    """`name:arch`; packages for all architectures are of the native one."""
    return F.concat(name, F.lit(":"), F.when(arch == "all", native).otherwise(arch))


def annotated(name: Column, annotation: Column, arch: Column, native: str) -> Column:
    """The name that an atom means, for a package of `arch`: `:any` the bare one, `:native` and `:<arch>` that
    architecture's, none the package's own."""
    return F.when(annotation == "any", name).when(annotation == "native", F.concat(name, F.lit(f":{native}"))).when(annotation.isNotNull(), F.concat(name, F.lit(":"), annotation)).otherwise(at_arch(name, arch, native))


def _single(p: DataFrame) -> tuple[DataFrame, ...]:
    """Atoms where architectures play no part, each with `full`, the name that it means: dependencies, conflicts,
    provides; and what has no virtual twin: own and further conflicts, own and further provides."""
    full = lambda df: df.withColumn("full", F.col("name"))
    own = full(p.select("repo", "uid", "name", "version"))
    return full(_explode(p, "pre_depends", "depends")), full(_explode(p, "conflicts", "breaks")), full(_explode(p, "provides")), own.select("repo", "uid", "full", F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("version")), own.select("repo", "uid", "full", "version")


def _several(p: DataFrame, native: str, foreign: tuple[str, ...]) -> tuple[DataFrame, ...]:
    """As _single(), by Multi-Arch. Every package provides its bare name. `foreign` stands in, with all that it provides,
    in every architecture; `allowed` provides what it provides in any as well; `same` goes together with its own version
    in other architectures, and all others with no package of their name. Conflicts hold in every architecture;
    those of a `same` package that would hit its own name, or what it provides itself, go, or mean the others that
    provide it."""
    archs = F.array(*[F.lit(a) for a in dict.fromkeys((native, *foreign))])
    p = p.withColumns({"__arch": F.col("arch"), "multi": F.coalesce(F.lower("multiarch"), F.lit("no"))})
    also = ("__arch", "multi", "own")
    p = p.withColumn("own", F.col("name"))
    mine = at_arch(F.col("own"), F.col("__arch"), native)
    said = lambda df, arch: df.withColumn("full", annotated(F.col("name"), F.col("arch"), arch, native))
    deps = said(_explode(p, "pre_depends", "depends", also=also), F.col("__arch"))

    provs = _explode(p, "provides", also=also)
    provs = provs.withColumn("arch", F.when(F.col("multi") != "allowed", F.col("arch")))
    everywhere = F.when(F.col("multi") == "foreign", archs).otherwise(F.array("__arch"))
    provided = said(provs.withColumn("at", F.explode(everywhere)), F.col("at")).drop("at")
    provided = provided.unionByName(provs.where("multi = 'allowed'").withColumn("full", F.col("name")))

    confs = _explode(p, "conflicts", "breaks", also=also)
    has = provs.select("repo", "uid", "name").distinct().withColumn("provided", F.lit(True))
    real = p.select("repo", "name").distinct().withColumn("real", F.lit(True))
    known = confs.join(has, ["repo", "uid", "name"], "left").join(real, ["repo", "name"], "left")
    own = (F.col("name") == F.col("own")) | (F.col("op").isNull() & F.coalesce("provided", F.lit(False)))
    known = known.select(*confs.columns, own.alias("mine"), F.coalesce("real", F.lit(False)).alias("real"))
    kept = known.where("multi <> 'same' OR (NOT mine AND (real OR op IS NULL))").select(*confs.columns)
    others = provs.select("repo", F.col("own").alias("other"), "name").distinct()
    swapped = known.where("multi = 'same' AND mine AND NOT real").join(others, ["repo", "name"]).where("other <> own")
    none = F.lit(None).cast("string")
    swapped = swapped.drop("name").withColumnRenamed("other", "name").withColumns({"op": none, "version": none}).select(*confs.columns)
    fights = said(kept.unionByName(swapped).withColumn("at", F.explode(archs)), F.col("at")).drop("at")

    row = lambda when, full, op, version: p.where(when).select("repo", "uid", full.alias("full"), op.alias("op"), version.alias("version"))
    elsewhere = F.explode(F.filter(archs, lambda a: a != F.col("__arch")))
    there = p.withColumn("at", elsewhere).withColumn("full", at_arch(F.col("own"), F.col("at"), native))
    apart = row("true", mine, none, none).unionByName(row("multi <> 'same'", F.col("own"), none, none))
    apart = apart.unionByName(there.where("multi = 'same'").select("repo", "uid", "full", F.lit("!=").alias("op"), "version"))
    stand = p.select("repo", "uid", mine.alias("full"), "version").unionByName(p.select("repo", "uid", F.col("own").alias("full"), none.alias("version")))
    stand = stand.unionByName(there.where("multi = 'foreign'").select("repo", "uid", "full", "version"))
    stand = stand.unionByName(p.where("multi = 'allowed'").select("repo", "uid", F.concat("own", F.lit(":any")).alias("full"), none.alias("version")))
    return deps, fights, provided, apart, stand


def debian(packages: DataFrame, repo: Column | None = None, native: str | None = None, foreign: tuple[str, ...] = ()) -> Universe:
    """A universe of Debian records as sources.stanzas.debian_packages() gives them.

    Versions get numbers in Debian order over everything that mentions one, 2, 4, ..., so that odd numbers are gaps.
    A dependency also means the virtual twin of its name. An unversioned provide has a version no constraint but `any`
    meets, a versioned one is a twin of its own; all versions of a name conflict with each other. With `native`, names
    are `name:arch` and Multi-Arch rules hold among it and the `foreign` architectures.
    """
    p = packages.withColumn("repo", repo if repo is not None else F.lit(0).cast("long"))
    p = versions.dense_numbers(p.withColumn("__id", F.concat_ws("\x1f", "name", "version", "arch")), "__id", "uid").withColumn("uid", F.col("uid").cast("int"))
    deps, confs, provs, apart, stand = _single(p) if native is None else _several(p, native, foreign)
    said = p.select(F.col("version")).unionByName(deps.select("version")).unionByName(confs.select("version")).unionByName(provs.select("version"))
    said = said.where("version IS NOT NULL").distinct().withColumn("key", versions.debian_key(F.col("version")))
    said = versions.dense_numbers(said, "key", "n", step=2, first=2).select("version", F.col("n").cast("int").alias("ver"))

    def numbered(df: DataFrame) -> DataFrame:
        return df.join(said, "version", "left").withColumns({"op": F.coalesce("op", F.lit("any")), "ver": F.coalesce("ver", F.lit(0))})

    provided = provs.select("repo", "name").distinct()
    cols = {True: ["repo", "uid", "clause", "alt", "name", "op", "ver"], False: ["repo", "uid", "name", "op", "ver"]}

    def twins(df: DataFrame, clauses: bool) -> DataFrame:
        """Atoms by the names that they mean, with the twins of those that something provides."""
        said = numbered(df)
        twin = said.join(provided, ["repo", "name"], "left_semi").withColumn("full", F.concat(F.when(F.col("op") == "any", VIRTUAL).otherwise(VERSIONED), "full"))
        return said.unionByName(twin.select(*said.columns)).drop("name").withColumnRenamed("full", "name").select(*cols[clauses])

    own = numbered(apart).withColumnRenamed("full", "name").select(*cols[False])
    real = stand.join(said, "version", "left").select("repo", "uid", F.col("full").alias("name"), "ver")
    v = numbered(provs)
    plain = v.select("repo", "uid", F.concat(F.lit(VIRTUAL), "full").alias("name"), F.lit(None).cast("int").alias("ver"))
    versioned = v.where("op <> 'any'").select("repo", "uid", F.concat(F.lit(VERSIONED), "full").alias("name"), "ver")
    name = F.col("name") if native is None else at_arch(F.col("name"), F.col("arch"), native)
    out = p.join(said, "version").select("repo", "uid", name.alias("name"), "ver", "version", "arch", "installed", "essential", "source", "source_version")
    return Universe(out, twins(deps, True), twins(confs, False).unionByName(own).distinct(), real.unionByName(plain).unionByName(versioned).distinct())


def debian_keep(arch: Column, installed: Column, hold: Column, native: str) -> Column:
    """version for an installed package on hold, of the native architecture or of all; none for every other one."""
    return F.when(arch.isin(native, "all") & installed & hold, "version").otherwise("none")


def keep_clauses(packages: DataFrame, provs: DataFrame) -> DataFrame:
    """Resolved clauses (repo, uid, clause, target) of GLOBAL from packages(repo, uid, name, installed, keep): version
    keeps the package, package some version of its name, feature a provider of each name that it provides."""
    kept = packages.where("installed").select("repo", "uid", "name", "keep")
    one = kept.where("keep = 'version'").select("repo", F.concat(F.lit("v"), "uid").alias("k"), F.col("uid").alias("target"))
    name = kept.where("keep = 'package'").select("repo", "name").distinct().join(packages.select("repo", "name", F.col("uid").alias("target")), ["repo", "name"])
    name = name.select("repo", F.concat(F.lit("p"), "name").alias("k"), "target")
    has = provs.select("repo", "uid", F.col("name").alias("feature")).join(kept.where("keep = 'feature'").select("repo", "uid"), ["repo", "uid"], "left_semi").select("repo", "feature").distinct()
    feature = has.join(provs.select("repo", F.col("name").alias("feature"), F.col("uid").alias("target")), ["repo", "feature"]).select("repo", F.concat(F.lit("f"), "feature").alias("k"), "target")
    return _as_global(one.unionByName(name).unionByName(feature))


def essential_clauses(packages: DataFrame) -> DataFrame:
    """Resolved clauses of GLOBAL: of each name with an essential version, some version is in."""
    name = packages.where("essential").select("repo", "name").distinct()
    return _as_global(name.join(packages.select("repo", "name", F.col("uid").alias("target")), ["repo", "name"]).select("repo", F.concat(F.lit("e"), "name").alias("k"), "target"))


def _as_global(rows: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    clause = -F.dense_rank().over(Window.partitionBy("repo").orderBy("k"))
    return rows.distinct().select("repo", F.lit(GLOBAL).alias("uid"), clause.alias("clause"), "target")


def build_packages(sources: DataFrame, arch: str, profiles: tuple[str, ...] = (), extra: tuple[str, ...] = ("build-essential",)) -> DataFrame:
    """Sources(name, version, build_depends, build_conflicts) as packages `src:name`: atoms carry archs
    ARRAY<STRUCT<wanted, name>> and profiles ARRAY<ARRAY<STRUCT<wanted, profile>>>; those that don't apply go."""
    active = F.array(*[F.lit(p) for p in profiles]).cast("array<string>")
    table = names.architecture_table(sources.sparkSession)
    parts = F.broadcast(table.where(F.col("arch") == arch).agg(F.first("parts").alias("__parts")))

    def fits(a: Column) -> Column:
        same = lambda x: (x["name"] == arch) | x["name"].isin("any", "all") | (x["name"] == F.concat(F.lit("any-"), F.col("__parts")[3])) | (x["name"] == F.concat(F.col("__parts")[2], F.lit("-any")))
        listed = a["archs"]
        by_arch = F.when(F.size(listed) <= 0, True).when(listed[0]["wanted"], F.exists(listed, same)).otherwise(F.forall(listed, lambda x: ~same(x)))
        return by_arch & names.profile_matches(a["profiles"], active)

    plain = lambda a: F.struct(a["name"].alias("name"), a["arch"].alias("arch"), a["op"].alias("op"), a["version"].alias("version"))

    def kept(c: str) -> Column:
        return F.filter(F.transform(c, lambda any_: F.transform(F.filter(any_, fits), plain)), lambda any_: F.size(any_) > 0).cast(names.ATOMS)

    more = F.array(*[F.array(F.struct(F.lit(e).alias("name"), F.lit(None).cast("string").alias("arch"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("version"))) for e in extra]).cast(names.ATOMS)
    out = sources.crossJoin(parts)  # one row
    return out.select(F.concat(F.lit("src:"), "name").alias("name"), "version", F.lit(arch).alias("arch"), F.concat(kept("build_depends"), more).alias("depends"), kept("build_conflicts").alias("conflicts"))


def source_of(binaries: DataFrame, sources: DataFrame) -> DataFrame:
    """`binaries`(source, source_version, ...) with `found`: exact, other (the source is there in another version) or none."""
    exact = sources.select(F.col("name").alias("source"), F.col("version").alias("source_version"), F.lit(True).alias("__exact")).distinct()
    named = sources.select(F.col("name").alias("source"), F.lit(True).alias("__named")).distinct()
    out = binaries.join(exact, ["source", "source_version"], "left").join(named, "source", "left")
    return out.withColumn("found", F.when(F.col("__exact"), "exact").when(F.col("__named"), "other").otherwise("none")).drop("__exact", "__named")


def status_merge(packages: DataFrame, status: DataFrame, key: tuple[str, ...] = ("name", "version", "arch")) -> DataFrame:
    """Records of both, one a key: installed or essential where either is; other fields from `packages` first."""
    both = packages.withColumn("__from", F.lit(0)).unionByName(status.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in packages.columns if c not in (*key, "installed", "essential")]
    return both.groupBy(*key).agg(F.bool_or("installed").alias("installed"), F.bool_or("essential").alias("essential"), *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__from"))).alias(c) for c in rest])


def version_lag(packages: DataFrame) -> DataFrame:
    """`packages` with `lag`: how many newer versions of its name there are."""
    from pyspark.sql import Window

    return packages.withColumn("lag", F.dense_rank().over(Window.partitionBy("repo", "name").orderBy(F.desc("ver"))) - 1)


def real_versions(numbers: DataFrame, numbered: DataFrame, unknown: str | None = None) -> DataFrame:
    """`numbers`(number) with the version that numbered(number, version) gives each; numbers that stand for none get
    `unknown`."""
    out = numbers.join(numbered.select("number", "version").dropDuplicates(["number"]), "number", "left")
    return out if unknown is None else out.withColumn("version", F.coalesce("version", F.lit(unknown)))


def binaries(packages: DataFrame) -> DataFrame:
    """(source, source_ver, binaries): the names that are built from each source version, in order."""
    return packages.groupBy("source", "source_ver").agg(F.array_sort(F.collect_set("name")).alias("binaries"))


def _rpm_atoms(packages: DataFrame, column: str) -> DataFrame:
    """(repo, uid, own, at, name, op, version) of a column of functions.names.rpm_atoms()."""
    rows = packages.select("repo", "uid", F.col("name").alias("own"), F.posexplode(column).alias("at", "a"))
    return rows.select("repo", "uid", "own", "at", "a.*")


def rpm_units(packages: DataFrame) -> DataFrame:
    """(repo, name, op, version, key, ver): every version that a package has or provides, numbered from 2 within its name."""
    from pyspark.sql import Window

    own = packages.select("repo", "name", F.lit("=").alias("op"), "version")
    said = own.unionByName(_rpm_atoms(packages, "provides").where("op IS NOT NULL").select("repo", "name", "op", "version")).distinct()
    said = said.withColumn("key", versions.rpm_key(F.col("version")))
    return said.withColumn("ver", F.dense_rank().over(Window.partitionBy("repo", "name").orderBy("key", "version", "op")) + 1)


def rpm_expanded(atoms: DataFrame, units: DataFrame) -> DataFrame:
    """`atoms` with an `= ver` for each unit whose range has a version in common with theirs, `= 1` if there is none, and
    `any` for those without a version."""
    cols = [c for c in atoms.columns if c not in ("op", "version")]
    asked = atoms.where("op IS NOT NULL").withColumn("want", versions.rpm_key(F.col("version")))
    have = units.select("repo", "name", F.col("op").alias("have_op"), F.col("key").alias("have"), "ver")
    hits = asked.join(have, ["repo", "name"], "left")
    met = F.when(versions.rpm_overlaps(F.col("have_op"), F.col("have"), F.col("op"), F.col("want")), F.col("ver"))
    # One row an atom holds its units' numbers, so that an atom without any is told from the same rows.
    found = hits.groupBy(*cols, "op", "version").agg(F.collect_set(met).alias("vers"))
    found = found.select(*cols, F.lit("=").alias("op"), F.explode(F.when(F.size("vers") > 0, F.col("vers")).otherwise(F.array(F.lit(1)))).alias("ver"))
    return found.unionByName(atoms.where("op IS NULL").select(*cols, F.lit("any").alias("op"), F.lit(0).alias("ver")))


def rpm(packages: DataFrame) -> Universe:
    """A universe of rpm records: packages(repo, uid, name, version, provides, requires, obsoletes, conflicts, files), atoms as
    functions.names.rpm_atoms() gives them, files an array of names.

    Constraints become lists of versions that are there. A package needs neither itself nor what it provides, obsoletes
    or holds as a file; files are provided where some package asks for them.
    """
    packages = packages.withColumn("installed", F.lit(False)) if "installed" not in packages.columns else packages
    units = rpm_units(packages)
    needs, fights, gives = (_rpm_atoms(packages, c) for c in ("requires", "conflicts", "provides"))
    files = packages.select("repo", "uid", F.explode("files").alias("name")).distinct()
    own = gives.unionByName(_rpm_atoms(packages, "obsoletes")).select("repo", "uid", "name").unionByName(files).distinct()
    deps = rpm_expanded(needs.where("name <> own").join(own, ["repo", "uid", "name"], "left_anti").select(*needs.columns), units)
    confs = rpm_expanded(fights, units)
    asked = needs.select("repo", "name").unionByName(fights.select("repo", "name")).distinct()
    real = packages.join(units.where("op = '='").select("repo", "name", "version", "ver"), ["repo", "name", "version"])
    ver = F.when(F.col("op") != "any", F.col("ver")).alias("ver")
    provs = rpm_expanded(gives, units).select("repo", "uid", "name", ver)
    provs = provs.unionByName(files.join(asked, ["repo", "name"], "left_semi").select("repo", "uid", "name", F.lit(None).cast("int").alias("ver")))
    return Universe(
        real.select("repo", "uid", "name", "ver", "version", "installed"),
        deps.select("repo", "uid", F.col("at").alias("clause"), (F.col("ver")).alias("alt"), "name", "op", "ver"),
        confs.select("repo", "uid", "name", "op", "ver").distinct(),
        real.select("repo", "uid", "name", "ver").unionByName(provs).distinct(),
    )


def file_conflicts(packages: DataFrame) -> DataFrame:
    """(repo, lo, hi): packages that hold a file of the same name, other versions of one name and itself included."""
    files = packages.select("repo", "uid", F.explode("files").alias("file")).distinct()
    pairs = files.withColumnRenamed("uid", "lo").join(files.withColumnRenamed("uid", "hi"), ["repo", "file"]).where("lo < hi")
    return pairs.select("repo", "lo", "hi").distinct()
