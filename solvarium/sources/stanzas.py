"""Readers of stanza files (deb822 and its kin), catalogs and package lists, as DataFrames with one row a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvarium.functions.names import parse_formula

FORMULAS = ("Depends", "Pre-Depends", "Conflicts", "Breaks", "Provides", "Recommends", "Suggests", "Enhances", "Replaces")


def fields(stanza: Column) -> Column:
    """A stanza's fields as a map: comments go, continuation lines are joined on without a separator, the first of
    repeated fields counts, and signature armour is no field."""
    text = F.regexp_replace(stanza, r"(?m)^(#.*|-----.*|Hash:.*)$\n?", "")
    lines = F.split(F.regexp_replace(text, r"\n[ \t]+", ""), "\n")
    pairs = F.filter(lines, lambda s: s.rlike(r"^[^\s:][^:]*:"))
    entry = lambda s: F.struct(F.substring_index(s, ":", 1).alias("key"), F.trim(F.regexp_replace(s, "^[^:]*:", "")).alias("value"))
    first = F.reduce(
        F.transform(pairs, entry),
        F.array().cast("array<struct<key:string,value:string>>"),
        lambda seen, e: F.when(F.exists(seen, lambda x: x["key"] == e["key"]), seen).otherwise(F.array_append(seen, e)),
    )
    return F.map_from_entries(first)


def read_stanzas(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(fields MAP) of files of stanzas apart by empty lines; compressed files by their extension."""
    rows = spark.read.option("lineSep", "\n\n").text(paths)
    out = rows.select(fields(F.col("value")).alias("fields"))
    return out.where(F.size("fields") > 0)


def debian_packages(stanzas: DataFrame, archs: list[str] | None = None, extras: tuple[str, ...] = ()) -> DataFrame:
    """Typed Packages records; `all` passes any architecture filter. Of records with one name, version and architecture
    one stays."""
    get = lambda k: F.col("fields")[k]
    out = stanzas.select(
        get("Package").alias("name"),
        get("Version").alias("version"),
        get("Architecture").alias("arch"),
        F.coalesce(get("Multi-Arch"), F.lit("no")).alias("multiarch"),
        F.lower(F.coalesce(get("Essential"), F.lit("no"))).isin("yes", "true").alias("essential"),
        F.coalesce(F.regexp_extract(get("Source"), r"^(\S+)", 1), get("Package")).alias("source"),
        F.coalesce(F.nullif(F.regexp_extract(get("Source"), r"\(([^)]*)\)", 1), F.lit("")), get("Version")).alias("source_version"),
        F.coalesce(F.split(get("Status"), " ")[2] == "installed", F.lit(False)).alias("installed"),
        *[parse_formula(F.coalesce(get(k), F.lit(""))).alias(k.lower().replace("-", "_")) for k in FORMULAS],
        *[get(k).alias(k) for k in extras],
    ).where("name IS NOT NULL AND version IS NOT NULL")
    if archs is not None:
        out = out.where(F.col("arch").isin("all", *archs))
    return out.dropDuplicates(["name", "version", "arch"])


def atoms(packages: DataFrame, formula: str, key: tuple[str, ...] = ("name", "version", "arch")) -> DataFrame:
    """(key as p_..., clause, alt, name, op, version): a formula column exploded to a row an alternative."""
    by = [F.col(k).alias(f"p_{k}") for k in key]
    clauses = packages.select(*by, F.posexplode(formula).alias("clause", "any"))
    return clauses.select(*[f"p_{k}" for k in key], "clause", F.posexplode("any").alias("alt", "a")).select(*[f"p_{k}" for k in key], "clause", "alt", "a.*")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return catalog(spark.read.text(path))


def catalog(lines: DataFrame) -> DataFrame:
    """Lines(value) of a blank-separated catalog: version in column 2, name in 3, depends in 7 and conflicts in 9, `|` between them and
    `none` for an empty list."""
    parts = F.split(F.col("value"), " ")
    names = lambda c: F.when(c == "none", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))
    rows = lines.where(F.size(parts) >= 9)
    return rows.select(parts[2].alias("name"), parts[1].alias("version"), names(parts[6]).alias("depends"), names(parts[8]).alias("conflicts"))


def read_synthesis(spark: SparkSession, path: str) -> DataFrame:
    return synthesis(spark.read.text(path, wholetext=True))


def synthesis(whole: DataFrame) -> DataFrame:
    """Of whole files(value), records of `@tag@value@value...` lines, each ended by its @info@ line: name-version-release.arch, and lists."""
    records = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(?:@(?!info@)[^\n]*\n)*@info@[^\n]*"), F.lit(0))).alias("r"))
    nvra = F.regexp_extract("r", r"@info@([^@\n]*)", 1)
    tag = lambda t: F.split(F.nullif(F.regexp_extract("r", rf"(?m)^@{t}@(.*)$", 1), F.lit("")), "@")
    return records.select(
        F.regexp_extract(nvra, r"^(.*)-([^-]*)-([^-]*)\.([^.]*)$", 1).alias("name"),
        F.regexp_extract(nvra, r"^(.*)-([^-]*)-([^-]*)\.([^.]*)$", 2).alias("version"),
        F.regexp_extract(nvra, r"^(.*)-([^-]*)-([^-]*)\.([^.]*)$", 3).alias("release"),
        F.regexp_extract(nvra, r"^(.*)-([^-]*)-([^-]*)\.([^.]*)$", 4).alias("arch"),
        *[tag(t).alias(t) for t in ("provides", "requires", "obsoletes", "conflicts")],
    )


def read_dpkg_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, version) of installed packages in the output of `dpkg -l`."""
    parts = F.split(F.col("value"), r"\s+")
    return spark.read.text(path).where(parts[0] == "ii").select(F.substring_index(parts[1], ":", 1).alias("name"), parts[2].alias("version"))


def read_popcon(spark: SparkSession, path: str) -> DataFrame:
    """(rank, name, inst) of a popularity list."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    return spark.read.text(path).where(F.trim("value").rlike(r"^[0-9]+ ")).select(parts[0].cast("int").alias("rank"), parts[1].alias("name"), parts[2].cast("int").alias("inst"))


def read_npm(stanzas: DataFrame) -> DataFrame:
    """(name, version, depends MAP<name, range>) of npm stanzas, whose depends are JSON members."""
    get = lambda k: F.col("fields")[k]
    return stanzas.where(get("package").isNotNull()).select(
        get("package").alias("name"), get("version").alias("version"), F.from_json(F.concat(F.lit("{"), F.coalesce(get("depends"), F.lit("")), F.lit("}")), "map<string,string>").alias("depends")
    )


def _list(c: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")


def debian_sources(stanzas: DataFrame, archs: list[str] | None = None) -> DataFrame:
    """Typed Sources records, build dependencies of all three fields together, likewise build conflicts; a source stays
    if one of its architectures is asked for, or it is for any or all."""
    from solvarium.functions.names import parse_build_formula

    get = lambda k: F.col("fields")[k]
    both = lambda what: parse_build_formula(F.concat_ws(",", *[get(f"Build-{what}{k}") for k in ("", "-Indep", "-Arch")]))
    out = stanzas.select(get("Package").alias("name"), get("Version").alias("version"), _list(get("Architecture"), r"\s+").alias("archs"), both("Depends").alias("build_depends"), both("Conflicts").alias("build_conflicts"))
    out = out.where("name IS NOT NULL AND version IS NOT NULL")
    if archs is not None:
        out = out.where(F.exists("archs", lambda a: a.isin("any", "all", *archs) | a.endswith("-any") | a.startswith("any-")))
    return out.dropDuplicates(["name", "version"])


def pef_packages(stanzas: DataFrame) -> DataFrame:
    """Typed records of package exchange stanzas: name, version, installed, and formulas."""
    from solvarium.functions.names import truth

    get = lambda k: F.coalesce(F.col("fields")[k], F.col("fields")[k.lower()])
    formulas = [parse_formula(F.coalesce(get(k), F.lit(""))).alias(k.lower()) for k in ("Depends", "Conflicts", "Provides", "Recommends")]
    out = stanzas.select(get("Package").alias("name"), get("Version").alias("version"), F.coalesce(truth(get("Installed")), F.lit(False)).alias("installed"), *formulas)
    return out.where("name IS NOT NULL AND version IS NOT NULL").dropDuplicates(["name", "version"])


def scenario(stanzas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An installation scenario: its request stanza as (action, name, op, version, suite) rows, and its packages, with
    installed, hold, candidate, automatic and pin beside the fields of debian_packages()."""
    from solvarium.functions.names import parse_request, truth

    get = lambda k: F.col("fields")[k]
    asked = stanzas.where(get("Request").isNotNull())
    kinds = F.array(*[F.struct(F.lit(k.lower()).alias("action"), _list(get(k), r"\s+").alias("tokens")) for k in ("Install", "Remove", "Upgrade")])
    each = asked.select(F.explode(kinds).alias("k")).select("k.action", F.explode("k.tokens").alias("token")).withColumn("r", parse_request(F.col("token")))
    flags = {"hold": "Hold", "candidate": "APT-Candidate", "automatic": "APT-Automatic"}
    own = stanzas.where(get("Request").isNull() & get("Package").isNotNull())
    more = own.select(
        get("Package").alias("name"), get("Version").alias("version"), get("Architecture").alias("arch"), F.coalesce(truth(get("Installed")), F.lit(False)).alias("installed"),
        *[F.coalesce(truth(get(f)), F.lit(False)).alias(c) for c, f in flags.items()], get("APT-Pin").cast("int").alias("pin"),
    )
    return each.select("action", "r.name", "r.op", "r.version", "r.suite"), more


def opam_packages(stanzas: DataFrame) -> DataFrame:
    """One row for each package and switch that it is available in, with whether it is installed, pinned or base there."""
    get = lambda k: F.col("fields")[k]
    in_ = lambda k: F.array_contains(_list(get(k), r"[,\s]+"), F.col("switch"))
    out = stanzas.where(get("package").isNotNull()).select("fields", F.explode(_list(get("switches"), r"[,\s]+")).alias("switch"))
    return out.select(
        get("package").alias("name"), get("version").alias("version"), "switch", in_("installed").alias("installed"), in_("pinned").alias("pinned"), in_("base").alias("base"),
        parse_formula(F.coalesce(get("depends"), F.lit(""))).alias("depends"), parse_formula(F.coalesce(get("conflicts"), F.lit(""))).alias("conflicts"),
    )


def universe_document(stanzas: DataFrame) -> DataFrame:
    """Packages of a universe document: integer versions, installed, keep, and formulas."""
    get = lambda k: F.col("fields")[k]
    out = stanzas.where(get("package").isNotNull())
    formulas = [parse_formula(F.regexp_replace(F.coalesce(get(k), F.lit("")), r"([^\s,|]+)\s*(!=|>=|<=|=|>|<)\s*([0-9]+)", "$1 ($2 $3)")).alias(k) for k in ("depends", "conflicts", "provides")]
    return out.select(get("package").alias("name"), get("version").cast("int").alias("ver"), (F.coalesce(get("installed"), F.lit("false")) == "true").alias("installed"), F.coalesce(get("keep"), F.lit("none")).alias("keep"), *formulas)


def release_files(stanzas: DataFrame) -> DataFrame:
    """Archive descriptions: fields as they are, lists split, flags as booleans; checksums are left out."""
    from solvarium.functions.names import truth

    get = lambda k: F.col("fields")[k]
    plain = [get(k).alias(k.lower()) for k in ("Origin", "Label", "Suite", "Version", "Codename", "Date", "Description")]
    lists = [_list(get(k), r"\s+").alias(k.lower()) for k in ("Architectures", "Components")]
    return stanzas.select(*plain, *lists, *[F.coalesce(truth(get(k)), F.lit(False)).alias(c) for c, k in (("not_automatic", "NotAutomatic"), ("automatic_upgrades", "ButAutomaticUpgrades"))])


def preferences(stanzas: DataFrame) -> DataFrame:
    """(package, kind, value, priority): package null for all; kind release, version or origin."""
    get = lambda k: F.col("fields")[k]
    pin = F.trim(get("Pin"))
    return stanzas.where(get("Pin").isNotNull()).select(
        F.nullif(get("Package"), F.lit("*")).alias("package"), F.regexp_extract(pin, r"^(\w+)", 1).alias("kind"), F.trim(F.regexp_replace(pin, r"^\w+", "")).alias("value"), get("Pin-Priority").cast("int").alias("priority")
    )
