"""Text forms of results, a row a line; write them with DataFrame.write.text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clause_lines(resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, uid, line): DIMACS clauses, variables numbered by uid; conflicts have uid 0."""
    own = resolved.groupBy("repo", "uid", "clause").agg(F.array_sort(F.collect_set("target")).alias("any"))
    line = F.concat(F.array_join(F.concat(F.array(-F.col("uid")), F.col("any")), " "), F.lit(" 0"))
    fights = conflicts.select("repo", F.lit(0).alias("uid"), F.concat(F.lit("-"), "lo", F.lit(" -"), "hi", F.lit(" 0")).alias("line"))
    return own.select("repo", "uid", line.alias("line")).unionByName(fights)


def _name(c: str):
    return F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '(["\\\\])', "\\\\$1"), F.lit('"'))


def dot_lines(edges: DataFrame, label: str | None = None) -> DataFrame:
    """(repo, line): edge statements of a DOT digraph."""
    tail = F.concat(F.lit(" [label="), _name(label), F.lit("];")) if label else F.lit(";")
    return edges.select("repo", F.concat(_name("src"), F.lit(" -> "), _name("dst"), tail).alias("line"))


def gml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, line): node and edge statements of a GML graph."""
    node = vertices.select("repo", F.concat(F.lit("node [ id "), "uid", F.lit(" ]")).alias("line"))
    return node.unionByName(edges.select("repo", F.concat(F.lit("edge [ source "), "src", F.lit(" target "), "dst", F.lit(" ]")).alias("line")))


def graphml_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, line): node and edge elements of a GraphML graph."""
    node = vertices.select("repo", F.concat(F.lit('<node id="'), "uid", F.lit('"/>')).alias("line"))
    return node.unionByName(edges.select("repo", F.concat(F.lit('<edge source="'), "src", F.lit('" target="'), "dst", F.lit('"/>')).alias("line")))


def report_lines(status: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, uid, line): one YAML list item a package with its name, version and status."""
    named = status.join(packages.select("repo", "uid", "name", "ver"), ["repo", "uid"])
    line = F.concat(F.lit("- package: "), "name", F.lit("\n  version: "), "ver", F.lit("\n  status: "), "status")
    return named.select("repo", "uid", line.alias("line"))


def _constraint(op: str = "op", ver: str = "ver"):
    return F.when(F.col(op) == "any", F.col("name")).otherwise(F.concat_ws(" ", "name", op, ver))


def document_stanzas(u) -> DataFrame:
    """(repo, uid, stanza): a universe's packages as stanzas of its document format, empty fields left out."""
    keys = ["repo", "uid"]
    clause = u.deps.groupBy(*keys, "clause").agg(F.array_sort(F.collect_list(F.struct("alt", _constraint().alias("t")))).alias("a"))
    clause = clause.select(*keys, "clause", F.array_join(F.transform("a", lambda x: x["t"]), " | ").alias("t"))
    deps = clause.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("clause", "t"))).alias("a")).select(*keys, F.array_join(F.transform("a", lambda x: x["t"]), ", ").alias("depends"))
    confs = u.confs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "op", "ver", _constraint().alias("t")))).alias("a")).select(*keys, F.array_join(F.transform("a", lambda x: x["t"]), ", ").alias("conflicts"))
    provs = u.provs.where("ver IS NULL").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("provides"))
    all_ = u.packages.join(deps, keys, "left").join(confs, keys, "left").join(provs, keys, "left")
    field = lambda name, c: F.concat(F.lit(f"\n{name}: "), c)
    more = [F.coalesce(field(c, F.col(c)), F.lit("")) for c in ("depends", "conflicts", "provides")]
    stanza = F.concat(F.lit("package: "), "name", field("version", F.col("ver")), *more, F.when(F.col("installed"), "\ninstalled: true").otherwise(""), F.lit("\n"))
    return all_.select(*keys, stanza.alias("stanza"))


def size_line(packages: DataFrame, edges: DataFrame, conflicts: DataFrame) -> DataFrame:
    """One line: packages, edges and conflicts, tabs between."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(packages, "p").join(n(edges, "e")).join(n(conflicts, "c")).select(F.concat_ws("\t", "p", "e", "c").alias("line"))  # single rows


def answer_stanzas(actions: DataFrame) -> DataFrame:
    """(repo, stanza) of actions(repo, uid, name, ver, action); a name that gets a new version needs no Remove."""
    new = actions.where("action = 'install'")
    gone = actions.where("action = 'remove'").join(new.select("repo", "name").distinct(), ["repo", "name"], "left_anti")
    stanza = lambda df, kind: df.select("repo", F.concat(F.lit(f"{kind}: "), "name", F.lit("\nVersion: "), "ver").alias("stanza"))
    return stanza(new, "Install").unionByName(stanza(gone, "Remove"))


def version_lines(packages: DataFrame, real: str = "real") -> DataFrame:
    """(repo, line): name=number=version."""
    return packages.select("repo", F.concat_ws("=", "name", "ver", real).alias("line"))


def impact_csv(impact: DataFrame) -> DataFrame:
    """(repo, line): name and the four counts of sat.impact(), commas between; names(repo, uid, name) joined before."""
    return impact.select("repo", F.concat_ws(", ", "name", "strong_out", "strong_in", "direct_out", "direct_in").alias("line"))
