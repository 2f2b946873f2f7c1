"""Version orders, formulas, requests and file formats made from the parts table, with SQL from the plain columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.functions import names, versions
from solvarium.operators import documents, evolution, translate
from solvarium.plans.lineage import new_path
from solvarium.plans.texts import parts, version_strings
from solvarium.sources import loading, stanzas

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def columns():
    """The parts' key and size."""
    return F.col("p_partkey"), F.col("p_size")


def as_file(spark, lines) -> str:
    """The path of a new text file of lines(value), for readers of files."""
    path = new_path(spark, "text")
    lines.select("value").write.text(path)
    return path


@query(
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '2' ELSE '' END AS epoch, p_size || '.' || p_partkey % 30 AS upstream, CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(p_partkey % 4 AS VARCHAR) END AS revision,"
    " CASE WHEN p_size % 5 = 0 THEN 'b' || p_size ELSE '' END AS binnmu, p_size % 2 = 0 AS native, true AS same, p_size || '.' || p_partkey % 30 || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' || p_partkey % 4 END || CASE WHEN p_size % 5 = 0 THEN '+b' || p_size ELSE '' END AS no_epoch FROM part"
)
def version_decomposition(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.when(size % 3 == 0, "2:").otherwise(""), size, F.lit("."), k % 30, F.when(size % 2 == 0, "").otherwise(F.concat(F.lit("-"), k % 4)), F.when(size % 5 == 0, F.concat(F.lit("+b"), size)).otherwise(""))
    rows = parts(spark, sf_dir).select("p_partkey", text.alias("v")).withColumn("d", versions.decompose(F.col("v")))
    return rows.select("p_partkey", "d.*", (versions.compose(F.col("d")) == F.col("v")).alias("same"), versions.strip_epoch(F.col("v")).alias("no_epoch"))


@query(
    "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_partkey % 12, p_size, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 0 ELSE 0 END) AS number FROM part"
)
def semver_rank_per_name(spark, sf_dir):
    """Pre-releases of one number, of one word, and releases with a build that doesn't count."""
    k, size = columns()
    pre = F.when(k % 4 == 0, F.concat(F.lit("-"), size)).when(k % 4 == 1, "-rc").otherwise(F.concat(F.lit("+b"), k))
    text = F.concat(F.when(size % 2 == 0, "v").otherwise(""), size % 3, F.lit("."), k % 12, F.lit("."), size, pre)
    rows = parts(spark, sf_dir).select("p_partkey", "p_brand", versions.semver_key(text).alias("key"))
    return versions.numbers_per_name(rows, "p_brand", "key").select("p_partkey", F.col("number").cast("long").alias("number"))


@query(
    "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END, p_partkey % 13, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN p_size % 3 = 2 THEN p_size ELSE 0 END, p_partkey % 5) AS number FROM part"
)
def rpm_rank_per_name(spark, sf_dir):
    """A version that goes on is above one that ends; letters that go on are below digits."""
    k, size = columns()
    tail = F.when(size % 3 == 0, "").when(size % 3 == 1, "rc").otherwise(F.concat(F.lit("."), F.lpad(size.cast("string"), 4, "0")))
    text = F.concat(F.when(size % 4 == 0, "1:").otherwise(""), k % 13, tail, F.lit("-"), k % 5)
    rows = parts(spark, sf_dir).select("p_partkey", "p_brand", versions.rpm_key(text).alias("key"))
    return versions.numbers_per_name(rows, "p_brand", "key").select("p_partkey", F.col("number").cast("long").alias("number"))


@query("SELECT p_partkey, p_partkey % 2 = 0 OR p_size % 5 = 0 AS same FROM part")
def rpm_open_releases(spark, sf_dir):
    """A release that is left out equals any."""
    k, size = columns()
    a = F.concat(F.lit("0:1."), F.lpad(size.cast("string"), 3, "0"), F.when(size % 5 == 0, "").otherwise("-2"))
    b = F.concat(F.lit("1."), size, F.when(k % 2 == 0, "-2").otherwise("-3"))
    return parts(spark, sf_dir).select("p_partkey", versions.rpm_equal(a, b).alias("same"))


@query(
    "WITH v AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY (p_size % 7 = 0)::INT DESC, p_size % 10 DESC, p_partkey % 30 DESC, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END DESC, p_partkey % 4 DESC) AS r FROM part)"
    " SELECT p_brand AS name, CASE WHEN p_size % 7 = 0 THEN '1:' ELSE '' END || (p_size % 10) || '.' || (p_partkey % 30) || CASE p_size % 5 WHEN 0 THEN '~rc1' WHEN 1 THEN '+b2' ELSE '' END || '-' || (p_partkey % 4) AS version FROM v WHERE r = 1"
)
def latest_debian_versions(spark, sf_dir):
    from solvarium.operators import model

    rows = version_strings(spark, sf_dir).select(F.col("p_brand").alias("name"), "version").withColumn("key", versions.debian_key(F.col("version")))
    return model.latest_by_key(rows.distinct(), "key").select("name", "version")


@query(
    "WITH v AS (SELECT p_brand AS name, CASE WHEN p_size % 7 = 0 THEN '1:' ELSE '' END AS e, (p_size % 10) || '.' || (p_partkey % 30) AS b FROM part)"
    " SELECT DISTINCT x.name, x.e || y.b AS version FROM (SELECT DISTINCT name, e FROM v) x JOIN (SELECT DISTINCT name, b FROM v) y USING (name)"
)
def epoch_products(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.when(size % 7 == 0, "1:").otherwise(""), size % 10, F.lit("."), k % 30, F.when(size % 3 == 0, "+b2").otherwise(""))
    return evolution.epoch_products(parts(spark, sf_dir).select(F.col("p_brand").alias("name"), text.alias("version")))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '4:' ELSE '' END || p_partkey || '-1' AS moved FROM part")
def aligned_epochs(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.when(size % 2 == 0, "1:").otherwise(""), k, F.lit("-1"))
    like = F.concat(F.when(size % 3 == 0, "4:").otherwise(""), F.lit("9.9"))
    return parts(spark, sf_dir).select("p_partkey", evolution.aligned(text, like).alias("moved"))


@query("SELECT DISTINCT p_brand AS name, p_size AS ver FROM part WHERE p_partkey % 3 <> 0")
def versions_of_constraints(spark, sf_dir):
    k, size = columns()
    c = parts(spark, sf_dir).select(F.col("p_brand").alias("name"), F.lit(">=").alias("op"), F.when(k % 3 != 0, size).alias("ver"))
    return evolution.versions_of(c)


@query(
    "WITH v AS (SELECT DISTINCT p_brand AS name, p_size AS ver FROM part), n AS (SELECT name, ver, lead(ver) OVER w AS nx, lag(ver) OVER w AS pv FROM v WINDOW w AS (PARTITION BY name ORDER BY ver))"
    " SELECT name, '= ' || ver AS text FROM n UNION ALL SELECT name, ver || ' < . < ' || nx FROM n WHERE nx IS NOT NULL UNION ALL SELECT name, ver || ' < .' FROM n WHERE nx IS NULL UNION ALL SELECT name, '. < ' || ver FROM n WHERE pv IS NULL"
)
def range_texts(spark, sf_dir):
    _, size = columns()
    r = evolution.ranges(parts(spark, sf_dir).select(F.col("p_brand").alias("name"), size.alias("ver")))
    return r.select("name", versions.range_text(F.col("kind"), F.col("lo").cast("string"), F.col("hi").cast("string")).alias("text"))


@query("SELECT p_size AS version, dense_rank() OVER (ORDER BY p_size) + 1 AS number FROM (SELECT DISTINCT p_size FROM part)")
def numbers_back_to_versions(spark, sf_dir):
    """Numbers from 2, as 1 stands for versions that nothing has."""
    _, size = columns()
    rows = versions.dense_numbers(parts(spark, sf_dir).select(size.alias("version")).distinct(), "version", first=2)
    return translate.real_versions(rows.select("number"), rows)


_CNF = (
    " SELECT p_partkey, clause, atom.op AS op, atom.version AS version FROM (SELECT p_partkey, p_size AS a, p_partkey % 7 AS b, p_partkey % 11 AS c FROM part), LATERAL (VALUES"
    " (0, {'op': '>=', 'version': a || '.' || b || '.0'}), (0, {'op': '>=', 'version': (a + 1) || '.0.0'}), (1, {'op': '>=', 'version': a || '.' || b || '.0'}), (1, {'op': '<=', 'version': (a + 2) || '.' || c || '.0'}),"
    " (2, {'op': '<', 'version': a || '.' || (b + 1) || '.0'}), (2, {'op': '>=', 'version': (a + 1) || '.0.0'}), (3, {'op': '<', 'version': a || '.' || (b + 1) || '.0'}), (3, {'op': '<=', 'version': (a + 2) || '.' || c || '.0'})) AS t(clause, atom)"
)


@query(_CNF)
def npm_formulas(spark, sf_dir):
    """`~a.b || >= a+1.0.0 <= a+2.c.0` as clauses of alternatives."""
    k, size = columns()
    a, b, c = size, k % 7, k % 11
    text = F.concat(F.lit("~"), a, F.lit("."), b, F.lit(" || >= "), a + 1, F.lit(".0.0 <="), a + 2, F.lit("."), c, F.lit(".0"))
    rows = parts(spark, sf_dir).select("p_partkey", F.posexplode(names.npm_formula(text)).alias("clause", "any"))
    return rows.select("p_partkey", "clause", F.explode("any").alias("atom")).select("p_partkey", "clause", "atom.op", "atom.version")


@query(
    "SELECT p_partkey, name, CAST(n_archs AS BIGINT) AS n_archs, first_arch, wanted, profile FROM part, LATERAL (VALUES ('a' || p_size, 2, 'amd64', true, NULL), ('b', 1, 'i386', false, 'nocheck'), ('c' || p_partkey, 0, NULL, NULL, NULL)) AS t(name, n_archs, first_arch, wanted, profile)"
)
def build_formulas(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.lit("a"), size, F.lit(" (>= 1) [amd64 arm64], b [!i386] <!nocheck> | c"), k)
    rows = parts(spark, sf_dir).select("p_partkey", F.explode(F.flatten(names.parse_build_formula(text))).alias("x"))
    first = F.get("x.archs", F.lit(0))
    return rows.select("p_partkey", "x.name", F.size("x.archs").cast("long").alias("n_archs"), first["name"].alias("first_arch"), first["wanted"].alias("wanted"), F.get(F.get("x.profiles", F.lit(0)), F.lit(0))["profile"].alias("profile"))


@query(
    "SELECT 'src:pkg' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN 'a,b,build-essential' WHEN p_size % 3 = 1 THEN 'b,build-essential' ELSE 'b,c,build-essential' END AS needs, CAST((p_partkey % 2 = 0)::INT AS BIGINT) AS conflicts FROM part"
)
def source_build_packages(spark, sf_dir):
    """Sources read from stanzas as packages to build on amd64 with the profile nocheck."""
    k, size = columns()
    text = F.concat(
        F.lit("Package: pkg"), k, F.lit("\nVersion: 1-"), size, F.lit("\nArchitecture: any all\nBuild-Depends: "),
        F.when(size % 3 == 0, "a [linux-any], b [!i386]").when(size % 3 == 1, "a [i386 hurd-any], b").otherwise("a <!nocheck>, b, c <nocheck>"),
        F.lit("\nBuild-Conflicts-Indep: "), F.when(k % 2 == 0, "x (<< 2)").otherwise("x [!amd64]"),
    )
    rows = stanzas.debian_sources(parts(spark, sf_dir).select(stanzas.fields(text).alias("fields")), archs=["amd64"])
    out = translate.build_packages(rows, "amd64", ("nocheck",))
    first = F.array_join(F.transform("depends", lambda c: c[0]["name"]), ",")
    return out.select("name", first.alias("needs"), F.size("conflicts").cast("long").alias("conflicts"))


@query("SELECT p_partkey, t.* FROM part, LATERAL (VALUES ('install', 'pkg' || p_size, NULL, NULL, NULL), ('remove', 'lib' || p_partkey || '-x', NULL, NULL, NULL), ('install', 'a', '=', '1.' || p_size || '-2', NULL), ('install', 'b', NULL, NULL, 'stable')) AS t(action, name, op, version, suite)")
def request_grammar(spark, sf_dir):
    k, size = columns()
    tokens = F.array(F.concat(F.lit("+pkg"), size), F.concat(F.lit("-lib"), k, F.lit("-x")), F.concat(F.lit("a=1."), size, F.lit("-2")), F.lit("b/stable"))
    return parts(spark, sf_dir).select("p_partkey", F.explode(F.transform(tokens, names.parse_request)).alias("r")).select("p_partkey", "r.*")


@query("SELECT p_partkey, 'p%' || p_partkey AS one, 'q' || p_size AS two, 'pkg' AS three, p_size % 2 = 0 AS truth, p_size % 3 = 0 AS hold, 'a (>= ' || p_size || ') | b:any, c' AS printed FROM part")
def names_back(spark, sf_dir):
    k, size = columns()
    one = names.real_name(F.concat(F.lit("--virtual-"), names.encode(F.concat(F.lit("p%"), k))))
    two, three = names.real_name(F.concat(F.lit("--virtual--versioned-q"), size)), names.real_name(F.lit("src:pkg"))
    printed = names.print_formula(names.parse_formula(F.concat(F.lit("a(>="), size, F.lit(")|b:any ,c"))))
    return parts(spark, sf_dir).select(
        "p_partkey", one.alias("one"), two.alias("two"), three.alias("three"), names.truth(F.when(size % 2 == 0, "Yes").otherwise("false")).alias("truth"),
        names.on_hold(F.when(size % 3 == 0, "hold ok installed").otherwise("install ok installed")).alias("hold"), F.trim(printed).alias("printed"),
    )


@query("SELECT p_brand AS source, p_size % 5 AS source_ver, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS binaries FROM part GROUP BY ALL")
def binaries_of_sources(spark, sf_dir):
    _, size = columns()
    rows = parts(spark, sf_dir).select(F.col("p_brand").alias("source"), (size % 5).alias("source_ver"), F.col("p_name").alias("name"))
    return translate.binaries(rows).select("source", "source_ver", F.array_join("binaries", ",").alias("binaries"))


@query(
    "WITH s AS (SELECT DISTINCT p_brand AS name, p_size % 5 AS version FROM part WHERE p_size % 2 = 0)"
    " SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.name = p_brand AND s.version = p_size % 7) THEN 'exact' WHEN EXISTS (SELECT 1 FROM s WHERE s.name = p_brand) THEN 'other' ELSE 'none' END AS found FROM part"
)
def sources_of_binaries(spark, sf_dir):
    _, size = columns()
    p = parts(spark, sf_dir)
    sources = p.where("p_size % 2 = 0").select(F.col("p_brand").alias("name"), (size % 5).alias("version")).distinct()
    return translate.source_of(p.select("p_partkey", F.col("p_brand").alias("source"), (size % 7).alias("source_version")), sources).select("p_partkey", "found")


@query("SELECT 'pkg' || p_partkey || '-x' AS name, CAST(p_size AS VARCHAR) AS version, '1mdv' AS release, 'i586' AS arch, CASE WHEN p_size % 2 = 0 THEN 'a,b[>= 2]' END AS requires FROM part")
def synthesis_reading(spark, sf_dir):
    k, size = columns()
    requires = F.when(size % 2 == 0, "@requires@a@b[>= 2]\n").otherwise("")
    lines = parts(spark, sf_dir).select(F.concat(F.lit("@provides@p\n"), requires, F.lit("@info@pkg"), k, F.lit("-x-"), size, F.lit("-1mdv.i586@0@7@System")).alias("value"))
    return stanzas.read_synthesis(spark, as_file(spark, lines)).select("name", "version", "release", "arch", F.array_join("requires", ",").alias("requires"))


@query("SELECT 'pkg' || p_partkey AS name, '1.' || p_size AS version, CASE WHEN p_size % 2 = 0 THEN 'a,b' ELSE '' END AS depends FROM part")
def catalog_reading(spark, sf_dir):
    k, size = columns()
    lines = parts(spark, sf_dir).select(F.concat(F.lit("n 1."), size, F.lit(" pkg"), k, F.lit(" f m s "), F.when(size % 2 == 0, "a|b").otherwise("none"), F.lit(" c none")).alias("value"))
    return stanzas.read_catalog(spark, as_file(spark, lines)).select("name", "version", F.array_join("depends", ",").alias("depends"))


@query("SELECT 'dpkg' AS source, 'pkg' || p_partkey AS name, '1.' || p_size AS value FROM part WHERE p_size % 3 = 0 UNION ALL SELECT 'popcon', 'pkg' || p_partkey, p_size || '/' || p_partkey FROM part")
def installed_list_reading(spark, sf_dir):
    k, size = columns()
    p = parts(spark, sf_dir)
    status = F.when(size % 3 == 0, "ii  ").otherwise("rc  ")
    dpkg = as_file(spark, p.select(F.concat(status, F.lit("pkg"), k, F.lit(":amd64   1."), size, F.lit("  amd64  words")).alias("value")))
    ranks = as_file(spark, p.select(F.concat(size, F.lit("  pkg"), k, F.lit("   "), k, F.lit(" 1 2 3 (me)")).alias("value")))
    one = stanzas.read_dpkg_list(spark, dpkg).select(F.lit("dpkg").alias("source"), "name", F.col("version").alias("value"))
    return one.unionByName(stanzas.read_popcon(spark, ranks).select(F.lit("popcon").alias("source"), "name", F.concat_ws("/", "rank", "inst").alias("value")))


@query("SELECT 'pkg' || p_partkey AS name, CAST(p_size AS VARCHAR) AS version, p_size % 2 = 0 AS installed, 'a (>= ' || p_size || ') | b' AS depends FROM part")
def exchange_reading(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.lit("package: pkg"), k, F.lit("\nversion: "), size, F.lit("\ninstalled: "), F.when(size % 2 == 0, "true").otherwise("false"), F.lit("\ndepends: a (>= "), size, F.lit(") | b"))
    rows = stanzas.pef_packages(parts(spark, sf_dir).select(stanzas.fields(text).alias("fields")))
    return rows.select("name", "version", "installed", names.print_formula(F.col("depends")).alias("depends"))


@query(
    "SELECT 'package' AS kind, 'pkg' || p_partkey AS name, '1.' || p_size AS version, p_size % 2 = 0 AS installed, CAST(p_partkey % 900 AS INT) AS pin FROM part"
    " UNION ALL SELECT 'install', 'x' || p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'remove', 'y', '2', NULL, NULL FROM part WHERE p_partkey % 50 = 0"
)
def scenario_reading(spark, sf_dir):
    k, size = columns()
    p = parts(spark, sf_dir)
    packages = F.concat(F.lit("Package: pkg"), k, F.lit("\nVersion: 1."), size, F.lit("\nArchitecture: amd64\nInstalled: "), F.when(size % 2 == 0, "yes").otherwise("no"), F.lit("\nAPT-Pin: "), k % 900)
    asked = F.concat(F.lit("Request: EDSP 0.5\nInstall: x"), k, F.lit("\nRemove: y=2"))
    rows = p.select(stanzas.fields(packages).alias("fields")).unionByName(p.where("p_partkey % 50 = 0").select(stanzas.fields(asked).alias("fields")))
    request, own = stanzas.scenario(rows)
    out = own.select(F.lit("package").alias("kind"), "name", "version", "installed", "pin")
    return out.unionByName(request.select(F.col("action").alias("kind"), "name", "version", F.lit(None).cast("boolean").alias("installed"), F.lit(None).cast("int").alias("pin")))


@query("SELECT 'pkg' || p_partkey AS name, switch, switch = 's1' AND p_size % 2 = 0 AS installed, p_size % 3 = 0 AS base FROM part, LATERAL (VALUES ('s1'), ('s' || 2 + p_size % 4)) AS t(switch)")
def switch_reading(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.lit("package: pkg"), k, F.lit("\nversion: 1\nswitches: s1, s"), 2 + size % 4, F.when(size % 2 == 0, "\ninstalled: s1").otherwise(""), F.when(size % 3 == 0, F.concat(F.lit("\nbase: s1,s"), 2 + size % 4)).otherwise(""))
    return stanzas.opam_packages(parts(spark, sf_dir).select(stanzas.fields(text).alias("fields"))).select("name", "switch", "installed", "base")


@query("SELECT 'pkg' || p_partkey AS name, p_size AS ver, p_size % 2 = 0 AS installed, CASE WHEN p_size % 5 = 0 THEN 'version' ELSE 'none' END AS keep, 'a (>= ' || p_size || ') | b, c (!= 3)' AS depends FROM part")
def document_reading(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.lit("package: pkg"), k, F.lit("\nversion: "), size, F.lit("\ndepends: a >= "), size, F.lit(" | b, c != 3"), F.when(size % 2 == 0, "\ninstalled: true").otherwise(""), F.when(size % 5 == 0, "\nkeep: version").otherwise(""))
    rows = stanzas.universe_document(parts(spark, sf_dir).select(stanzas.fields(text).alias("fields")))
    return rows.select("name", "ver", "installed", "keep", names.print_formula(F.col("depends")).alias("depends"))


@query("SELECT 's' || p_size AS suite, 'main,part' || p_partkey AS components, CAST(2 AS BIGINT) AS archs, p_size % 2 = 0 AS not_automatic FROM part")
def release_reading(spark, sf_dir):
    k, size = columns()
    text = F.concat(F.lit("Origin: O\nSuite: s"), size, F.lit("\nArchitectures: amd64 i386\nComponents: main part"), k, F.lit("\nNotAutomatic: "), F.when(size % 2 == 0, "yes").otherwise("no"))
    rows = stanzas.release_files(parts(spark, sf_dir).select(stanzas.fields(text).alias("fields")))
    return rows.select("suite", F.array_join("components", ",").alias("components"), F.size("architectures").cast("long").alias("archs"), "not_automatic")


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'pkg' || p_partkey END AS package, CASE WHEN p_size % 3 = 0 THEN 'version' ELSE 'release' END AS kind, CASE WHEN p_size % 3 = 0 THEN '1.*' ELSE 'a=stable' END AS value, CAST(p_partkey % 1000 AS INT) AS priority FROM part")
def preference_reading(spark, sf_dir):
    k, size = columns()
    pin = F.when(size % 3 == 0, "version 1.*").otherwise("release a=stable")
    text = F.concat(F.lit("Package: "), F.when(size % 2 == 0, F.concat(F.lit("pkg"), k)).otherwise("*"), F.lit("\nPin: "), pin, F.lit("\nPin-Priority: "), k % 1000)
    return stanzas.preferences(parts(spark, sf_dir).select(stanzas.fields(text).alias("fields")))


_RPM = """
WITH p AS (SELECT CAST(p_partkey AS INT) AS k, p_partkey // 50 AS repo, 'n' || p_partkey % 7 AS name, p_size AS s, p_partkey % 2 AS r FROM part),
g AS (SELECT p.*, 'v' || s % 3 AS o FROM p WHERE s % 2 = 0),
u AS (SELECT repo, name, s, r, dense_rank() OVER (PARTITION BY repo, name ORDER BY s, r) + 1 AS ver FROM (SELECT repo, name, s, r FROM p UNION SELECT repo, o, s, -1 FROM g)),
d AS (SELECT p.*, 0 AS pos, 'n' || (k + 1) % 7 AS o, CASE k % 4 WHEN 0 THEN '>=' WHEN 1 THEN '<' WHEN 2 THEN '=' END AS op, s AS v, CASE WHEN s % 2 = 0 THEN -1 ELSE 0 END AS w FROM p
  UNION ALL SELECT p.*, 1, name, NULL, 0, 0 FROM p UNION ALL SELECT p.*, 2, '/f' || k % 3, NULL, 0, 0 FROM p UNION ALL SELECT p.*, 3, 'v' || k % 3, '>', 30, -1 FROM p),
n AS (SELECT * FROM d WHERE o <> name AND NOT (k % 5 = 0 AND o = 'n' || (k + 1) % 7) AND o <> '/f' || s % 4 AND NOT (s % 2 = 0 AND o = 'v' || s % 3)),
c AS (SELECT p.*, 0 AS pos, 'n' || (k + 2) % 7 AS o, '<=' AS op, s - 1 AS v, -1 AS w FROM p),
x AS (SELECT 'need' AS kind, * FROM n UNION ALL SELECT 'conflict', * FROM c),
cmp AS (SELECT x.kind, x.k, x.pos, x.o, x.op, u.ver, CASE WHEN u.s <> x.v THEN sign(u.s - x.v) WHEN u.r < 0 OR x.w < 0 THEN 0 ELSE sign(u.r - x.w) END AS z FROM x JOIN u ON u.repo = x.repo AND u.name = x.o WHERE x.op IS NOT NULL),
hit AS (SELECT * FROM cmp WHERE CASE op WHEN '>=' THEN z >= 0 WHEN '>' THEN z > 0 WHEN '<' THEN z < 0 WHEN '<=' THEN z <= 0 ELSE z = 0 END)
SELECT kind, k, o AS name, CASE WHEN op IS NULL THEN 'any' ELSE '=' END AS op, CASE WHEN op IS NULL THEN 0 ELSE 1 END AS ver FROM x ANTI JOIN hit USING (kind, k, pos)
UNION ALL SELECT kind, k, o, '=', ver FROM hit
UNION ALL SELECT 'provide', k, name, NULL, ver FROM p JOIN u USING (repo, name, s, r)
UNION ALL SELECT 'provide', g.k, g.o, NULL, u.ver FROM g JOIN u ON u.repo = g.repo AND u.name = g.o AND u.s = g.s
UNION ALL SELECT 'provide', k, '/f' || s % 4, NULL, NULL FROM p WHERE EXISTS (SELECT 1 FROM p q WHERE q.repo = p.repo AND q.k % 3 = p.s % 4)
"""


def rpm_packages(spark, sf_dir):
    k, size = columns()
    n, v = (lambda x: F.concat(F.lit("n"), x % 7)), (lambda x: F.concat(F.lit("v"), x % 3))
    some = lambda when, text: F.when(when, F.array(text)).otherwise(F.array().cast("array<string>"))
    op = F.when(k % 4 == 0, ">=").when(k % 4 == 1, "<").otherwise("==")
    want = F.concat(n(k + 1), F.lit("["), op, F.lit(" "), size, F.when(size % 2 == 0, "").otherwise("-0"), F.lit("]"))
    needs = F.array(F.when(k % 4 == 3, n(k + 1)).otherwise(want), n(k), F.concat(F.lit("/f"), k % 3), F.concat(v(k), F.lit("[> 30]")))
    return parts(spark, sf_dir).select(
        F.floor(k / 50).alias("repo"),
        k.cast("int").alias("uid"),
        n(k).alias("name"),
        F.concat(size, F.lit("-"), k % 2).alias("version"),
        names.rpm_atoms(some(size % 2 == 0, F.concat(v(size), F.lit("[== "), size, F.lit("]")))).alias("provides"),
        names.rpm_atoms(needs).alias("requires"),
        names.rpm_atoms(some(k % 5 == 0, F.concat(n(k + 1), F.lit("[*]")))).alias("obsoletes"),
        names.rpm_atoms(F.array(F.concat(n(k + 2), F.lit("[<= "), size - 1, F.lit("]")))).alias("conflicts"),
        F.array(F.concat(F.lit("/f"), size % 4), F.concat(F.lit("/g"), k)).alias("files"),
    )


@query(_RPM)
def rpm_translation(spark, sf_dir):
    u = translate.rpm(rpm_packages(spark, sf_dir))
    rows = lambda kind, df, op: df.select(F.lit(kind).alias("kind"), F.col("uid").alias("k"), "name", op.alias("op"), "ver")
    return rows("need", u.deps, F.col("op")).unionByName(rows("conflict", u.confs, F.col("op"))).unionByName(rows("provide", u.provs, F.lit(None).cast("string")))


@query("SELECT DISTINCT a.p_partkey // 50 AS repo, CAST(a.p_partkey AS INT) AS lo, CAST(b.p_partkey AS INT) AS hi FROM part a JOIN part b ON a.p_partkey // 50 = b.p_partkey // 50 AND a.p_partkey < b.p_partkey AND a.p_size % 4 = b.p_size % 4")
def rpm_file_conflicts(spark, sf_dir):
    return translate.file_conflicts(rpm_packages(spark, sf_dir))


@query("SELECT p_partkey, 'x-' || regexp_replace(lower(p_brand), '[^0-9a-z-]', '-', 'g') || '-' || md5(p_brand || '=' || p_name)[:8] AS field FROM part")
def criteria_fields(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return rows.select("p_partkey", names.criteria_field(F.col("p_brand"), F.col("p_name")).alias("field"))


@query(
    "SELECT 'p' || p_partkey AS name, p_size || '.' || p_partkey % 30 AS version, CASE WHEN p_partkey % 2 = 0 THEN 'all' ELSE 'amd64' END AS arch, CASE WHEN p_size % 4 = 0 THEN 0 ELSE 1 END AS n_depends FROM part"
)
def loaded_packages(spark, sf_dir):
    """Lists that are plain, gzip and bzip2, named so, named otherwise or not at all; records of a list come in others too."""
    k, size = columns()
    text = F.concat(
        F.lit("Package: p"), k, F.lit("\nVersion: "), size, F.lit("."), k % 30, F.lit("\nArchitecture: "), F.when(k % 2 == 0, "all").otherwise("amd64"),
        F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("\nDepends: q"), size, F.lit(" |\n r"))), F.lit("\n"),
    )
    rows, uris = parts(spark, sf_dir).select("p_partkey", text.alias("value")), []
    jvm = spark._jvm.org.apache.hadoop.fs
    for i, (codec, was, named) in enumerate([("none", ".txt", ".gz"), ("gzip", ".txt.gz", ".txt"), ("gzip", ".txt.gz", ".txt.gz"), ("bzip2", ".txt.bz2", ".gz"), ("bzip2", ".txt.bz2", ".txt.bz2")]):
        path = new_path(spark, "list")
        rows.where((F.col("p_partkey") % 5 == i) | (F.col("p_partkey") % 7 == 0)).select("value").write.option("compression", codec).text(path)
        fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(jvm.Path(path)):
            old = status.getPath()
            if old.getName().endswith(was) and was != named:
                fs.rename(old, jvm.Path(old.getParent(), old.getName().removesuffix(was) + named))
        uris.append(f"deb://{path}")
    return loading.load(spark, uris).select("name", "version", "arch", F.size("depends").alias("n_depends"))


@query(
    "SELECT p_brand AS repo, 'pkg' || p_partkey AS name, p_size || '-1' AS version, CASE WHEN p_partkey % 3 = 0 THEN 'all' ELSE 'amd64' END AS arch, p_partkey % 2 = 0 AS essential, 'src' || p_size AS source,"
    " CASE WHEN p_size % 4 = 0 THEN '' ELSE 'x (> ' || p_size || ') | y:any' || CASE WHEN p_size % 4 = 1 THEN ', z (= 1)' ELSE '' END END AS depends FROM part"
)
def control_files(spark, sf_dir):
    """Packages of all brands printed, written a folder a brand with a manifest, and read back."""
    k, size = columns()
    depends = F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("x (>> "), size, F.lit(") | y:any"), F.when(size % 4 == 1, ", z (= 1)").otherwise("")))
    made = F.concat(
        F.lit("Package: pkg"), k, F.lit("\nVersion: "), size, F.lit("-1\nArchitecture: "), F.when(k % 3 == 0, "all").otherwise("amd64"), F.when(k % 2 == 0, "\nEssential: yes").otherwise(""),
        F.lit("\nSource: src"), size, F.lit("\nDepends: "), depends,
    )
    brands = parts(spark, sf_dir).select(F.concat(F.lit("pkg"), k).alias("name"), F.col("p_brand").alias("repo"), k)
    typed = stanzas.debian_packages(parts(spark, sf_dir).select(stanzas.fields(made).alias("fields"))).join(brands, "name")
    path = new_path(spark, "control")
    documents.write_documents(documents.control_stanzas(typed, "repo", "p_partkey"), path, ("p_partkey",))
    if not documents.damaged(spark, path).isEmpty():
        raise OSError("written documents differ from their manifest")
    back = documents.read_documents(spark, path).select("repo", stanzas.fields(F.col("stanza")).alias("fields"))
    again = stanzas.debian_packages(back).join(back.select(F.col("fields")["Package"].alias("name"), "repo"), "name")
    return again.select("repo", "name", "version", "arch", "essential", "source", names.print_formula(F.col("depends")).alias("depends"))
