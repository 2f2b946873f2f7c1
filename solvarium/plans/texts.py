"""Queries over versions, names, formulas, stanzas and clusters made from the parts table."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.functions import names, versions
from solvarium.operators import evolution
from solvarium.sources import stanzas

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def version_strings(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    suffix = F.when(size % 5 == 0, "~rc1").when(size % 5 == 1, "+b2").otherwise("")
    text = F.concat(F.when(size % 7 == 0, "1:").otherwise(""), size % 10, F.lit("."), key % 30, suffix, F.lit("-"), key % 4)
    return parts(spark, sf_dir).select("p_partkey", "p_brand", text.alias("version"))


@query(
    "SELECT p_partkey, dense_rank() OVER (ORDER BY (p_size % 7 = 0)::INT, p_size % 10, p_partkey % 30, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, p_partkey % 4) AS number FROM part"
)
def version_dense_rank(spark, sf_dir):
    rows = version_strings(spark, sf_dir).withColumn("key", versions.debian_key(F.col("version")))
    return versions.dense_numbers(rows, "key").select("p_partkey", "number")


@query(
    "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY (p_size % 7 = 0)::INT, p_size % 10, p_partkey % 30, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END, p_partkey % 4) AS number FROM part"
)
def version_rank_per_name(spark, sf_dir):
    rows = version_strings(spark, sf_dir).withColumn("key", versions.debian_key(F.col("version")))
    return versions.numbers_per_name(rows, "p_brand", "key").select("p_partkey", F.col("number").cast("long").alias("number"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '1' ELSE '' END AS epoch, (p_size % 10) || '.' || (p_partkey % 30) || CASE p_size % 5 WHEN 0 THEN '~rc1' WHEN 1 THEN '+b2' ELSE '' END AS upstream, CAST(p_partkey % 4 AS VARCHAR) AS revision FROM part"
)
def version_parts(spark, sf_dir):
    v = F.col("version")
    return version_strings(spark, sf_dir).select("p_partkey", versions.epoch(v).alias("epoch"), versions.upstream(v).alias("upstream"), versions.revision(v).alias("revision"))


@query(
    ", ".join(
        [
            "WITH v AS (SELECT DISTINCT p_brand AS name, p_size AS ver FROM part)",
            "n AS (SELECT name, ver, lead(ver) OVER w AS nx, lag(ver) OVER w AS pv FROM v WINDOW w AS (PARTITION BY name ORDER BY ver))",
        ]
    )
    + " SELECT name, 'eq' AS kind, ver AS lo, ver AS hi FROM n UNION ALL SELECT name, 'in', ver, nx FROM n WHERE nx IS NOT NULL"
    " UNION ALL SELECT name, 'hi', ver, NULL FROM n WHERE nx IS NULL UNION ALL SELECT name, 'lo', NULL, ver FROM n WHERE pv IS NULL"
)
def version_ranges(spark, sf_dir):
    return evolution.ranges(parts(spark, sf_dir).select(F.col("p_brand").alias("name"), F.col("p_size").alias("ver")))


@query(
    "WITH c AS (SELECT DISTINCT p_brand AS name, CASE p_partkey % 3 WHEN 0 THEN '>=' WHEN 1 THEN '<' ELSE '=' END AS op, 1 + p_size % 6 AS ver FROM part),"
    " p AS (SELECT name, unnest(range(1, 2 * max(ver) + 2)) AS point FROM c GROUP BY name),"
    " v AS (SELECT name, point, string_agg(CASE op WHEN '>=' THEN point >= 2 * ver WHEN '<' THEN point < 2 * ver ELSE point = 2 * ver END::INT::VARCHAR, '' ORDER BY op, ver) AS x FROM p JOIN c USING (name) GROUP BY ALL)"
    " SELECT name, CAST(max(point) AS INT) AS point, string_agg(point::VARCHAR, ',' ORDER BY point) AS equivalents FROM v GROUP BY name, x"
)
def discriminants(spark, sf_dir):
    op = F.when(F.col("p_partkey") % 3 == 0, ">=").when(F.col("p_partkey") % 3 == 1, "<").otherwise("=")
    c = parts(spark, sf_dir).select(F.col("p_brand").alias("name"), op.alias("op"), (1 + F.col("p_size") % 6).alias("ver"))
    return evolution.discriminants(c).withColumn("equivalents", F.array_join("equivalents", ","))


@query(
    "SELECT p_brand AS source, p_size % 5 AS source_ver, CAST(p_partkey % 3 AS VARCHAR) AS norm, count(*) AS packages, min(p_partkey) AS lowest, max(p_partkey) AS highest, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members FROM part GROUP BY ALL"
)
def source_clusters(spark, sf_dir):
    p = parts(spark, sf_dir)
    made = F.concat(F.lit("1:"), F.col("p_partkey") % 3, F.lit("+b"), F.col("p_size"))
    rows = p.select(F.col("p_brand").alias("source"), (F.col("p_size") % 5).alias("source_ver"), versions.strip_epoch_binnmu(made).alias("norm"), F.col("p_partkey").alias("key"))
    return evolution.clusters(rows).withColumn("members", F.array_join("members", ","))


@query(
    "SELECT p_partkey, p_name AS name, array_to_string(list_transform(string_split(p_name || '_' || p_type || '|é', ''), lambda c: CASE WHEN regexp_full_match(c, '[a-zA-Z0-9@/+().-]') THEN c ELSE regexp_replace(lower(hex(encode(c))), '(..)', '%\\1', 'g') END), '') AS encoded, p_name || '_' || p_type || '|é' AS decoded FROM part"
)
def name_encoding(spark, sf_dir):
    raw = F.concat("p_name", F.lit("_"), "p_type", F.lit("|é"))
    return parts(spark, sf_dir).select("p_partkey", F.col("p_name").alias("name"), names.encode(raw).alias("encoded"), names.decode(names.encode(raw)).alias("decoded"))


_PATTERNS = ("any", "all", "linux-any", "hurd-any", "any-amd64", "any-arm", "any-any", "amd64", "armhf", "linux-amd64", "kfreebsd-any", "any-i386")
_REALS = {"amd64": "linux amd64", "i386": "linux i386", "armhf": "linux arm", "hurd-i386": "hurd i386", "kfreebsd-amd64": "kfreebsd amd64", "x32": "linux amd64", "unlisted": ""}
_ARCH_SQL = (
    f"WITH p AS (SELECT unnest({list(_PATTERNS)!r}) AS pattern), r AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{t}')" for a, t in _REALS.items())
    + ") AS t(arch, parts)) SELECT n_nationkey, pattern, arch, pattern IN ('any', 'all') OR pattern = arch OR (pattern = 'any-any' AND parts <> '')"
    " OR (pattern LIKE '%-any' AND parts LIKE replace(pattern, '-any', '') || ' %') OR (pattern LIKE 'any-%' AND parts LIKE '% ' || replace(pattern, 'any-', ''))"
    " OR (pattern = 'linux-amd64' AND arch = 'amd64') AS matches FROM p, r, nation"
)


@query(_ARCH_SQL)
def arch_matching(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", F.explode(F.array(*map(F.lit, _PATTERNS))).alias("pattern")
    ).select("*", F.explode(F.array(*map(F.lit, _REALS))).alias("arch"))
    return names.match_architectures(rows, "pattern", "arch")


@query(
    "SELECT p_partkey, clause, alt, name, op, version FROM part, LATERAL (VALUES (0, 0, 'a' || p_partkey % 9, '>=', '1.' || p_size), (0, 1, 'b' || p_size, NULL, NULL), (1, 0, 'c', '<', CAST(p_partkey AS VARCHAR))) AS t(clause, alt, name, op, version)"
)
def vpkg_parsing(spark, sf_dir):
    text = F.concat(F.lit("a"), F.col("p_partkey") % 9, F.lit(" (>= 1."), "p_size", F.lit(") | b"), "p_size", F.lit(" , c:any (<<"), "p_partkey", F.lit(")"))
    rows = parts(spark, sf_dir).select("p_partkey", names.parse_formula(text).alias("f"))
    return rows.select("p_partkey", F.posexplode("f").alias("clause", "any")).select("p_partkey", "clause", F.posexplode("any").alias("alt", "a")).select("p_partkey", "clause", "alt", "a.name", "a.op", "a.version")


@query(
    "SELECT p_partkey, t.text, t.low AS low, t.high AS high FROM part, LATERAL (SELECT p_size AS a, p_partkey % 7 AS b, p_partkey % 11 AS c), LATERAL (VALUES"
    " (a || '.' || b || '.' || c, '= ' || a || '.' || b || '.' || c, NULL), (a || '.x', '>= ' || a || '.0.0', '< ' || (a + 1) || '.0.0'),"
    " ('~' || a || '.' || b, '>= ' || a || '.' || b || '.0', '< ' || a || '.' || (b + 1) || '.0'),"
    " ('^' || a || '.' || b || '.' || c, '>= ' || a || '.' || b || '.' || c, '< ' || CASE WHEN a > 0 THEN (a + 1) || '.0.0' WHEN b > 0 THEN '0.' || (b + 1) || '.0' WHEN c > 0 THEN '0.0.' || (c + 1) ELSE '0.1.0' END),"
    " (a || '.0.0 - ' || (a + 2) || '.' || b, '>= ' || a || '.0.0', '< ' || (a + 2) || '.' || b || '.0')) AS t(text, low, high)"
)
def npm_ranges(spark, sf_dir):
    a, b, c = F.col("p_size"), F.col("p_partkey") % 7, F.col("p_partkey") % 11
    full = F.concat_ws(".", a, b, c)
    texts = F.array(full, F.concat(a, F.lit(".x")), F.concat(F.lit("~"), a, F.lit("."), b), F.concat(F.lit("^"), full), F.concat(a, F.lit(".0.0 - "), a + 2, F.lit("."), b))
    rows = parts(spark, sf_dir).select("p_partkey", F.explode(texts).alias("text")).withColumn("r", names.npm_range(F.col("text")))
    atom = lambda i: F.concat_ws(" ", F.get("r", F.lit(i))["op"], F.get("r", F.lit(i))["version"])
    return rows.select("p_partkey", "text", atom(0).alias("low"), F.nullif(atom(1), F.lit("")).alias("high"))


@query("SELECT 'pkg' || p_partkey AS name, p_size || '-1' AS version, 'all' AS arch, p_partkey % 2 = 0 AS essential, p_brand AS source, CAST(2 AS BIGINT) AS clauses, p_name || p_type AS note FROM part")
def stanza_reading(spark, sf_dir):
    text = F.concat(
        F.lit("# made\nPackage: pkg"), "p_partkey", F.lit("\nVersion: "), "p_size", F.lit("-1\nArchitecture: all\nEssential: "), F.when(F.col("p_partkey") % 2 == 0, "yes").otherwise("no"),
        F.lit("\nSource: "), "p_brand", F.lit(" (1.0)\nDepends: x (>= 1) | y,\n z\nX-Note: "), "p_name", F.lit("\n\t"), "p_type",
    )
    rows = parts(spark, sf_dir).select(stanzas.fields(text).alias("fields"))
    out = stanzas.debian_packages(rows, archs=["amd64"], extras=("X-Note",))
    return out.select("name", "version", "arch", "essential", "source", F.size("depends").cast("long").alias("clauses"), F.col("X-Note").alias("note"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS snapshot, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def snapshot_history(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("snapshot"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
