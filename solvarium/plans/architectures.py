"""Packages of several architectures, made from the parts in blocks of 50, and their translation with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from solvarium.functions import names
from solvarium.operators import translate

QUERIES: dict = {}
SQL: dict = {}

_SQL = """
WITH a(a) AS (VALUES ('amd64'), ('i386')),
p AS (SELECT p_partkey AS k, p_size AS s, p_partkey // 50 AS repo, 'n' || p_partkey % 7 AS name, 2 * row_number() OVER (ORDER BY p_partkey) AS num,
  CASE p_partkey % 4 WHEN 0 THEN 'all' WHEN 2 THEN 'i386' ELSE 'amd64' END AS arch, CASE p_partkey % 4 WHEN 2 THEN 'i386' ELSE 'amd64' END AS q,
  CASE p_size % 5 WHEN 1 THEN 'same' WHEN 2 THEN 'foreign' WHEN 3 THEN 'allowed' ELSE 'no' END AS multi FROM part),
d AS (SELECT p.*, 0 AS alt, 'n' || (k + 1) % 7 AS o, CASE s % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'native' WHEN 2 THEN 'i386' END AS ann, CASE WHEN s % 2 = 0 THEN '>=' END AS op FROM p
  UNION ALL SELECT p.*, 1, 'v' || k % 3, NULL, NULL FROM p),
v AS (SELECT p.*, 'v' || s % 3 AS o, CASE WHEN s % 4 = 0 THEN '=' END AS op FROM p WHERE s % 2 = 0),
c AS (SELECT p.*, 'n' || (k + s % 3) % 7 AS o, CASE WHEN s % 3 = 0 THEN '<' END AS op FROM p UNION ALL SELECT p.*, 'v' || k % 3, NULL FROM p WHERE s % 7 < 4),
vf AS (SELECT v.*, o || ':' || CASE WHEN multi = 'foreign' THEN a ELSE q END AS f FROM v, a UNION ALL SELECT v.*, o FROM v WHERE multi = 'allowed'),
m AS (SELECT c.*, o = name OR (op IS NULL AND EXISTS (SELECT 1 FROM v WHERE v.k = c.k AND v.o = c.o)) AS mine, EXISTS (SELECT 1 FROM p WHERE p.repo = c.repo AND p.name = c.o) AS real FROM c),
kept AS (SELECT repo, k, num, o, op FROM m WHERE multi <> 'same' OR (NOT mine AND (real OR op IS NULL))
  UNION ALL SELECT m.repo, m.k, m.num, v.name, NULL FROM m JOIN v ON v.repo = m.repo AND v.o = m.o AND v.name <> m.name WHERE m.multi = 'same' AND m.mine AND NOT m.real),
"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = _SQL + sql
        return f

    return add


def universe(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("string")
    version = k.cast("string")

    def atom(name, arch=none, op=none):
        return F.struct(name.alias("name"), arch.alias("arch"), op.alias("op"), F.when(op.isNotNull(), version).alias("version"))

    n, v = (lambda x: F.concat(F.lit("n"), x % 7)), (lambda x: F.concat(F.lit("v"), x % 3))
    first = atom(n(k + 1), F.when(s % 4 == 0, "any").when(s % 4 == 1, "native").when(s % 4 == 2, "i386"), F.when(s % 2 == 0, ">="))
    fights = F.array(F.array(atom(n(k + s % 3), op=F.when(s % 3 == 0, "<"))), F.when(s % 7 < 4, F.array(atom(v(k)))))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.floor(k / 50).alias("repo"),
        n(k).alias("name"),
        version.alias("version"),
        F.when(k % 4 == 0, "all").when(k % 4 == 2, "i386").otherwise("amd64").alias("arch"),
        F.when(s % 5 == 1, "same").when(s % 5 == 2, "foreign").when(s % 5 == 3, "allowed").otherwise("no").alias("multiarch"),
        F.lit(False).alias("installed"),
        F.lit(False).alias("essential"),
        F.lit("s").alias("source"),
        F.lit("1").alias("source_version"),
        F.array().cast(names.ATOMS).alias("pre_depends"),
        F.array(F.array(first, atom(v(k)))).cast(names.ATOMS).alias("depends"),
        F.array_compact(fights).cast(names.ATOMS).alias("conflicts"),
        F.array().cast(names.ATOMS).alias("breaks"),
        F.when(s % 2 == 0, F.array(F.array(atom(v(s), op=F.when(s % 4 == 0, "="))))).cast(names.ATOMS).alias("provides"),
    )
    return translate.debian(p, F.col("repo"), "amd64", ("i386",))


def said(u, atoms):
    """Atoms by the package's version in place of its number."""
    return atoms.join(u.packages.select("repo", "uid", F.col("version").cast("long").alias("k")), ["repo", "uid"]).drop("repo", "uid")


@query(
    " x AS (SELECT repo, k, num, alt, o, op, CASE ann WHEN 'any' THEN o WHEN 'native' THEN o || ':amd64' WHEN 'i386' THEN o || ':i386' ELSE o || ':' || q END AS f FROM d)"
    " SELECT k, alt, f AS name, coalesce(op, 'any') AS op, CASE WHEN op IS NULL THEN 0 ELSE num END AS ver FROM x"
    " UNION ALL SELECT k, alt, CASE WHEN op IS NULL THEN '--virtual-' ELSE '--virtual--versioned-' END || f, coalesce(op, 'any'), CASE WHEN op IS NULL THEN 0 ELSE num END FROM x SEMI JOIN v USING (repo, o)"
)
def multiarch_dependencies(spark, sf_dir):
    u = universe(spark, sf_dir)
    return said(u, u.deps).select("k", "alt", "name", "op", "ver")


@query(
    " x AS (SELECT repo, k, num, o, op, o || ':' || a AS f FROM kept, a)"
    " SELECT k, name || ':' || q AS name, 'any' AS op, 0 AS ver FROM p UNION SELECT k, name, 'any', 0 FROM p WHERE multi <> 'same' UNION SELECT k, name || ':' || a, '!=', num FROM p, a WHERE multi = 'same' AND a <> arch"
    " UNION SELECT k, f, coalesce(op, 'any'), CASE WHEN op IS NULL THEN 0 ELSE num END FROM x"
    " UNION SELECT k, CASE WHEN op IS NULL THEN '--virtual-' ELSE '--virtual--versioned-' END || f, coalesce(op, 'any'), CASE WHEN op IS NULL THEN 0 ELSE num END FROM x SEMI JOIN v USING (repo, o)"
)
def multiarch_conflicts(spark, sf_dir):
    u = universe(spark, sf_dir)
    return said(u, u.confs).select("k", "name", "op", "ver")


@query(
    " x AS (SELECT 1)"
    " SELECT k, name || ':' || q AS name, num AS ver FROM p UNION SELECT k, name, NULL FROM p UNION SELECT k, name || ':' || a, num FROM p, a WHERE multi = 'foreign' AND a <> arch UNION SELECT k, name || ':any', NULL FROM p WHERE multi = 'allowed'"
    " UNION SELECT k, '--virtual-' || f, NULL FROM vf UNION SELECT k, '--virtual--versioned-' || f, num FROM vf WHERE op IS NOT NULL"
)
def multiarch_provides(spark, sf_dir):
    u = universe(spark, sf_dir)
    return said(u, u.provs).select("k", "name", "ver")
