"""Version orders as sort keys, so that Catalyst can compare, rank and join on plain columns.

debian_key(): epoch, upstream and revision, each as pairs of a non-digit and a digit run. In the non-digit run `~` sorts
before the end, the end before letters, letters before other signs; digit runs compare as numbers, empty as zero. The
key's byte order is that order: signs move above letters, a digit run is preceded by its length without leading zeros.
ASCII versions, digit runs up to 120 digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.plans.lineage import cut

_SIGNS = "".join(chr(c) for c in range(33, 126) if not chr(c).isalnum())
#: The tilde below all, signs above letters.
_FROM, _TO = "~" + _SIGNS, "\x01" + "".join(chr(0x80 | ord(c)) for c in _SIGNS)


def epoch(v: Column) -> Column:
    return F.when(v.contains(":"), F.substring_index(v, ":", 1)).otherwise(F.lit(""))


def _rest(v: Column) -> Column:
    return F.regexp_replace(v, "^[^:]*:", "")


def revision(v: Column) -> Column:
    return F.when(_rest(v).contains("-"), F.substring_index(_rest(v), "-", -1)).otherwise(F.lit(""))


def upstream(v: Column) -> Column:
    return F.regexp_replace(_rest(v), "-[^-]*$", "")


def binnmu(v: Column) -> Column:
    """The `bN` of a `+bN` suffix, or null."""
    return F.nullif(F.regexp_extract(v, r"\+(b[0-9]+)$", 1), F.lit(""))


def strip_epoch_binnmu(v: Column) -> Column:
    return F.regexp_replace(_rest(v), r"\+b[0-9]+$", "")


def _part_key(s: Column) -> Column:
    runs = F.arrays_zip(
        F.regexp_extract_all(s, F.lit("([^0-9]*)([0-9]*)"), 1).alias("t"), F.regexp_extract_all(s, F.lit("([^0-9]*)([0-9]*)"), 2).alias("d")
    )
    number = lambda x: F.regexp_replace(x["d"], "^0+", "")
    full = F.filter(runs, lambda x, i: (i == 0) | (x["t"] != "") | (number(x) != ""))
    one = lambda x: F.concat(F.translate(x["t"], _FROM, _TO), F.lit("\x02"), F.char(F.length(number(x)) + 3), number(x))
    return F.concat(F.array_join(F.transform(full, one), ""), F.lit("\x02"))


def debian_key(v: Column) -> Column:
    return F.concat(_part_key(epoch(v)), _part_key(upstream(v)), _part_key(revision(v)))


SEMVER = r"^[v=\s]*([0-9]+|[xX*])(?:\.([0-9]+|[xX*])?)?(?:\.([0-9]+|[xX*])?)?(?:-?([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+([0-9A-Za-z.-]+))?\s*$"


def semver_part(v: Column, k: int) -> Column:
    """1 major, 2 minor, 3 patch, 4 pre-release, 5 build; empty where it is not there."""
    return F.regexp_extract(v, SEMVER, k)


def semver_key(v: Column) -> Column:
    """A struct that sorts as semver does, build left out: a release is above its pre-releases; in pre-releases a list
    that goes on is above one that ends, before elements are looked at, and numbers are below words."""
    number = lambda k: F.coalesce(semver_part(v, k).try_cast("long"), F.lit(0))
    pre = semver_part(v, 4)
    items = F.split(pre, "[.]")
    element = F.transform(
        items,
        lambda x, i: F.struct((i < F.size(items) - 1).alias("goes_on"), (~x.rlike("^[0-9]+$")).alias("word"), F.coalesce(F.when(x.rlike("^[0-9]+$"), x.try_cast("long")), F.lit(0)).alias("n"), x.alias("s")),
    )
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), F.when(pre != "", element).alias("pre"))


def dense_numbers(df: DataFrame, key: str, number: str = "number", step: int = 1, first: int = 1) -> DataFrame:
    """`df` with `number`: first, first + step, ... by the distinct values of `key` in order, nulls none.

    Distinct keys are range-partitioned and numbered within their partition; partition sizes give the offsets. Unlike a
    window over all rows, no task sees more than its range.
    """
    keys = df.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    keys = cut(keys.repartitionByRange("__k").sortWithinPartitions("__k").withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(keys.groupBy(part.alias("p")).count().collect())  # one row a partition
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "p long, before long")
    numbered = keys.withColumn("p", part).join(F.broadcast(offsets), "p").select("__k", ((F.col("before") + at) * step + first).alias(number))
    return df.join(numbered, F.col(key) == F.col("__k"), "left").drop("__k")


def numbers_per_name(df: DataFrame, name: str, key: str, number: str = "number", first: int = 1) -> DataFrame:
    """Dense numbers of versions within each name."""
    from pyspark.sql import Window

    return df.withColumn(number, F.dense_rank().over(Window.partitionBy(name).orderBy(key)) + (first - 1))


def strip_epoch(v: Column) -> Column:
    return _rest(v)


def decompose(v: Column) -> Column:
    """struct(epoch, upstream, revision, binnmu, native): a version in its parts, empty where one is not there."""
    bare = F.regexp_replace(v, r"\+b[0-9]+$", "")
    return F.struct(
        epoch(v).alias("epoch"), upstream(bare).alias("upstream"), revision(bare).alias("revision"), F.coalesce(binnmu(v), F.lit("")).alias("binnmu"), (revision(bare) == "").alias("native")
    )


def compose(d: Column) -> Column:
    """The inverse of decompose()."""
    piece = lambda name, before, after="": F.when(d[name] == "", "").otherwise(F.concat(F.lit(before), d[name], F.lit(after)))
    return F.concat(piece("epoch", "", ":"), d["upstream"], piece("revision", "-"), piece("binnmu", "+"))


def _rpm_part(s: Column) -> Column:
    """Runs of digits and of letters; whatever else only divides. Digits are above letters, more runs above fewer."""
    runs = F.regexp_extract_all(s, F.lit("([0-9]+|[A-Za-z]+)"), F.lit(0))
    number = lambda x: F.regexp_replace(x, "^0+", "")
    digit = lambda x: x.rlike("^[0-9]")
    return F.transform(runs, lambda x: F.struct(digit(x).alias("digit"), F.when(digit(x), F.length(number(x))).otherwise(0).alias("n"), F.when(digit(x), number(x)).otherwise(x).alias("s")))


def rpm_key(v: Column) -> Column:
    """A struct that sorts as epoch:version-release does; no epoch is 0."""
    number = F.when(v.contains(":"), F.substring_index(v, ":", 1).try_cast("long"))
    rest = _rest(v)
    return F.struct(F.coalesce(number, F.lit(0)).alias("epoch"), _rpm_part(upstream(rest)).alias("version"), _rpm_part(revision(rest)).alias("release"))


def rpm_equal(a: Column, b: Column) -> Column:
    """Whether two versions are the same one; a release that is left out equals any."""
    x, y = rpm_key(a), rpm_key(b)
    open_ = (revision(_rest(a)) == "") | (revision(_rest(b)) == "")
    return (x["epoch"] == y["epoch"]) & (x["version"] == y["version"]) & (open_ | (x["release"] == y["release"]))


def rpm_overlaps(op: Column, key: Column, other_op: Column, other_key: Column) -> Column:
    """Whether two ranges have a version in common; versions as rpm_key(), one without a release stands for all of them."""
    bare = (F.size(key["release"]) == 0) | (F.size(other_key["release"]) == 0)
    seen = lambda k: F.struct(k["epoch"].alias("epoch"), k["version"].alias("version"), F.when(bare, F.slice(k["release"], 1, 0)).otherwise(k["release"]).alias("release"))
    x, y = seen(key), seen(other_key)
    up, down, closed = (lambda o, ops=ops: o.isin(*ops) for ops in ((">", ">="), ("<", "<="), ("=", ">=", "<=")))
    same_way = (up(op) & up(other_op)) | (down(op) & down(other_op))
    return same_way | ((x == y) & closed(op) & closed(other_op)) | ((x < y) & (up(op) | down(other_op))) | ((x > y) & (down(op) | up(other_op)))


def range_text(kind: Column, lo: Column, hi: Column) -> Column:
    """A range as text: `= v`, `a < . < b`, `v < .` and `. < v`."""
    return (
        F.when(kind == "eq", F.concat(F.lit("= "), lo)).when(kind == "in", F.concat(lo, F.lit(" < . < "), hi)).when(kind == "hi", F.concat(lo, F.lit(" < ."))).otherwise(F.concat(F.lit(". < "), hi))
    )
