"""Name coding, architecture matching, arch and profile selection, and dependency grammar as column functions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ATOMS = "array<array<struct<name:string,arch:string,op:string,version:string>>>"


def encode(name: Column) -> Column:
    """Characters other than letters, digits and @/+().- become %xx, byte by byte."""
    return F.array_join(
        F.transform(F.split(name, ""), lambda c: F.when(c.rlike("^[a-zA-Z0-9@/+().-]*$"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "utf-8"))), "(..)", "%$1"))), ""
    )


def decode(name: Column) -> Column:
    """The inverse of encode()."""
    return F.url_decode(F.regexp_replace(name, r"\+", "%2B"))


# The Debian architecture tables (cpu names; tuple of abi, libc, os, cpu and the architecture's name).
CPUS = (
    "i386 ia64 alpha amd64 armeb arm arm64 avr32 hppa m32r m68k mips mipsel mipsr6 mipsr6el mips64 mips64el mips64r6 "
    "mips64r6el nios2 or1k powerpc powerpcel ppc64 ppc64el s390 s390x sh3 sh3eb sh4 sh4eb sparc sparc64 tilegx"
).split()
TUPLES = """
eabi-uclibc-linux-arm uclibc-linux-armel
base-uclibc-linux-<cpu> uclibc-linux-<cpu>
eabihf-musl-linux-arm musl-linux-armhf
base-musl-linux-<cpu> musl-linux-<cpu>
eabihf-gnu-linux-arm armhf
eabi-gnu-linux-arm armel
abin32-gnu-linux-mips64r6el mipsn32r6el
abin32-gnu-linux-mips64r6 mipsn32r6
abin32-gnu-linux-mips64el mipsn32el
abin32-gnu-linux-mips64 mipsn32
abi64-gnu-linux-mips64r6el mips64r6el
abi64-gnu-linux-mips64r6 mips64r6
abi64-gnu-linux-mips64el mips64el
abi64-gnu-linux-mips64 mips64
spe-gnu-linux-powerpc powerpcspe
x32-gnu-linux-amd64 x32
base-gnu-linux-<cpu> <cpu>
eabihf-gnu-kfreebsd-arm kfreebsd-armhf
base-gnu-kfreebsd-<cpu> kfreebsd-<cpu>
base-gnu-knetbsd-<cpu> knetbsd-<cpu>
base-gnu-kopensolaris-<cpu> kopensolaris-<cpu>
base-gnu-hurd-<cpu> hurd-<cpu>
base-bsd-dragonflybsd-<cpu> dragonflybsd-<cpu>
base-bsd-freebsd-<cpu> freebsd-<cpu>
base-bsd-openbsd-<cpu> openbsd-<cpu>
base-bsd-netbsd-<cpu> netbsd-<cpu>
base-bsd-darwin-<cpu> darwin-<cpu>
base-sysv-aix-<cpu> aix-<cpu>
base-sysv-solaris-<cpu> solaris-<cpu>
eabi-uclibc-uclinux-arm uclinux-armel
base-uclibc-uclinux-<cpu> uclinux-<cpu>
base-tos-mint-m68k mint-m68k
base-gnu-linux-<cpu> linux-<cpu>
"""


@cache
def architectures() -> dict[str, str]:
    """Tuple by architecture name; later lines win, as does the last cpu."""
    out = {}
    for line in TUPLES.strip().splitlines():
        parts, arch = line.split()
        for cpu in CPUS if "<cpu>" in line else [""]:
            out[arch.replace("<cpu>", cpu)] = parts.replace("<cpu>", cpu)
    return out


def architecture_table(spark: SparkSession) -> DataFrame:
    """(arch, parts): a table of fixed size."""
    return spark.createDataFrame([(a, t.split("-")) for a, t in architectures().items()], "arch string, parts array<string>")


def match_architectures(df: DataFrame, pattern: str, real: str, out: str = "matches") -> DataFrame:
    """`df` with whether the architecture in `real` is one that `pattern` names: itself, any, all, or a wildcard of two
    to four parts that are compared from the right with the architecture's tuple."""
    table = architecture_table(df.sparkSession)
    r = F.broadcast(table.select(F.col("arch").alias("__r"), F.col("parts").alias("__rp")))
    a = F.broadcast(table.select(F.col("arch").alias("__a"), F.col("parts").alias("__ap")))
    joined = df.join(r, F.col(real) == F.col("__r"), "left").join(a, F.col(pattern) == F.col("__a"), "left")
    said = F.split(F.col(pattern), "-")
    wild = F.when(F.array_contains(said, "any") & (F.size(said) <= 4), F.concat(F.array_repeat(F.lit("any"), 4 - F.size(said)), said))
    # A part that is missing on the left is any; of two parts that end in any, the first names the system.
    wild = F.when((F.size(said) == 3) & (said[1] == "any") & (said[0] != "any"), F.array(F.lit("any"), said[0], F.lit("any"), said[2])).otherwise(wild)
    wild = F.coalesce(wild, F.when(~F.array_contains(said, "any"), F.col("__ap")))
    fits = F.forall(F.arrays_zip(wild.alias("w"), F.col("__rp").alias("r")), lambda x: (x["w"] == "any") | (x["w"] == x["r"]))
    same = (F.col(pattern) == F.col(real)) | F.col(pattern).isin("any", "all")
    return joined.withColumn(out, same | F.coalesce(fits, F.lit(False))).drop("__r", "__rp", "__a", "__ap")


def profile_matches(formula: Column, active: Column) -> Column:
    """A disjunction of conjunctions of (wanted, profile); an empty formula always holds."""
    return (F.size(formula) == 0) | F.exists(formula, lambda c: F.forall(c, lambda p: p["wanted"] == F.array_contains(active, p["profile"])))


_ATOM = r"^\s*([^\s:(\[<]+)(?::([^\s(\[<]+))?\s*(?:\(\s*(<<|<=|<|>>|>=|>|=|!=)?\s*([^\s)]*)\s*\))?.*$"


def parse_formula(text: Column) -> Column:
    """`a (>= 1) | b:any, c` as an array of clauses, each an array of alternatives; << and >> are strict."""

    def atom(t: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(t, _ATOM, k), F.lit(""))
        op = F.regexp_extract(t, _ATOM, 3)
        op = F.when(op == "<<", "<").when(op == ">>", ">").otherwise(F.nullif(op, F.lit("")))
        return F.struct(part(1).alias("name"), part(2).alias("arch"), op.alias("op"), part(4).alias("version"))

    clauses = F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.transform(clauses, lambda c: F.transform(F.split(c, r"\|"), atom)).cast(ATOMS)


def print_formula(formula: Column) -> Column:
    def one(a: Column) -> Column:
        tail = F.when(a["op"].isNotNull(), F.concat(F.lit(" ("), a["op"], F.lit(" "), a["version"], F.lit(")"))).otherwise(F.lit(""))
        return F.concat(a["name"], F.when(a["arch"].isNotNull(), F.concat(F.lit(":"), a["arch"])).otherwise(F.lit("")), tail)

    return F.array_join(F.transform(formula, lambda c: F.array_join(F.transform(c, one), " | ")), ", ")


def npm_range(text: Column) -> Column:
    """One npm comparator as an array of (op, version): exact, partial and x versions, tilde, caret, hyphen, operators."""
    t = F.trim(F.regexp_replace(text, r"[\t\n]", " "))
    piece = r"[v=\s]*([0-9]+|[xX*])?(?:\.([0-9]+|[xX*])?)?(?:\.([0-9]+|[xX*])?)?(-[0-9A-Za-z.-]+)?(?:\+\S*)?"
    hyphen = r"^\s*" + piece + r"\s+-\s+" + piece + r"\s*$"
    kind = F.when(t.rlike(r"\S\s+-\s+\S"), "-").otherwise(F.regexp_extract(t, r"^(\^|~|>=|<=|>|<)?", 1))
    body = F.regexp_replace(t, r"^(\^|~|>=|<=|>|<)", "")
    one = F.array(*[F.regexp_extract(body, "^" + piece + r"\s*$", k) for k in (1, 2, 3, 4)])
    two = F.array(*[F.regexp_extract(t, hyphen, k) for k in range(1, 9)])
    # The pieces are bound once, by a transform over an array of one.
    given = F.struct(kind.alias("kind"), F.when(kind == "-", two).otherwise(one).alias("p"))
    return F.transform(F.array(given), lambda g: _npm_atoms(g["kind"], g["p"]))[0]


def _npm_atoms(kind: Column, p: Column) -> Column:
    wild = lambda k: p[k].isin("", "x", "X", "*")
    num = lambda k: F.when(wild(k), F.lit("0")).otherwise(p[k])
    up = lambda k: (num(k).cast("long") + 1).cast("string")
    ver = lambda *parts: F.concat_ws(".", *parts)
    atom = lambda op, v: F.struct(F.lit(op).alias("op"), v.alias("version"))
    span = lambda a, b: F.array(atom(">=", a), atom("<", b))
    zero, any_ = F.lit("0"), F.array(atom(">=", F.lit("0.0.0")))
    bare = ver(num(0), num(1), num(2))
    low = F.concat(bare, p[3])
    next_major, next_minor = ver(up(0), zero, zero), ver(num(0), up(1), zero)
    exact = F.when(wild(0), any_).when(wild(1), span(bare, next_major)).when(wild(2), span(bare, next_minor)).otherwise(F.array(atom("=", low)))
    tilde = F.when(wild(1), span(low, next_major)).otherwise(span(low, next_minor))
    top = (
        F.when(num(0) != "0", next_major)
        .when(wild(1), F.lit("1.0.0"))
        .when(num(1) != "0", next_minor)
        .when((~wild(2)) & (num(2) != "0"), ver(zero, zero, up(2)))
        .otherwise(F.lit("0.1.0"))
    )
    caret = F.when(wild(0), any_).otherwise(span(bare, top))
    side = lambda k: F.concat(ver(num(k), num(k + 1), num(k + 2)), p[k + 3])
    out = F.when(kind == "-", span(side(0), side(4))).when(kind == "^", caret).when(kind == "~", tilde)
    for op in (">=", "<=", ">", "<"):
        out = out.when(kind == op, F.array(atom(op, low)))
    return out.otherwise(exact)


BUILD_ATOMS = (
    "array<array<struct<name:string,arch:string,op:string,version:string,archs:array<struct<wanted:boolean,name:string>>,profiles:array<array<struct<wanted:boolean,profile:string>>>>>>"
)


def parse_build_formula(text: Column) -> Column:
    """As parse_formula(), where an alternative may end in `[arch !arch]` and in `<profile !profile>` groups."""

    def words(t: Column, name: str) -> Column:
        said = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
        return F.transform(said, lambda w: F.struct((~w.startswith("!")).alias("wanted"), F.regexp_replace(w, "^!", "").alias(name)))

    def atom(t: Column) -> Column:
        part = lambda k: F.nullif(F.regexp_extract(t, _ATOM, k), F.lit(""))
        op = F.regexp_extract(t, _ATOM, 3)
        op = F.when(op == "<<", "<").when(op == ">>", ">").otherwise(F.nullif(op, F.lit("")))
        groups = F.regexp_extract_all(F.regexp_replace(t, r"\([^)]*\)", ""), F.lit("<([^>]*)>"), F.lit(1))
        archs = words(F.regexp_extract(t, r"\[([^\]]*)\]", 1), "name")
        return F.struct(part(1).alias("name"), part(2).alias("arch"), op.alias("op"), part(4).alias("version"), archs.alias("archs"), F.transform(groups, lambda g: words(g, "profile")).alias("profiles"))

    clauses = F.filter(F.transform(F.split(text, ","), lambda c: F.trim(c)), lambda c: c != "")
    return F.transform(clauses, lambda c: F.transform(F.split(c, r"\|"), atom)).cast(BUILD_ATOMS)


def dnf_to_cnf(dnf: Column, kind: str) -> Column:
    """A disjunction of conjunctions as a conjunction of disjunctions: one clause for each way to take an atom of every
    conjunction. kind: SQL type of an atom."""
    start = F.array(F.array().cast(f"array<{kind}>"))
    return F.reduce(dnf, start, lambda acc, conj: F.flatten(F.transform(acc, lambda c: F.transform(conj, lambda a: F.array_append(c, a)))))


NPM_ATOM = "struct<op:string,version:string>"


def npm_alternatives(text: Column) -> Column:
    """An npm range as a disjunction (`||`) of conjunctions (comparators apart by blanks) of (op, version)."""
    tight = F.regexp_replace(F.trim(text), r"(\^|~|>=|<=|>|<|=)\s+", "$1")
    hyphens = F.regexp_replace(tight, r"\s+-\s+", "\x1f")
    one = lambda c: F.flatten(F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), lambda w: npm_range(F.replace(w, F.lit("\x1f"), F.lit(" - ")))))
    said = F.transform(F.split(hyphens, r"\|\|"), lambda c: F.when(F.trim(c) == "", npm_range(F.lit("*"))).otherwise(one(c)))
    return said.cast(f"array<array<{NPM_ATOM}>>")


def npm_formula(text: Column) -> Column:
    """An npm range as clauses of (op, version)."""
    return dnf_to_cnf(npm_alternatives(text), NPM_ATOM)


def parse_request(token: Column) -> Column:
    """struct(action, name, op, version, suite) of `name`, `+name`, `-name`, `name-`, `name=version` or `name/suite`."""
    pattern = r"^([+-]?)([^=/\s]+?)([+-]?)(?:=(\S+)|/(\S+))?$"
    part = lambda k: F.nullif(F.regexp_extract(token, pattern, k), F.lit(""))
    action = F.when((part(1) == "-") | (part(3) == "-"), "remove").otherwise("install")
    return F.struct(action.alias("action"), part(2).alias("name"), F.when(part(4).isNotNull(), "=").alias("op"), part(4).alias("version"), part(5).alias("suite"))


def real_name(name: Column) -> Column:
    """The name behind a virtual twin or a source's dummy package, decoded."""
    return decode(F.regexp_replace(name, "^(--virtual--versioned-|--virtual-|src:)", ""))


def truth(text: Column) -> Column:
    """Yes, yes, True, true, 1 and their opposites; anything else is null."""
    return F.when(F.lower(text).isin("yes", "true", "1"), True).when(F.lower(text).isin("no", "false", "0"), False)


def on_hold(status: Column) -> Column:
    return F.split(F.trim(status), r"\s+")[0] == "hold"


def rpm_atoms(texts: Column) -> Column:
    """Array of struct(name, op, version) of texts such as `a`, `a[*]`, `a[== 1-2]` and `a[>= 2]`."""

    def one(t: Column) -> Column:
        op = F.regexp_extract(t, r"\[\s*(==|=|>=|<=|<|>)", 1)
        version = F.nullif(F.regexp_extract(t, r"\[\s*[<>=]+\s*([^\]\s]+)\s*\]", 1), F.lit(""))
        return F.struct(F.regexp_extract(t, r"^([^\[]*)", 1).alias("name"), F.when(version.isNotNull(), F.replace(op, F.lit("=="), F.lit("="))).alias("op"), version.alias("version"))

    return F.transform(texts, one)


def criteria_field(field: Column, pattern: Column, sep: str = "=") -> Column:
    """The property that stands for a match of `pattern` in `field`: x-<field in lower case, other signs as dashes>-<first
    eight hex digits of the MD5 of field, sep and pattern>."""
    bare = F.regexp_replace(F.lower(field), "[^0-9a-z-]", "-")
    return F.concat(F.lit("x-"), bare, F.lit("-"), F.substring(F.md5(F.concat(field, F.lit(sep), pattern)), 1, 8))
