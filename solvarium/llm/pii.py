"""Surrogates for personal data, in DataFrame functions only.

Detected kinds: email, IBAN, payment card (Luhn-valid), phone, social security number, IPv4, person after a title. An
entity's surrogate comes from a keyed hash of its kind and normal form, so it is the same wherever the entity is named
(coreference), whatever its separators or case. It keeps kind and format: digits for digits, letters for letters in
their case and script, separators and country prefixes as they are, card and IBAN check digits valid. A person's title
stays as it is written, and each part of the name is an entity of its own, so `Mr. John Smith`, `Mr Smith` and
`Mrs Smith` share a surname; a given name's ending follows the title's gender, and that of a Cyrillic surname its own.
A name has any number of parts, with hyphens, apostrophes, initials and particles; particles stay, an initial moves
within its alphabet by a keyed step that its surname decides. Words of three letters or more of a person's name are
found again in the same text without a title, where they start with a capital, even if they mean something else there.

Collision checks: over all distinct entities of the table, two that would get one surrogate, or one whose surrogate is
itself an entity, take the next attempt of the hash until all are distinct. From attempt WIDEN on each attempt makes the
surrogate one letter, digit or syllable longer, so a format's code space can't run out (IPv4 addresses, which have no
longer form, have 3.7 thousand million codes; after MOST attempts the job fails with a message). Entities beyond attempt
0 are few; only documents that hold one are joined with them.

Defined cases: a null text stays null and has no entities; texts without entities come back as they are; repeated rows
get the same surrogates; an empty table gives an empty table; other columns are kept, and `entities` is replaced;
letters of scripts that SCRIPTS doesn't list become Latin ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, running, table

KEY = "solvarium"
# Titles by gender, titles of either, and particles of names.
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Signor|Sir|Господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Mme|Madame|Mlle|Señora|Sra|Doña|Signora|Госпожа"
_EITHER = "Dr|Prof|Professor|Rev"
_PARTICLES = "af|al|av|bin|bint|da|das|de|del|della|den|der|des|di|do|dos|du|el|ibn|la|le|ten|ter|van|von|y|zu|zum|zur"
_LETTER, _GAP = r"[\p{L}\p{M}]", r"[ \u00A0]"
# A word's letters go on behind an apostrophe, but for a possessive s.
_BEHIND = rf"(?:['’](?!s(?!\p{{L}})){_LETTER}++)"
_WORD = rf"\p{{Lu}}(?:{_LETTER}++{_BEHIND}*+|{_BEHIND}++|(?={_GAP}\p{{Lu}}\p{{L}}))(?:-{_LETTER}++{_BEHIND}*+)*+"
_NAMED = rf"(?:[dl]['’]|(?:{_PARTICLES}){_GAP}|[ae]l-)*+(?:\p{{Lu}}\.(?:-?\p{{Lu}}\.)*+|{_WORD})"
_TITLED = rf"(?:{_MALE}|{_FEMALE}|{_EITHER})(?:\.{_GAP}?|{_GAP})(?:(?:{_EITHER})(?:\.{_GAP}?|{_GAP}))*+"
#: Patterns by kind, tried in this order at each place; matches don't overlap.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "person": rf"(?<!\p{{L}}){_TITLED}{_NAMED}(?:(?:{_GAP}|(?<=\.)){_NAMED})*+",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: From which attempt surrogates grow, and how many there are at most.
WIDEN, MOST = 4, 64
# For each script of Unicode, the first code point and the number of its (lower-case) letters in one
# block, and the same for upper-case letters, where the script has them.
SCRIPTS = {
    "Latin": ((0x61, 26), (0x41, 26)),
    "Cyrillic": ((0x430, 32), (0x410, 32)),
    "Greek": ((0x3B1, 17), (0x391, 17)),
    "Armenian": ((0x561, 38), (0x531, 38)),
    "Georgian": ((0x10D0, 33), None),
    "Hebrew": ((0x5D0, 27), None),
    "Arabic": ((0x621, 26), None),
    "Devanagari": ((0x915, 37), None),
    "Bengali": ((0x995, 20), None),
    "Gurmukhi": ((0xA15, 20), None),
    "Gujarati": ((0xA95, 20), None),
    "Telugu": ((0xC15, 20), None),
    "Kannada": ((0xC95, 20), None),
    "Malayalam": ((0xD15, 20), None),
    "Sinhala": ((0xD9A, 24), None),
    "Thai": ((0xE01, 46), None),
    "Myanmar": ((0x1000, 33), None),
    "Ethiopic": ((0x1200, 73), None),
    "Khmer": ((0x1780, 35), None),
    "Mongolian": ((0x1820, 35), None),
    "Hiragana": ((0x3041, 86), None),
    "Katakana": ((0x30A1, 90), None),
    "Han": ((0x4E00, 20902), None),
    "Hangul": ((0xAC00, 11172), None),
}
_TITLE = rf"^({_TITLED})"
#: Pieces of a name: words, particles, and what is between.
_PIECES = rf"[dl]['’](?=\p{{Lu}})|{_LETTER}++{_BEHIND}*+|[^\p{{L}}\p{{M}}]++"
#: Country codes of phone numbers, with separators anywhere: none begins another.
_COUNTRY = r"^(\+(?:1|7|2_[07]|3_[0-469]|4_[013-9]|5_[1-8]|6_[0-6]|8_[1246]|9_[0-58]|[0-9]_[0-9]_[0-9]))".replace("_", "[^0-9]*")
#: Syllables of made-up names, and the letters of other scripts that stand for theirs.
_NAME = ("ba be bo da de do fa fi ga ge ha he ja jo ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi zo").split()
_SPELT = {"Latin": "abdefghijklmnoprstuvz", "Cyrillic": "абдефгхийклмнопрстувз", "Greek": "αβδεφγχιξκλμνοπρστυθζ"}
_ENDINGS = {
    "Latin": {"m": "rn ld n s rt k".split(), "f": "ra na la lia nne tta".split()},
    "Cyrillic": {"m": "ов ин ев ан ий ир".split(), "f": "ова ина ева ана ия ира".split()},
    "Greek": {"m": "ος ης ας ων ις ους".split(), "f": "α η ια ινα ου ω".split()},
}
PARTS = "array<struct<t:string,kind:string,norm:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its Luhn check digit."""
    return _luhn_sum(digits, 0) % 10 == 0


def _luhn_sum(digits: Column, shift: int) -> Column:
    """shift 1: as if one more digit, 0, followed."""
    back = F.reverse(F.split(digits, ""))
    value = F.transform(back, lambda c, i: F.when((i + shift) % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def kind_of(hit: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, p in reversed(PATTERNS.items()):
        fits = hit.rlike(f"^(?:{p})$")
        out = F.when(fits & luhn(_digits(hit)) if kind == "card" else fits, kind).otherwise(out)
    return out


def normal(kind: Column, text: Column) -> Column:
    """What makes two mentions one entity. It is a mention itself: its surrogate has the normal form of any mention's."""
    return (
        F.when(kind.isin("card", "ssn"), _digits(text))
        .when(kind == "phone", F.concat(F.regexp_extract(text, r"^\+?", 0), _digits(text)))
        .when(kind == "iban", F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", "")))
        .otherwise(F.lower(F.translate(text, "İ’", "I'")))
    )


def parts(kind: Column, hit: Column, again: Column) -> Column:
    """The hit in pieces: entities with kind and normal form, and what stays as it is, without. `again` is the kind of a
    name that stands without a title, else null. The normal form of an initial is that of its surname."""
    plain = lambda t: F.struct(t.alias("t"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("norm"))
    own = lambda t, k: F.struct(t.alias("t"), k.alias("kind"), normal(k, t).alias("norm"))

    def person(x: Column) -> Column:
        kinds = lambda i: F.when(i > x["gap"], "surname").when(_female(x["title"]), "given_f").otherwise("given_m")

        def piece(w: Column, i: Column) -> Column:
            stays = ~w.rlike(r"^\p{L}") | w.rlike(rf"^(?:(?:{_PARTICLES})|[ae]l|[dl]['’])$")
            initial = F.struct(w.alias("t"), F.lit("initial").alias("kind"), x["family"].alias("norm"))
            return F.when(stays, plain(w)).when(F.length(w) == 1, initial).otherwise(own(w, kinds(i)))

        return F.concat(F.array(plain(x["title"])), F.transform(x["words"], piece))

    title = F.regexp_extract(hit, _TITLE, 1)
    words = F.regexp_extract_all(F.substr(hit, F.length(title) + 1), F.lit(_PIECES), F.lit(0))
    gap = lambda words: F.coalesce(F.array_max(F.transform(words, lambda w, i: F.when(w.rlike(_GAP), i))), F.lit(-1))
    family = lambda words, gap: normal(F.lit("surname"), F.array_join(F.filter(words, lambda w, i: i > gap), ""))
    split = _let(words, lambda w: _let(gap(w), lambda g: F.struct(title.alias("title"), w.alias("words"), g.alias("gap"), family(w, g).alias("family"))))
    named = F.when(again.isNotNull(), F.array(own(hit, again))).otherwise(_let(split, person))
    return F.when(kind == "person", named).when(kind.isNotNull(), F.array(own(hit, kind))).otherwise(F.array(plain(hit))).cast(PARTS)


def _female(title: Column) -> Column:
    return title.rlike(f"^(?:{_FEMALE})")


def _prefix(hit: Column) -> Column:
    """The country prefix as written; it follows from the number's digits, not from where they are separated."""
    return F.regexp_extract(hit, _COUNTRY, 1)


def _nibbles(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 512)


def _number(h: Column, at: Column, below: int | Column) -> Column:
    """A number from 0 to below - 1 from the at-th four digits of the hash, which wrap around."""
    return (F.conv(F.substr(h, (at % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") % below).cast("int")


def _let(value: Column, of) -> Column:
    """`of` the value, which is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _before(values: Column) -> Column:
    """For each place of an array of int, the sum of what stands before it, by chunks as in running()."""
    none = F.array().cast("array<int>")
    scan = lambda v, first, by: F.aggregate(
        v, F.struct(first.alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + by(x)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"]
    )
    total = lambda y: F.aggregate(y, F.lit(0), lambda a, b: a + b)
    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / 256).cast("int"))), lambda k: F.slice(v, k * 256 + 1, 256))
    each = lambda c: F.flatten(F.zip_with(c, scan(c, F.lit(0), total), lambda y, first: scan(y, first, lambda x: x)))
    return _let(_let(values, chunks), each)


def _code(c: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")


def _reletter(text: Column, h: Column) -> Column:
    """Digits and letters replaced by the hash, each kind, case and script by its own; the n-th of these takes the n-th part."""
    block = lambda b: F.struct(F.lit(b[0]).alias("first"), F.lit(b[1]).alias("size"))

    def one(c: Column, before: Column) -> Column:
        to = F.when(c.rlike("^[0-9]$"), block((0x30, 10))).when(~c.rlike(r"^\p{L}$"), F.lit(None))
        for script, (lower, upper) in SCRIPTS.items():
            fits = c.rlike(rf"^\p{{Is{script}}}$")
            if upper:
                to = to.when(fits & c.rlike(r"^\p{Lu}$"), block(upper))
            to = to.when(fits, block(lower))
        to = to.when(c.rlike(r"^\p{Lu}$"), block(SCRIPTS["Latin"][1])).otherwise(block(SCRIPTS["Latin"][0]))
        return _let(to, lambda b: F.when(b.isNull(), c).otherwise(_code(b["first"] + _number(h, before, b["size"]))))

    counted = lambda cs: F.zip_with(cs, _before(F.transform(cs, lambda c: c.rlike(r"^[\p{L}0-9]$").cast("int"))), one)
    return F.array_join(_let(F.split(text, ""), counted), "")


def _initial(letter: Column, family: Column, key: str) -> Column:
    """The letter some steps on in its alphabet, never itself; the surname's normal form and the key say how many."""
    step = F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("initial"), family), 256), F.lit(1), F.lit(4)), 16, 10).cast("int")
    moved = lambda first, size: _code(first + F.pmod(F.ascii(letter) - first + 1 + step % (size - 1), F.lit(size)))
    out = moved(*SCRIPTS["Latin"][1])
    for script in ("Cyrillic", "Greek"):
        out = F.when(letter.rlike(rf"^\p{{Is{script}}}$"), moved(*SCRIPTS[script][1])).otherwise(out)
    return out


def _iban_check(country: Column, body: Column) -> Column:
    said = F.split(F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00")), "")
    rest = F.aggregate(said, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _name(kind: Column, text: Column, new: Column, h: Column, more: Column) -> Column:
    """A made-up name of the text's script, in capitals if the text is; of other scripts than _SPELT, letter for letter
    (`new`). One or two letters before an apostrophe stay apart."""
    of = lambda words, at: F.element_at(F.array(*map(F.lit, words)), _number(h, at, len(words)) + 1)
    said = F.array_join(F.transform(F.sequence(F.lit(0), more + 2), lambda at: of(_NAME, at + 4)), "")
    female = {"Cyrillic": (kind == "given_f") | (kind == "surname") & F.lower(text).rlike("[ая]$")}
    apart, bare = F.regexp_extract(new, r"^\p{L}{1,2}['’](?=.)", 0), F.regexp_replace(text, "['’]", "")
    spelt = F.lit(None).cast("string")
    for script, letters in _SPELT.items():
        end = F.when(female.get(script, kind == "given_f"), of(_ENDINGS[script]["f"], F.lit(0))).otherwise(of(_ENDINGS[script]["m"], F.lit(0)))
        spelt = F.when(bare.rlike(rf"^\p{{Is{script}}}+$"), F.concat(F.translate(said, _SPELT["Latin"], letters), end)).otherwise(spelt)

    def cased(x: Column) -> Column:
        front, out = F.when(x["spelt"].isNull(), "").otherwise(apart), F.coalesce(x["spelt"], new)
        return F.concat(front, F.when(F.upper(text) == text, F.upper(out)).when(F.lower(text) == text, F.lower(out)).otherwise(F.initcap(out)))

    return _let(F.struct(spelt.alias("spelt")), cased)


def surrogate(kind: Column, text: Column, attempt: Column, key: str = KEY) -> Column:
    """Of an entity as it is written; for a person's, of one part of the name."""
    more = F.greatest(F.lit(0), attempt - (WIDEN - 1))
    longer = lambda t, by: F.concat(t, F.repeat(by, more))
    first = lambda n: F.substr(text, F.lit(1), F.lit(n))
    # What stays at the front, and what gets other letters and digits.
    head = F.when(kind == "phone", _prefix(text)).when(kind == "card", first(1)).when(kind == "iban", first(2)).otherwise("")
    body = (
        F.when(kind == "email", F.concat(longer(F.substring_index(text, "@", 1), F.lit("a")), F.lit("@"), F.regexp_replace(F.substring_index(text, "@", -1), r"\.[A-Za-z]+$", "")))
        .when(kind == "card", F.substr(longer(text, F.lit("0")), F.lit(2), F.length(text) + more - 2))
        .when(kind == "iban", F.substr(longer(text, F.lit("0")), F.lit(5)))
        .when(kind == "phone", F.substr(longer(text, F.lit("0")), F.length(_prefix(text)) + 1))
        .when(kind == "ssn", longer(text, F.lit("0")))
        .otherwise(longer(text, F.right(text, F.lit(1))))
    )

    def made(m: Column) -> Column:
        h, head, new = m["h"], m["head"], m["new"]
        ip = F.concat_ws(".", _number(h, F.lit(0), 223) + 1, *[_number(h, F.lit(i), 256) for i in (1, 2, 3)])
        return (
            F.when(kind == "email", F.concat(new, F.lit(".example")))
            .when(kind == "ip", ip)
            .when(kind == "card", F.concat(head, new, ((10 - _luhn_sum(_digits(F.concat(head, new)), 1) % 10) % 10).cast("string")))
            .when(kind == "iban", F.concat(head, _iban_check(head, new), new))
            .when(kind.isin("phone", "ssn"), F.concat(head, new))
            .otherwise(_name(kind, text, new, h, more))
        )

    given = F.struct(_nibbles(kind, normal(kind, text), attempt, key).alias("h"), head.alias("head"), body.alias("body"))
    return _let(_let(given, lambda g: F.struct(g["h"].alias("h"), g["head"].alias("head"), _reletter(g["body"], g["h"]).alias("new"))), made)


def attempts(entities: DataFrame, scratch: Scratch, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt) of the entities(kind, norm) whose first surrogate is not theirs alone; the rest have 0."""
    named = scratch.save(entities.select("kind", "norm").distinct().withColumn("attempt", F.lit(0)), "entities0")
    for k in range(MOST):
        made = named.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        made = made.select("kind", "norm", "attempt", _let(F.col("made"), lambda s: normal(F.col("kind"), s)).alias("code"))
        made = scratch.save(made, f"made{k}")
        shared = made.groupBy("kind", "code").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).where("n > 1")
        taken = made.select("kind", F.col("norm").alias("code")).withColumn("taken", F.lit(True))
        bad = made.join(shared, ["kind", "code"], "left").join(taken, ["kind", "code"], "left")
        again = F.coalesce(F.col("taken"), F.lit(False)) | (F.col("n").isNotNull() & (F.col("first.norm") != F.col("norm")))
        moved = scratch.save(bad.select("kind", "norm", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("moved")), f"entities{k + 1}")
        scratch.drop(f"made{k}", f"entities{k}")
        named = moved.select("kind", "norm", "attempt")
        if moved.where("moved").isEmpty():
            return named.where("attempt > 0")
    raise ValueError(f"entities without a surrogate of their own after {MOST} attempts")


def surrogates(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """`docs` with entities in the text replaced, and `entities`: array of (kind, start, length, surrogate)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "pii")
    names = [c for c in docs.columns if c != "entities"]
    # Documents with a match are written once with their cut texts; the others go straight through.
    has = F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    kinds = "array<struct<kind:string,start:int,length:int,surrogate:string>>"
    plain = docs.where(~has).select(*names, F.array().cast(kinds).alias("entities"))
    given = docs.where(has).select(*names, F.split(F.col(text_col), ANY, -1).alias("__pieces"), F.regexp_extract_all(F.col(text_col), F.lit(ANY), 0).alias("__hits"))
    given = given.withColumn("__e", F.transform("__hits", lambda x: F.struct(x.alias("hit"), kind_of(x).alias("kind"))))
    titled = F.flatten(F.transform(F.filter("__e", lambda e: e["kind"] == "person"), lambda e: parts(e["kind"], e["hit"], F.lit(None).cast("string"))))
    long = lambda p: p["kind"].isin("surname", "given_f", "given_m") & (F.length(p["norm"]) > 2)
    given = given.withColumn("__names", F.array_distinct(F.transform(F.filter(titled, long), lambda p: F.struct(p["kind"].alias("kind"), p["norm"].alias("norm")))))
    # Names, by what they begin with, so that a place of the text meets few of them.
    norms = F.array_distinct(F.transform("__names", lambda p: p["norm"]))
    begun = F.array_distinct(F.transform(norms, lambda n: F.left(n, F.lit(2))))
    ends = lambda n, b: F.array_join(F.transform(F.filter(n, lambda x: F.left(x, F.lit(2)) == b), lambda x: F.replace(F.substr(x, F.lit(3)), F.lit("'"), F.lit("['’]"))), "|")
    tree = _let(norms, lambda n: F.array_join(F.transform(begun, lambda b: F.concat(F.replace(b, F.lit("'"), F.lit("['’]")), F.lit("(?:"), ends(n, b), F.lit(")"))), "|"))
    named = F.concat(F.lit(rf"{ANY}|(?<!{_LETTER})(?=\p{{Lu}})(?iu:"), tree, F.lit(rf")(?!{_LETTER})"))
    some = F.size("__names") > 0
    given = given.withColumn("__by", F.when(some, named).otherwise(F.lit(ANY)))
    for name, of in (("__pieces", lambda t, by: F.split(t, by, -1)), ("__hits", lambda t, by: F.regexp_extract_all(t, by, F.lit(0)))):
        given = given.withColumn(name, F.when(some, of(F.col(text_col), F.col("__by"))).otherwise(F.col(name)))
    given = given.withColumn("__e", F.when(some, F.transform("__hits", lambda x: F.struct(x.alias("hit"), kind_of(x).alias("kind")))).otherwise(F.col("__e")))

    def whole(e: Column) -> Column:
        known = _let(normal(F.lit("surname"), e["hit"]), lambda n: F.array_max(F.filter("__names", lambda p: p["norm"] == n))["kind"])
        again = F.when(e["kind"].isNull() & e["hit"].rlike(r"^\p{Lu}"), known)
        kind = F.coalesce(e["kind"], F.when(again.isNotNull(), "person"))
        return F.struct(e["hit"].alias("hit"), kind.alias("kind"), parts(kind, e["hit"], again).alias("parts"))

    given = given.withColumn("__e", F.transform("__e", whole))
    given = scratch.save(given.drop("__hits", "__names", "__by").withColumn("__row", F.monotonically_increasing_id()), "found")

    each = given.select("__row", F.explode(F.flatten(F.transform("__e", lambda e: e["parts"]))).alias("e")).where("e.kind <> 'initial'").select("__row", "e.kind", "e.norm")
    late = scratch.save(attempts(each, scratch, key), "late")
    if late.isEmpty():
        given = given.withColumn("__late", F.array().cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        own = each.distinct().join(late, ["kind", "norm"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias("__late"))
        given = given.join(own, "__row", "left")
    tried = lambda p: F.coalesce(F.get(F.filter("__late", lambda x: (x["kind"] == p["kind"]) & (x["norm"] == p["norm"])), F.lit(0))["attempt"], F.lit(0))
    new = lambda p: F.when(p["kind"].isNull(), p["t"]).when(p["kind"] == "initial", _initial(p["t"], p["norm"], key)).otherwise(surrogate(p["kind"], p["t"], tried(p), key))
    made = F.transform("__e", lambda e: F.struct(e["hit"].alias("hit"), e["kind"].alias("kind"), F.array_join(F.transform(e["parts"], new), "").alias("s")))
    given = given.withColumn("__e", made)
    text = F.array_join(F.flatten(F.transform("__pieces", lambda p, i: F.array_compact(F.array(p, F.get("__e", i)["s"])))), "")
    before = running("zip_with(slice(__pieces, 1, size(__e)), __e, (p, e) -> length(p) + length(e.hit))")
    spans = F.expr(f"""transform(
        filter(
          zip_with(zip_with(__e, slice(__pieces, 1, size(__e)), (e, p) -> named_struct('e', e, 'gap', length(p))), {before},
            (x, at) -> named_struct('kind', x.e.kind, 'start', at + x.gap, 'length', length(x.e.hit), 'surrogate', x.e.s)),
          x -> x.kind IS NOT NULL), x -> x)""").cast(kinds)
    done = given.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], spans.alias("entities"))
    return plain.unionByName(done)


def query(spark, sf_dir: str) -> DataFrame:
    out = surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["start"] + e["length"])), ",")
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), said.alias("entities"))
