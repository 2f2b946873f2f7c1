"""License scan by ordered signature rules, in DataFrame functions only.

A text becomes words: A-Z in lower case, split at ASCII signs, space and control characters. Rules are regular
expressions over these words and come in four classes, in order of priority: tag (an SPDX line), text (a sentence of the
license's own text, or its address), grant (licensed under ...), name (the name alone). Every rule needs some
words; one intersection of the text's words with all rules' words tells which rules can match at all, and only their
expressions run. A text that holds no rule's rarest word is done with that.

A detection is an interval of words. It is suppressed if it lies within another one of a class of higher priority, or
within a longer one of its own class, or if a rule that comes before gives the same interval. That is decided by running
maxima over the detections in order of start, so a text of many detections takes time in proportion to them.

Defined cases: a null text is empty and has no words; rows are independent, so ties, repeated rows and ids change
nothing; texts of any length are read whole; an empty table gives an empty table; columns of the input keep their values
but for `n_words`, `bases` and `detections`, which are replaced.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import running, table

# Fixed phrases with their labels, by contract.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# label ; words a text must hold, the rarest last ; SPDX id ; name ; address. Expressions are over words; `-` is none.
LICENSES = r"""
0bsd ; zero bsd ; 0bsd ; (?:bsd zero clause|zero clause bsd)(?: license)? ; -
afl-3.0 ; academic license ; afl 3 0 ; academic free license (?:version )?(?:v )?v?3(?: 0)? ; -
agpl-3.0 ; affero ; agpl 3 0(?: only| or later)? ; (?:gnu )?affero general public license(?: (?:version )?(?:v )?v?3(?: 0)?)? ; gnu org licenses agpl(?: 3 0)?
apache-1.1 ; apache ; apache 1 1 ; apache (?:software )?license(?: version)? 1 1 ; apache org licenses license 1 1
apache-2.0 ; apache ; apache 2 0 ; (?:apache (?:software )?license(?: version)? (?:v )?2(?: 0)?|apache 2 0(?: license)?|apache license v2(?: 0)?) ; apache org licenses license 2 0
apache ; apache ; apache ; apache (?:software )?license ; apache org licenses
apsl-2.0 ; apple license ; apsl 2 0 ; apple public source license(?: version)?(?: 2(?: 0)?)? ; opensource apple com apsl
artistic-1.0 ; artistic license ; artistic 1 0(?: perl| cl8)? ; artistic license(?: version)? 1(?: 0)? ; -
artistic-2.0 ; artistic license ; artistic 2 0 ; artistic license(?: version)? 2(?: 0)? ; opensource org licenses artistic license 2 0
artistic ; artistic license ; artistic ; (?:perl |clarified )?artistic license ; -
beerware ; beerware ; beerware ; beerware license ; -
blueoak-1.0.0 ; blue license ; blueoak 1 0 0 ; blue oak model license(?: 1 0 0)? ; blueoakcouncil org license 1 0 0
bsl-1.0 ; boost license ; bsl 1 0 ; boost software license(?: version)?(?: 1(?: 0)?)? ; boost org license 1 0 txt
bsd-1-clause ; bsd ; bsd 1 clause ; (?:bsd 1 clause|1 clause bsd|one clause bsd)(?: license)? ; -
bsd-2-clause ; bsd ; bsd 2 clause ; (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: license)? ; opensource org licenses bsd 2 clause
bsd-3-clause ; bsd ; bsd 3 clause ; (?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)? ; opensource org licenses bsd 3 clause
bsd-4-clause ; bsd ; bsd 4 clause ; (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: license)? ; -
bsd ; bsd ; bsd ; bsd (?:style )?licen[cs]e ; -
busl-1.1 ; business license ; busl 1 1 ; business source license(?: version)?(?: 1 1)? ; mariadb com bsl11
bzip2-1.0.6 ; bzip2 ; bzip2 1 0 6 ; bzip2(?: and libbzip2)? license ; -
cc-by-1.0 ; cc ; cc by 1 0 ; cc by 1 0(?: license)? ; creativecommons org licenses by 1 0
cc-by-2.0 ; cc ; cc by 2 0 ; cc by 2 0(?: license)? ; creativecommons org licenses by 2 0
cc-by-3.0 ; cc ; cc by 3 0 ; cc by 3 0(?: license)? ; creativecommons org licenses by 3 0
cc-by-4.0 ; cc ; cc by 4 0 ; cc by 4 0(?: license)? ; creativecommons org licenses by 4 0
cc-by-sa-3.0 ; sa cc ; cc by sa 3 0 ; cc by sa 3 0(?: license)? ; creativecommons org licenses by sa 3 0
cc-by-sa-4.0 ; sa cc ; cc by sa 4 0 ; cc by sa 4 0(?: license)? ; creativecommons org licenses by sa 4 0
cc-by-nc-3.0 ; nc cc ; cc by nc 3 0 ; cc by nc 3 0(?: license)? ; creativecommons org licenses by nc 3 0
cc-by-nc-4.0 ; nc cc ; cc by nc 4 0 ; cc by nc 4 0(?: license)? ; creativecommons org licenses by nc 4 0
cc-by-nd-4.0 ; nd cc ; cc by nd 4 0 ; cc by nd 4 0(?: license)? ; creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 ; nc sa cc ; cc by nc sa 4 0 ; cc by nc sa 4 0(?: license)? ; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 ; nc nd cc ; cc by nc nd 4 0 ; cc by nc nd 4 0(?: license)? ; creativecommons org licenses by nc nd 4 0
cc-by ; creative commons ; - ; creative commons attribution(?: [0-9] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)? ; creativecommons org licenses by
cc-by-sa ; sharealike ; - ; creative commons attribution sharealike(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: license)? ; creativecommons org licenses by sa
cc-by-nc ; noncommercial ; - ; creative commons attribution noncommercial(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: license)? ; creativecommons org licenses by nc
cc-by-nd ; noderivatives ; - ; creative commons attribution noderivatives(?: [0-9] [0-9])?(?: international| unported)?(?: public)?(?: license)? ; creativecommons org licenses by nd
cc0-1.0 ; cc0 ; cc0 1 0 ; (?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)? ; -
cc-pdm ; mark domain ; - ; public domain mark(?: 1 0)? ; creativecommons org publicdomain(?: zero 1 0)?
cddl-1.0 ; cddl ; cddl 1 0 ; cddl(?: version)?(?: 1 0)? ; -
cddl ; distribution license ; - ; common development and distribution license(?: version)?(?: 1 [01])? ; opensource org licenses cddl
cecill-2.1 ; cecill ; cecill(?: b| c)?(?: [12] [01])? ; cecill(?: b| c)?(?: free software license(?: agreement)?| license) ; cecill info licences
cpl-1.0 ; common license ; cpl 1 0 ; common public license(?: version)?(?: 1 0)? ; -
curl ; curl license ; curl ; curl license ; -
ecl-2.0 ; educational license ; ecl 2 0 ; educational community license(?: version)?(?: 2 0)? ; -
epl-1.0 ; eclipse ; epl 1 0 ; eclipse public license (?:version )?(?:v )?v?1(?: 0)? ; eclipse org legal epl v10(?: html)?
epl-2.0 ; eclipse ; epl 2 0 ; eclipse public license (?:version )?(?:v )?v?2(?: 0)? ; eclipse org legal epl (?:2 0|v20)(?: html)?
epl ; eclipse ; epl ; eclipse public license ; -
eupl-1.2 ; public union european ; eupl 1 [0-2] ; european union public licen[cs]e(?: version)?(?: 1 [0-2])? ; -
fsfap ; permissive license ; fsfap ; gnu all permissive license ; -
ftl ; freetype ; ftl ; freetype (?:project )?license ; -
gfdl-1.3 ; documentation license ; gfdl 1 [123](?: only| or later)? ; (?:gnu )?free documentation license(?: version)?(?: 1 [123])? ; gnu org licenses fdl(?: 1 [123])?
gpl-1.0 ; gnu ; gpl 1 0(?: only| or later)? ; gnu general public license(?: version| v)? 1(?: 0)? ; gnu org licenses gpl 1 0
gpl-2.0 ; gnu ; gpl 2 0(?: only)? ; gnu (?:general public license|gpl) (?:version )?(?:v )?v?2(?: 0)? ; gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0-or-later ; later gnu ; gpl 2 0 (?:or later|plus) ; gnu (?:general public license|gpl) (?:version )?(?:v )?v?2(?: 0)? or(?: at your option)?(?: any)? later(?: version)? ; -
gpl-3.0 ; gnu ; gpl 3 0(?: only)? ; gnu (?:general public license|gpl) (?:version )?(?:v )?v?3(?: 0)? ; gnu org licenses gpl 3 0
gpl-3.0-or-later ; later gnu ; gpl 3 0 (?:or later|plus) ; gnu (?:general public license|gpl) (?:version )?(?:v )?v?3(?: 0)? or(?: at your option)?(?: any)? later(?: version)? ; -
gpl ; general license ; gpl ; (?:gnu )?general public license ; gnu org licenses gpl
gplv2 ; gplv2 ; - ; (?:gnu )?gplv2(?: license)? ; -
gplv3 ; gplv3 ; - ; (?:gnu )?gplv3(?: license)? ; -
hpnd ; historical permission disclaimer ; hpnd ; historical permission notice and disclaimer ; -
icu ; icu license ; icu ; icu license ; -
ijg ; independent jpeg ; ijg ; independent jpeg group(?: s)? (?:software|license) ; -
ipl-1.0 ; ibm license ; ipl 1 0 ; ibm public license(?: version)?(?: 1 0)? ; -
isc ; isc license ; isc ; isc license ; opensource org licenses isc
json ; json license ; json ; json license ; json org license
lgpl-2.0 ; library license ; lgpl 2 0(?: only| or later)? ; gnu library general public license(?: version| v)?(?: 2(?: 0)?)? ; gnu org licenses (?:old licenses )?lgpl 2 0
lgpl-2.1 ; lesser license ; lgpl 2 1(?: only| or later)? ; (?:gnu )?lesser general public license (?:version )?(?:v )?v?2 1 ; gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 ; lesser license ; lgpl 3 0(?: only| or later)? ; (?:gnu )?lesser general public license (?:version )?(?:v )?v?3(?: 0)? ; gnu org licenses lgpl 3 0
lgpl ; lesser license ; lgpl ; (?:gnu )?lesser general public license ; gnu org licenses lgpl
libpng ; libpng ; libpng(?: 2 0)? ; libpng license(?: version)?(?: 2)? ; -
llama-2 ; llama license ; llama2 ; llama (?:2|3|3 1) community license(?: agreement)? ; ai meta com llama license
lppl-1.3c ; latex license ; lppl 1 [0-3][ac]? ; latex project public license(?: version)?(?: 1 [0-3][ac]?)? ; latex project org lppl
miros ; miros ; miros ; miros licen[cs]e ; -
mit ; mit ; mit ; (?:the )?mit (?:x11 |expat )?licen[cs]e ; opensource org licenses mit
mit-0 ; attribution mit ; mit 0 ; mit no attribution(?: license)? ; -
mpl-1.1 ; mozilla ; mpl 1 [01] ; mozilla public license (?:version )?(?:v )?v?1 [01] ; mozilla org mpl 1 1
mpl-2.0 ; mozilla ; mpl 2 0 ; mozilla public license (?:version )?(?:v )?v?2(?: 0)? ; mozilla org mpl 2 0
mpl ; mozilla ; mpl ; mozilla public license ; mozilla org mpl
ms-pl ; microsoft license ; ms pl ; microsoft public license ; -
ms-rl ; microsoft license ; ms rl ; microsoft reciprocal license ; -
mulanpsl-2.0 ; mulan ; mulanpsl 2 0 ; mulan (?:psl|permissive software license)(?: v2| version 2)? ; license coscl org cn mulanpsl2
ncsa ; illinois license ; ncsa ; university of illinois(?: ncsa)? open source license ; -
odbl-1.0 ; database license ; odbl 1 0 ; open database license(?: odbl)?(?: v1 0| 1 0)? ; opendatacommons org licenses odbl
odc-by-1.0 ; commons license ; odc by 1 0 ; open data commons attribution license(?: 1 0| v1 0)? ; opendatacommons org licenses by
ofl-1.1 ; sil license ; ofl 1 [01] ; sil open font license(?: version)?(?: 1 [01])? ; scripts sil org ofl
openrail-m ; rail license ; openrail(?: m)? ; (?:bigscience |creativeml )?open rail m license ; -
openssl ; openssl ; openssl ; openssl license ; -
osl-3.0 ; open license ; osl 3 0 ; open software license (?:version )?(?:v )?v?3(?: 0)? ; -
pddl-1.0 ; dedication license ; pddl 1 0 ; public domain dedication and license(?: 1 0)? ; opendatacommons org licenses pddl
php-3.01 ; php license ; php 3 01? ; php license(?: version)?(?: 3 01?)? ; php net license
postgresql ; postgresql ; postgresql ; postgresql licen[cs]e ; -
psf-2.0 ; python license ; (?:psf 2 0|python 2 0) ; python software foundation license(?: version)?(?: 2)? ; docs python org license
qpl-1.0 ; q license ; qpl 1 0 ; q public license(?: version)?(?: 1 0)? ; -
ruby ; ruby license ; ruby ; ruby(?: s)? license ; -
sspl-1.0 ; server license ; sspl 1 0 ; server side public license(?: version)?(?: 1)? ; mongodb com licensing server side public license
unicode-dfs-2016 ; unicode license ; unicode dfs 2016 ; unicode license agreement ; unicode org copyright
unlicense ; unlicense ; unlicense ; (?:the )?unlicense ; unlicense org
upl-1.0 ; universal license ; upl 1 0 ; universal permissive license(?: version| v)?(?: 1 0)? ; oss oracle com licenses upl
vim ; vim license ; vim ; vim license ; -
w3c ; w3c license ; w3c ; w3c software(?: notice)?(?: and)?(?: document)? license ; w3 org consortium legal
wtfpl ; fuck ; wtfpl ; do what the fuck you want to public license ; wtfpl net
x11 ; x11 license ; x11 ; x11 license ; -
zlib ; zlib ; zlib ; zlib(?: libpng)? license ; zlib net zlib license
zpl-2.1 ; zope ; zpl 2 [01] ; zope public license(?: version)?(?: 2 [01])? ; -
all-rights-reserved ; rights reserved ; - ; all rights reserved ; -
public-domain ; public domain ; - ; (?:released into|placed in|dedicated to|in) the public domain ; -
"""

# label ; words a text must hold, the rarest last ; a sentence of the license's own text.
TEXTS = r"""
mit ; hereby obtaining ; permission is hereby granted free of charge to any person obtaining a copy of this software
mit ; sublicense ; without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
isc ; purpose hereby ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd ; redistribution ; redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause ; promote endorse ; neither the name of (?:the )?[0-9a-z]+(?: [0-9a-z]+){0,12} may be used to endorse or promote products
bsd-4-clause ; advertising mentioning ; all advertising materials mentioning features or use of this software must display
apache-2.0 ; compliance license ; you may not use this file except in compliance with the license
apache-2.0 ; perpetual ; perpetual worldwide non exclusive no charge royalty free irrevocable
gpl ; redistribute gnu ; you can redistribute it and or modify it under the terms of the gnu general public license
gpl ; warranty merchantability ; without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl ; redistribute gnu ; you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl-3.0 ; redistribute gnu ; you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2.0 ; mozilla ; this source code form is subject to the terms of the mozilla public license v 2 0
epl-2.0 ; eclipse ; this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
zlib ; misrepresented ; the origin of this software must not be misrepresented
zlib ; altered ; altered source versions must be plainly marked as such
unlicense ; unencumbered ; this is free and unencumbered software released into the public domain
bsl-1.0 ; executable processor ; solely in the form of machine executable object code generated by a source language processor
wtfpl ; fuck ; you just do what the fuck you want to
json ; evil ; the software shall be used for good not evil
beerware ; buy beer ; you can buy me a beer in return
fsfap ; copyright preserved ; provided the copyright notice and this notice are preserved
ofl-1.1 ; sil license ; this font software is licensed under the sil open font license
cc0-1.0 ; copyright waived ; has waived all copyright and related or neighboring rights
gfdl-1.3 ; invariant ; with no invariant sections no front cover texts and no back cover texts
artistic ; intent conditions copied ; the intent of this document is to state the conditions under which a package may be copied
"""

CLASSES = ("tag", "text", "grant", "name")
WEIGHTS = (1.0, 0.95, 0.9, 0.7)
ONLY_BASE = 0.5
GRANT = r"(?:licen[cs]ed|released|distributed|published|available|provided|offered|covered|redistributed) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """Rank counts from 0 in order of priority; need: words without which the pattern can't match, the rarest last."""

    rank: int
    kind: int
    label: str
    need: tuple[str, ...]
    pattern: str


def _over_words(pattern: str) -> str:
    """The pattern for texts in which each word has a space of its own on both sides: a space in it stands for two."""
    return " (?:" + pattern.replace(" ", "  ") + ") "


def _rare(url: str) -> tuple[str, ...]:
    """The first and the longest of the words that every form of an address holds."""
    fixed = url.split("(")[0].split()
    return fixed[0], max(fixed, key=len)


def rules() -> list[Rule]:
    """All rules in order: by class, then as the tables list them."""
    licenses = [tuple(x.strip() for x in line.split(" ; ")) for line in LICENSES.strip().splitlines()]
    texts = [tuple(x.strip() for x in line.split(" ; ")) for line in TEXTS.strip().splitlines()]
    out: list[tuple[int, str, tuple[str, ...], str]] = []
    out += [(0, label, ("spdx",), f"spdx license identifier {spdx}") for label, _, spdx, _, _ in licenses if spdx != "-"]
    out += [(1, label, tuple(need.split()), pattern) for label, need, pattern in texts]
    out += [(1, label, _rare(url), url) for label, _, _, _, url in licenses if url != "-"]
    out += [(2, label, ("under", *need.split()), GRANT + f"(?:{name})") for label, need, _, name, _ in licenses]
    out += [(3, label, tuple(need.split()), name) for label, need, _, name, _ in licenses]
    return [Rule(k, kind, label, need, _over_words(pattern)) for k, (kind, label, need, pattern) in enumerate(out)]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spaces(text: str) -> str:
    return f"(length({text}) - length(replace({text}, ' ', '')))"


def _places(text: str, pattern: str) -> str:
    """SQL: array of (start, many) in words, for the pattern's leftmost matches that do not overlap."""
    lengths = f"zip_with(slice(f.pieces, 1, size(f.hits)), f.hits, (p, h) -> {_spaces('p')} + {_spaces('h')})"
    return f"""
    CASE WHEN {text} RLIKE {pattern} THEN
      transform(array(named_struct('pieces', split({text}, {pattern}, -1), 'hits', regexp_extract_all({text}, {pattern}, 0))), f ->
        zip_with(
          zip_with(f.hits, slice(f.pieces, 1, size(f.hits)), (h, p) -> named_struct('many', {_spaces("h")}, 'gap', {_spaces("p")})),
          {running(lengths)},
          (m, before) -> named_struct('start', CAST((before + m.gap) DIV 2 AS INT), 'many', CAST(m.many DIV 2 AS INT))))[0]
    ELSE CAST(array() AS array<struct<start:int,many:int>>) END"""


def scan(docs: DataFrame, text_col: str = "text", ordered: list[Rule] | None = None) -> DataFrame:
    """`docs` with n_words; bases: array of (start, label), all places of the fixed phrases by start; and detections:
    array of (start, end, rank, kind, label) that none suppresses, by start; positions count words, ends are exclusive."""
    ordered = rules() if ordered is None else ordered
    work = "__solvarium_"
    keywords = sorted({w for r in ordered for w in r.need} | {"license"})
    upper = "".join(map(chr, range(65, 91)))
    plain = f"trim(regexp_replace(translate(coalesce(`{text_col}`, ''), '{upper}', '{upper.lower()}'), {_literal(SIGNS)}, ' '))"
    out = docs.withColumn(f"{work}plain", F.expr(plain))
    out = out.withColumn(f"{work}words", F.expr(f"CASE WHEN {work}plain = '' THEN CAST(array() AS array<string>) ELSE split({work}plain, ' ') END"))
    known = "array(" + ", ".join(map(_literal, keywords)) + ")"
    out = out.withColumns({"n_words": F.expr(f"CAST(size({work}words) AS BIGINT)"), f"{work}held": F.expr(f"array_intersect({known}, {work}words)")})
    rare = "array(" + ", ".join(map(_literal, sorted({r.need[-1] for r in ordered} | {"license"}))) + ")"
    spaced = f"CASE WHEN arrays_overlap({work}held, {rare}) THEN concat(' ', replace({work}plain, ' ', '  '), ' ') ELSE '' END"
    out = out.withColumn(f"{work}spaced", F.expr(spaced))

    bases = ", ".join(
        f"transform({_places(work + 'spaced', _literal(_over_words(phrase)))}, m -> named_struct('start', m.start, 'label', '{label}'))" for phrase, label in BASE
    )
    none = "CAST(array() AS array<struct<start:int,label:string>>)"
    bases = f"CASE WHEN array_contains({work}held, 'license') THEN array_sort(concat({bases})) ELSE {none} END"
    schema = "array<struct<rank:int,kind:int,label:string,need:array<string>,pattern:string>>"
    listed = f"from_json({_literal(json.dumps([asdict(r) for r in ordered]))}, '{schema}')"
    found = f"""
      flatten(transform(filter({listed}, r -> size(array_except(r.need, {work}held)) = 0), r ->
        transform({_places(work + "spaced", "r.pattern")}, m -> named_struct(
          'start', m.start, 'shorter', -m.many, 'rank', r.rank, 'kind', r.kind, 'label', r.label))))"""
    empty = "CAST(array() AS array<struct<start:int,shorter:int,rank:int,kind:int,label:string>>)"
    found = f"CASE WHEN {work}spaced <> '' THEN array_sort({found}) ELSE {empty} END"
    out = out.withColumns({"bases": F.expr(bases), f"{work}all": F.expr(found)})
    # In order of start, then length, then rank, whatever holds an interval stands before it.
    ends = ", ".join(running(f"transform(a, x -> CASE WHEN x.kind <= {k} THEN x.start - x.shorter ELSE 0 END)", "max") for k in range(len(CLASSES)))
    own = f"""
      transform(array({work}all), a -> transform(array(array({ends})), e ->
        transform(filter(sequence(0, size(a) - 1), i -> e[a[i].kind][i] < a[i].start - a[i].shorter), i -> named_struct(
          'start', a[i].start, 'end', a[i].start - a[i].shorter, 'rank', a[i].rank, 'kind', a[i].kind, 'label', a[i].label)))[0])[0]"""
    last = "CAST(array() AS array<struct<start:int,end:int,rank:int,kind:int,label:string>>)"
    out = out.withColumn("detections", F.expr(f"CASE WHEN size({work}all) > 0 THEN {own} ELSE {last} END"))
    return out.drop(*[c for c in out.columns if c.startswith(work)])


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = "array_distinct(transform(bases, b -> b.label))"
    weights = "array(" + ", ".join(f"{w!r}D" for w in WEIGHTS) + ")"
    return found.select(
        "doc_id",
        "n_words",
        F.expr("CAST(size(bases) AS BIGINT)").alias("n_base"),
        F.expr("CAST(array_min(transform(bases, b -> b.start)) AS BIGINT)").alias("first_word"),
        F.expr("CAST(array_max(transform(bases, b -> b.start)) AS BIGINT)").alias("last_word"),
        F.expr(f"array_join(array_sort({base}), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, transform(detections, d -> d.label))), ',')").alias("labels"),
        F.expr(f"coalesce(array_max(transform(detections, d -> {weights}[d.kind])), CASE WHEN size(bases) > 0 THEN {ONLY_BASE!r}D ELSE 0.0D END)").alias("score"),
    )


def oracle() -> str:
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    listed = ", ".join(f"({r.rank}, {r.kind}, {quoted(r.label)}, [{', '.join(map(quoted, r.need))}], {quoted(r.pattern)})" for r in rules())
    phrases = ", ".join(f"({quoted(_over_words(p))}, {quoted(label)})" for p, label in BASE)
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    places = f"""CAST((list_sum(list_transform(pieces[1:i], lambda x: {spaces("x")})) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: {spaces("x")})), 0)) / 2 AS INT)"""
    upper = "".join(map(chr, range(65, 91)))
    return f"""
WITH rule(rank, kind, label, need, pattern) AS (VALUES {listed}),
phrase(pattern, label) AS (VALUES {phrases}),
plain AS (
  SELECT doc_id, row_number() OVER () AS row, trim(regexp_replace(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{SIGNS}', ' ', 'g'), ' ') AS p
  FROM documents),
doc AS (
  SELECT doc_id, row, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS words, ' ' || replace(p, ' ', '  ') || ' ' AS t FROM plain),
base AS (
  SELECT row, label, {places} AS start FROM (
    SELECT row, label, hits, string_split_regex(t, pattern) AS pieces, unnest(range(1, len(hits) + 1)) AS i
    FROM (SELECT row, label, t, pattern, regexp_extract_all(t, pattern) AS hits FROM doc, phrase WHERE contains(t, ' license ')))),
hit AS (
  SELECT row, rank, kind, label, {places} AS a, CAST({spaces("hits[i]")} / 2 AS INT) AS many FROM (
    SELECT row, rank, kind, label, hits, string_split_regex(t, pattern) AS pieces, unnest(range(1, len(hits) + 1)) AS i
    FROM (SELECT row, rank, kind, label, t, pattern, regexp_extract_all(t, pattern) AS hits
          FROM doc JOIN rule ON list_has_all(words, need)))),
kept AS (
  SELECT * FROM hit h WHERE NOT EXISTS (
    SELECT 1 FROM hit e WHERE e.row = h.row AND e.rank <> h.rank AND e.a <= h.a AND e.a + e.many >= h.a + h.many
      AND (e.kind < h.kind OR e.kind = h.kind AND (e.many > h.many OR e.rank < h.rank)))),
b AS (SELECT row, count(*) AS n, min(start) AS first, max(start) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY row),
k AS (SELECT row, max([{", ".join(map(repr, WEIGHTS))}][kind + 1])::DOUBLE AS score FROM kept GROUP BY row),
l AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM base UNION ALL SELECT row, label FROM kept) GROUP BY row)
SELECT doc_id, len(words) AS n_words, coalesce(b.n, 0) AS n_base, b.first::BIGINT AS first_word, b.last::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  coalesce(k.score, CASE WHEN b.n > 0 THEN {ONLY_BASE!r} ELSE 0 END)::DOUBLE AS score
FROM doc LEFT JOIN b USING (row) LEFT JOIN k USING (row) LEFT JOIN l USING (row)"""
