"""Secret scan in DataFrame functions only: three fixed patterns, and windowed Shannon entropy per character class.

Positions count code points and ends are exclusive. A text is cut at a pattern's matches with split() and the matches
themselves come from regexp_extract_all(), so a match's start is the length of all that stands before it: a running
sum over an array, without a UDF and linear in the number of matches.

Entropy. A candidate is a maximal run of one character class. A window of WINDOW characters slides over it; the sum of
count * log2(count) over the window's characters, and the counts themselves, are carried from step to step: a step
changes two counts, of the character that leaves and of the one that comes. Windows at or above the class's limit are hot; the span runs from
the first hot window to the end of the last. Candidates on the allow-list (place-holders, runs with no digit or no
letter, UUIDs) are left alone.

Defined cases: a null text counts as empty and has no spans; rows are independent, so ties, repeated rows and
duplicate ids change nothing; an empty table gives an empty table; columns of the input keep their values, and
`spans` of the input, if any, is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import running, table

# Fixed patterns (kind, pattern, least length, group whose length counts).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more: matches are maximal runs
HEX = r"[0-9a-f]{16,}"  # likewise for [0-9a-f]+ of 16 or more
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Candidate runs by character class, and the entropy in bits from which a window is hot.
CLASSES = {"hex": (r"[0-9A-Fa-f]{20,}", 2.87), "base64": (r"[A-Za-z0-9+/_=-]{20,}", 3.81)}
#: Candidates that match are never secrets.
ALLOW = (
    r"(?i)example|sample|dummy|changeme|placeholder|redacted|your[_-]|xxxx|lorem"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^[^0-9]*$|^[^A-Za-z]*$"
)
SPAN = "array<struct<start:int,kind_rank:int,end:int,kind:string>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(text: str, pattern: str) -> str:
    """SQL: array of (hit, start) for the pattern's leftmost matches that do not overlap."""
    q = _quoted(pattern)
    lengths = "zip_with(slice(f.pieces, 1, size(f.hits)), f.hits, (p, h) -> length(p) + length(h))"
    return f"""
    CASE WHEN {text} RLIKE {q} THEN
      transform(array(named_struct('pieces', split({text}, {q}, -1), 'hits', regexp_extract_all({text}, {q}, 0))), f ->
        zip_with(
          zip_with(f.hits, slice(f.pieces, 1, size(f.hits)), (h, p) -> named_struct('hit', h, 'gap', length(p))),
          {running(lengths)},
          (m, before) -> named_struct('hit', m.hit, 'start', before + m.gap)))[0]
    ELSE CAST(array() AS array<struct<hit:string,start:int>>) END"""


def _spans(found: str, kind: str) -> str:
    rank = KINDS.index(kind)
    return f"""CAST(transform({found}, m -> named_struct(
        'start', m.start, 'kind_rank', {rank}, 'end', m.start + length(m.hit), 'kind', '{kind}')) AS {SPAN})"""


def _hot(hit: str, limit: float) -> str:
    """SQL: struct(first, last) of hot windows over the characters of `hit`, both 0 if there are none.

    The window's counts are a string with one place for each ASCII character from + to z, which holds the character
    whose code is 48 and the count; a step changes the places of the character that leaves and of the one that comes.
    """
    w = WINDOW
    logs = "array(" + ", ".join(f"{k * math.log2(k) if k else 0.0!r}D" for k in range(w + 2)) + ")"

    def changed(state: str, ch: str, by: int) -> str:
        at = f"ascii({ch}) - 42"
        return f"""transform(array(ascii(substring({state}.n, {at}, 1)) - 48), k -> named_struct(
            'sum', {state}.sum + {logs}[k + {by}] - {logs}[k], 'n', overlay({state}.n, char(48 + k + {by}), {at}, 1)))[0]"""

    left = f"CASE WHEN i > {w} THEN {changed('s', f'c[i - {w} - 1]', -1)} ELSE named_struct('sum', s.sum, 'n', s.n) END"
    hot = f"i >= {w} AND {math.log2(w)!r}D - t.sum / {w} >= {limit!r}D"
    return f"""
    transform(array(split({hit}, '')), c ->
      aggregate(sequence(1, size(c)), named_struct('sum', 0.0D, 'n', repeat('0', 80), 'first', 0, 'last', 0), (s, i) ->
        transform(array({left}), u -> transform(array({changed("u", "c[i - 1]", 1)}), t -> named_struct(
          'sum', t.sum, 'n', t.n,
          'first', CASE WHEN s.first = 0 AND {hot} THEN i - {w} + 1 ELSE s.first END,
          'last', CASE WHEN {hot} THEN i ELSE s.last END))[0])[0],
        s -> named_struct('first', s.first, 'last', s.last)))[0]"""


def _entropy(found: str, limit: float) -> str:
    return f"""CAST(transform(filter(transform(
        filter({found}, m -> NOT m.hit RLIKE {_quoted(ALLOW)}),
        m -> named_struct('start', m.start, 'hot', {_hot("m.hit", limit)})), m -> m.hot.first > 0),
        m -> named_struct('start', m.start + m.hot.first - 1, 'kind_rank', 3, 'end', m.start + m.hot.last,
                          'kind', 'entropy')) AS {SPAN})"""


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `spans`: array of (start, kind_rank, end, kind), ordered by start, then by kind.

    A span of kind entropy is added only where it is not inside a span already found by a pattern.
    """
    work = "__solvarium_"
    text = f"{work}text"
    out = docs.drop("spans").withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    steps: dict[str, Column] = {f"{work}{kind}": F.expr(_found(text, p)) for kind, p in zip(KINDS, (ASSIGN, ACCESS, HEX))}
    steps |= {f"{work}run_{name}": F.expr(_found(text, p)) for name, (p, _) in CLASSES.items()}
    out = out.withColumns(steps)
    value = f"regexp_extract(m.hit, {_quoted(ASSIGN)}, 2)"
    base = ", ".join(
        [_spans(f"filter({work}assign, m -> length({value}) >= 12)", "assign"), *(_spans(work + k, k) for k in ("access", "hex"))]
    )
    out = out.withColumn(f"{work}base", F.expr(f"concat({base})"))
    more = ", ".join(_entropy(f"{work}run_{name}", limit) for name, (_, limit) in CLASSES.items())
    out = out.withColumn(f"{work}all", F.expr(f"array_sort(concat({work}base, {more}))"))
    # At one start, spans of patterns sort first: the furthest of their ends so far tells whether one holds this span.
    ends = running("transform(a, x -> CASE WHEN x.kind_rank < 3 THEN x.end ELSE 0 END)", "max")
    own = f"""
      transform(array({work}all), a -> transform(
        filter(zip_with(sequence(0, size(a) - 1), {ends}, (i, e) -> named_struct('i', i, 'e', e)),
          z -> a[z.i].kind_rank < 3 OR z.e < a[z.i].end AND (z.i = 0 OR a[z.i - 1] <> a[z.i])),
        z -> a[z.i]))[0]"""
    out = out.withColumn("spans", F.expr(f"CASE WHEN size({work}all) > 0 THEN {own} ELSE {work}all END"))
    return out.drop(*[c for c in out.columns if c.startswith(work)])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each run of overlapping secret spans in the text replaced by `mark`; other texts stay as they are."""
    work = "__solvarium_"
    found = find_secrets(docs.withColumn("__given", F.col(text_col)), "__given")
    # Before each sorted span stands what lies between the furthest end so far (m) and its start. That is cut from the
    # part of the text that 256 spans cover, since finding a place in a text takes time in proportion to the place.
    ends = running("transform(spans, x -> x.end)", "max")
    piece = f"""CASE WHEN z.m > 0 AND z.a < z.m THEN '' ELSE concat(substring(g.text, z.m - g.from + 1, z.a - z.m), {_quoted(mark)}) END"""
    cut = f"""
      transform(array(zip_with(spans, {ends}, (x, m) -> named_struct('a', x.start, 'm', m))), all ->
        array_join(concat(
          flatten(transform(
            transform(
              transform(sequence(0, CAST((size(all) - 1) div 256 AS INT)), k -> slice(all, 256 * k + 1, 256)),
              y -> named_struct('y', y, 'from', y[0].m, 'text', substring(__given, y[0].m + 1, greatest(0, y[size(y) - 1].a - y[0].m)))),
            g -> transform(g.y, z -> {piece}))),
          array(substring(__given, array_max(transform(spans, x -> x.end)) + 1))), ''))[0]"""
    out = found.withColumn(f"{work}text", F.expr(f"CASE WHEN size(spans) > 0 THEN {cut} ELSE __given END"))
    keep = [F.col(f"{work}text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*keep)


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = {f"n_{k}": F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)") for k in KINDS[:3]}
    return found.select(
        "doc_id",
        *[c.alias(k) for k, c in n.items()],
        F.sha2(joined("filter(spans, x -> x.kind_rank < 3)"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SQL_ASSIGN = rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_found(kind: str, pattern: str) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, hits[i] AS hit,
      CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS INT) AS a
    FROM (SELECT doc_id, hits, string_split_regex(t, '{pattern}') AS pieces, unnest(range(1, len(hits) + 1)) AS i
          FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS hits FROM doc))"""


ORACLE = f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
assign AS ({_sql_found("assign", _SQL_ASSIGN)}),
base AS (
  SELECT doc_id, 0 AS k, kind, a, a + length(hit) AS b FROM assign WHERE length(regexp_extract(hit, '{_SQL_ASSIGN}', 2)) >= 12
  UNION ALL SELECT doc_id, 1, kind, a, a + length(hit) FROM ({_sql_found("access", ACCESS)})
  UNION ALL SELECT doc_id, 2, kind, a, a + length(hit) FROM ({_sql_found("hex", HEX)})),
run AS ({" UNION ALL ".join(f"SELECT *, {limit} AS least FROM ({_sql_found(name, p)})" for name, (p, limit) in CLASSES.items())}),
hot AS (
  SELECT doc_id, a, list_filter(range(1, length(hit) - {WINDOW - 2}), lambda i: list_aggregate(c[i:i + {WINDOW - 1}], 'entropy') >= least) AS w
  FROM (SELECT *, string_split(hit, '') AS c FROM run WHERE NOT regexp_matches(hit, '{ALLOW}'))),
more AS (SELECT DISTINCT doc_id, CAST(a + list_min(w) - 1 AS INT) AS a, CAST(a + list_max(w) - 1 + {WINDOW} AS INT) AS b FROM hot WHERE len(w) > 0),
span AS (
  SELECT * FROM base UNION ALL SELECT doc_id, 3, 'entropy', a, b FROM more e
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = e.doc_id AND base.a <= e.a AND base.b >= e.b)),
said AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n0, count(*) FILTER (WHERE k = 1) AS n1, count(*) FILTER (WHERE k = 2) AS n2,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (WHERE k < 3) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans
  FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN said USING (doc_id)"""
