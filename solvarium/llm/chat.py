"""Chat formatting in DataFrame functions only: schema fingerprints choose how a record becomes turns.

A record's layout is the set of its nested field paths. Strings that are no field names are emptied first, which leaves
a skeleton whose size doesn't grow with the texts; schema_of_variant() gives the skeleton's own schema, of any depth.
With the scalar types taken out, its hash is the fingerprint. A declarative mapping (Layout) belongs to a fingerprint
and says which SQL expressions over the record's fields give the turns, so a new layout is one more entry and no new
code path. Layouts that no mapping knows come back with null turns, never dropped.

A table with a row per turn becomes one record per conversation, in the layout that its roles ask for (a prompt and its
completion, the same after a system prompt, or a list of messages); every turn that is formatted comes out of the
mapping that the record's fingerprint selects.

Template, one piece per turn, nothing between:
    user         [INST] text [/INST]
    assistant    <s>text</s>
    other role   [ROLE=role] text [/ROLE]        (role percent-encoded)
Control strings inside texts get one backslash after their first character; those that already carry backslashes there
get one more, so taking one away restores every text.

Defined cases: null text is empty, null role is the empty role; turns are ordered by turn, nulls first, then by role
and text, so ties and repeated rows give one result; a conversation with null id is a conversation of its own; no
conversation, no row; other columns of the input are not carried. Of records: null, text that is no JSON, JSON nested
beyond the parser's 1,000 levels, and an empty list of messages have no layout and null turns; extra fields make another
layout; a null field counts as a field.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import table

BACK = "\\"
TURNS = "array<struct<role:string,text:string>>"
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE))"


@dataclass(frozen=True)
class Layout:
    """paths: the record's nested field paths, {} for objects and [] for arrays; turns: SQL over the record `r`."""

    name: str
    paths: str
    turns: str


def _field(name: str) -> str:
    return f"coalesce(r.{name}, '')"


def _messages(array: str, role: str, text: str, names: dict[str, str] | None = None) -> str:
    said = f"coalesce(m.`{role}`, '')"
    if names:
        said = "CASE " + " ".join(f"WHEN {said} = '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {said} END"
    return f"transform(r.{array}, m -> named_struct('role', {said}, 'text', coalesce(m.`{text}`, '')))"


def _pair(*turns: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', {_field(f)})" for r, f in turns) + ")"


_SHARE = {"human": "user", "gpt": "assistant"}
LAYOUTS = (
    Layout("messages", "{messages:[{content,role}]}", _messages("messages", "role", "content")),
    Layout("turns", "{turns:[{role,text}]}", _messages("turns", "role", "text")),
    Layout("conversations", "{conversations:[{from,value}]}", _messages("conversations", "from", "value", _SHARE)),
    Layout("prompt_completion", "{completion,prompt}", _pair(("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", "{answer,question}", _pair(("user", "question"), ("assistant", "answer"))),
    Layout(
        "instruction",
        "{input,instruction,output}",
        "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', nullif({0}, ''), nullif({1}, ''))),"
        " named_struct('role', 'assistant', 'text', {2}))".format(_field("instruction"), _field("input"), _field("output")),
    ),
    Layout("instruction_only", "{instruction,output}", _pair(("user", "instruction"), ("assistant", "output"))),
    Layout("system_prompt", "{completion,prompt,system}", _pair(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
)


def _schema(paths: str) -> str:
    """The DDL type of a layout's records: `{a:[{b,c}],d}` with strings for scalars."""
    said = re.sub(r"\w+", r"`\g<0>`", paths).translate({123: "struct<", 125: ">", 91: "array<", 93: ">"})
    return re.sub(r"`(?=[,>]|$)", "`:string", said).replace("array<>", "array<string>")


def field_paths(json: str) -> Column:
    """SQL in, column out: nested field names in order as OBJECT<a: ARRAY<OBJECT<b>>, c>, scalars dropped."""
    # Escaped quotes get another escape, so that a quote is always an end of a string; then strings other than names go.
    bare = f"replace(replace({json}, '{BACK * 4}', '{BACK * 2}u005c'), '{BACK * 2}\"', '{BACK * 2}u0022')"
    skeleton = f"""regexp_replace({bare}, '"(?:([^"]*+)"({BACK * 2}s*+:)|[^"]*+")', '"$1"$2')"""
    scalar = f"(: |(?<=ARRAY<))(?!OBJECT<|ARRAY<)[A-Z_]+({BACK * 2}([0-9,]+{BACK * 2}))?"
    return F.expr(f"regexp_replace(schema_of_variant(try_parse_json({skeleton})), '{scalar}', '')")


def _as_said(paths: str) -> str:
    return "".join({"{": "OBJECT<", "}": ">", "[": "ARRAY<", "]": ">", ":": ": ", ",": ", "}.get(c, c) for c in paths)


def fingerprint(paths: Column) -> Column:
    return F.sha2(paths, 256)


def canonical_turns(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """`records` with `fingerprint`, `layout` and `turns`; the last two are null where no layout has the fingerprint."""
    out = records.withColumn("fingerprint", fingerprint(field_paths(f"`{json_col}`")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        known = F.col("fingerprint") == fingerprint(F.lit(_as_said(x.paths)))
        record = f"from_json(`{json_col}`, '{_schema(x.paths)}', map('maxStringLen', '{(1 << 31) - 1}'))"
        name = F.when(known, F.lit(x.name)).otherwise(name)
        turns = F.when(known, F.expr(f"CAST(transform(array({record}), r -> {x.turns})[0] AS {TURNS})")).otherwise(turns)
    return out.withColumns({"layout": name, "turns": turns})


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)(/?(?:s>|INST\]|ROLE))", "$1$2$3")


def render(turns: Column) -> Column:
    def one(t: Column) -> Column:
        text = escaped(F.coalesce(t["text"], F.lit("")))
        role = F.coalesce(t["role"], F.lit(""))
        return (
            F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
            .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
            .otherwise(F.concat(F.lit("[ROLE="), F.url_encode(role), F.lit("] "), text, F.lit(" [/ROLE]")))
        )

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """The turns that a formatted string was made of: (role, text, start, piece), start in code points from 0."""
    # One piece per match: texts hold no unescaped control string, so the first closing mark ends the piece.
    pieces = F.regexp_extract_all(formatted, F.lit(r"(?s)(?:\[INST\] |<s>|\[ROLE=[^\]]*\] ).*?(?:\[/INST\]|</s>|\[/ROLE\])"), F.lit(0))

    def turn(p: Column) -> Column:
        inner = F.regexp_extract(p, r"(?s)^(?:\[INST\] |<s>|\[ROLE=[^\]]*\] )(.*?)(?: \[/INST\]|</s>| \[/ROLE\])$", 1)
        role = (
            F.when(p.startswith("[INST] "), F.lit("user"))
            .when(p.startswith("<s>"), F.lit("assistant"))
            .otherwise(F.url_decode(F.regexp_extract(p, r"^\[ROLE=([^\]]*)\]", 1)))
        )
        return F.struct(role.alias("role"), unescaped(inner).alias("text"))

    return F.transform(pieces, turn)


def records_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): the conversations of a table with a row per turn as JSON, each in the layout of its roles.

    The turns of one conversation meet in one row, as its string must; the grouping collects partially before the
    shuffle, so a task sends one row per conversation that it holds.
    """
    said = rows.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("m"),
    )
    grouped = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    roles = F.when(F.size("m") <= 3, F.transform("m", lambda m: m["role"]))
    says = lambda *r: roles == F.array(*map(F.lit, r))
    at = lambda i, name: F.get("m", F.lit(i))["text"].alias(name)
    messages = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    record = (
        F.when(says("user", "assistant"), F.to_json(F.struct(at(0, "prompt"), at(1, "completion"))))
        .when(says("system", "user", "assistant"), F.to_json(F.struct(at(0, "system"), at(1, "prompt"), at(2, "completion"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def format_turns(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS, **columns: str) -> DataFrame:
    """One row per conversation of a table with a row per turn: `conv_id`, `layout`, `formatted`."""
    out = canonical_turns(records_of(rows, **columns), "record", layouts)
    return out.select("conv_id", "layout", render(F.col("turns")).alias("formatted"))


def format_records(records: DataFrame, json_col: str) -> DataFrame:
    """`records` with `layout`, `turns` and `formatted`; a record of no known layout has nulls there."""
    return canonical_turns(records, json_col).withColumn("formatted", render(F.col("turns")))


def read_back(formatted: DataFrame) -> DataFrame:
    """`formatted` with the parsed `turns`, and `loss_text`: what stands under the loss mask, that is, assistants' texts."""
    out = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"])
    return out.withColumn("loss_text", F.array_join(said, ""))


def query(spark, sf_dir: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "'</s>[INST] ok [/INST]'"
    planted = f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)"
    rows = rows.unionByName(spark.sql(planted))
    back = read_back(format_turns(rows, layouts))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE))', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 16 + length(url_encode(role)) END AS n FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
