"""Audit of how five filters of documents interact, over all 120 orders in which they can be applied.

Each document fails a set of filters, a mask of five bits. One pass over the texts gives the first four bits; the fifth
(the text stands at a smaller id too) compares ids within equal texts, known by SHA-256 and length. Rows that are alike
in all that counts are counted together before each shuffle, so a text that a third of all rows share costs each task a
row. What follows needs only counts by part and mask: 32 cells a part.

The orders are visited by adjacent transpositions, so from one to the next only two steps change: the two whose filters
swap; the steps before see the same documents, and those after have the same set of filters before them. These two are
counted anew from the cells, and each filter's removals are added up along the walk, which gives its Shapley sum. Parts
are walked in tasks, each from its one row of cells.

Defined cases: a null text is empty; a null part is the empty string, and one part with it; a null id has no label, fails
no E and makes no other fail it; rows that repeat id and text are documents each, and none fails E by the other; several
labels of an id: it is good or toxic if one of them says so; an empty table gives an empty table; other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, table

FILTERS = "ABCDE"
ALL = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def flagged(docs: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, digest, mask): what each document fails of A to D (bits 0 to 3), with its text's digest and length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.expr(f"filter(split(__text, r'{SPACE}'), w -> w <> '')")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("__text"))
    rows = rows.withColumn("__words", words)
    size, n = F.size("__words"), F.length("__text")
    fails = (
        size < 100,
        100 * F.size(F.array_distinct("__words")) < 80 * size,
        100 * (n - F.length(F.translate("__text", UPPER, ""))).cast("long") > 10 * n.cast("long"),
        F.col("__text").rlike("[#$%&*|]"),
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    digest = F.struct(F.unhex(F.sha2("__text", 256)).alias("sha"), n.alias("n"))
    return rows.select("id", "part", digest.alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the set of filters that they fail, all five.

    Texts are read once: the narrow rows that come from them are written, and so are the rows of alike documents.
    """
    scratch = Scratch(docs.sparkSession, "filters")
    rows = flagged(docs, part_col, id_col, text_col).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = scratch.save(rows, "flags")
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    said = said.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    named = rows.where("id IS NOT NULL").join(said, "id", "left")
    rows = named.unionByName(rows.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))
    rows = rows.na.fill(False, ["good", "toxic"])
    # Copies of a text with one part and label are one row from here on: how many, their least id, and how many have it.
    alike = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("at_least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    alike = scratch.save(alike, "alike")
    first = alike.groupBy("digest").agg(F.min("least").alias("first"), F.count("*").alias("rows"))
    # Only texts with several rows of that kind have to learn the least id of all; the others know it.
    several = first.where("rows > 1").select("digest", "first")
    alike = alike.join(several, "digest", "left").withColumn("first", F.coalesce("first", "least"))
    stays = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    alike = alike.select("part", "mask", "good", "toxic", "n", stays.alias("stays"))
    both = F.explode(F.array(F.struct("mask", F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    alike = alike.select("part", "good", "toxic", both.alias("c")).where("c.n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("c.n")).otherwise(0))
    found = alike.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum("c.n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))
    found = scratch.save(found, "cells")
    scratch.drop("flags", "alike")
    return found


def transpositions(n: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every order of n items once, with the place whose item was swapped with the next one to come there (-1: the first).

    Each item has a direction; the greatest that can step over a smaller neighbour does so, and all greater ones turn.
    """
    order, way = list(range(n)), [-1] * n
    yield tuple(order), -1
    while True:
        free = [(v, i) for i, v in enumerate(order) if 0 <= i + way[v] < n and order[i + way[v]] < v]
        if not free:
            return
        v, i = max(free)
        j = i + way[v]
        order[i], order[j] = order[j], order[i]
        for w in range(v + 1, n):
            way[w] = -way[w]
        yield tuple(order), min(i, j)


def audit(counts: dict[int, tuple[int, int, int]], filters: str = FILTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part, from its cells
    mask -> (n, good, toxic)."""
    n = len(filters)
    total = sum(c[0] for c in counts.values())
    fails = [sum(c[0] for m, c in counts.items() if m >> f & 1) for f in range(n)]
    alone = [counts.get(1 << f, (0, 0, 0))[0] for f in range(n)]
    lost: list[tuple[int, int, int]] = [(0, 0, 0)] * n  # of each step
    left = [total] * n
    shapley, visited = [0] * n, []
    for order, at in transpositions(n):
        for i in range(n) if at < 0 else (at, at + 1):
            f, before = order[i], sum(1 << g for g in order[:i])
            here = [c for m, c in counts.items() if m >> f & 1 and not m & before]
            lost[i] = tuple(map(sum, zip(*here))) if here else (0, 0, 0)
            left[i] = (left[i - 1] if i else total) - lost[i][0]
        for f, gone in zip(order, lost):
            shapley[f] += gone[0]
        visited.append((order, tuple(lost), tuple(left)))
    out = []
    for order, gone, kept in visited:
        name = "".join(filters[f] for f in order)
        for i, f in enumerate(order):
            removed, good, toxic = gone[i]
            out.append((name, i + 1, kept[i], removed, fails[f] - removed, alone[f], good, toxic, shapley[f]))
    return out


def interactions(found: DataFrame) -> DataFrame:
    """The audit of each part of cells()."""
    one = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    names = ("part", "filter_order", "step", *COLUMNS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                said = audit({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in row["cells"]})
                order, step, *numbers = zip(*said)
                columns = [pa.array([row["part"]] * len(said), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in numbers)], names=names)

    return one.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return interactions(cells(docs, table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flag AS (
  SELECT part, CASE WHEN coalesce(good, false) THEN 1 ELSE 0 END AS good, CASE WHEN coalesce(toxic, false) THEN 1 ELSE 0 END AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc.doc_id > min(doc.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM doc LEFT JOIN said ON said.doc_id = doc.doc_id),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flag GROUP BY part, mask),
f AS (SELECT l, b FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)),
perm AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a JOIN f b ON b.b <> a.b
  JOIN f c ON c.b NOT IN (a.b, b.b) JOIN f d ON d.b NOT IN (a.b, b.b, c.b) JOIN f e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
step AS (
  SELECT filter_order, CAST(s AS INT) AS step, bits[s] AS own, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM perm, range(1, 6) AS r(s)),
seen AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN (mask & (own | before)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & own) <> 0 AND (mask & before) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & own) <> 0 AND (mask & before) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & own) <> 0 AND (mask & before) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & own) <> 0 AND (mask & before) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM seen"""
