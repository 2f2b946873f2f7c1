"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton holds every substring of every item. A document's words are streamed through it; the state's matching
length says how long a suffix of what was read occurs in some item. Where it reaches the window, the window's words are
hit; a shorter item is a window of its own and is found as a suffix of the state's string.

Size. The items are a query set: they are brought to the driver in blocks of BLOCK_WORDS words at most, one automaton a
block; an item of more words is cut into pieces that overlap by a window less one word, so that each window is in a
piece. One block is broadcast. Several go to files in the shared folder, and a task matches BUFFER bytes of documents
against one after the other, so that documents are read once, and one automaton and one buffer are in memory. Documents
are never shuffled or rewritten: the only stage maps over them in Arrow batches.

Words: A-Z lower-cased, then runs of characters other than ASCII punctuation, space and controls.

Defined cases: a null text has no words; an item without words matches nothing; repeated rows and items count each; an
empty benchmark leaves all as it is; an item id that is null counts as a window, but not among the items listed; other
columns of the input are kept, and columns named words, spans or items are replaced.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvarium.llm._shared import shared_uri, table

WINDOW = 10
BLOCK_WORDS = 200_000
#: Bytes of text that a task holds while it goes through several blocks.
BUFFER = 16 << 20
#: Lower-cases A-Z and turns every ASCII character that is no letter or digit into a space; other bytes stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_GAPS = bytes(120 if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton over words of all items; states are list indexes, 0 the start."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        for _, said in items:
            self._add(said)
        # What occurs at a state: short items by their length, and the items that hold the state's window.
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.held: dict[int, set] = {}
        for item, said in items:
            if 0 < len(said) < window:
                state = self._state(said)
                self.short.setdefault(state, []).append((len(said), item))
            for _, state, n in self.stream(said):
                if n >= window:
                    self.held.setdefault(self._window_state(state), set()).add(item)
        # A state's suffixes are those of its link too: carry short items down the links, shortest strings first.
        for state in sorted(range(1, len(self.step)), key=self.length.__getitem__):
            if up := self.short.get(self.link[state]):
                self.short[state] = up + self.short.get(state, [])

    def _add(self, said: list[bytes]) -> None:
        step, length, link = self.step, self.length, self.link
        last = 0
        for w in said:
            if (q := step[last].get(w)) is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:  # the string is there, as part of a longer state: split that state
                last = self._split(last, w, q)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and w not in step[p]:
                step[p][w] = new
                p = link[p]
            if p != -1:
                q = step[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = new

    def _split(self, p: int, w: bytes, q: int) -> int:
        step, length, link = self.step, self.length, self.link
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p != -1 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def _state(self, said: list[bytes]) -> int:
        state = 0
        for w in said:
            state = self.step[state][w]
        return state

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, said: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(end, state, matching length) after each word, where the length is not 0."""
        step, length, link = self.step, self.length, self.link
        state = n = 0
        start = step[0]
        for end, w in enumerate(said, 1):
            if (to := step[state].get(w)) is not None:
                state, n = to, n + 1
            elif state:
                while state != -1 and w not in step[state]:
                    state = link[state]
                if state == -1:
                    state = n = 0
                    continue
                n = length[state] + 1
                state = step[state][w]
            else:
                continue
            yield end, state, n

    def hits(self, said: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans (first word, end) of hit words, and the items with occurring windows."""
        step, length, link, short, window = self.step, self.length, self.link, self.short, self.window
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = n = 0
        root = step[0]
        at = root
        for end, w in enumerate(said, 1):  # stream() written out: this loop runs once for each word of the corpus
            to = at.get(w)
            if to is None:
                if not state:
                    continue
                while True:
                    state = link[state]
                    if state == -1:
                        break
                    to = step[state].get(w)
                    if to is not None:
                        break
                if to is None:
                    state, n, at = 0, 0, root
                    continue
                n = length[state]
            state = to
            at = step[to]
            n += 1
            if n >= window:
                spans.append((end - window, end))
                items |= self.held.get(self._window_state(state), ())
            if state in short:
                for k, item in short[state]:
                    if k <= n:
                        spans.append((end - k, end))
                        items.add(item)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, window: int) -> Iterator[list]:
    """Items with their words in blocks; items come to the driver a partition at a time."""
    block, size = [], 0
    block_words = max(block_words, 2 * window)
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        all_ = words(text)
        for a in range(0, max(1, len(all_) - window + 1), block_words - window + 1):
            said = all_[a : a + block_words]
            if block and size + len(said) > block_words:
                yield block
                block, size = [], 0
            block.append((item, said))
            size += len(said)
    if block:
        yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    prefix: str = "",
) -> DataFrame:
    """`docs` with `words` (number), `spans` (merged word spans that are hit) and `items` (item ids, as strings).

    prefix: before the names of the three, so that columns of the same names can stay.
    """
    spark = docs.sparkSession
    new = {
        f"{prefix}words": F.lit(0).cast("long"),
        f"{prefix}spans": F.array().cast("array<struct<start:int,end:int>>"),
        f"{prefix}items": F.array().cast("array<string>"),
    }
    out = docs.drop(*new).withColumns(new)
    blocks = (Automaton(x, window) for x in _blocks(benchmark, item_id, item_text, block_words, window))
    first, second = next(blocks, Automaton([], window)), next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(first)
        return _matched(out, lambda: [shared.value], text_col, prefix, 0)
    root = f"{shared_uri(spark)}/solvarium/decontam-{uuid.uuid4().hex}"
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    n = 0
    for n, automaton in enumerate(itertools.chain([first, second], blocks), 1):
        with store.open_output_stream(f"{base}/{n}") as f:
            f.write(pickle.dumps(automaton))

    def load() -> Iterator[Automaton]:
        store, base = fs.FileSystem.from_uri(root)
        for k in range(1, n + 1):
            with store.open_input_stream(f"{base}/{k}") as f:
                yield pickle.loads(f.read())

    return _matched(out, load, text_col, prefix)


def _matched(docs: DataFrame, automata: Callable[[], Iterable[Automaton]], text_col: str, prefix: str, buffer: int = BUFFER) -> DataFrame:
    schema = T.StructType(docs.schema.fields)

    def run(batches):
        for held in _buffers(batches, text_col, buffer):
            said = [[words(t.as_py()) for t in batch[batch.schema.get_field_index(text_col)]] for batch in held]
            found = [[([], set()) for _ in own] for own in said]
            for automaton in automata():
                for own, rows in zip(said, found):
                    for k, w in enumerate(own):
                        spans, items = automaton.hits(w)
                        if spans:
                            rows[k] = merged(rows[k][0] + spans), rows[k][1] | items
            for batch, own, rows in zip(held, said, found):
                new = {
                    f"{prefix}words": [len(w) for w in own],
                    f"{prefix}spans": [[{"start": a, "end": b} for a, b in spans] for spans, _ in rows],
                    f"{prefix}items": [sorted({str(x) for x in items if x is not None}) for _, items in rows],
                }
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(new[f.name], type=batch.schema.field(i).type) if f.name in new else batch[i]
                        for i, f in enumerate(batch.schema)
                    ],
                    schema=batch.schema,
                )

    return docs.mapInArrow(run, schema)


def _buffers(batches, text_col: str, buffer: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch[batch.schema.get_field_index(text_col)].nbytes
        if size > buffer:
            yield held
            held, size = [], 0
    if held:
        yield held


def remove(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    max_coverage: float = 0.0,
    window: int = WINDOW,
    **options,
) -> DataFrame:
    """`docs` without contamination: a document of which more than `max_coverage` of the words is hit goes; from the
    others, hit spans are cut out of the text. Clean documents come back as they are, in the columns of `docs`."""
    found = find_contamination(docs, benchmark, text_col=text_col, window=window, prefix="__hit_", **options)
    hit = F.aggregate("__hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    keep = found.where(hit <= max_coverage * F.col("__hit_words"))
    names = docs.columns
    if max_coverage <= 0:
        return keep.select(*names)
    schema = docs.schema

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(names.index(text_col)).to_pylist(), batch.column(len(names)).to_pylist()
            new = [without(t, [(x["start"], x["end"]) for x in s]) if s else t for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, type=batch.schema.field(i).type) if c == text_col else batch[i] for i, c in enumerate(names)],
                names=names,
            )

    return keep.select(*names, "__hit_spans").mapInArrow(cut, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    shape, at, bounds = raw.translate(_GAPS), 0, []
    while (start := shape.find(b"x", at)) >= 0:
        at = shape.find(b" ", start)
        at = len(raw) if at < 0 else at
        bounds.append((start, at))
    out, kept = [], 0
    for a, b in spans:
        out.append(raw[kept : bounds[a][0]])
        kept = bounds[b - 1][1]
    return b"".join([*out, raw[kept:]]).decode("utf-8", "surrogatepass")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_W = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH item AS (SELECT item_id, regexp_extract_all({_LOWER}, {_W}) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k,
    unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM item WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_W}) AS w FROM documents),
gram AS (
  SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM doc, sizes WHERE len(w) >= k),
occ AS (SELECT gram.r, gram.i, gram.k, win.item_id FROM gram JOIN win USING (g, k)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""
