"""Best-fit packing of token pieces into sequences of a fixed capacity; the sweep over runs of one length is a driver loop.

Tokens. A document's ids are the tokenizer's, then one end id; only documents longer than the capacity are cut. This
tokenizer drops white space and never merges across it, so a chunk between ASCII white space always gives the same
ids: each worker keeps the ids of chunks that it has met, and asks the tokenizer for new ones only.

Packing. Pieces are range-sorted by length, longest first, and written with their place in that order. Lengths are
integers up to the capacity, so the sorted pieces are at most `capacity` runs of one length, and what the driver gets
is one row for each run and range partition (capacity + partitions rows at most, whatever the number of documents).
There a step takes the next run of pieces, sweeps the sorted gaps for the successor (the smallest gap that holds the
length), matches the run's pieces to that gap's sequences by rank, puts back what is left of the gaps, and repeats until
the run is placed; new sequences are opened where no gap holds the length. This is best-fit decreasing, a run at a
time. Matches are rank intervals; each piece then finds its own by (partition, length, rank) in a join against that
bounded table, which is the only thing broadcast.

Defined cases: null text is the empty text (its one token is the end id); pieces of equal length are ordered by the
other columns of the order given, then as they come; repeated rows are packed each; no document, no row.
"""

from __future__ import annotations

import bisect
import functools
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, table

CAPACITY = 4096
END_ID = 1
#: Chunks whose ids a worker keeps, and the longest chunk kept.
KEPT, KEPT_BYTES = 600_000, 64


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special: bool = True):
        """special: whether the names of special tokens in a text give these tokens, or are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        self.encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kept: dict[bytes, bytes] = {}
        self.marks = dict(zip(b".,", self._alone([".", ","])))

    def _alone(self, chunks: list[str]) -> list[bytes]:
        said = self.encode(chunks, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in said]

    def _words(self, chunks: list[str]) -> list[bytes]:
        """Of chunks of letters only: each is one word, so they can be asked for at once and told apart by word ends."""
        if not chunks:
            return []
        ids = np.array(self.encode([" ".join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
        bounds = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(bounds) != len(chunks):
            return self._alone(chunks)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *bounds], bounds)]

    def _new(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """A letter or digit and a full stop or comma after it are never one token: the mark's ids follow the rest's."""
        marked = [c for c in chunks if c.endswith((b".", b",")) and c[-2:-1].isalnum()]
        bare = chunks.difference(marked)
        bare.update([c[:-1] for c in marked])
        bare = bare.difference(self.kept)
        words = [c for c in bare if c.isalpha()]  # of bytes: ASCII letters
        spelt = b" ".join(words).decode("ascii").split()
        others = []
        for c in bare.difference(words):
            t = c.decode("utf-8", "replace")
            if t.isalpha() and t.lower().isalpha():
                words.append(c)
                spelt.append(t)
            else:
                others.append((c, t))
        own = dict(zip(words, self._words(spelt)))
        own |= dict(zip((c for c, _ in others), self._alone([t for _, t in others])))
        kept, marks = self.kept, self.marks
        for c in marked:
            rest = c[:-1]
            own[c] = (own[rest] if rest in own else kept[rest]) + marks[c[-1]]
        return own

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        # The tokenizer lower-cases; only the names of special tokens tell upper case from lower.
        said = [(t if b"<|" in t else t.lower()).split() for t in raw]
        kept, before = self.kept, len(self.kept)
        new = set().union(*said).difference(kept)
        own = self._new(new) if new else {}
        kept.update(own)
        out = [b"".join(map(kept.__getitem__, chunks)) for chunks in said]
        for c in own:  # frequent chunks come early; the tail has no end
            if before >= KEPT or len(c) > KEPT_BYTES:
                del kept[c]
        return out


@functools.lru_cache(2)
def _encoder(path: str, special: bool = True) -> _Encoder:
    """One for each worker process: its tasks share the tokenizer and the chunks that are known."""
    return _Encoder(path, special)


def _groups(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in groups of some 128 KB."""
    own, size = [], 0
    for t in texts:
        own.append(t.as_py())
        size += len(own[-1] or "")
        if size > 1 << 17:
            yield own
            own, size = [], 0
    if own:
        yield own


def token_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    path: str | None = None,
) -> DataFrame:
    """Per piece: the document's id, piece, start, length, and ids (binary: little-endian unsigned 32-bit integers)."""
    path = path or tokenizer_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out = {"at": [], "piece": [], "start": [], "length": [], "ids": []}
            size = 0

            def flush():
                rows = pa.RecordBatch.from_arrays(
                    [
                        batch[0].take(pa.array(out["at"], pa.int64())),
                        pa.array(out["piece"], pa.int32()),
                        pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()),
                        pa.array(out["ids"], pa.binary()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids"],
                )
                for x in out.values():
                    x.clear()
                return rows

            for at, ids in enumerate(ids + end for texts in _groups(batch[1]) for ids in encode(texts)):
                for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    for k, v in zip(out, (at, piece, a // 4, len(own) // 4, own)):
                        out[k].append(v)
                    size += len(own)
                    if size > 16 << 20:
                        yield flush()
                        size = 0
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, piece int, start long, length long, ids binary")


def sweep(runs: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over runs (length, count): matches (length, first rank, count, first sequence, offset).

    Gaps are kept as runs of sequences with consecutive numbers and the same room left, sorted by room.
    """
    rooms: list[int] = []  # sorted
    by_room: dict[int, list[tuple[int, int]]] = {}
    matches, opened = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room <= 0 or count <= 0:
            return
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        by_room[room].append((first, count))

    for length, count in sorted(runs, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[k]
                each = room // length
            else:
                room, each = capacity, capacity // length
                first, n = opened, -(-left // each)
                opened += n
            whole = min(n, left // each)  # sequences that take as many pieces as fit
            for j in range(each):
                if whole:
                    matches.append((length, rank + j * whole, whole, first, capacity - room + j * length))
            rank += each * whole
            rest = min(count - rank, each - 1) if whole < n else 0  # the last one takes what is left of the run
            for j in range(rest):
                matches.append((length, rank + j, 1, first + whole, capacity - room + j * length))
            rank += rest
            put(room - each * length, first, whole)
            put(room - rest * length, first + whole, 1 if rest else 0)
            put(room, first + whole + (1 if rest else 0), n - whole - (1 if rest else 0))
    return matches


def best_fit(pieces: DataFrame, *, length_col: str = "length", order: tuple[str, ...] = (), capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; lengths must be from 1 to `capacity`."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    names = pieces.columns
    by = [F.col(length_col).desc(), *order]
    # Written before the range sort, since that samples its input and would run what is upstream twice.
    made = scratch.save(pieces, "pieces")
    placed = made.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__place", F.monotonically_increasing_id())
    placed = scratch.save(placed, "sorted")
    scratch.drop("pieces")
    part, at = F.shiftright("__place", 33).alias("__part"), F.col("__place").bitwiseAND((1 << 33) - 1).alias("__at")
    placed = placed.select(*names, part, at)
    runs = placed.groupBy("__part", F.col(length_col).alias("length")).agg(F.count("*").alias("n"), F.min("__at").alias("at"))
    rows = sorted(runs.collect(), key=lambda r: (r["__part"], r["at"]))  # capacity + partitions rows at most
    totals: dict[int, int] = {}
    held: dict[int, list[tuple[int, int, int, int]]] = {}  # length: (first rank, count, partition, place)
    for r in rows:
        if not 0 < r["length"] <= capacity:
            raise ValueError(f"a piece of length {r['length']} can't be packed into {capacity}")
        held.setdefault(r["length"], []).append((totals.get(r["length"], 0), r["n"], r["__part"], r["at"]))
        totals[r["length"]] = totals.get(r["length"], 0) + r["n"]
    out = []
    for length, rank, count, sequence, offset in sweep(list(totals.items()), capacity):
        spans = held[length]
        for first, n, p, place in spans[max(0, bisect.bisect_right(spans, (rank, float("inf"))) - 1) :]:
            lo, hi = max(rank, first), min(rank + count, first + n)
            if first >= rank + count:
                break
            if lo < hi:
                out.append((p, length, place + lo - first, place + hi - first, sequence + lo - rank, offset))
    found = spark.createDataFrame(out, "p long, l long, lo long, hi long, sequence long, offset long")
    on = (F.col("__part") == F.col("p")) & (F.col(length_col) == F.col("l")) & (F.col("__at") >= F.col("lo")) & (F.col("__at") < F.col("hi"))
    joined = placed.alias("x").join(F.broadcast(found.alias("m")), on)
    return joined.select(
        *[F.col(f"x.`{c}`") for c in names if c not in ("sequence_id", "offset")],
        (F.col("m.sequence") + F.col("x.__at") - F.col("m.lo")).alias("sequence_id"),
        F.col("m.offset").alias("offset"),
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """Per piece: id, piece, start, length, ids, sequence_id, offset."""
    pieces = token_pieces(docs, capacity=capacity, **options)
    return best_fit(pieces, order=(pieces.columns[0], "piece"), capacity=capacity)


def digest(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """As pack(), with the ids' CRC-32 in place of the ids."""
    pieces = token_pieces(docs, capacity=capacity, **options)
    short = pieces.select(pieces.columns[0], "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit(short, order=(pieces.columns[0], "piece"), capacity=capacity)


def query(spark, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"))
