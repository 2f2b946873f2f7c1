"""Repositories of up to eight packages as truth tables: a bit for each set of packages, in four words of 64.

A clause and a conflict are a table each, all of a repository's are put together by `and`, and what a question asks for is
one more. So a task answers for thousands of repositories in a few array operations. Tasks get rows by bits.stream(), find
out which repositories are that narrow, and name the others, which take the ways of their modules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from solvarium.operators import atoms, bits
from solvarium.operators.model import Universe, together
from solvarium.plans.lineage import cut

#: Packages of a repository that a truth table covers.
WIDTH = 8
SETS = np.arange(1 << WIDTH)


def _packed(tables: np.ndarray) -> np.ndarray:
    return np.packbits(tables, axis=1, bitorder="little").view(np.uint64)


#: Row m: the sets that hold one of m, all of m, exactly one of m. A set is a number, a bit a place.
SOME = _packed((SETS & SETS[:, None]) != 0)
ALL = _packed((SETS & SETS[:, None]) == SETS[:, None])
ONE = _packed(np.bitwise_count(SETS & SETS[:, None]) == 1)
#: Row n: the sets of the first n places.
FIRST = _packed(SETS < (1 << np.arange(WIDTH + 1))[:, None])


def grown(tables: np.ndarray) -> np.ndarray:
    """The sets that hold a set of the table."""
    return _moved(tables, range(WIDTH), True)


def shrunk(tables: np.ndarray, places=range(WIDTH)) -> np.ndarray:
    """The sets that are a set of the table, but for some of those places left out."""
    return _moved(tables, places, False)


def _moved(tables: np.ndarray, places, up: bool) -> np.ndarray:
    out = tables.copy()
    for p in places:
        out |= _step(out, p, up)
    return out


def _step(tables: np.ndarray, p: int, up: bool) -> np.ndarray:
    """The table's sets without place p with it put in, or those with it without it."""
    by = np.uint64(1 << p) if p < 6 else None
    own = tables & (~SOME[1 << p] if up else SOME[1 << p])
    if by is not None:
        return own << by if up else own >> by
    return np.roll(own, (1 << p - 6) * (1 if up else -1), axis=1)


def listed(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every set of each table: (row, set), in order."""
    return np.nonzero(np.unpackbits(np.ascontiguousarray(tables).view(np.uint8), axis=1, bitorder="little"))


def least(tables: np.ndarray) -> np.ndarray:
    """The first set of each table that has one."""
    return np.unpackbits(np.ascontiguousarray(tables).view(np.uint8), axis=1, bitorder="little").argmax(axis=1)


def merge(out: np.ndarray, run: np.ndarray, tables: np.ndarray) -> None:
    """`and` of the tables into those of their runs; run is sorted."""
    at = bits._starts(run)
    if len(at):
        out[run[at]] &= np.bitwise_and.reduceat(tables, at, axis=0)


class Sets:
    """Of a chunk's repositories: whether each is narrow, its closed sets, and those of them without a conflict."""

    def __init__(self, x: bits.Chunk):
        many = np.bincount(x.node_run, minlength=len(x.first))
        self.many, self.narrow = many, many <= WIDTH
        self.closed = FIRST[np.minimum(many, WIDTH)]
        run = x.node_run[x.owner]
        keep = self.narrow[run]
        merge(self.closed, run[keep], ~SOME[1 << x.place[x.owner[keep]]] | SOME[low(x.asks[keep])])
        self.valid = self.closed.copy()
        run = x.node_run[x.lo]
        keep = self.narrow[run]
        both = (1 << x.place[x.lo[keep]]) | (1 << x.place[x.hi[keep]])
        merge(self.valid, run[keep], ~ALL[both])
        self.fighting = np.zeros(len(many), np.int64)
        np.bitwise_or.at(self.fighting, run[keep], both)


def low(words: np.ndarray) -> np.ndarray:
    """The first eight places of rows of words, as numbers."""
    return (words[:, 0] & np.uint64(255)).astype(np.int64)


def asked(x: bits.Chunk, sets: Sets) -> np.ndarray:
    """The places that a request of each run names, none of wide runs."""
    out = np.zeros(len(sets.many), np.int64)
    np.bitwise_or.at(out, x.run, np.where(sets.narrow[x.run], low(x.need), 0))
    return out


def strong(x: bits.Chunk, sets: Sets) -> np.ndarray:
    """[run, place]: what else every valid set with the place holds, nothing for places not asked for or in no set."""
    out = np.zeros((len(sets.many), WIDTH), np.int64)
    here = asked(x, sets)
    for p in range(WIDTH):
        held = sets.valid & SOME[1 << p]
        fine = held.any(axis=1) & (here >> p & 1 == 1)
        for q in range(WIDTH):
            if q != p:
                out[:, p] |= (fine & ~(held & ~SOME[1 << q]).any(axis=1)).astype(np.int64) << q
    return out


def edges(x: bits.Chunk, sets: Sets) -> np.ndarray:
    """[run, place]: the other places that its alternatives name."""
    out = np.zeros((len(sets.many), WIDTH), np.int64)
    run = x.node_run[x.src]
    at = np.flatnonzero(sets.narrow[run] & (x.src != x.dst))
    np.bitwise_or.at(out, (run[at], x.place[x.src[at]]), 1 << x.place[x.dst[at]])
    return out


def back(of: np.ndarray) -> np.ndarray:
    """The edges turned round."""
    out = np.zeros_like(of)
    for p in range(WIDTH):
        for q in range(WIDTH):
            out[:, q] |= (of[:, p] >> q & 1) << p
    return out


def members(x: bits.Chunk, run: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The uids of each set, one after the other, and how many each has."""
    words = np.zeros((len(sets), x.words), np.uint64)
    words[:, 0] = sets
    return x.sets(words, run)


def repos(x: bits.Chunk, run: np.ndarray) -> pa.Array:
    got = x.t.column("repo").take(pa.array(x.first[run])).combine_chunks()
    return got.chunk(0) if isinstance(got, pa.ChunkedArray) else got


def told(task, schema: str, resolved: DataFrame, conflicts: DataFrame | None = None, requests: DataFrame | None = None, more: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, DataFrame | None]:
    """What task(chunk, sets) tells of narrow repositories, as arrays of the columns of `schema` after repo, with each
    row's run before them; and (repo) of those that are wider, None if there is none. `more` are tables of the stream."""
    tables = [resolved, *([conflicts] if conflicts is not None else []), *([requests] if requests is not None else [])]
    crowd = bits.crowded(*tables, *more)
    small = bits.split(crowd, resolved, conflicts, requests, *more)[0] if crowd is not None else [resolved, conflicts, requests, *more]
    return _parted(bits.stream(*small[:3], more=small[3:]).mapInArrow(_run(task, schema), f"{schema}, wide boolean"), crowd)


def told_of(task, schema: str, u: Universe) -> tuple[DataFrame, DataFrame | None]:
    """told() of a universe with a request for each package: records go through one shuffle and are resolved where they are
    asked, so that no table of alternatives or conflicts is written."""
    crowd = atoms.crowded_of(u)
    return _parted(together(u, crowd).mapInArrow(_run(task, schema, atoms.packed), f"{schema}, wide boolean"), crowd)


def _run(task, schema: str, made=lambda t: t):
    """The task of told(): `made` are the rows of a stream that a table stands for."""
    names = [c.strip().split(" ", 1)[0].strip("`") for c in bits.fields(schema)]

    def run(batches):
        for t in bits.chunks(batches):
            x = bits.Chunk(made(t))
            sets = Sets(x)
            at, *columns = task(x, sets)
            yield pa.RecordBatch.from_arrays([repos(x, at), *columns, pa.array(np.zeros(len(at), bool))], names=[*names, "wide"])
            wide = np.flatnonzero(~sets.narrow)
            if len(wide):
                yield pa.RecordBatch.from_arrays([repos(x, wide), *(pa.nulls(len(wide), c.type) for c in columns), pa.array(np.ones(len(wide), bool))], names=[*names, "wide"])

    return run


def _parted(said: DataFrame, crowd: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """What was told, and (repo) of those that are wide or crowded."""
    out = cut(said)
    rest = out.where("wide").select("repo")
    rest = None if rest.isEmpty() else rest
    if crowd is not None:
        rest = crowd if rest is None else rest.unionByName(crowd)
    return out.where("NOT wide").drop("wide"), rest
