"""Constraints and what provides them, matched in a task: model's joins on names for many small repositories at once.

Rows are package records (repo, uid, name, ver, deps, confs, provs), those of a repository together; lists become arrays
with the row that each element stands in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.operators import bits
from solvarium.operators.model import Universe, records
from solvarium.plans.lineage import cut

OPS = {"any": 0, "=": 1, "!=": 2, ">=": 3, ">": 4, "<=": 5, "<": 6}
OTHER, NONE = 7, 8  # an operator that nothing meets, and none


def crowded(rows: DataFrame) -> DataFrame | None:
    """(repo) of repositories whose records hold more than bits.SMALL packages, alternatives, conflicts and provided names
    together; None if there is none."""
    held = sum((F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)) for c in ("deps", "confs", "provs")), F.lit(1))
    out = cut(rows.where("repo IS NOT NULL").groupBy("repo").agg(F.sum(held).alias("n")).where(F.col("n") > bits.SMALL).select("repo"))
    return None if out.isEmpty() else out


def crowded_of(u: Universe) -> DataFrame | None:
    """crowded() of records(u); none is made where the number of packages tells that no repository is."""
    if u.most is not None:
        many = u.source.where("repo IS NOT NULL").groupBy("repo").agg(F.count("*").alias("n"))
        if cut(many.where(F.col("n") * u.most > bits.SMALL)).isEmpty():
            return None
    return crowded(records(u))


def whole(column) -> pa.Array:
    """A column as one array."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (c.chunk(0) if c.num_chunks else pa.array([], c.type)) if isinstance(c, pa.ChunkedArray) else c


def ints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers, 0 where there is none, and where there is one."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)


def codes(*columns: pa.Array) -> list[np.ndarray]:
    """The same number for the same text in any of the columns; -1 for null."""
    each = pa.chunked_array(columns).combine_chunks()
    code = pc.fill_null(whole(each).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(code, np.cumsum([len(c) for c in columns])[:-1])


def matched(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of equal numbers, in order of the left one; negative ones equal nothing."""
    order = np.argsort(right, kind="stable")
    keys = right[order]
    first = np.searchsorted(keys, left)
    n = np.where(left < 0, 0, np.searchsorted(keys, left, side="right") - first)
    at = np.repeat(np.arange(len(left)), n)
    return at, order[np.arange(len(at)) + np.repeat(first - np.cumsum(n) + n, n)]


def spread(run: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run asked for, everything from its first to before its last: (place of the asking, what)."""
    n = (last - first)[run]
    at = np.repeat(np.arange(len(run)), n)
    return at, np.arange(len(at)) + np.repeat(first[run] - np.cumsum(n) + n, n)


def meets(have: np.ndarray, has: np.ndarray, op: np.ndarray, want: np.ndarray, wants: np.ndarray) -> np.ndarray:
    """model.satisfies()."""
    lt, eq = have < want, have == want
    said = np.choose(op, [lt, eq, ~eq, ~lt, ~(lt | eq), lt | eq, lt, lt & False, lt & False])
    return ~has | (op == 0) | (said & wants)


class Part:
    """The elements of a column of lists: the row of each, name, op, ver and whether there is a ver, and clause."""

    def __init__(self, column: pa.Array, ops: bool, clauses: bool):
        self.row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(column)
        self.text = pc.struct_field(flat, "name")
        self.ver, self.has = ints(pc.struct_field(flat, "ver"))
        if ops:
            op = pc.struct_field(flat, "op").dictionary_encode()
            table = np.array([*(OPS.get(o, OTHER) for o in op.dictionary.to_pylist()), NONE])
            self.op = table[pc.fill_null(op.indices, len(table) - 1).to_numpy(zero_copy_only=False)]
        if clauses:
            self.clause = ints(pc.struct_field(flat, "clause"))[0]


class Atoms:
    """Records as arrays; `run` numbers the repository of each row and rises. A node is a package of a repository."""

    def __init__(self, t: pa.Table, run: np.ndarray, runs: int):
        self.run = run
        self.uid = ints(whole(t.column("uid")))[0]
        self.keys, self.node = np.unique(node_key(run, self.uid), return_inverse=True)
        self.node_run, self.node_uid = self.keys >> 32, (self.keys & 0xFFFFFFFF) - (1 << 31)
        self.start = np.searchsorted(self.node_run, np.arange(runs + 1))
        self.place = np.arange(len(self.keys)) - self.start[self.node_run]
        self.ver, self.has = ints(whole(t.column("ver")))
        self.deps, self.confs, self.provs = (Part(whole(t.column(c)), c != "provs", c == "deps") for c in ("deps", "confs", "provs"))
        parts = (self.deps, self.confs, self.provs)
        self.name, *names = codes(whole(t.column("name")), *(p.text for p in parts))
        self.width = 1 + max((int(n.max(initial=0)) for n in (self.name, *names)), default=0)
        for p, name in zip(parts, names):
            p.run, p.node, p.name = run[p.row], self.node[p.row], name
            p.key = self.key(p.run, name)

    def key(self, run: np.ndarray, name: np.ndarray) -> np.ndarray:
        """A number for a name of a repository; negative for no name."""
        return np.where(name < 0, -1, run * self.width + name)


def node_key(run: np.ndarray, uid: np.ndarray) -> np.ndarray:
    return (run << 32) | (uid + (1 << 31))


def holding(part: Part, provs: Part) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a constraint and a provided name that meets it."""
    at, of = matched(part.key, provs.key)
    good = meets(provs.ver[of], provs.has[of], part.op[at], part.ver[at], part.has[at])
    return at[good], of[good]


def resolved(x: Atoms) -> tuple[np.ndarray, ...]:
    """model.resolve_deps() by nodes: (owner, clause, target, whether there is one)."""
    at, of = holding(x.deps, x.provs)
    values, code = np.unique(x.deps.clause, return_inverse=True)
    many, nodes = max(1, len(values)), max(1, len(x.keys))
    clause = x.deps.node * many + code
    found = np.unique(clause[at] * nodes + x.provs.node[of])
    none = np.setdiff1d(clause, found // nodes)
    clause, target = np.concatenate([found // nodes, none]), np.concatenate([found % nodes, none * 0])
    return clause // many, values[clause % many] if len(values) else clause, target, np.arange(len(clause)) < len(found)


def conflicts(x: Atoms) -> tuple[np.ndarray, np.ndarray]:
    """model.resolve_conflicts() by nodes: (lo, hi)."""
    at, of = holding(x.confs, x.provs)
    one, two = x.confs.node[at], x.provs.node[of]
    nodes = max(1, len(x.keys))
    pair = np.unique((np.minimum(one, two) * nodes + np.maximum(one, two))[one != two])
    return pair // nodes, pair % nodes


def packed(t: pa.Table) -> pa.Table:
    """The rows of bits.stream() for the records of a task's repositories, with a request for each package."""
    t = t.combine_chunks()
    ends = bits._ends(t)
    x = Atoms(t, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), len(ends))
    owner, clause, target, has = resolved(x)
    lo, hi = conflicts(x)
    repo = whole(t.column("repo").take(pa.array(ends - 1)))
    run, uid = x.node_run, x.node_uid
    return bits.packed(repo, (run[owner], uid[owner], clause, uid[target], has), (run[lo], uid[lo], uid[hi]), (run, uid))
