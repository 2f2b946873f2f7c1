"""What a micro-batch of records changes in small repositories, told in a task for many of them at once.

Rows are those of history's state and of the batch, a repository's together: records that stand, of several batches
(STATE), their status (MARK), and what came (CAME). One pass finds the newest, what is refused, what reaches a change, and
checks that again by bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from solvarium.operators import bits
from solvarium.operators.atoms import Atoms, ints, matched, meets, node_key, whole

STATE, MARK, CAME = 0, 1, 2
STATUS = ["ok", "broken", "unknown"]
RECORD = ("uid", "at", "gone", "name", "ver", "deps", "confs", "provs")


def _edges(x: Atoms, part) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a part's elements and of provided names that meet them."""
    at, of = matched(part.key, x.provs.key)
    good = meets(x.provs.ver[of], x.provs.has[of], part.op[at], part.ver[at], part.has[at])
    return at[good], of[good]


def check_again(x: Atoms, now: np.ndarray, changed: np.ndarray, budget) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, uid, place in STATUS) of packages that are there `now` (of each row; others are what was before) and reach a
    node that changed."""
    at, of = _edges(x, x.deps)
    src, dst = x.deps.node[at], x.provs.node[of]
    again = changed.copy()
    while True:
        new = src[again[dst] & ~again[src]]
        if not len(new):
            break
        again[new] = True
    there = np.zeros(len(x.keys), bool)
    there[x.node[now]] = True
    asked = np.flatnonzero(again & there)

    both = now[x.deps.row[at]] & now[x.provs.row[of]]
    at, of = at[both], of[both]
    unmet = now[x.deps.row].copy()
    unmet[at] = False
    unmet = np.flatnonzero(unmet)
    left, right = _edges(x, x.confs)
    both = now[x.confs.row[left]] & now[x.provs.row[right]] & (x.confs.node[left] != x.provs.node[right])
    left, right = left[both], right[both]
    sizes = [len(asked), len(at), len(unmet), len(left)]
    zero = [np.zeros(n, np.int64) for n in sizes]
    uid, clause = x.node_uid, x.deps.clause
    kind = np.repeat([0, 1, 1, 2], sizes)
    run = np.concatenate([x.node_run[asked], x.deps.run[at], x.deps.run[unmet], x.confs.run[left]])
    a = np.concatenate([zero[0], uid[x.deps.node[at]], uid[x.deps.node[unmet]], uid[x.confs.node[left]]])
    b = np.concatenate([zero[0], clause[at], clause[unmet], uid[x.provs.node[right]]])
    c = np.concatenate([zero[0], uid[x.provs.node[of]], zero[2], zero[3]])
    req = np.concatenate([uid[asked], *zero[1:]])
    by = np.lexsort((b, a, kind, run))
    first, real = kind[by] == 0, np.repeat([False, True, False, False], sizes)[by]
    number = lambda v, valid: pa.array(v[by].astype(np.int32), mask=~valid)
    need = bits.listed(req[by][first].astype(np.int32), first.astype(np.int64), first)
    none = bits.listed(np.zeros(0, np.int32), np.zeros(len(by), np.int64), first)
    columns = [pa.array(run[by]), pa.array(kind[by].astype(np.int8)), number(a, ~first), number(b, ~first), number(c, real), number(req, first), need, none]
    batch = pa.RecordBatch.from_arrays(columns, names=["repo", "kind", "a", "b", "c", "req", "need", "forbid"])
    said = list(bits.solved(budget, False)([batch])) if len(asked) else []
    if not said:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    said = pa.Table.from_batches(said)
    status = pc.index_in(said.column("status"), pa.array(STATUS)).to_numpy()
    return said.column("repo").to_numpy(), said.column("req").to_numpy().astype(np.int64), status.astype(np.int64)


def followed(every: bool, budget):
    """The task: rows of `part` records (to keep: all that stand, if `every`, else what came), refused, checked, status (to
    keep) and counts."""

    def run(batches):
        for t in bits.chunks(batches):
            yield from _chunk(t.combine_chunks(), every, budget)

    return run


def _chunk(t: pa.Table, every: bool, budget):
    ends = bits._ends(t)
    run = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    kind, uid, at = (ints(whole(t.column(c)))[0] for c in ("kind", "uid", "at"))
    gone = pc.fill_null(whole(t.column("gone")), False).to_numpy(zero_copy_only=False)
    key = node_key(run, uid)
    last = np.append(bits._starts(run, kind, uid)[1:], len(run)) - 1
    state, marks, top = (last[kind[last] == k] for k in (STATE, MARK, CAME))

    has = np.searchsorted(key[state], key[top])
    found = np.isin(key[top], key[state])
    newer = ~found
    newer[found] = at[top[found]] > at[state[has[found]]]
    new = top[newer]
    refused = np.setdiff1d(np.flatnonzero(kind == CAME), new)
    touched = np.zeros(len(ends), bool)
    touched[run[new]] = True
    replaced = np.isin(key[state], key[new])
    stays, old = state[~replaced], state[replaced]
    now = np.concatenate([stays[touched[run[stays]]], new])
    now, old = now[~gone[now]], old[~gone[old]]
    rows = np.sort(np.concatenate([now, old]))
    x = Atoms(t.take(pa.array(rows)), run[rows], len(ends))
    s_run, s_uid, status = check_again(x, np.isin(rows, now), np.isin(x.keys, key[new]), budget)

    left = new[gone[new]]
    s_run, s_uid = np.concatenate([s_run, run[left]]), np.concatenate([s_uid, uid[left]])
    status = np.concatenate([status, np.full(len(left), -1)])
    had = pc.fill_null(pc.index_in(whole(t.column("status")), pa.array(STATUS)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = marks[~np.isin(key[marks], node_key(s_run, s_uid))]
    k_run, k_uid, known = np.concatenate([run[kept], s_run]), np.concatenate([uid[kept], s_uid]), np.concatenate([had[kept], status])
    live = (known >= 0) & touched[k_run]
    counted, n = np.unique(k_run[live] * len(STATUS) + known[live], return_counts=True)

    names = [f.name for f in t.schema if f.name in ("repo", *RECORD)]

    def rows_of(part, at):
        got = t.take(pa.array(at))
        return _batch(t, part, len(at), {c: whole(got.column(c)) for c in names})

    def told(part, runs, status, **more):
        where = whole(t.column("repo").take(pa.array(ends[runs] - 1)))
        words = pa.array(STATUS).take(pa.array(status, mask=status < 0))
        return _batch(t, part, len(runs), {"repo": where, "status": words, **more})

    yield rows_of("records", np.concatenate([stays, new]) if every else new)
    yield rows_of("refused", refused)
    yield told("checked", s_run, status, uid=pa.array(s_uid.astype(np.int32)))
    keep = (k_run, known, k_uid) if every else (s_run, status, s_uid)
    yield told("status", keep[0], keep[1], uid=pa.array(keep[2].astype(np.int32)))
    yield told("counts", counted // len(STATUS), counted % len(STATUS), n=pa.array(n.astype(np.int64)))


def _batch(t: pa.Table, part: str, n: int, columns: dict) -> pa.RecordBatch:
    """Rows of a part, columns that it doesn't have null."""
    types = {c: t.schema.field(c).type for c in ("repo", *RECORD, "status")} | {"n": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), *(columns.get(c, None) if c in columns else pa.nulls(n, k) for c, k in types.items())], names=["part", *types])
