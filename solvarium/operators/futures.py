"""What each move of a cluster breaks, told in a task for many narrow repositories at once: evolution.challenged() without a
row for each package of each future.

A future is one repository and one cluster at one target. Only the versions that the cluster provides differ in it, so
the pairs of constraints and provided names are found once, and each future says which of them hold. Its sets of
packages are a truth table, as in tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from solvarium.operators import bits, tables
from solvarium.operators.atoms import NONE, Atoms, codes, matched, meets, node_key, spread, whole


def others(x: Atoms) -> np.ndarray:
    """Whether a provided name is another than the package's own."""
    theirs = x.node * x.width + x.name
    return ~np.isin(x.provs.node * x.width + x.provs.name, theirs[x.name >= 0])


def moves(x: Atoms, own_cluster: np.ndarray, name: np.ndarray, own_ver: np.ndarray, there: np.ndarray, cluster_run: np.ndarray) -> tuple[np.ndarray, ...]:
    """evolution.targets() of clusters that hold packages of such names, versions and whether there is one: (cluster, target),
    and for each of them the equivalents' first and last place in the points."""
    many = len(cluster_run)
    named = np.unique(own_cluster[name >= 0] * x.width + name[name >= 0])
    named_key = x.key(cluster_run[named // x.width], named % x.width)
    other = others(x) & x.provs.has
    asks = [(p.key[k], p.op[k], p.ver[k]) for p in (x.deps, x.confs) for k in [(p.op > 0) & (p.op < NONE) & p.has]]
    asks.append((x.provs.key[other], np.ones(int(other.sum()), np.int64), x.provs.ver[other]))
    key, op, ver = (np.concatenate(c) for c in zip(*asks))
    at, of = matched(key, named_key)
    cluster, op, ver = named[of] // x.width, op[at], ver[at]

    present, now = own_ver[there], np.full(many, np.iinfo(np.int64).min)
    np.maximum.at(now, own_cluster[there], present * 2)
    values, code = np.unique(np.concatenate([ver, present]), return_inverse=True)
    each, place = np.unique(np.concatenate([cluster, own_cluster[there]]) * max(1, len(values)) + code, return_inverse=True)
    place = place[: len(ver)]
    point_cluster = np.repeat(each // max(1, len(values)), 2)
    point = np.repeat(values[each % max(1, len(values))] * 2, 2) + np.tile([0, 1], len(each))
    turn, single = np.zeros(len(point), bool), np.full(len(point), -1)
    order = (op >= 3) & (op <= 6)
    turn[place[order] * 2 + np.isin(op[order], (4, 5))] = True
    alone = place[(op == 1) | (op == 2)] * 2
    single[alone] = alone
    passed = np.cumsum(turn)
    by = np.lexsort((single, passed, point_cluster))
    point, point_cluster = point[by], point_cluster[by]
    first = bits._starts(point_cluster, passed[by], single[by])
    last = np.append(first[1:], len(point)) if len(first) else first
    group = point_cluster[first]
    same = np.logical_or.reduceat(point == now[point_cluster], first) if len(first) else np.zeros(0, bool)
    target = point[last - 1]
    keep = (target > now[group]) & (now[group] > np.iinfo(np.int64).min) & ~same
    return group[keep], target[keep], first[keep], last[keep], point


def installable(x: Atoms, run: np.ndarray, cluster: np.ndarray, target: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Of futures, the places that can be installed, as bits; cluster -1: as it is. `inside` are the places of each
    cluster's packages."""
    mine = ~others(x)
    spot, many = x.place, np.diff(x.start)

    def holding(part, at, of):
        """(future, pair): pairs of constraints and provided names that hold in a future."""
        bounds = np.searchsorted(part.run[at], np.arange(len(many) + 1))
        future, pair = spread(run, bounds[:-1], bounds[1:])
        a, p = at[pair], of[pair]
        moved = (cluster[future] >= 0) & mine[p] & (inside[cluster[future]] >> spot[x.provs.node[p]] & 1 > 0)
        have = np.where(moved, target[future], x.provs.ver[p] * 2)
        good = meets(have, x.provs.has[p] | moved, part.op[a], part.ver[a] * 2, part.has[a])
        return future[good], a[good], p[good]

    valid = tables.FIRST[many[run]]
    values, code = np.unique(x.deps.clause, return_inverse=True)
    clauses, clause = np.unique(x.deps.node * max(1, len(values)) + code, return_inverse=True)
    owner = clauses // max(1, len(values))
    bounds = np.searchsorted(x.node_run[owner], np.arange(len(many) + 1))
    future, which = spread(run, bounds[:-1], bounds[1:])
    begin = np.cumsum(np.diff(bounds)[run]) - np.diff(bounds)[run] - bounds[:-1][run]
    met = np.zeros(len(future), np.int64)
    f, a, p = holding(x.deps, *matched(x.deps.key, x.provs.key))
    np.bitwise_or.at(met, begin[f] + clause[a], 1 << spot[x.provs.node[p]])
    tables.merge(valid, future, ~tables.SOME[1 << spot[owner[which]]] | tables.SOME[met])

    at, of = matched(x.confs.key, x.provs.key)
    apart = x.confs.node[at] != x.provs.node[of]
    f, a, p = holding(x.confs, at[apart], of[apart])
    tables.merge(valid, f, ~tables.ALL[(1 << spot[x.confs.node[a]]) | (1 << spot[x.provs.node[p]])])
    out = np.zeros(len(run), np.int64)
    for k in range(tables.WIDTH):
        out |= (valid & tables.SOME[1 << k]).any(axis=1).astype(np.int64) << k
    return out


class Listed:
    """Records of kind 0 and members of kind 1: atoms, and for each package of a cluster the cluster and the row."""

    def __init__(self, t: pa.Table):
        self.t = t = t.combine_chunks()
        self.ends = ends = bits._ends(t)
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        member = whole(t.column("kind")).to_numpy() == 1
        rows = np.flatnonzero(~member)
        self.x = x = Atoms(t.take(pa.array(rows)), of[rows], len(ends))
        rows = np.flatnonzero(member)
        self.listed = t.take(pa.array(rows))
        cluster = of[rows] * (len(rows) + 1) + codes(whole(self.listed.column("cluster")))[0]
        _, self.some, cluster = np.unique(cluster, return_index=True, return_inverse=True)
        self.cluster_run = of[rows][self.some]
        at, self.row = matched(node_key(of[rows], whole(self.listed.column("uid")).to_numpy().astype(np.int64)), node_key(x.run, x.uid))
        self.own = cluster[at]

    def repo(self, run: np.ndarray) -> pa.Array:
        return whole(self.t.column("repo").take(pa.array(self.ends[run] - 1)))


def told(small: bool):
    """The task: (repo, cluster, target, equivalents, broken, unknown, wide) of rows (repo, kind, record, cluster), records
    of kind 0 and members of kind 1; wide: a repository that a truth table doesn't cover. small: versions are ints."""
    number = pa.int32() if small else pa.int64()

    def run(batches):
        for t in bits.chunks(batches):
            said = Listed(t)
            x, cluster_run = said.x, said.cluster_run
            wide = np.flatnonzero(np.diff(x.start) > tables.WIDTH)
            fits = ~np.isin(x.run[said.row], wide)
            own, row = said.own[fits], said.row[fits]
            goal, target, first, last, point = moves(x, own, x.name[row], x.ver[row], x.has[row], cluster_run)
            inside = np.zeros(len(cluster_run), np.int64)
            np.bitwise_or.at(inside, own, 1 << x.place[x.node[row]])

            mine = cluster_run[goal]
            asked = np.unique(mine)
            none = np.zeros(len(asked), np.int64)
            fine = installable(x, np.concatenate([mine, asked]), np.concatenate([goal, none - 1]), np.concatenate([target, none]), inside)
            broken = np.bitwise_count(fine[len(goal) :][np.searchsorted(asked, mine)] & ~fine[: len(goal)]).astype(np.int64)
            n = last - first
            points = point[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
            equivalents = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(points, number))
            names = ["repo", "cluster", "target", "equivalents", "broken", "unknown", "wide"]
            clusters = whole(said.listed.column("cluster").take(pa.array(said.some[goal])))
            yield pa.RecordBatch.from_arrays([said.repo(mine), clusters, pa.array(target, number), equivalents, pa.array(broken), pa.array(broken * 0), pa.array(np.zeros(len(goal), bool))], names=names)
            if len(wide):
                nulls = [pa.nulls(len(wide), c) for c in (clusters.type, number, equivalents.type, pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([said.repo(wide), *nulls, pa.array(np.ones(len(wide), bool))], names=names)

    return run


#: Packages, those that may come among them, of a repository whose futures are put together in a task.
MOST = 256
#: Rows that such a task takes at once.
CHUNK = 20_000


def outdated(budget: tuple[int, int | None], first: int):
    """The task: (repo, uid, status, wide) of rows as those of told(): evolution.outdated() without a table of what may come;
    wide: a repository that may become more than MOST packages."""

    def run(batches):
        for t in bits.chunks(batches, CHUNK):
            said = Listed(t)
            x = said.x
            many = np.diff(x.start)
            made = Made(said, first)
            wide = many + np.bincount(made.run, minlength=len(many)) > MOST
            inside = np.zeros(1, np.int64)
            narrow = np.flatnonzero((many > 0) & (many <= tables.WIDTH) & ~wide)
            none = np.zeros(len(narrow), np.int64)
            now = np.zeros(len(many), np.int64)
            now[narrow] = installable(x, narrow, none - 1, none, inside)  # what goes in now does so still, as nothing has to move
            fine = (many[x.node_run] <= tables.WIDTH) & (now[x.node_run] >> np.minimum(x.place, tables.WIDTH) & 1 == 1)
            asked = np.flatnonzero(~fine & ~wide[x.node_run])
            rows = bits.packed(pa.array(np.arange(len(many))), *made.resolved(~wide), (x.node_run[asked], x.place[asked]))
            status = np.full(len(x.keys), "ok", "U7")
            chunk = bits.Chunk(rows)
            status[asked] = bits.statuses(chunk, budget)[0]
            at = np.flatnonzero(~wide[x.node_run])
            names = ["repo", "uid", "status", "wide"]
            yield pa.RecordBatch.from_arrays([said.repo(x.node_run[at]), pa.array(x.node_uid[at].astype(np.int32)), pa.array(status[at], pa.string()), pa.array(np.zeros(len(at), bool))], names=names)
            at = np.flatnonzero(wide)
            if len(at):
                yield pa.RecordBatch.from_arrays([said.repo(at), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.string()), pa.array(np.ones(len(at), bool))], names=names)

    return run


class Made:
    """What evolution.future() adds to the packages of a task's repositories: run and number within it (after the packages'
    places), cluster, state, name, and the package whose other names it provides (-1: none)."""

    def __init__(self, said: Listed, first: int):
        self.x = x = said.x
        _, keep = np.unique(node_key(said.own, x.node[said.row]), return_index=True)
        own, row = said.own[keep], said.row[keep]
        self.members = own, x.node[row]
        self.other = np.flatnonzero(others(x))
        asks = np.unique(np.concatenate([x.deps.key, x.confs.key, x.provs.key[self.other]]))
        lone = np.setdiff1d(asks[asks >= 0], x.key(x.run, x.name))
        mark = np.arange(len(lone)) + len(said.cluster_run)
        cluster_run = np.concatenate([said.cluster_run, lone // x.width])
        cluster, name = np.concatenate([own, mark]), np.concatenate([x.name[row], lone % x.width])
        ver, has = np.concatenate([x.ver[row], lone * 0 + first]), np.concatenate([x.has[row], lone >= 0])
        node = np.concatenate([x.node[row], lone * 0 - 1])
        goal, target = moves(x, cluster, name, ver, has, cluster_run)[:2]
        at, of = matched(cluster, goal)
        up = has[at] & (target[of] > 2 * ver[at]) & (name[at] >= 0)
        at, state = np.concatenate([at[up], np.arange(len(own), len(cluster))]), np.concatenate([target[of[up]], lone * 0 + 2 * first])
        # Of those that provide nothing but the same version of a name in one cluster, one stands for all.
        plain = ~np.isin(node[at], x.provs.node[self.other])
        key = np.lexsort((plain, state, name[at], cluster[at]))
        same = np.zeros(len(key), bool)
        k = key[1:]
        same[1:] = plain[k] & plain[key[:-1]]
        for v in (state, name[at], cluster[at]):
            same[1:] &= v[k] == v[key[:-1]]
        at, state = at[key[~same]], state[key[~same]]
        run = cluster_run[cluster[at]]
        order = np.argsort(run, kind="stable")
        at, self.state, self.run = at[order], state[order], run[order]
        self.cluster, self.name, self.node = cluster[at], name[at], node[at]
        begin = np.searchsorted(self.run, np.arange(len(x.start)))
        self.number = np.arange(len(at)) - begin[self.run] + np.diff(x.start)[self.run]

    def resolved(self, keep: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """bits.packed()'s alternatives and conflicts of the runs to keep, versions doubled."""
        x, mine = self.x, np.flatnonzero(keep[self.run])
        run, number, state, cluster, key = self.run[mine], self.number[mine], self.state[mine], self.cluster[mine], x.key(self.run[mine], self.name[mine])
        again, of = matched(self.node[mine], x.provs.node[self.other])
        of = self.other[of]
        here = [np.flatnonzero(keep[p.run]) for p in (x.deps, x.confs, x.provs)]
        each = lambda *parts: np.concatenate(parts)
        d, c, p = here
        have_key = each(x.provs.key[p], key, x.provs.key[of])
        have_id = each(x.place[x.provs.node[p]], number, number[again])
        have, has = each(2 * x.provs.ver[p], state, 2 * x.provs.ver[of]), each(x.provs.has[p], state >= state, x.provs.has[of])

        def holding(key, op, ver, wants):
            at, of = matched(key, have_key)
            good = meets(have[of], has[of], op[at], ver[at], wants[at])
            return at[good], have_id[of[good]]

        at, target = holding(x.deps.key[d], x.deps.op[d], 2 * x.deps.ver[d], x.deps.has[d])
        values, code = np.unique(x.deps.clause[d], return_inverse=True)
        clause = x.deps.node[d] * max(1, len(values)) + code
        _, none = np.unique(clause, return_index=True)
        none = none[~np.isin(clause[none], clause[at])]
        rows = d[each(at, none)]
        alternatives = x.deps.run[rows], x.place[x.deps.node[rows]], x.deps.clause[rows], each(target, none * 0), np.arange(len(rows)) < len(at)

        conf_run, conf_id = each(x.confs.run[c], run), each(x.place[x.confs.node[c]], number)
        at, other = holding(each(x.confs.key[c], key), each(x.confs.op[c], state * 0), each(2 * x.confs.ver[c], state * 0), each(x.confs.has[c], state >= state))
        one, fight_run = conf_id[at], conf_run[at]
        own, node = self.members  # clusters of several packages move together
        some = keep[x.node_run[node]] & (np.bincount(own, minlength=1)[own] > 1)
        own, node = own[some], node[some]
        whose, which, when = each(own, cluster), each(x.place[node], number), each(own * 0, state)
        whose_run = each(x.node_run[node], run)
        held = np.isin(whose, own)
        whose, which, when, whose_run = whose[held], which[held], when[held], whose_run[held]
        a, b = matched(whose, whose)
        apart = when[a] < when[b]
        a, b = a[apart], b[apart]
        fight_run, one, other = each(fight_run, whose_run[a]), each(one, which[a]), each(other, which[b])
        some = one != other
        pair = np.unique(((fight_run * MOST + np.minimum(one, other)) * MOST + np.maximum(one, other))[some])
        return alternatives, (pair // MOST // MOST, pair // MOST % MOST, pair % MOST)
