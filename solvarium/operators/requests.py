"""Install, remove and upgrade requests under lexicographic criteria, solved per independent component of what they
concern.

A component's packages, clauses and conflicts are one row. The criteria become one weight for each package that doesn't
stay as the criteria want it, in a mixed radix, so that the least sum of weights is the lexicographic optimum. The helper
`clauses.cheapest` finds sets of choices that can't hold together, and the cheapest way to break all of them. Repositories
that a truth table covers are answered whole, by the costs of every set that it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvarium.operators import bits, graphs, tables
from solvarium.operators.clauses import Sat, cheapest
from solvarium.operators.model import upgrade_floor
from solvarium.plans.lineage import cut

#: Conflicts that one question to the solver may take; None: as many as it needs, so every request is decided.
LIMIT: int | None = None
CRITERIA = ("removed", "new", "changed", "installed", "notuptodate")


def total_of(criterion: str) -> str | None:
    """The column whose total over the answer `sum:column` makes least."""
    return criterion[4:] if criterion.startswith("sum:") else None


def best(packages: dict[int, dict], clauses: list[tuple[int, tuple[int, ...]]], conflicts: list[tuple[int, int]], items: list[tuple[str, tuple[int, ...]]], criteria: tuple[str, ...], limit: int | None = None):
    """(least counts in the order of `criteria`, the uids of an answer that has them) over all valid sets that meet the
    request; None if there is none, and a string beyond the limit.

    packages: uid -> installed, and where criteria ask for them name, newest and the columns of totals. items: (action,
    uids): install takes one of them in, upgrade exactly one, remove leaves all of them out.
    """
    uids = sorted(packages)
    var = {p: k + 1 for k, p in enumerate(uids)}
    of = lambda ps: [var[p] for p in dict.fromkeys(ps) if p in var]
    hard = [[-var[p], *of(any_)] for p, any_ in clauses] + [[-var[a], -var[b]] for a, b in conflicts]
    for action, ps in items:
        if action == "remove":
            hard += [[-v] for v in of(ps)]
            continue
        hard.append(of(ps))
        if action == "upgrade":
            hard += [[-a, -b] for k, a in enumerate(of(ps)) for b in of(ps)[:k]]
    names: dict = {}
    if "notuptodate" in criteria:
        for p in uids:
            names.setdefault(packages[p]["name"], []).append(p)
    stale = {name: len(uids) + 1 + k for k, name in enumerate(names)}  # true where only old versions of a name are in
    for name, ps in names.items():
        newest = [var[p] for p in ps if packages[p]["newest"]]
        hard += [[-var[p], *newest, stale[name]] for p in ps if not packages[p]["newest"]]

    def counts(inside: set[int]) -> tuple[int, ...]:
        removed = sum(packages[p]["installed"] and p not in inside for p in uids)
        new = sum(not packages[p]["installed"] for p in inside)
        by = {"removed": removed, "new": new, "changed": removed + new, "installed": len(inside)}
        if names:
            by["notuptodate"] = sum(any(p in inside for p in ps) and not any(p in inside and packages[p]["newest"] for p in ps) for ps in names.values())
        return tuple(by[c] if c in by else sum(packages[p][total_of(c)] or 0 for p in inside) for c in criteria)

    weight: dict[int, int] = {}
    scale = 1
    for c in reversed(criteria):
        own: dict[int, int] = {}  # by the literal that costs
        for p in uids:
            there = packages[p]["installed"]
            if there and c in ("removed", "changed"):
                own[-var[p]] = 1
            elif c == "installed" or not there and c in ("new", "changed"):
                own[var[p]] = 1
            elif total_of(c):
                own[var[p]] = int(packages[p][total_of(c)] or 0)
        if c == "notuptodate":
            own = dict.fromkeys(stale.values(), 1)
        if min(own.values(), default=0) < 0:
            raise ValueError(f"{c} is negative for some package")
        for lit, w in own.items():
            weight[lit] = weight.get(lit, 0) + scale * w
        scale *= sum(own.values()) + 1
    soft = {}
    for lit, w in weight.items():
        if w > weight.get(-lit, 0):
            soft[-lit] = w - weight.get(-lit, 0)
    sat = Sat(len(uids) + len(stale), hard, [var[p] for p in uids if packages[p]["installed"]])
    said = cheapest(sat, soft, limit)
    if not said:
        return None if said is False else "unknown"
    inside = {p for p in uids if sat.val[var[p]] > 0}
    return counts(inside), sorted(inside)


def upgrades(packages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Request rows (repo, action, item, uid) that upgrade wanted(repo, item, name): exactly one version, no less than the
    highest installed one, and no lower one beside it. A name of which nothing is installed takes any version; a name
    that has no package gives no row."""
    floor = upgrade_floor(packages).withColumnRenamed("ver", "least")
    rows = packages.join(wanted.select("repo", "item", "name"), ["repo", "name"]).join(floor, ["repo", "name"], "left")
    action = F.when(F.coalesce(F.col("ver") >= F.col("least"), F.lit(True)), "upgrade").otherwise("remove")
    return rows.select("repo", action.alias("action"), "item", "uid")


def _answers(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame, request: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """(repo, status, *criteria, chosen) of each component, or of a narrow repository as a whole: chosen are the uids of
    its answer."""
    totals = [c for c in map(total_of, criteria) if c]
    if not criteria or {c for c in criteria if not total_of(c)} - set(CRITERIA):
        raise ValueError(f"criteria are {CRITERIA} and sum:column")
    request = cut(request.select("repo", "action", "item", "uid").distinct())
    packages = packages.join(request.select("repo").distinct(), "repo", "left_semi")
    fresh = "notuptodate" in criteria
    if fresh:
        top = F.max("ver").over(Window.partitionBy("repo", "name"))
        packages = packages.withColumn("newest", F.col("ver") == top)
    details = ["uid", "installed", *(["name", "newest"] if fresh else []), *totals]
    packages = cut(packages.select("repo", *dict.fromkeys(details)))

    none, nothing = F.array().cast("array<int>"), F.array().cast("array<bigint>")
    row = lambda df, kind, need, forbid=none, costs=nothing: df.select("repo", F.struct(kind.cast("int").alias("kind"), costs.alias("costs")).alias("req"), need.cast("array<int>").alias("need"), forbid.cast("array<int>").alias("forbid"))
    costs = F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in totals]) if totals else nothing
    rows = row(packages, F.when(F.col("installed"), THERE).otherwise(AWAY), F.array("uid"), costs=costs)
    kind = F.when(F.col("action") == "remove", REMOVE).when(F.col("action") == "upgrade", UPGRADE).otherwise(INSTALL)
    rows = rows.unionByName(row(request.groupBy("repo", "action", "item").agg(F.collect_list("uid").alias("uids")), kind, F.col("uids")))
    if fresh:
        same = packages.groupBy("repo", "name").agg(F.collect_list("uid").alias("uids"), F.collect_list(F.when(F.col("newest"), F.col("uid"))).alias("newest"))
        rows = rows.unionByName(row(same, F.lit(NAME), F.col("uids"), F.col("newest")))
    kind = packages.schema["repo"].dataType.simpleString()
    schema = ", ".join([f"repo {kind}", "status string", *(f"`{k}` long" for k in criteria), "chosen array<int>"])
    found, rest = tables.told(cheapest_sets(criteria), schema, resolved, conflicts, rows)
    if rest is None:
        return found
    return found.unionByName(_answers_joined(*(t.join(rest, "repo", "left_semi") for t in (packages, resolved, conflicts, request)), criteria))


#: Kinds of rows of cheapest_sets(): packages, names and items.
AWAY, THERE, NAME, INSTALL, UPGRADE, REMOVE = range(6)


def cheapest_sets(criteria: tuple[str, ...]):
    """The task that answers requests of narrow repositories: of the valid sets that meet every item, those that cost
    least by one criterion after the other, and the first of what is left."""
    totals = [c for c in map(total_of, criteria) if c]

    def task(x, sets):
        req = x.column("req", np.arange(len(x.rows)))
        kind, mask, newest = req.field("kind").to_numpy(zero_copy_only=False), tables.low(x.need), tables.low(x.bar)
        packages = np.flatnonzero(sets.narrow[x.run] & (kind <= THERE))
        run, own, there = x.run[packages], mask[packages], kind[packages] == THERE
        place = np.bitwise_count(own - 1)
        n = len(sets.many)
        every, asked = np.zeros(n, np.int64), np.zeros(n, bool)
        np.bitwise_or.at(every, run, own)
        items = np.flatnonzero(sets.narrow[x.run] & (kind >= INSTALL))
        asked[x.run[items]] = True
        m, k = mask[items] & every[x.run[items]], kind[items, None]
        left = sets.valid & ~tables.SOME[255 & ~every]
        tables.merge(left, x.run[items], np.where(k == INSTALL, tables.SOME[m], np.where(k == UPGRADE, tables.ONE[m], ~tables.SOME[m])))

        inside, outside = np.zeros((len(criteria), n, tables.WIDTH), np.int64), np.zeros((len(criteria), n, tables.WIDTH), np.int64)
        held = req.field("costs").take(pa.array(packages)).flatten().to_numpy(zero_copy_only=False).reshape(len(packages), len(totals))
        for j, c in enumerate(criteria):
            if c in ("removed", "changed"):
                outside[j, run, place] = there
            if c in ("new", "changed"):
                inside[j, run, place] = ~there
            if c == "installed":
                inside[j, run, place] = 1
            if total_of(c):
                inside[j, run, place] = held[:, totals.index(total_of(c))]
                if (inside[j] < 0).any():
                    raise ValueError(f"{c} is negative for some package")
        names = np.flatnonzero(sets.narrow[x.run] & (kind == NAME))
        stale = tables.SOME[mask[names]] & ~tables.SOME[newest[names]]

        done, told, counts, chosen = [], [], [], []
        flat = lambda t, size: np.unpackbits(np.ascontiguousarray(t).view(np.uint8), axis=1, bitorder="little")[:, :size]
        for many in np.unique(sets.many[asked & (every > 0)]):
            at = np.flatnonzero(asked & (every > 0) & (sets.many == many))
            size = 1 << int(many)
            may = flat(left[at], size).astype(bool)
            found = may.any(axis=1)
            best = np.zeros((len(at), len(criteria)), np.int64)
            holds = (tables.SETS[:size] >> np.arange(tables.WIDTH)[:, None] & 1).astype(np.int64)
            for j, c in enumerate(criteria):
                cost = outside[j, at].sum(axis=1)[:, None] + (inside[j, at] - outside[j, at]) @ holds
                if c == "notuptodate":
                    mine = np.flatnonzero(np.isin(x.run[names], at))
                    np.add.at(cost, np.searchsorted(at, x.run[names[mine]]), flat(stale[mine], size))
                best[:, j] = np.where(may, cost, np.iinfo(np.int64).max).min(axis=1)
                may &= cost == best[:, j : j + 1]
            done.append(at)
            told.append(found)
            counts.append(best)
            chosen.append(may.argmax(axis=1))
        run, fine = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((done, np.int64), (told, bool)))
        counts = np.concatenate(counts) if counts else np.zeros((0, len(criteria)), np.int64)
        chosen = np.where(fine, np.concatenate(chosen) if chosen else np.zeros(0, np.int64), 0)
        lists = bits.listed(*tables.members(x, run, chosen), fine)
        return run, pa.array(np.where(fine, "ok", "none").astype(str), pa.string()), *(pa.array(counts[:, j], pa.int64(), mask=~fine) for j in range(len(criteria))), lists

    return task


def _answers_joined(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame, request: DataFrame, criteria: tuple[str, ...]) -> DataFrame:
    """_answers() by components; packages hold which of them are the newest."""
    fresh = "notuptodate" in criteria
    totals = [c for c in map(total_of, criteria) if c]
    details = ["uid", "installed", *(["name", "newest"] if fresh else []), *totals]
    packages, request = cut(packages), cut(request)
    asked = request.select("repo").distinct()
    edges = cut(graphs.dependency_edges(resolved.join(asked, "repo", "left_semi")))
    roots = packages.where("installed").select("repo", "uid").unionByName(request.where("action <> 'remove'").select("repo", "uid"))
    leads = edges
    if fresh:  # the newest version of whatever may be in can come in for its own sake
        newest = packages.where("newest").select("repo", "name", F.col("uid").alias("dst"))
        leads = cut(edges.unionByName(packages.join(newest, ["repo", "name"]).select("repo", F.col("uid").alias("src"), "dst")))
    inside = cut(graphs.cone(roots.distinct().withColumn("root", F.lit(0)), leads).select("repo", "uid"))
    of = lambda c: inside.withColumnRenamed("uid", c)
    pairs = cut(conflicts.join(of("lo"), ["repo", "lo"], "left_semi").join(of("hi"), ["repo", "hi"], "left_semi").select("repo", "lo", "hi"))
    wanted = request.where("action <> 'remove'")
    tied = lambda rows, *by: rows.join(rows.groupBy("repo", *by).agg(F.min("uid").alias("dst")), ["repo", *by]).select("repo", F.col("uid").alias("src"), "dst")
    ties = edges.join(of("src"), ["repo", "src"], "left_semi").select("repo", "src", "dst")
    ties = ties.unionByName(pairs.select("repo", F.col("lo").alias("src"), F.col("hi").alias("dst"))).unionByName(tied(wanted, "item"))
    if fresh:
        ties = ties.unionByName(tied(packages.join(inside, ["repo", "uid"], "left_semi"), "name"))
    part = cut(graphs.components(inside, ties))

    lists = packages.join(part, ["repo", "uid"]).groupBy("repo", "component").agg(F.collect_list(F.struct(*dict.fromkeys(details))).alias("packages"))
    c = resolved.join(part, ["repo", "uid"]).groupBy("repo", "component", "uid", "clause").agg(F.collect_list("target").alias("any"))
    c = c.groupBy("repo", "component").agg(F.collect_list(F.struct("uid", "any")).alias("clauses"))
    x = pairs.join(part.withColumnRenamed("uid", "lo"), ["repo", "lo"]).groupBy("repo", "component").agg(F.collect_list(F.struct("lo", "hi")).alias("pairs"))
    r = request.join(part, ["repo", "uid"]).groupBy("repo", "component", "action", "item").agg(F.collect_list("uid").alias("uids"))
    r = r.groupBy("repo", "component").agg(F.collect_list(F.struct("action", "uids")).alias("items"))
    keys, limit = ["repo", "component"], LIMIT
    rows = lists.join(c, keys, "left").join(x, keys, "left").join(r, keys, "left").select("repo", "packages", "clauses", "pairs", "items")

    def run(batches):
        for batch in batches:
            status, out, chosen = [], [[] for _ in criteria], []
            for row in batch.to_pylist():
                said = best(
                    {p["uid"]: p for p in row["packages"]},
                    [(k["uid"], tuple(k["any"])) for k in row["clauses"] or ()],
                    [(k["lo"], k["hi"]) for k in row["pairs"] or ()],
                    [(k["action"], tuple(k["uids"])) for k in row["items"] or ()],
                    criteria,
                    limit,
                )
                found = isinstance(said, tuple)
                status.append("ok" if found else said or "none")
                chosen.append(said[1] if found else None)
                for column, v in zip(out, said[0] if found else [None] * len(criteria)):
                    column.append(v)
            columns = [batch.column(0), pa.array(status, pa.string()), *(pa.array(v, pa.int64()) for v in out), pa.array(chosen, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["repo", "status", *criteria, "chosen"])

    kind = packages.schema["repo"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"repo {kind}", "status string", *(f"`{k}` long" for k in criteria), "chosen array<int>"]))


def _status():
    has = lambda s: F.bool_or(F.col("status") == s)
    return F.when(has("none"), "none").when(has("unknown"), "unknown").otherwise("ok").alias("s")


def optimise(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame, request: DataFrame, criteria: tuple[str, ...] = ("removed", "changed")) -> DataFrame:
    """(repo, status, *criteria) of the best answer to request(repo, action, item, uid); actions are install, upgrade and
    remove, and an item of the first two is met by any of its uids. Status ok, none (no answer) or unknown (beyond
    LIMIT); counts are null unless it is ok. Criteria: removed, new, changed, installed, notuptodate (names of which only
    old versions are in), and sum:column for a column of `packages` that is nowhere negative.

    What the request can concern is the cone of the requested and the installed packages. It falls into components by
    dependency, conflict and item, which are answered each in a row of its own: counts add up, so least counts of the
    components give the least of the repository.
    """
    each = _answers(packages, resolved, conflicts, request, criteria)
    whole = each.groupBy("repo").agg(_status(), *[F.sum(f"`{k}`").alias(k) for k in criteria])
    return whole.select("repo", F.col("s").alias("status"), *[F.when(F.col("s") == "ok", F.col(f"`{k}`")).alias(k) for k in criteria])


def solution(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame, request: DataFrame, criteria: tuple[str, ...] = ("removed", "changed")) -> DataFrame:
    """(repo, uid, action) of a best answer to each request that has one: keep, install or remove for each package that is
    in it or was there before. Of several answers with equal counts it is any one; sum:column as the last criterion can
    make it the only one."""
    each = cut(_answers(packages, resolved, conflicts, request, criteria).select("repo", "status", "chosen"))
    fine = each.groupBy("repo").agg(_status()).where("s = 'ok'").select("repo")
    chosen = each.join(fine, "repo", "left_semi").select("repo", F.explode("chosen").alias("uid"), F.lit(True).alias("after"))
    before = packages.where("installed").join(fine, "repo", "left_semi").select("repo", "uid", F.lit(True).alias("before"))
    action = F.when(F.col("before").isNull(), "install").when(F.col("after").isNull(), "remove").otherwise("keep")
    return chosen.join(before, ["repo", "uid"], "full").select("repo", "uid", action.alias("action"))
