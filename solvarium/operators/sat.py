"""Installability: Horn fixpoint, conflict-free cones, and a small solver for what remains.

A package is installable if some set holds it, meets every clause of its members and holds no pair in conflict.
1. Horn stage: a clause without a provider that is not broken breaks its owner, to a fixpoint of joins.
2. Cones: a request whose cone (among unbroken packages) holds no pair in conflict is met by the cone itself.
3. The rest, one row a request with its own cone's clauses and conflicts, goes to a backtracking search in Arrow
   batches, and what that can't decide in its steps to a search that learns from conflicts, which decides everything
   unless BUDGET limits it. Beyond a limit the status is `unknown`, never a guess, and every operator below carries it: as
   a status column, or null in place of true and false.
Repositories of up to bits.SMALL rows go through the same stages many at once in a task, as bits; larger ones by joins.

Two installable packages whose models hold no pair in conflict go together, as the union of closed sets is closed. So
pairs are asked only where a conflict runs between the two models, and models, not cones, give the candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvarium.operators import bits
from solvarium.operators.clauses import Sat
from solvarium.operators.graphs import cone, dependency_closure, dependency_edges, direct_dominators_within
from solvarium.operators.model import Universe, within
from solvarium.operators.model import resolved as resolved_parts
from solvarium.plans.lineage import cut

#: Steps of the backtracking search, and then conflicts of the learning one (None: as many as it needs).
BUDGET: tuple[int, int | None] = (200_000, None)
#: Pairs of packages that cross one conflict, which one key of a join makes.
SPREAD = 4_000_000
#: Packages of a class that are expanded together.
CLASS = 1_000


def horn_broken(resolved: DataFrame) -> DataFrame:
    """(repo, uid) of packages with a clause that no installable package can meet, conflicts left out."""
    crowd = bits.crowded(resolved)
    small, large = bits.split(crowd, resolved)
    found = bits.stream(small[0]).mapInArrow(bits.horn, f"repo {resolved.schema['repo'].dataType.simpleString()}, uid int")
    return found.unionByName(_horn_joined(large[0])) if large else found


def _horn_joined(resolved: DataFrame) -> DataFrame:
    """horn_broken() by joins: a round follows only what the last one broke, and counts for each clause how many of its
    alternatives are gone."""
    keys = ["repo", "uid", "clause", "n"]
    size = F.count("target").over(Window.partitionBy("repo", "uid", "clause"))
    open_ = cut(resolved.select("repo", "uid", "clause", "target").distinct().withColumn("n", size))
    new = cut(open_.where("n = 0").select("repo", "uid").distinct())
    broken, hit = new, None
    while not new.isEmpty():
        lost = open_.join(new.withColumnRenamed("uid", "target"), ["repo", "target"]).groupBy(*keys).agg(F.count("*").alias("lost"))
        hit = cut(lost if hit is None else lost.unionByName(hit).groupBy(*keys).agg(F.sum("lost").alias("lost")))
        new = cut(hit.where("lost = n").select("repo", "uid").distinct().join(broken, ["repo", "uid"], "left_anti"))
        hit = hit.where("lost < n")
        broken = broken.unionByName(new)
    return broken


def search(need: list[int], forbid: list[int], clauses: dict[int, list[tuple[int, ...]]], conflicts: dict[int, set[int]], budget: tuple[int, int | None] = BUDGET):
    """A closed, peaceful set with all of `need` and none of `forbid`; None if there is none, False beyond both budgets.

    Only clauses of packages that are in matter, so search follows them: forced choices first, then the clause with
    the fewest alternatives left. Choices are kept on a stack, each with the trail to undo.
    """
    chosen, out = set(), set(forbid)
    trail: list[tuple[set, int]] = []
    frames: list[list] = []  # length of the trail, open clauses, alternatives, which of them is tried
    open_, todo, steps = [], list(need), 0

    def put(where: set, p: int) -> None:
        if p not in where:
            where.add(p)
            trail.append((where, p))

    def take() -> bool:
        """Takes in what is to do; whether that went without a contradiction."""
        while todo:
            p = todo.pop()
            if p in out:
                return False
            if p not in chosen:
                put(chosen, p)
                open_.extend(clauses.get(p, ()))
                for q in conflicts.get(p, ()):
                    if q in chosen:
                        return False
                    put(out, q)
        return True

    while True:
        sound = take()
        if sound:
            rest, best = [], None
            for c in open_:
                if not any(q in chosen for q in c):
                    rest.append(c)
                    left = [q for q in c if q not in out]
                    if len(left) < 2:
                        todo.extend(left)
                        sound &= bool(left)
                    elif best is None or len(left) < len(best):
                        best = left
            open_ = rest
            if sound and todo:
                continue
            if sound and best is None:
                return chosen
        if sound:
            frames.append([len(trail), list(open_), best, -1])
        while frames:
            frame = frames[-1]
            while len(trail) > frame[0]:
                where, p = trail.pop()
                where.discard(p)
            frame[3] += 1
            if frame[3] < len(frame[2]):
                break
            frames.pop()
        else:
            return None
        steps += 1
        if steps > budget[0]:
            return learned(need, forbid, clauses, conflicts, budget[1])
        for q in frame[2][: frame[3]]:  # what was tried before stays out
            put(out, q)
        open_, todo = list(frame[1]), [frame[2][frame[3]]]


def learned(need: list[int], forbid: list[int], clauses: dict[int, list[tuple[int, ...]]], conflicts: dict[int, set[int]], limit: int | None = None):
    """As search(), by learning from conflicts; False beyond `limit` of them."""
    uids = sorted({*need, *forbid, *clauses, *conflicts}.union(q for own in clauses.values() for c in own for q in c).union(*conflicts.values()))
    var = {p: k + 1 for k, p in enumerate(uids)}
    hard = [[-var[p], *(var[q] for q in c)] for p, own in clauses.items() for c in own]
    sat = Sat(len(uids), hard + [[-var[p], -var[q]] for p, own in conflicts.items() for q in own])
    said = sat.solve([var[p] for p in need] + [-var[p] for p in forbid], limit)
    if not said:
        return None if said is False else False
    inside = {uids[v - 1] for v in sat.model()}
    chosen, todo = set(need), list(need)
    while todo:  # what the need leads to is closed; the rest of the model may go
        for c in clauses.get(todo.pop(), ()):
            if not chosen.intersection(c):
                q = next(q for q in c if q in inside)
                chosen.add(q)
                todo.append(q)
    return chosen


def strong_members(root: int, clauses: dict, conflicts: dict, budget: tuple[int, int | None] = BUDGET) -> list[tuple[int, str]]:
    """(member, status) of what every set with `root` holds: candidates are one model's members, and each model that a
    test finds takes away what it doesn't hold. Clauses with one alternative force theirs without a test."""
    forced, todo = set(), [root]
    while todo:
        for c in clauses.get(todo.pop(), ()):
            if len(c) == 1 and c[0] not in forced:
                forced.add(c[0])
                todo.append(c[0])
    model = search([root], [], clauses, conflicts, budget)
    if model is None:
        return []
    if model is False:
        return [(root, "unknown")]
    out, maybe = [(q, "broken") for q in forced if q != root], set(model) - forced - {root}
    while maybe:
        q = maybe.pop()
        other = search([root], [q], clauses, conflicts, budget)
        if other:
            maybe &= other
        else:
            out.append((q, "broken" if other is None else "unknown"))
    return sorted(out)


def conflict_core(root: int, clauses: dict, conflicts: dict, budget: tuple[int, int | None] = BUDGET) -> list[tuple[int, int, bool]]:
    """(lo, hi, alone) of a least set of conflicts that keep `root` out: with these only it is broken, without any one of
    them it is not; alone: it would go in if that one went from all there are. None if it isn't known to be broken. A
    conflict whose part the budget doesn't tell stays."""

    def status(pairs):
        fight: dict[int, set] = {}
        for p, q in pairs:
            fight.setdefault(p, set()).add(q)
            fight.setdefault(q, set()).add(p)
        return search([root], [], clauses, fight, budget)

    every = core = sorted({(min(p, q), max(p, q)) for p, own in conflicts.items() for q in own})
    if status(every) is not None:
        return []
    for pair in every:
        rest = [x for x in core if x != pair]
        if status(rest) is None:
            core = rest
    return [(*pair, bool(status([x for x in every if x != pair]))) for pair in core]


def _tables(row: dict) -> tuple[dict[int, list], dict[int, set]]:
    """The clauses and conflicts of one request's row, by package."""
    by: dict[int, list] = {}
    for c in row["clauses"] or ():
        by.setdefault(c["uid"], []).append(tuple(sorted(c["any"])))
    fight: dict[int, set] = {}
    for c in row["pairs"] or ():
        fight.setdefault(c["lo"], set()).add(c["hi"])
        fight.setdefault(c["hi"], set()).add(c["lo"])
    return by, fight


def _cones(requests: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of requests(repo, req, need ARRAY<INT>): those with a broken package (repo, req), the members of the others'
    cones (repo, req, uid), the conflicts inside (repo, req, lo, hi), and the clauses of unbroken packages."""
    live = resolved.join(broken.select("repo", F.col("uid").alias("target")), ["repo", "target"], "left_anti").where("target IS NOT NULL")
    live = cut(live.select("repo", "uid", "clause", "target"))
    roots = requests.select("repo", "req", F.explode("need").alias("uid"))
    dead = cut(roots.join(broken, ["repo", "uid"], "left_semi").select("repo", "req").distinct())
    edges = live.select("repo", F.col("uid").alias("src"), F.col("target").alias("dst")).distinct()
    inside = cut(cone(roots.join(dead, ["repo", "req"], "left_anti"), edges, keys=("req",)).select("repo", "req", "uid"))
    lo, hi = (inside.select("repo", "req", F.col("uid").alias(c)) for c in ("lo", "hi"))
    fights = cut(conflicts.join(lo, ["repo", "lo"]).join(hi, ["repo", "req", "hi"]).select("repo", "req", "lo", "hi"))
    return dead, inside, fights, live


def _rows(requests: DataFrame, inside: DataFrame, fights: DataFrame, live: DataFrame) -> DataFrame:
    """`requests` with the clauses and conflicts of their cones, one row each."""
    own = inside.join(requests.select("repo", "req"), ["repo", "req"], "left_semi")
    clauses = own.join(live, ["repo", "uid"]).groupBy("repo", "req", "uid", "clause").agg(F.collect_list("target").alias("any"))
    clauses = clauses.groupBy("repo", "req").agg(F.collect_list(F.struct("uid", "any")).alias("clauses"))
    pairs = fights.groupBy("repo", "req").agg(F.collect_list(F.struct("lo", "hi")).alias("pairs"))
    return requests.join(clauses, ["repo", "req"], "left").join(pairs, ["repo", "req"], "left")


def solve(requests: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame | None = None, with_model: bool = False) -> DataFrame:
    """(repo, req, status) for requests(repo, req, need ARRAY<INT>, forbid ARRAY<INT>): ok, broken or unknown; and, if
    asked, `model`: the members of one set that meets the request."""
    requests = cut(requests.select("repo", "req", "need", "forbid"))
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    schema = f"repo {kinds['repo']}, req {kinds['req']}, status string" + (", model array<int>" if with_model else "")
    crowd = bits.crowded(requests, resolved, conflicts)
    small, large = bits.split(crowd, resolved, conflicts, requests)
    out = bits.stream(*small).mapInArrow(bits.solved(BUDGET, with_model), schema)
    return out.unionByName(_solve_joined(large[2], large[0], large[1], broken, with_model)) if large else out


def _solve_joined(requests: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame | None, with_model: bool) -> DataFrame:
    """solve() with cones by joins, for repositories that no task should hold."""
    requests, limit = cut(requests), BUDGET
    broken = cut(_horn_joined(resolved)) if broken is None else broken
    dead, inside, fights, live = _cones(requests, resolved, conflicts, broken)
    open_ = requests.join(dead, ["repo", "req"], "left_anti")
    hard = open_.join(fights.select("repo", "req").distinct().withColumn("hit", F.lit(True)), ["repo", "req"], "left")
    hard = cut(hard.where("hit OR size(forbid) > 0").drop("hit"))
    rows = _rows(hard, inside, fights, live).select("repo", "req", "need", "forbid", "clauses", "pairs")

    def run(batches):
        for batch in batches:
            said, models = [], []
            for r in batch.to_pylist():
                got = search(r["need"], r["forbid"], *_tables(r), limit)
                said.append("broken" if got is None else "ok" if got else "unknown")
                models.append(sorted(got) if got else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(models, pa.list_(pa.int32()))], names=["repo", "req", "status", "model"])

    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}
    solved = rows.mapInArrow(run, f"repo {kinds['repo']}, req {kinds['req']}, status string, model array<int>")
    easy = open_.select("repo", "req").join(hard.select("repo", "req"), ["repo", "req"], "left_anti")
    none = F.lit(None).cast("array<int>").alias("model")
    dead = dead.select("repo", "req", F.lit("broken").alias("status"), none)
    if not with_model:
        easy = easy.select("repo", "req", F.lit("ok").alias("status"))
        return solved.drop("model").unionByName(easy).unionByName(dead.drop("model"))
    easy = inside.join(easy, ["repo", "req"]).groupBy("repo", "req").agg(F.collect_list("uid").alias("model")).select("repo", "req", F.lit("ok").alias("status"), "model")
    return solved.unionByName(easy).unionByName(dead)


def check(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame | None = None, also: int | None = None, with_model: bool = False) -> DataFrame:
    """(repo, uid, status) of every package by itself; with `also`, together with that package, such as the one that
    carries global constraints. `packages` may be some of the universe's, to check a list."""
    none = F.array().cast("array<int>")
    need = F.array("uid") if also is None else F.array(F.col("uid"), F.lit(also))
    asked = packages.select("repo", F.col("uid").alias("req"), need.alias("need"), none.alias("forbid"))
    return solve(asked, resolved, conflicts, broken, with_model).withColumnRenamed("req", "uid")


def trim(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The universe without packages that can't be installed; those of unknown status stay."""
    gone = cut(check(packages, resolved, conflicts).where("status = 'broken'").select("repo", "uid"))
    of = lambda c: gone.withColumnRenamed("uid", c)
    deps = resolved.join(gone, ["repo", "uid"], "left_anti").join(of("target"), ["repo", "target"], "left_anti")
    return packages.join(gone, ["repo", "uid"], "left_anti"), deps.select(*resolved.columns), conflicts.join(of("lo"), ["repo", "lo"], "left_anti").join(of("hi"), ["repo", "hi"], "left_anti").select(*conflicts.columns)


def violations(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, kind, uid, other): what is wrong with the installed packages: clauses that none of them meets (other is
    the clause), and pairs in conflict."""
    have = packages.where("installed").select("repo", "uid")
    own = resolved.join(have, ["repo", "uid"], "left_semi")
    met = own.join(have.withColumnRenamed("uid", "target"), ["repo", "target"], "left_semi").select("repo", "uid", "clause").distinct()
    unmet = own.select("repo", "uid", "clause").distinct().join(met, ["repo", "uid", "clause"], "left_anti")
    lo, hi = (have.withColumnRenamed("uid", c) for c in ("lo", "hi"))
    fight = conflicts.join(lo, ["repo", "lo"], "left_semi").join(hi, ["repo", "hi"], "left_semi")
    return unmet.select("repo", F.lit("dependency").alias("kind"), "uid", F.col("clause").alias("other")).unionByName(fight.select("repo", F.lit("conflict").alias("kind"), F.col("lo").alias("uid"), F.col("hi").alias("other")))


def consistent(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, consistent): whether the installed packages meet their clauses and hold no pair in conflict."""
    bad = violations(packages, resolved, conflicts).select("repo").distinct().withColumn("bad", F.lit(True))
    return packages.select("repo").distinct().join(bad, "repo", "left").select("repo", F.col("bad").isNull().alias("consistent"))


def pair_requests(pairs: DataFrame, a: str = "lo", b: str = "hi") -> DataFrame:
    """Requests to install both of a pair; req names the two."""
    none = F.array().cast("array<int>")
    return pairs.select("repo", F.struct(F.col(a).alias("lo"), F.col(b).alias("hi")).alias("req"), F.array(a, b).alias("need"), none.alias("forbid"))


def _crossing(models: DataFrame, conflicts: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """(repo, lo, hi): packages between whose models a conflict runs; with forced(repo, root, uid) also whether one runs
    between what both of them force, as `sure`."""
    each = models.where("status = 'ok'").select("repo", F.col("uid").alias("root"), F.explode("model").alias("uid"))
    sure = F.lit(False).alias("sure")
    if forced is not None:
        each = each.join(forced.distinct().withColumn("must", F.lit(True)), ["repo", "root", "uid"], "left")
        sure = F.coalesce("must", F.lit(False)).alias("sure")
    each = cut(each.select("repo", "root", "uid", sure))
    fights = _shares(each, conflicts)
    x = fights.join(each.select("repo", F.col("uid").alias("lo"), F.col("root").alias("a"), F.col("sure").alias("sure_a")), ["repo", "lo"])
    y = fights.join(each.select("repo", F.col("uid").alias("hi"), F.col("root").alias("b"), F.col("sure").alias("sure_b")), ["repo", "hi"])
    x = x.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).drop("parts")
    y = y.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = x.join(y, ["repo", "lo", "hi", "part"]).where("a <> b")
    pairs = pairs.groupBy("repo", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.max(F.expr("sure_a AND sure_b")).alias("sure"))
    return pairs if forced is not None else pairs.drop("sure")


def _shares(each: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, lo, hi, parts) of conflicts both ends of which are in each(repo, root, uid): in how many parts the roots of the
    first end are dealt, so that a part makes about SPREAD pairs at most, or a root is one by itself."""
    many = each.groupBy("repo", "uid").agg(F.count("*").alias("n"))
    of = lambda c: many.select("repo", F.col("uid").alias(c), F.col("n").alias(f"n_{c}"))
    both = conflicts.select("repo", "lo", "hi").join(of("lo"), ["repo", "lo"]).join(of("hi"), ["repo", "hi"])
    parts = F.least(F.col("n_lo"), F.ceil(F.col("n_lo") * F.col("n_hi") / F.lit(SPREAD)).cast("bigint")).cast("int")
    return cut(both.select("repo", "lo", "hi", parts.alias("parts")))


def _expanded(said: DataFrame, rows: DataFrame) -> DataFrame:
    """Every (repo, p, q, status) of pairs of classes said(repo, a, b, status), packages rows(repo, uid, rep). Members of a
    class come as arrays of about CLASS, each a row of its own, so that nothing that grows like the result is shuffled and
    no task gets all of a class."""
    parts = F.ceil(F.count("*") / F.lit(CLASS)).cast("int").alias("parts")
    many = cut(rows.groupBy("repo", "rep").agg(parts))
    held = rows.join(many, ["repo", "rep"]).groupBy("repo", "rep", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("uid").alias("uids"))
    held = cut(held)
    out = said
    for rep in ("a", "b"):
        out = out.join(many.withColumnRenamed("rep", rep), ["repo", rep]).withColumn(f"part_{rep}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    for rep, c in (("a", "p"), ("b", "q")):
        out = out.join(held.select("repo", F.col("rep").alias(rep), F.col("part").alias(f"part_{rep}"), F.col("uids").alias(f"all_{c}")), ["repo", rep, f"part_{rep}"])
    return out.select("repo", "status", F.explode("all_p").alias("p"), "all_q").select("repo", "status", "p", F.explode("all_q").alias("q"))


def coinstallable(pairs: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """`pairs` (repo, lo, hi) with their status. In small repositories every pair is asked where it is; elsewhere only
    those between whose models a conflict runs."""
    pairs = cut(pairs.select("repo", "lo", "hi"))
    crowd = bits.crowded(pairs, resolved, conflicts)
    if crowd is None:
        return solve(pair_requests(pairs), resolved, conflicts, broken).select("repo", "req.*", "status")
    (near, *own), (far, deps, fights) = bits.split(crowd, pairs, resolved, conflicts)
    said = solve(pair_requests(near), *own, broken).select("repo", "req.*", "status")
    return said.unionByName(_coinstallable_joined(cut(far), cut(deps), cut(fights), broken))


def _coinstallable_joined(pairs: DataFrame, resolved: DataFrame, conflicts: DataFrame, broken: DataFrame | None) -> DataFrame:
    """coinstallable() by the models of both ends."""
    ends = pairs.select("repo", F.explode(F.array("lo", "hi")).alias("uid")).distinct()
    models = cut(check(ends, resolved, conflicts, broken, with_model=True))
    of = lambda c: models.select("repo", F.col("uid").alias(c), F.col("status").alias(f"s_{c}"))
    known = pairs.join(of("lo"), ["repo", "lo"]).join(of("hi"), ["repo", "hi"])
    dead = F.array_contains(F.array("s_lo", "s_hi"), "broken")
    unsure = F.array_contains(F.array("s_lo", "s_hi"), "unknown")
    # Both ends in either order: a pair is asked once, whichever end is less.
    hit = _crossing(models, conflicts).select("repo", F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(True).alias("hit"))
    known = known.withColumns({"a": F.least("lo", "hi"), "b": F.greatest("lo", "hi")}).join(hit, ["repo", "a", "b"], "left")
    known = cut(known.select("repo", "lo", "hi", F.when(dead, "broken").when(unsure | F.col("hit"), None).otherwise("ok").alias("status")))
    said = solve(pair_requests(known.where("status IS NULL")), resolved, conflicts, broken).select("repo", "req.*", "status")
    return known.where("status IS NOT NULL").unionByName(said)


def strong_dependencies(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, uid, dep, status): dep is in every installation of the installable package uid, itself left out. Status
    unknown: not decided within the budget; with dep = uid, the package itself. Repositories that a truth table covers are
    told by it, wider ones by joined cones."""
    from solvarium.operators import flatten, tables

    if BUDGET[0] < len(tables.SETS):  # a table holds so many sets
        return _strong_dependencies_joined(packages, resolved, conflicts)
    found, rest = tables.told(_strong_dependencies, _STRONG.format(packages.schema["repo"].dataType.simpleString()), resolved, conflicts, flatten._each(packages))
    if rest is None:
        return found
    return found.unionByName(_strong_dependencies_joined(*(cut(t.join(rest, "repo", "left_semi")) for t in (packages, resolved, conflicts))))


def strong_dependencies_of(u: Universe) -> DataFrame:
    """strong_dependencies() of a universe, narrow repositories resolved where they are told."""
    from solvarium.operators import tables

    if BUDGET[0] < len(tables.SETS):
        return _strong_dependencies_joined(*resolved_parts(u))
    found, rest = tables.told_of(_strong_dependencies, _STRONG.format(u.packages.schema["repo"].dataType.simpleString()), u)
    return found if rest is None else found.unionByName(_strong_dependencies_joined(*resolved_parts(within(u, rest))))


_STRONG = "repo {}, uid int, dep int, status string"


def _strong_dependencies(x, sets):
    """The task of strong_dependencies()."""
    from solvarium.operators import tables

    run, p, q = np.nonzero(tables.strong(x, sets)[:, :, None] >> np.arange(tables.WIDTH) & 1)
    uid = lambda place: pa.array(x.uid[x.start[run] + place], pa.int32())
    return run, uid(p), uid(q), pa.array(np.full(len(run), "broken"), pa.string())


def _strong_dependencies_joined(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """strong_dependencies() by joined cones."""
    broken = cut(horn_broken(resolved))
    asked, limit = cut(packages.select("repo", F.col("uid").alias("req"), F.array("uid").alias("need"))), BUDGET
    dead, inside, fights, live = _cones(asked, resolved, conflicts, broken)
    rows = _rows(asked.join(dead, ["repo", "req"], "left_anti"), inside, fights, live).where("clauses IS NOT NULL")

    def run(batches):
        for batch in batches:
            at, dep, status = [], [], []
            for k, r in enumerate(batch.to_pylist()):
                for q, said in strong_members(r["req"], *_tables(r), limit):
                    at.append(k)
                    dep.append(q)
                    status.append(said)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(dep, pa.int32()), pa.array(status, pa.string())], names=["repo", "uid", "dep", "status"])

    kind = packages.schema["repo"].dataType.simpleString()
    return rows.select("repo", "req", "clauses", "pairs").mapInArrow(run, f"repo {kind}, uid int, dep int, status string")


def strong_conflicts(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, lo, hi, status): both installable, never together; unknown where the budget did not do.

    Asked of the flattened repository, in which conflicts between alternatives of one clause (triangles) have left the
    clauses of their users: packages that need the same of those in conflict are one class, and only pairs of classes
    between whose models a conflict runs are asked, and of those not the ones that force both ends of it. Repositories
    that a truth table covers are told by it.
    """
    from solvarium.operators import flatten, tables

    kind = packages.schema["repo"].dataType.simpleString()
    found, rest = tables.told(_strong_conflicts, f"repo {kind}, lo int, hi int, status string", resolved, conflicts, flatten._each(packages))
    if rest is None:
        return found
    return found.unionByName(_strong_conflicts_joined(*(cut(t.join(rest, "repo", "left_semi")) for t in (packages, resolved, conflicts))))


def _strong_conflicts(x, sets):
    """The task of strong_conflicts()."""
    from solvarium.operators import tables

    asked = tables.asked(x, sets)
    can = [(asked >> p & 1 == 1) & (sets.valid & tables.SOME[1 << p]).any(axis=1) for p in range(tables.WIDTH)]
    run, lo, hi = [], [], []
    for q in range(tables.WIDTH):
        for p in range(q):
            at = np.flatnonzero(can[p] & can[q])
            at = at[~(sets.valid[at] & tables.ALL[1 << p | 1 << q]).any(axis=1)]
            run.append(at)
            lo.append(x.uid[x.start[at] + p])
            hi.append(x.uid[x.start[at] + q])
    run, lo, hi = (np.concatenate(v) for v in (run, lo, hi))
    return run, pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(np.full(len(run), "broken"), pa.string())


def _strong_conflicts_joined(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """strong_conflicts() by flattening."""
    rows, asked, flat, left, broken = strong_conflict_requests(packages, resolved, conflicts)
    said = solve(pair_requests(asked.where("NOT sure")), flat, left, broken).where("status <> 'ok'")
    said = said.select("repo", F.col("req.lo").alias("a"), F.col("req.hi").alias("b"), "status")
    said = cut(said.unionByName(asked.where("sure").select("repo", F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit("broken").alias("status"))))
    return _expanded(said, rows).select("repo", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "status")


def strong_conflict_requests(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """What strong_conflicts() asks: the class of each package (repo, uid, rep), the pairs of classes (repo, lo, hi, sure:
    what both must hold is in conflict), and the flattened repository with what is broken in it."""
    from solvarium.operators.flatten import flattened

    flat, left = flattened(packages, resolved, conflicts)
    flat, left = cut(flat), cut(left)
    clause = flat.groupBy("repo", "uid", "clause").agg(F.array_sort(F.collect_list("target")).alias("members"))
    formula = clause.groupBy("repo", "uid").agg(F.array_sort(F.collect_list("members")).alias("formula"))
    rep = F.min("uid").over(Window.partitionBy("repo", "formula"))
    rows = cut(formula.select("repo", "uid", rep.alias("rep")))
    broken = cut(flat.where("target IS NULL").select("repo", "uid").distinct())  # no flat clause names a broken package
    models = cut(check(rows.select("repo", F.col("rep").alias("uid")).distinct(), flat, left, broken, with_model=True))
    forced = clause.where("size(members) = 1").select("repo", F.col("uid").alias("root"), F.col("members")[0].alias("uid"))
    return rows, cut(_crossing(models, left, forced)), flat, left, broken


def triangles(resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, lo, hi, kind) of conflicts between packages that the same packages use: simple, one package is the only user
    of both; shared, every user of but one of them also uses a package that uses both.

    Users are listed from the end with fewer of them and looked up at the other end, so a hot end costs no more than its
    rival has users; all users of both are listed only where some are in common.
    """
    edges = resolved.where("target IS NOT NULL AND target <> uid").select("repo", F.col("target").alias("used"), F.col("uid").alias("user")).distinct()
    edges = cut(edges)
    many = edges.groupBy("repo", "used").agg(F.count("*").alias("n"))
    of = lambda c: many.select("repo", F.col("used").alias(c), F.col("n").alias(f"n_{c}"))
    pairs = conflicts.select("repo", "lo", "hi").join(of("lo"), ["repo", "lo"]).join(of("hi"), ["repo", "hi"])
    few, other = F.when(F.col("n_lo") <= F.col("n_hi"), F.col("lo")).otherwise(F.col("hi")), F.when(F.col("n_lo") <= F.col("n_hi"), F.col("hi")).otherwise(F.col("lo"))
    pairs = cut(pairs.withColumns({"few": few, "other": other}))
    common = pairs.join(edges.withColumnRenamed("used", "few"), ["repo", "few"]).join(edges.withColumnRenamed("used", "other"), ["repo", "other", "user"], "left_semi")
    common = cut(common.select("repo", "lo", "hi", "n_lo", "n_hi", F.col("user").alias("common")))
    near = common.select("repo", "lo", "hi").distinct()
    users = near.select("repo", "lo", "hi", F.explode(F.array("lo", "hi")).alias("used")).join(edges, ["repo", "used"]).select("repo", "lo", "hi", "user").distinct()
    rest = users.join(common.withColumnRenamed("common", "user"), ["repo", "lo", "hi", "user"], "left_anti")
    covered = rest.join(edges.select("repo", "user", F.col("used").alias("common")), ["repo", "user"]).join(common, ["repo", "lo", "hi", "common"], "left_semi")
    open_ = rest.join(covered.select("repo", "lo", "hi", "user").distinct(), ["repo", "lo", "hi", "user"], "left_anti").select("repo", "lo", "hi").distinct()
    kinds = common.select("repo", "lo", "hi", F.when(F.expr("n_lo = 1 AND n_hi = 1"), "simple").otherwise("shared").alias("kind")).distinct()
    return kinds.join(open_, ["repo", "lo", "hi"], "left_anti")


def strong_conflict_roots(found: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Strong conflicts found(repo, lo, hi) with the plain conflicts behind them: (repo, lo, hi, root_lo, root_hi, kind), a
    row for each conflict between what the two force by clauses of one alternative. Kind: explicit, the pair itself;
    conjunctive; or other, with null roots, where it takes more than that."""
    found = cut(found.select("repo", "lo", "hi"))
    ends = found.select("repo", F.explode(F.array("lo", "hi")).alias("uid")).distinct().withColumn("root", F.col("uid"))
    forced = cut(dependency_closure(ends, resolved, conjunctive=True).select("repo", "root", "uid"))
    both = conflicts.select("repo", F.explode(F.array(F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")), F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))).alias("c")).select("repo", F.col("c.a").alias("root_lo"), F.col("c.b").alias("root_hi"))
    of = lambda end: forced.select("repo", F.col("root").alias(end), F.col("uid").alias(f"root_{end}"))
    rows = found.join(of("lo"), ["repo", "lo"]).join(both, ["repo", "root_lo"]).join(of("hi"), ["repo", "hi", "root_hi"])
    explicit = (F.col("lo") == F.col("root_lo")) & (F.col("hi") == F.col("root_hi"))
    rows = rows.withColumn("kind", F.when(explicit, "explicit").otherwise("conjunctive"))
    return found.join(rows, ["repo", "lo", "hi"], "left").select("repo", "lo", "hi", "root_lo", "root_hi", F.coalesce("kind", F.lit("other")).alias("kind"))


def conflict_reasons(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, uid, lo, hi, alone): which conflicts keep out the packages that are broken though every clause of their cone
    can be met: conflict_core() of each."""
    from solvarium.operators import flatten, tables

    kind = packages.schema["repo"].dataType.simpleString()
    found, rest = tables.told(_conflict_reasons, f"repo {kind}, uid int, lo int, hi int, alone boolean", resolved, conflicts, flatten._each(packages))
    if rest is None:
        return found
    return found.unionByName(_conflict_reasons_joined(*(cut(t.join(rest, "repo", "left_semi")) for t in (packages, resolved, conflicts))))


def _conflict_reasons(x, sets):
    """The task of conflict_reasons(): conflict_core() over truth tables as numbers."""
    from solvarium.operators import tables

    number = lambda table: int.from_bytes(table.tobytes(), "little")
    at = np.flatnonzero(sets.narrow[x.run] & ~x.dead)
    at = at[~(sets.valid[x.run[at]] & tables.ALL[tables.low(x.need[at])]).any(axis=1)]
    pairs: dict[int, list] = {int(r): [] for r in x.run[at]}
    fights = np.flatnonzero(np.isin(x.node_run[x.lo], x.run[at]))
    for r, p, q in zip(x.node_run[x.lo[fights]].tolist(), x.place[x.lo[fights]].tolist(), x.place[x.hi[fights]].tolist()):
        pairs[r].append((min(p, q), max(p, q)))
    out = []
    for k, r, inside in zip(at.tolist(), x.run[at].tolist(), tables.low(x.inside[at]).tolist()):
        table = number(sets.closed[r] & tables.ALL[tables.low(x.need[k : k + 1])[0]])
        every = {c: number(tables.ALL[1 << c[0] | 1 << c[1]]) for c in sorted(set(pairs[r])) if inside >> c[0] & inside >> c[1] & 1}

        def left(some):
            rest = table  # noqa: B023
            for c in some:
                rest &= ~every[c]  # noqa: B023
            return rest

        core = list(every)
        for c in every:
            rest = [d for d in core if d != c]
            if not left(rest):
                core = rest
        out += [(k, r, p, q, bool(left([d for d in every if d != (p, q)]))) for p, q in core]
    k, r, p, q = (np.array([o[i] for o in out], np.int64) for i in range(4))
    uid = lambda place: pa.array(x.uid[x.start[r] + place], pa.int32())
    return r, x.column("req", k), uid(p), uid(q), pa.array([o[4] for o in out], pa.bool_())


def _conflict_reasons_joined(packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """conflict_reasons() by joined cones."""
    broken = cut(horn_broken(resolved))
    asked, limit = cut(packages.select("repo", F.col("uid").alias("req"), F.array("uid").alias("need"))), BUDGET
    dead, inside, fights, live = _cones(asked, resolved, conflicts, broken)
    hard = cut(asked.join(fights.select("repo", "req").distinct(), ["repo", "req"], "left_semi"))
    rows = _rows(hard, inside, fights, live)

    def run(batches):
        for batch in batches:
            at, out = [], []
            for k, r in enumerate(batch.to_pylist()):
                core = conflict_core(r["req"], *_tables(r), limit)
                at += [k] * len(core)
                out += core
            at, (lo, hi, alone) = pa.array(at, pa.int64()), (zip(*out) if out else ((), (), ()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(alone, pa.bool_())], names=["repo", "uid", "lo", "hi", "alone"])

    kind = packages.schema["repo"].dataType.simpleString()
    return rows.select("repo", "req", "clauses", "pairs").mapInArrow(run, f"repo {kind}, uid int, lo int, hi int, alone boolean")


def useless_alternatives(deps: DataFrame, provs: DataFrame, packages: DataFrame, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, uid, clause, alt, status) of installable packages: alternatives that nothing provides, or that cannot be
    used; status unknown where the budget did not tell."""
    from solvarium.operators.model import resolve_atoms

    good = check(packages, resolved, conflicts).where("status = 'ok'").select("repo", "uid")
    asked = cut(deps.select("repo", "uid", "clause", "alt", "name", "op", "ver").join(good, ["repo", "uid"], "left_semi"))
    ways = cut(resolve_atoms(asked, provs).select("repo", "uid", "clause", "alt", "target").distinct())
    pairs = ways.select("repo", F.col("uid").alias("lo"), F.col("target").alias("hi")).distinct()
    said = coinstallable(pairs, resolved, conflicts).select("repo", F.col("lo").alias("uid"), F.col("hi").alias("target"), "status")
    used = ways.join(said, ["repo", "uid", "target"]).groupBy("repo", "uid", "clause", "alt")
    used = used.agg(F.bool_or(F.col("status") == "ok").alias("ok"), F.bool_or(F.col("status") == "unknown").alias("unsure"))
    out = asked.select("repo", "uid", "clause", "alt").join(used, ["repo", "uid", "clause", "alt"], "left").where("NOT coalesce(ok, false)")
    return out.select("repo", "uid", "clause", "alt", F.when(F.col("unsure"), "unknown").otherwise("broken").alias("status"))


def useless_conflicts(confs: DataFrame, provs: DataFrame) -> DataFrame:
    """`confs` that name nothing but the package itself, or nothing at all."""
    from solvarium.operators.model import resolve_atoms

    keys = ["repo", "uid", "name", "op", "ver"]
    asked = confs.select(*keys).distinct()
    return asked.join(resolve_atoms(asked, provs).where("uid <> target").select(*keys).distinct(), keys, "left_anti")


def reasons(resolved: DataFrame, deps: DataFrame, broken: DataFrame, depth: int | None = None) -> DataFrame:
    """(repo, uid, root, clause, cause): why the Horn-broken packages are broken: clauses that nothing provides, of the
    package itself or of one that it needs whichever way; cause is the clause as text. Depth 1: of the package itself."""
    dead = broken.select("repo", "uid")
    gone = resolved.where("target IS NULL").select("repo", F.col("uid").alias("root"), "clause")
    edges = resolved.where("target IS NOT NULL").join(dead, ["repo", "uid"], "left_semi").join(dead.withColumnRenamed("uid", "target"), ["repo", "target"], "left_semi")
    alive = resolved.where("target IS NOT NULL").join(dead.withColumnRenamed("uid", "target"), ["repo", "target"], "left_anti").select("repo", "uid", "clause").distinct()
    edges = edges.join(alive, ["repo", "uid", "clause"], "left_anti").select("repo", F.col("uid").alias("src"), F.col("target").alias("dst")).distinct()
    reach = cone(dead.select("repo", F.col("uid").alias("first"), "uid"), edges, keys=("first",), depth=depth).select("repo", F.col("first").alias("uid"), F.col("uid").alias("root"))
    one = F.when(F.col("op") == "any", F.col("name")).otherwise(F.concat_ws(" ", "name", "op", "ver"))
    text = deps.select("repo", F.col("uid").alias("root"), "clause", F.struct("alt", one.alias("t")).alias("a")).join(gone, ["repo", "root", "clause"], "left_semi").groupBy("repo", "root", "clause")
    text = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["t"]), " | ").alias("cause"))
    return reach.join(gone, ["repo", "root"]).join(text, ["repo", "root", "clause"]).select("repo", "uid", "root", "clause", "cause")


def causes(found: DataFrame, least: int = 2) -> DataFrame:
    """(cause, victims) of reasons(), with at least so many victims."""
    return found.select("repo", "uid", "cause").distinct().groupBy("cause").agg(F.count("*").alias("victims")).where(F.col("victims") >= least)


def coinstall_products(choices: DataFrame, items: int, resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, uids, status): every way to take one uid from each of the items 1 to `items` of choices(repo, item, uid)."""
    rows = None
    for k in range(1, items + 1):
        own = choices.where(F.col("item") == k).select("repo", F.col("uid").alias("next")).distinct()
        rows = own.select("repo", F.array("next").alias("uids")) if rows is None else rows.join(own, "repo").select("repo", F.concat("uids", F.array("next")).alias("uids"))
    rows = rows.select("repo", F.array_join("uids", "~").alias("req"), F.array_distinct("uids").alias("need"), F.array().cast("array<int>").alias("forbid"))
    said = solve(rows, resolved, conflicts)
    return said.select("repo", F.split("req", "~").cast("array<int>").alias("uids"), "status")


def minimal_sets(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, root, uid): of sets(repo, root, uid), what is reached from the root by edges inside its set."""
    sets = cut(sets.select("repo", "root", "uid").distinct())
    seen = frontier = cut(sets.where("uid = root"))
    while not frontier.isEmpty():
        step = frontier.withColumnRenamed("uid", "src").join(edges, ["repo", "src"]).select("repo", "root", F.col("dst").alias("uid")).distinct()
        step = step.join(sets, ["repo", "root", "uid"], "left_semi").join(seen, ["repo", "root", "uid"], "left_anti")
        frontier = cut(step)
        seen = seen.unionByName(frontier)
    return seen


def impact(strong: DataFrame, edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, uid, strong_out, strong_in, direct_out, direct_in) for every package: how many it depends on and how many
    depend on it, strongly (uid, dep) and directly (src, dst)."""
    out = packages.select("repo", "uid")
    plain = edges.where("src <> dst").select("repo", "src", "dst").distinct()
    for name, df, c in (("strong_out", strong, "uid"), ("strong_in", strong, "dep"), ("direct_out", plain, "src"), ("direct_in", plain, "dst")):
        out = out.join(df.groupBy("repo", F.col(c).alias("uid")).agg(F.count("*").alias(name)), ["repo", "uid"], "left").na.fill(0, [name])
    return out


def impact_of(u: Universe) -> DataFrame:
    """impact() of a universe: narrow repositories are told in a task, with nothing joined."""
    from solvarium.operators import tables

    kind = u.packages.schema["repo"].dataType.simpleString()
    names = ("strong_out", "strong_in", "direct_out", "direct_in")
    found, rest = tables.told_of(_impact, f"repo {kind}, uid int, {', '.join(f'{c} bigint' for c in names)}", u)
    none = u.packages.where("repo IS NULL OR uid IS NULL").select("repo", "uid", *[F.lit(0).cast("bigint").alias(c) for c in names])
    if rest is None:
        return found.unionByName(none)
    packages, resolved, conflicts = resolved_parts(within(u, rest))
    strong = cut(_strong_dependencies_joined(packages, resolved, conflicts).where("status = 'broken'").select("repo", "uid", "dep"))
    return found.unionByName(none).unionByName(impact(strong, dependency_edges(resolved), packages))


def _impact(x, sets):
    """The task of impact_of()."""
    from solvarium.operators import tables

    strong, direct = tables.strong(x, sets), tables.edges(x, sets)
    run, p = np.nonzero(tables.asked(x, sets)[:, None] >> np.arange(tables.WIDTH) & 1)
    counts = (np.bitwise_count(of[run, p]).astype(np.int64) for of in (strong, tables.back(strong), direct, tables.back(direct)))
    return run, pa.array(x.uid[x.start[run] + p], pa.int32()), *map(pa.array, counts)


def strong_dominators(u: Universe, percent: float = 0) -> DataFrame:
    """(repo, dominator, dominated) of graphs.direct_dominators_within() among the strong dependencies of a universe; in
    narrow repositories told where these are."""
    from solvarium.operators import tables

    kind = u.packages.schema["repo"].dataType.simpleString()
    found, rest = tables.told_of(_dominating(percent), f"repo {kind}, dominator int, dominated int", u)
    if rest is None:
        return found
    strong = _strong_dependencies_joined(*resolved_parts(within(u, rest))).where("status = 'broken'")
    return found.unionByName(direct_dominators_within(cut(strong.select("repo", F.col("uid").alias("src"), F.col("dep").alias("dst"))), percent))


def _dominating(percent: float):
    """The task of strong_dominators()."""
    from solvarium.operators import tables

    def task(x, sets):
        strong = tables.strong(x, sets)
        users = tables.back(strong)
        run, p, q = np.nonzero(strong[:, :, None] >> np.arange(tables.WIDTH) & 1)
        lacking = np.bitwise_count(users[run, q] & ~(users[run, p] | strong[run, p] | 1 << p)).astype(np.int64)
        fine = lacking * 100 <= np.bitwise_count(users[run, q]) * percent
        run, p, q = run[fine], p[fine], q[fine]
        uid = lambda place: pa.array(x.uid[x.start[run] + place], pa.int32())
        return run, uid(p), uid(q)

    return task


def explanation(resolved: DataFrame, broken: DataFrame) -> DataFrame:
    """(repo, root, src, dst, kind) of Horn-broken packages: from each root, the dependencies on broken packages that no
    working one replaces (kind dependency), down to clauses that nothing provides (kind missing, dst null)."""
    dead = cut(broken.select("repo", "uid"))
    keys = ["repo", "uid", "clause"]
    alive = resolved.where("target IS NOT NULL").join(dead.withColumnRenamed("uid", "target"), ["repo", "target"], "left_anti").select(*keys).distinct()
    stuck = cut(resolved.join(dead, ["repo", "uid"], "left_semi").join(alive, keys, "left_anti").select("repo", F.col("uid").alias("src"), F.col("target").alias("dst")).distinct())
    reach = cut(cone(dead.select("repo", F.col("uid").alias("root"), "uid"), stuck.where("dst IS NOT NULL")).select("repo", "root", F.col("uid").alias("src")))
    return reach.join(stuck, ["repo", "src"]).select("repo", "root", "src", "dst", F.when(F.col("dst").isNull(), "missing").otherwise("dependency").alias("kind"))


def condensed(explained: DataFrame, packages: DataFrame) -> DataFrame:
    """(repo, root, name, members): versions of one name with the same neighbours in an explanation become one vertex;
    members are their uids in order."""
    pick = lambda c: F.array_sort(F.collect_set(c))
    down = explained.groupBy("repo", "root", F.col("src").alias("uid")).agg(pick(F.coalesce("dst", F.lit(0))).alias("down"))
    up = explained.where("dst IS NOT NULL").groupBy("repo", "root", F.col("dst").alias("uid")).agg(pick("src").alias("up"))
    both = down.join(up, ["repo", "root", "uid"], "full").join(packages.select("repo", "uid", "name"), ["repo", "uid"])
    return both.groupBy("repo", "root", "name", "down", "up").agg(F.array_sort(F.collect_list("uid")).alias("members")).select("repo", "root", "name", "members")
