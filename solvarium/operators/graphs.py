"""Dependency graphs as edge tables: closures by semi-naive loops, components, reduction, layers, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvarium.plans.lineage import cut


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """(repo, src, dst) over every alternative."""
    return resolved.where("target IS NOT NULL").select("repo", F.col("uid").alias("src"), F.col("target").alias("dst")).distinct()


def conjunctive_edges(resolved: DataFrame) -> DataFrame:
    """Edges of clauses that exactly one package can meet, the package itself left out."""
    one = resolved.groupBy("repo", "uid", "clause").agg(F.count("target").alias("n"), F.max("target").alias("dst"))
    return one.where("n = 1 AND uid <> dst").select("repo", F.col("uid").alias("src"), "dst").distinct()


def syntactic_edges(resolved: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(repo, src, dst, kind): packages p<uid>, disjunctions o<uid>.<clause>, missing clauses m<uid>.<clause>."""
    size = F.count("target").over(Window.partitionBy("repo", "uid", "clause"))
    r = resolved.withColumn("n", size)
    p, q = F.concat(F.lit("p"), "uid"), F.concat(F.lit("p"), "target")
    node = lambda k: F.concat(F.lit(k), F.concat_ws(".", "uid", "clause"))
    edge = lambda when, src, dst, kind: r.where(when).select("repo", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind")).distinct()
    out = edge("n = 1", p, q, "direct").unionByName(edge("n > 1", p, node("o"), "or")).unionByName(edge("n > 1", node("o"), q, "or")).unionByName(edge("n = 0", p, node("m"), "missing"))
    return out.unionByName(conflicts.select("repo", F.concat(F.lit("p"), "lo").alias("src"), F.concat(F.lit("p"), "hi").alias("dst"), F.lit("conflict").alias("kind")))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.col("dst").alias("src"), F.col("src").alias("dst"))


def reverse_counts(edges: DataFrame) -> DataFrame:
    """(repo, uid, n): how many other packages name a package in some alternative."""
    return edges.where("src <> dst").groupBy("repo", F.col("dst").alias("uid")).agg(F.count("*").alias("n"))


def _apart(df: DataFrame) -> DataFrame:
    """`df` for a join by shuffle: a table that grows with the graph, and is broadcast in each of many rounds while it is
    under the limit for one, adds up on the driver."""
    return df.hint("merge")


def cone(roots: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("root",), depth: int | None = None, shuffled: bool = False) -> DataFrame:
    """(repo, *keys, uid, level) reached from roots(repo, *keys, uid); depth n takes levels 0 to n - 1. With `shuffled` no
    table of a round goes through the driver.

    Each round joins only what the last one found; a round's rows are written, so the plan never grows.
    """
    by, apart = ["repo", *keys], _apart if shuffled else lambda df: df
    frontier = cut(roots.select(*by, "uid").distinct().withColumn("level", F.lit(0)))
    seen, level = frontier, 0
    while (depth is None or level + 1 < depth) and not frontier.isEmpty():
        level += 1
        step = frontier.withColumnRenamed("uid", "src").join(apart(edges), ["repo", "src"])
        new = step.select(*by, F.col("dst").alias("uid")).distinct().join(apart(seen.select(*by, "uid")), [*by, "uid"], "left_anti")
        frontier = cut(new.withColumn("level", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def dependency_closure(roots: DataFrame, resolved: DataFrame, depth: int | None = None, conjunctive: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """The cone of roots(repo, root, uid) over all alternatives or, if asked, over clauses of one alternative only; with
    `extra`(repo, uid), such as the package that carries global constraints, in every closure."""
    edges = cut(conjunctive_edges(resolved) if conjunctive else dependency_edges(resolved))
    if extra is not None:
        roots = roots.unionByName(roots.select("repo", "root").distinct().join(extra.select("repo", "uid"), "repo")).distinct()
    return cone(roots, edges, depth=depth)


def full_cones(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, root, uid): the cone of every vertex. Asked for all roots at once, doubling needs fewer rounds than cone()."""
    own = vertices.select("repo", F.col("uid").alias("root"), "uid")
    return own.unionByName(closure(edges).select("repo", F.col("src").alias("root"), F.col("dst").alias("uid"))).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """(repo, src, dst) for every path of one edge or more, by doubling: paths of length up to 2^k after k rounds."""
    now = cut(edges.select("repo", "src", "dst").distinct())
    n, before = now.count(), -1
    while n != before:
        before = n
        step = now.withColumnRenamed("dst", "mid").join(now.select("repo", F.col("src").alias("mid"), "dst"), ["repo", "mid"]).select("repo", "src", "dst")
        now = cut(now.unionByName(step).distinct())
        n = now.count()
    return now


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, component): the least uid that is connected, directions left out.

    Labels spread to neighbours, then jump to their label's label, so long paths take logarithmically many rounds.
    """
    both = cut(edges.select("repo", "src", "dst").unionByName(reverse(edges)).distinct())
    now = cut(vertices.select("repo", "uid", F.col("uid").alias("component")))
    while True:
        near = both.join(now.select("repo", F.col("uid").alias("dst"), "component"), ["repo", "dst"])
        near = near.groupBy("repo", F.col("src").alias("uid")).agg(F.min("component").alias("near"))
        new = now.join(near, ["repo", "uid"], "left").select("repo", "uid", F.least("component", F.coalesce("near", "component")).alias("component"))
        new = cut(new)
        hop = new.select("repo", F.col("uid").alias("component"), F.col("component").alias("up"))
        new = cut(new.join(hop, ["repo", "component"], "left").select("repo", "uid", F.least("component", F.coalesce("up", "component")).alias("component")))
        if new.exceptAll(now).isEmpty():
            return new
        now = new


def _trimmed(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges after those without an edge in or out of the rest are gone, a layer a round."""
    many = vertices.count()
    while True:
        into, out = edges.select("repo", F.col("dst").alias("uid")).distinct(), edges.select("repo", F.col("src").alias("uid")).distinct()
        kept = cut(vertices.join(_apart(into), ["repo", "uid"], "left_semi").join(_apart(out), ["repo", "uid"], "left_semi"))
        inner = cut(induced(edges, _apart(kept.select("repo", "uid"))).select("repo", "src", "dst"))
        before, many = many, kept.count()
        if many == before:
            return kept, inner
        vertices, edges = kept, inner


def _least_upstream(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, color): the least vertex from which uid is reachable, itself included; a round spreads only labels
    that fell in the last one, and every round hands on a label's own label."""
    now = cut(vertices.select("repo", "uid", F.col("uid").alias("color")))
    fell = now
    while not fell.isEmpty():
        told = fell.withColumnRenamed("uid", "src").join(_apart(edges), ["repo", "src"]).groupBy("repo", F.col("dst").alias("uid")).agg(F.min("color").alias("told"))
        hop = now.select("repo", F.col("uid").alias("color"), F.col("color").alias("up"))
        new = now.join(_apart(told), ["repo", "uid"], "left").join(_apart(hop), ["repo", "color"], "left")
        new = cut(new.select("repo", "uid", F.col("color").alias("old"), F.least("color", F.coalesce("told", "color"), F.coalesce("up", "color")).alias("color")))
        now, fell = new.select("repo", "uid", "color"), new.where("color < old").select("repo", "uid", "color")
    return now


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, component): the least uid that is reachable and from which uid is reachable.

    By colouring: vertices outside cycles are trimmed; each other takes the least vertex upstream as its colour; what
    reaches a colour's vertex inside that colour is its component, and goes. No round holds more rows than the graph.
    """
    every = vertices.select("repo", "uid")
    left, inner = cut(every), cut(induced(edges.where("src <> dst"), _apart(every)).select("repo", "src", "dst").distinct())
    found = None
    while True:
        left, inner = _trimmed(left, inner)
        if left.isEmpty():
            break
        colors = _least_upstream(left, inner)
        of = lambda c: colors.select("repo", F.col("uid").alias(c), F.col("color").alias(f"c_{c}"))
        same = cut(inner.join(_apart(of("src")), ["repo", "src"]).join(_apart(of("dst")), ["repo", "dst"]).where("c_src = c_dst").select("repo", F.col("dst").alias("src"), F.col("src").alias("dst")))
        # Colours don't meet along `same`, so one walk back from all their vertices needs no key of its own.
        back = cone(colors.where("uid = color").select("repo", "uid"), same, keys=(), shuffled=True).select("repo", "uid")
        done = cut(colors.join(_apart(back), ["repo", "uid"], "left_semi"))
        found = done if found is None else found.unionByName(done)
        left = cut(left.join(_apart(done.select("repo", "uid")), ["repo", "uid"], "left_anti"))
        inner = cut(induced(inner, _apart(left)).select("repo", "src", "dst"))
    if found is None:
        return every.withColumn("component", F.col("uid"))
    return every.join(_apart(found), ["repo", "uid"], "left").select("repo", "uid", F.coalesce("color", "uid").alias("component"))


def condensation(vertices: DataFrame, edges: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cycles as single vertices: (repo, component, label) with member names sorted and joined by '/', and the edges
    between components; names(repo, uid, name)."""
    scc = cut(strong_components(vertices, edges))
    label = scc.join(_apart(names.select("repo", "uid", "name")), ["repo", "uid"]).groupBy("repo", "component")
    label = label.agg(F.array_join(F.array_sort(F.collect_list("name")), "/").alias("label"))
    of = lambda c: scc.select("repo", F.col("uid").alias(c), F.col("component").alias(f"c_{c}"))
    between = edges.join(_apart(of("src")), ["repo", "src"]).join(_apart(of("dst")), ["repo", "dst"]).where("c_src <> c_dst")
    return label, between.select("repo", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct()


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Of an acyclic graph: the edges that no longer path makes superfluous."""
    paths = closure(edges)
    longer = edges.select("repo", "src", F.col("dst").alias("mid")).join(paths.select("repo", F.col("src").alias("mid"), "dst"), ["repo", "mid"])
    return edges.select("repo", "src", "dst").join(longer.select("repo", "src", "dst").distinct(), ["repo", "src", "dst"], "left_anti")


def layers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, layer) of an acyclic graph: the length of the longest path that starts there; a cycle is an error."""
    left, done, layer = cut(vertices.select("repo", "uid").distinct()), None, 0
    edges = cut(edges.select("repo", "src", "dst").distinct())
    while not left.isEmpty():
        waits = edges.join(_apart(left.withColumnRenamed("uid", "dst")), ["repo", "dst"], "left_semi").select("repo", F.col("src").alias("uid")).distinct()
        free = cut(left.join(_apart(waits), ["repo", "uid"], "left_anti").withColumn("layer", F.lit(layer)))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.unionByName(free)
        left = cut(left.join(_apart(free.select("repo", "uid")), ["repo", "uid"], "left_anti"))
        layer += 1
    return done if done is not None else vertices.select("repo", "uid", F.lit(0).alias("layer"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    v = vertices.select("repo", "uid")
    return edges.join(v.withColumnRenamed("uid", "src"), ["repo", "src"], "left_semi").join(v.withColumnRenamed("uid", "dst"), ["repo", "dst"], "left_semi")


# Statistics of a graph.


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    out = edges.groupBy("repo", F.col("src").alias("uid")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy("repo", F.col("dst").alias("uid")).agg(F.count("*").alias("in_degree"))
    both = vertices.select("repo", "uid").join(out, ["repo", "uid"], "left").join(into, ["repo", "uid"], "left")
    return both.na.fill(0, ["out_degree", "in_degree"])


def degree_histogram(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(direction, degree, n); vertices of degree 0 are not counted."""
    d = degrees(vertices, edges)
    each = d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("direction"), F.col(f"{k}_degree").alias("degree")) for k in ("in", "out")])).alias("d"))
    return each.select("d.*").where("degree > 0").groupBy("direction", "degree").agg(F.count("*").alias("n"))


def density(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, vertices, edges, density), density as edges over ordered pairs."""
    v = vertices.groupBy("repo").agg(F.count("*").alias("vertices"))
    e = edges.groupBy("repo").agg(F.count("*").alias("edges"))
    both = v.join(e, "repo", "left").na.fill(0, ["edges"])
    return both.withColumn("density", F.when(F.col("vertices") > 1, F.col("edges") / (F.col("vertices") * (F.col("vertices") - 1))).otherwise(F.lit(0.0)))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, coefficient): edges among a vertex's successors over their ordered pairs; 0 for none, 1 for one."""
    plain = edges.where("src <> dst").select("repo", "src", "dst").distinct()
    k = plain.groupBy("repo", F.col("src").alias("uid")).agg(F.count("*").alias("k"))
    one = plain.select("repo", F.col("src").alias("uid"), F.col("dst").alias("src"))
    two = plain.select("repo", F.col("src").alias("uid"), F.col("dst").alias("dst"))
    closed = one.join(plain, ["repo", "src"]).join(two, ["repo", "uid", "dst"], "left_semi").groupBy("repo", "uid").agg(F.count("*").alias("t"))
    out = vertices.select("repo", "uid").join(k, ["repo", "uid"], "left").join(closed, ["repo", "uid"], "left").na.fill(0, ["k", "t"])
    value = F.when(F.col("k") == 0, 0.0).when(F.col("k") == 1, 1.0).otherwise(F.col("t") / (F.col("k") * (F.col("k") - 1)))
    return out.select("repo", "uid", value.alias("coefficient"))


def two_step_reach(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, n): vertices reached in one or two steps, the vertex itself left out."""
    step = edges.select("repo", "src", F.col("dst").alias("mid")).join(edges.select("repo", F.col("src").alias("mid"), "dst"), ["repo", "mid"])
    near = edges.select("repo", "src", "dst").unionByName(step.select("repo", "src", "dst")).where("src <> dst").distinct()
    near = near.groupBy("repo", F.col("src").alias("uid")).agg(F.count("*").alias("n"))
    return vertices.select("repo", "uid").join(near, ["repo", "uid"], "left").na.fill(0, ["n"])


def distances(edges: DataFrame) -> DataFrame:
    """(repo, src, dst, distance) for every pair with a path, by doubling: after k rounds, paths of up to 2^k edges."""
    now = cut(edges.select("repo", "src", "dst").distinct().withColumn("distance", F.lit(1).cast("long")))
    before = None
    while (said := tuple(now.agg(F.count("*"), F.sum("distance")).first())) != before:
        before = said
        step = now.select("repo", "src", F.col("dst").alias("mid"), F.col("distance").alias("d")).join(now.select("repo", F.col("src").alias("mid"), "dst", "distance"), ["repo", "mid"])
        step = step.select("repo", "src", "dst", (F.col("d") + F.col("distance")).alias("distance"))
        now = cut(now.unionByName(step).groupBy("repo", "src", "dst").agg(F.min("distance").alias("distance")))
    return now


def average_distance(edges: DataFrame) -> DataFrame:
    """(repo, pairs, distance_sum): over ordered pairs with a path, shortest distances."""
    far = distances(edges).where("src <> dst")
    return far.groupBy("repo").agg(F.count("*").alias("pairs"), F.sum("distance").alias("distance_sum"))


def direct_dominators(closed: DataFrame) -> DataFrame:
    """(repo, dominator, dominated) in a transitively closed graph: p -> q where whoever reaches q also reaches p, or is
    among p's own successors: Is(q) without (Scons(p) and p) is within Is(p)."""
    plain = closed.where("src <> dst").select("repo", "src", "dst").distinct()
    pair = plain.select("repo", F.col("src").alias("p"), F.col("dst").alias("q"))
    users = plain.select("repo", F.col("src").alias("r"), F.col("dst").alias("q"))
    bad = pair.join(users, ["repo", "q"]).where("r <> p")
    bad = bad.join(plain.select("repo", F.col("src").alias("r"), F.col("dst").alias("p")), ["repo", "r", "p"], "left_anti")
    bad = bad.join(plain.select("repo", F.col("src").alias("p"), F.col("dst").alias("r")), ["repo", "p", "r"], "left_anti")
    out = pair.join(bad.select("repo", "p", "q").distinct(), ["repo", "p", "q"], "left_anti")
    return out.select("repo", F.col("p").alias("dominator"), F.col("q").alias("dominated"))


def direct_dominators_within(closed: DataFrame, percent: float) -> DataFrame:
    """(repo, dominator, dominated) as direct_dominators(), where up to `percent` of Is(q) may lack p. What is shared is
    counted by one join on the users of q that use p as well."""
    plain = cut(closed.where("src <> dst").select("repo", "src", "dst").distinct())
    size = plain.groupBy("repo", F.col("dst").alias("q")).agg(F.count("*").alias("n"))
    pair = plain.select("repo", F.col("src").alias("p"), F.col("dst").alias("q"))
    using_p = pair.join(plain.select("repo", F.col("src").alias("r"), F.col("dst").alias("p")), ["repo", "p"])
    shared = using_p.join(plain.select("repo", F.col("src").alias("r"), F.col("dst").alias("q")), ["repo", "r", "q"], "left_semi").groupBy("repo", "p", "q").agg(F.count("*").alias("shared"))
    inner = pair.join(plain.select("repo", F.col("src").alias("p"), F.col("dst").alias("r")), ["repo", "p"]).join(plain.select("repo", F.col("src").alias("r"), F.col("dst").alias("q")), ["repo", "r", "q"], "left_semi")
    inner = inner.join(plain.select("repo", F.col("src").alias("r"), F.col("dst").alias("p")), ["repo", "r", "p"], "left_anti").groupBy("repo", "p", "q").agg(F.count("*").alias("own"))
    out = pair.join(size, ["repo", "q"]).join(shared, ["repo", "p", "q"], "left").join(inner, ["repo", "p", "q"], "left").na.fill(0, ["shared", "own"])
    lacking = F.col("n") - 1 - F.col("shared") - F.col("own")
    return out.where(lacking * 100 <= F.col("n") * percent).select("repo", F.col("p").alias("dominator"), F.col("q").alias("dominated"))


def dominators(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, dominator) of an acyclic graph entered at its vertices without a predecessor: every way to uid passes
    through the dominator, itself included. Layer by layer: what all predecessors' dominators share."""
    edges = cut(edges.select("repo", "src", "dst").distinct())
    order = cut(layers(vertices, reverse(edges)))  # 0: no predecessor
    into = edges.groupBy("repo", F.col("dst").alias("uid")).agg(F.count("*").alias("n"))
    done, k = cut(order.where("layer = 0").select("repo", "uid", F.col("uid").alias("dominator"))), 0
    top = order.agg(F.max("layer")).first()[0] or 0
    while k < top:
        k += 1
        now = order.where(F.col("layer") == k).select("repo", "uid")
        given = edges.withColumnRenamed("dst", "uid").join(now, ["repo", "uid"], "left_semi").join(done.withColumnRenamed("uid", "src"), ["repo", "src"])
        all_ = given.groupBy("repo", "uid", "dominator").agg(F.count("*").alias("k")).join(into, ["repo", "uid"]).where("k = n").select("repo", "uid", "dominator")
        done = done.unionByName(cut(all_.unionByName(now.select("repo", "uid", F.col("uid").alias("dominator")))))
    return done


def immediate_dominators(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, uid, dominator): the nearest dominator other than uid itself, that is, the one with most of its own."""
    all_ = cut(dominators(vertices, edges))
    depth = all_.groupBy("repo", F.col("uid").alias("dominator")).agg(F.count("*").alias("depth"))
    return all_.where("uid <> dominator").join(depth, ["repo", "dominator"]).groupBy("repo", "uid").agg(F.max_by("dominator", "depth").alias("dominator"))


def dominator_tree(vertices: DataFrame, edges: DataFrame, reduce: bool = False) -> DataFrame:
    """(repo, uid, component, dominator) of any graph: cycles are vertices of their own, named by their least uid, and a
    start leads to all that nothing leads to; dominator is the nearest cycle or vertex that every way from the start to uid
    passes through, null where that is the start itself. With `reduce`, edges that a longer path replaces go first, as a
    closed graph needs it.

    Each vertex keeps its way from the start in the tree as an array, one row a vertex. The ways of all predecessors share
    what the least and the greatest of them share, as arrays sort by their first difference, so a layer is one aggregate.
    """
    part = cut(strong_components(vertices, edges))
    of = lambda c: part.select("repo", F.col("uid").alias(c), F.col("component").alias(f"c_{c}"))
    between = edges.select("repo", "src", "dst").join(_apart(of("src")), ["repo", "src"]).join(_apart(of("dst")), ["repo", "dst"]).where("c_src <> c_dst")
    between = cut(between.select("repo", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).distinct())
    if reduce:
        between = cut(transitive_reduction(between))
    order = cut(layers(part.select("repo", F.col("component").alias("uid")).distinct(), reverse(between)))
    done, k = cut(order.where("layer = 0").select("repo", "uid", F.array("uid").alias("way"))), 0
    top = order.agg(F.max("layer")).first()[0] or 0
    shared = F.expr("filter(transform(sequence(1, size(a)), i -> CASE WHEN slice(a, 1, i) = slice(b, 1, i) THEN a[i - 1] END), x -> x IS NOT NULL)")
    while k < top:
        k += 1
        now = between.withColumnRenamed("dst", "uid").join(_apart(order.where(F.col("layer") == k).select("repo", "uid")), ["repo", "uid"], "left_semi")
        given = now.join(_apart(done.select("repo", F.col("uid").alias("src"), "way")), ["repo", "src"]).groupBy("repo", "uid").agg(F.min("way").alias("a"), F.max("way").alias("b"))
        done = done.unionByName(cut(given.select("repo", "uid", F.concat(shared, F.array("uid")).alias("way"))))
    parent = done.select("repo", F.col("uid").alias("component"), F.when(F.size("way") > 1, F.element_at("way", -2)).alias("dominator"))
    return part.join(_apart(parent), ["repo", "component"]).select("repo", "uid", "component", "dominator")


def large_components(vertices: DataFrame, edges: DataFrame, more_than: int) -> DataFrame:
    """Edges of components with more than so many vertices."""
    part = cut(components(vertices, edges))
    keep = part.groupBy("repo", "component").count().where(F.col("count") > more_than).select("repo", "component")
    inside = part.join(keep, ["repo", "component"], "left_semi").select("repo", F.col("uid").alias("src"))
    return edges.join(inside, ["repo", "src"], "left_semi")


def edge_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, src, dst, change): edges that only one of two graphs has."""
    keys = ["repo", "src", "dst"]
    one, two = before.select(*keys).distinct(), after.select(*keys).distinct()
    return two.join(one, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(one.join(two, keys, "left_anti").withColumn("change", F.lit("removed")))


def cheapest(edges: DataFrame, cost: str = "cost") -> DataFrame:
    """(repo, src, dst, cost) of the cheapest path of every pair that has one, by doubling: costs are at least 0."""
    now = cut(edges.groupBy("repo", "src", "dst").agg(F.min(F.col(cost).cast("long")).alias("cost")))
    before = None
    while (said := tuple(now.agg(F.count("*"), F.sum("cost")).first())) != before:
        before = said
        step = now.select("repo", "src", F.col("dst").alias("mid"), F.col("cost").alias("c")).join(now.select("repo", F.col("src").alias("mid"), "dst", "cost"), ["repo", "mid"])
        now = cut(now.unionByName(step.select("repo", "src", "dst", (F.col("c") + F.col("cost")).alias("cost"))).groupBy("repo", "src", "dst").agg(F.min("cost").alias("cost")))
    return now


def degree_extremes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, direction, highest, average): over all vertices."""
    d = degrees(vertices, edges)
    each = d.select("repo", F.explode(F.array(*[F.struct(F.lit(k).alias("direction"), F.col(f"{k}_degree").alias("degree")) for k in ("in", "out")])).alias("d"))
    return each.groupBy("repo", "d.direction").agg(F.max("d.degree").alias("highest"), F.avg("d.degree").alias("average"))


def degree_pairs(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, in_degree, out_degree, n): how many vertices have both degrees."""
    return degrees(vertices, edges).groupBy("repo", "in_degree", "out_degree").agg(F.count("*").alias("n"))


def centrality(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, direction, centrality): how far degrees, as shares of the n - 1 others, stay below the highest, over n - 2."""
    d = degrees(vertices, edges)
    each = d.select("repo", F.explode(F.array(*[F.struct(F.lit(k).alias("direction"), F.col(f"{k}_degree").alias("degree")) for k in ("in", "out")])).alias("d"))
    g = each.groupBy("repo", "d.direction").agg(F.count("*").alias("n"), F.max("d.degree").alias("m"), F.sum("d.degree").alias("s"))
    value = (F.col("m") * F.col("n") - F.col("s")) / (F.col("n") - 1) / (F.col("n") - 2)
    return g.select("repo", "direction", F.when(F.col("n") > 2, value).alias("centrality"))


def component_sizes(part: DataFrame) -> DataFrame:
    """(repo, components, average, largest) of components (repo, uid, component)."""
    n = part.groupBy("repo", "component").agg(F.count("*").alias("n"))
    return n.groupBy("repo").agg(F.count("*").alias("components"), F.avg("n").alias("average"), F.max("n").alias("largest"))


def without_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("repo", F.col("src").alias("uid")).unionByName(edges.select("repo", F.col("dst").alias("uid"))).distinct()
    return vertices.join(ends, ["repo", "uid"], "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("repo", "src", "dst").unionByName(reverse(edges)).distinct()


def with_essentials(edges: DataFrame, vertices: DataFrame, essential: DataFrame) -> DataFrame:
    """`edges` and, from every vertex, one to each essential package (repo, uid) of its repository."""
    more = vertices.select("repo", F.col("uid").alias("src")).join(essential.select("repo", F.col("uid").alias("dst")), "repo").where("src <> dst")
    return edges.select("repo", "src", "dst").unionByName(more.select("repo", "src", "dst")).distinct()
