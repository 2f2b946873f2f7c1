"""Approximate nearest neighbours by learned partitions.

Learning, on a bounded sample (SAMPLE vectors, the first in an order by a hash of the id): a graph of each vector's
nearest neighbours; a balanced partition of that graph, by moving vectors to the part that most of their neighbours
are in while no part outgrows its share; and a small network that predicts, from a vector, how its neighbours spread
over the parts. Every row of the table is then indexed in its most probable part. How many parts a query must visit depends on how far the vectors cluster, so
it is measured: on the sample, the least number of most probable parts that hold TARGET of all true neighbours. A query
is routed to so many (more where these hold under LEAST rows).

Search. A part's rows are dealt to blocks of some BLOCK rows and its queries likewise, so a part that draws a third of
all rows (many equal vectors) is many small groups and no group grows with the table. A group multiplies two matrices,
and gives each query's best K with scores computed anew on the original vectors; the best K of these over all groups
are found with a ranking that Spark limits before the shuffle.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of a
length other than the sample's most common one, nor rows with a null id; rows that share an id count as one, with
the best of their scores; equal scores go to the smaller id; fewer candidates than K give them all; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, table

K = 20
SAMPLE = 6144
ROWS_A_PART, LEAST_PARTS, MOST_PARTS = 8192, 16, 256
TARGET, LEAST = 0.94, 2000
BLOCK = 8192
NEIGHBOURS, ROUNDS, SLACK = 10, 30, 1.1
HIDDEN, EPOCHS, RATE, SEED = 96, 40, 0.003, 11


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Ids of the k rows with the largest inner product with each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), dtype=np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row: few graph edges between parts, and no part above SLACK times its share."""
    r = np.random.default_rng(SEED)
    n, room = len(x), int(np.ceil(SLACK * len(x) / parts))

    def deal(liking: np.ndarray) -> np.ndarray:
        """Each row to the part it likes best that has room; the most decided rows choose first."""
        label, left = np.full(n, -1), np.full(parts, room)
        for _ in range(parts):
            open_ = np.flatnonzero(label < 0)
            if not len(open_):
                break
            own = np.where(left > 0, liking[open_], -np.inf)
            best = own.argmax(axis=1)
            order = np.lexsort((-own[np.arange(len(open_)), best], best))
            best_sorted = best[order]
            rank = np.arange(len(order)) - np.searchsorted(best_sorted, best_sorted)
            taken = order[rank < left[best_sorted]]
            label[open_[taken]] = best[taken]
            left -= np.bincount(best[taken], minlength=parts)
        return label

    centres = x[r.choice(n, parts, replace=False)]
    for _ in range(8):
        label = deal(x @ centres.T)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    source = np.repeat(np.arange(n), graph.shape[1])
    for k in range(ROUNDS):
        to = graph.ravel()
        votes = np.bincount(source * parts + label[to], minlength=n * parts) + np.bincount(to * parts + label[source], minlength=n * parts)
        votes = votes.reshape(n, parts).astype(float)
        votes[np.arange(n), label] += 0.5 + 2 * (r.random(n) < 0.3)  # some stay, or neighbours would swap for ever
        moved = deal(votes)
        if (moved == label).all():
            break
        label = moved
    return label


@dataclass
class Router:
    """A network from vectors to part probabilities."""

    weights: list[np.ndarray]
    mean: np.ndarray
    scale: float
    probes: int = 1

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        s = np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d
        s = np.exp(s - s.max(axis=1, keepdims=True))
        return s / s.sum(axis=1, keepdims=True)


def probes_needed(router: Router, x: np.ndarray, graph: np.ndarray, target: float) -> int:
    """The least number of parts, by probability, that hold `target` of the neighbours of the rows of `x`."""
    p = router.probabilities(x)
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1)  # of each part in each row's order
    at = np.take_along_axis(place, p.argmax(axis=1)[graph], axis=1)
    seen = np.cumsum(np.bincount(at.ravel(), minlength=p.shape[1])) / max(1, at.size)
    return int(np.searchsorted(seen, target)) + 1


def learn(x: np.ndarray, parts: int, target: float = TARGET) -> Router:
    n, dim = x.shape
    r = np.random.default_rng(SEED)
    router = Router([], x.mean(axis=0), float(x.std() or 1))
    parts = max(1, min(parts, n))
    p = [r.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
    router.weights = p
    if parts == 1 or n < 3:
        return router
    graph = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(x, graph, parts)
    y = np.zeros((n, parts))
    np.add.at(y, (np.arange(n), label), 1)
    np.add.at(y, (np.repeat(np.arange(n), graph.shape[1]), label[graph.ravel()]), 1)
    y /= y.sum(axis=1, keepdims=True)
    z = (x - router.mean) / router.scale
    m1, m2, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(r.permutation(n), max(1, n // 128)):
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(axis=1, keepdims=True))
            d = (s / s.sum(axis=1, keepdims=True) - y[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            step += 1
            for k, g in enumerate((z[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                p[k] -= RATE * (1 - epoch / EPOCHS) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    router.probes = min(parts, probes_needed(router, x, neighbour_graph(x, K), target))
    return router


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """(query row, vector row, score) of each query's k best, its own id left out."""
    s = queries @ vectors.T
    s[query_ids[:, None] == ids[None, :]] = -np.inf
    k = min(k, len(ids))
    kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
    # All that may tie with the k-th, as products of matrices round differently from sums by row.
    q, v = np.nonzero((s >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None]) & np.isfinite(s))
    score = np.concatenate([(queries[q[a : a + 8192]] * vectors[v[a : a + 8192]]).sum(axis=1) for a in range(0, len(q), 8192)] or [np.zeros(0)])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[near], v[near], score[near]


def search(
    rows: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    sample: int = SAMPLE,
    target: float = TARGET,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found among `rows`, by inner product.

    target: share of the true neighbours of the sample that the routing must reach there.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")

    def valid(df: DataFrame) -> DataFrame:
        x = F.col("x")
        fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.col("id").isNotNull() & fine)

    given = valid(rows)
    some = [r.x for r in given.orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths, counts = np.unique([len(x) for x in some], return_counts=True)
    dim = int(lengths[counts.argmax()])
    n = given.count()
    router = learn(np.array([x for x in some if len(x) == dim]), min(MOST_PARTS, max(LEAST_PARTS, -(-n // ROWS_A_PART))), target)
    parts = len(router.weights[3])
    shared = spark.sparkContext.broadcast(router)

    def assign(batches):
        for batch in batches:
            part = shared.value.probabilities(_matrix(batch.column(1), dim)).argmax(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], names=["id", "x", "part"])

    fit = F.size("x") == dim
    index = scratch.save(given.where(fit).mapInArrow(assign, "id long, x array<double>, part int"), "index")
    held = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # one row a part
    sizes = np.array([held.get(p, 0) for p in range(parts)])
    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(-shared.value.probabilities(_matrix(batch.column(1), dim)), axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            go = ((np.arange(parts) < shared.value.probes) | (before < LEAST)) & (sizes[order] > 0)
            at, place = np.nonzero(go)
            for a in range(0, len(at), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(at[a : a + 20_000])) for c in batch.columns), pa.array(order[at, place][a : a + 20_000].astype(np.int32))], names=["id", "x", "part"]
                )

    asked = scratch.save(valid(queries).where(fit).mapInArrow(route, "id long, x array<double>, part int"), "asked")
    asks = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = [-(-int(s) // BLOCK) for s in sizes]
    chunks = [-(-asks.get(p, 0) // BLOCK) for p in range(parts)]
    of = lambda n: F.element_at(F.array(*[F.lit(max(1, v)) for v in n]), F.col("part") + 1)
    spread = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    # By place, not by id: rows that repeat one id are dealt out as well.
    dealt = lambda n: F.pmod(F.monotonically_increasing_id(), of(n).cast("long")).cast("int")
    left = index.withColumn("block", dealt(blocks)).withColumn("chunk", spread(chunks))
    right = asked.withColumn("chunk", dealt(chunks)).withColumn("block", spread(blocks))

    def near(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, own = (t.column("id").to_numpy() for t in (vectors, queries))
        x, y = (_matrix(t.column("x").combine_chunks(), dim) for t in (vectors, queries))
        repeats = len(ids) - len(np.unique(ids))  # these may stand among the best in place of other ids
        some = [best(y[a : a + 256], own[a : a + 256], x, ids, k + repeats) for a in range(0, len(own), 256)]
        q, v, score = (np.concatenate(c) for c in zip(*((q + 256 * i, v, s) for i, (q, v, s) in enumerate(some))))
        return pa.table({"query_id": own[q], "vec_id": ids[v], "score": score})

    keys = ("part", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(near, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = F.row_number().over(_window())
    return found.withColumn("rank", by).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
