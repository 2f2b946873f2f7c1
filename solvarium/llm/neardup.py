"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. A document's set is its distinct 5-word shingles as 64-bit hashes. Documents with equal sets form a class (128-bit
   digest of the set); classes, not documents, go on, so exact copies cost nothing further.
2. Each class enters TREES sorted orders, one a tree, by DEPTH MinHash values. Neighbours in an order are those with
   the longest common prefix. An entry is paired with the next WIDTH ones that share MIN_DEPTH values: where a region
   is sparse that reaches all of it at the least depth, and where many share a prefix, the sort itself goes deeper, so
   depth adapts to the region. Orders are range-partitioned with the class as tie-breaker, and entries at partition
   ends are stitched, so no region meets in one task.
3. Candidates are confirmed on full sets: the neighbours of a few trees first. What that leaves in different
   components is confirmed next; pairs within one component cannot change the result. Two sets of 75% overlap share
   MIN_DEPTH values in a tree with probability 0.56, and in no tree with 1e-9.
4. Where more than WIDTH + 1 entries share MIN_DEPTH values, some pairs were not neighbours. There the depth is
   CROWD_DEPTH: in a region that shares so many values, and still has several components,
   all its pairs across components are compared on full sets: the entries are dealt into blocks of bounded size, and
   two blocks are compared by a matrix product, so no pair becomes a row. The largest component's entries meet the
   others only, never each other. Regions of one component, such as large groups of near copies, cost nothing. Two
   sets of 75% overlap share CROWD_DEPTH values in a tree with probability 0.42, and in no tree with 2e-6.
5. Components come from alternating stars over confirmed links.

Defined cases: null and empty texts have the empty set and are linked with nothing; fewer than five words make one
shingle; ties: the least id of a component is kept; rows that share an id are one document for what is kept, each with
its own set; a null id takes its class's component (null if its class has no id) and is kept if that is null; an
empty table gives an empty table; other columns are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvarium.llm import graph
from solvarium.llm._shared import Scratch, table

SHINGLE = 5
PERCENT = 75
TREES, DEPTH, MIN_DEPTH, WIDTH = 24, 6, 2, 2
#: Values that make a region whose entries are compared in full.
CROWD_DEPTH = 3
#: Trees whose direct neighbours are confirmed first.
FIRST_TREES = 6
#: Bytes of a tree's key: four for the first value, two for each further one.
KEY = 4 + 2 * (DEPTH - 1)
#: Bytes of a key that neighbours share (tree, and MIN_DEPTH values), and that make a region.
SHARED, REGION = (1 + 4 + 2 * (d - 1) for d in (MIN_DEPTH, CROWD_DEPTH))
#: Shingles in a block of a region's entries, each entry counting as LEAST at least.
BLOCK, LEAST = 250_000, 250
#: Cells of a matrix of entries by shingles.
CELLS = 4_000_000
KEPT = 200_000
#: Bits of the map of ids whose texts are wanted (8 MB).
BITS = 1 << 26

_R = np.random.default_rng(20)
_MULTIPLY = _R.integers(1 << 31, size=TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _R.integers(1 << 32, size=TREES * DEPTH, dtype=np.uint32)
_MIX = [np.uint64(int(x) | 1) for x in _R.integers(1 << 63, size=SHINGLE, dtype=np.uint64)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    import xxhash

    said = text.lower().split()  # of bytes: A-Z, and the six ASCII white-space characters
    if len(said) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(said), seed=len(said))] if said else [], dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, said), dtype=np.uint64, count=len(said))
    n = len(h) - SHINGLE + 1
    s = h[:n] * _MIX[0]
    for k in range(1, SHINGLE):
        s ^= s >> np.uint64(29)
        s += h[k : k + n] * _MIX[k]
    s ^= s >> np.uint64(32)
    s *= _MIX[0]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> bytes:
    """KEY bytes a tree, in an order that compares as the values do."""
    h = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(h), 2048):
        np.minimum(low, (h[a : a + 2048, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    low = low.reshape(TREES, DEPTH)
    out = np.empty((TREES, KEY), dtype=np.uint8)
    out[:, :4] = low[:, :1].astype(">u4").view(np.uint8)
    out[:, 4:] = np.ascontiguousarray((low[:, 1:] >> np.uint32(8)).astype(">u2")).view(np.uint8)
    return out.tobytes()


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        import xxhash

        words = _Words()
        for batch in batches:
            n, digest, sig = [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py() or b"", words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "digest", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sig binary")


PAIRS = "a long, b long, later int, part int, at long, key binary"


def _pairs(keys: np.ndarray, ids: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, later, place of the second) of neighbours in one sorted run of entries."""
    out = []
    prefix = np.ascontiguousarray(keys[:, :SHARED])
    for k in range(1, WIDTH + 1):
        near = (prefix[:-k] == prefix[k:]).all(axis=1)
        if part is not None:
            near &= part[:-k] != part[k:]
        i = np.flatnonzero(near)
        later = np.full(len(i), int(k > 1)) | (keys[i, 0] >= FIRST_TREES)
        out.append((np.minimum(ids[i], ids[i + k]), np.maximum(ids[i], ids[i + k]), later, i + k))
    return tuple(map(np.concatenate, zip(*out)))


def _neighbours(batches) -> Iterator[pa.RecordBatch]:
    """Pairs within a partition and entries of crowded regions, then the first and last WIDTH entries for the stitching."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    names = ["a", "b", "later", "part", "at", "key"]
    ends: dict[int, tuple[int, bytes]] = {}
    last_keys, last_ids, seen = np.zeros((0, 1 + KEY), np.uint8), np.zeros(0, np.int64), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = batch.column(0).to_pylist()
        new = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), 1 + KEY)
        keys, ids = np.concatenate([last_keys, new]), np.concatenate([last_ids, batch.column(1).to_numpy()])
        held = len(last_ids)
        a, b, later, second = _pairs(keys, ids)
        own = second >= held  # the others were given with the batch before
        n = int(own.sum())
        none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own]), pa.array(later[own].astype(np.int32)), *none], names=names)
        many = np.flatnonzero(_crowded(new))
        none = (pa.nulls(len(many), k) for k in kinds[1:5])
        regions = pa.array([bytes(raw[i][:REGION]) for i in many], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(ids[held + many], pa.int64()), *none, regions], names=names)
        for i in range(len(raw)):
            if seen + i < WIDTH or i >= len(raw) - WIDTH:
                ends[seen + i] = (int(ids[held + i]), raw[i])
        seen += len(raw)
        for at in [at for at in ends if WIDTH <= at < seen - WIDTH]:
            del ends[at]
        last_keys, last_ids = keys[-WIDTH:], ids[-WIDTH:]
    rows = [(i, None, None, part, at, key) for at, (i, key) in sorted(ends.items())]
    cols = list(zip(*rows)) if rows else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _crowded(keys: np.ndarray) -> np.ndarray:
    """Which sorted entries are in a region of more than WIDTH + 1; so is the first and the last region, which may go on."""
    start = np.flatnonzero(np.append(True, (keys[1:, :REGION] != keys[:-1, :REGION]).any(axis=1)))
    size = np.diff(np.append(start, len(keys)))
    many = size > WIDTH + 1
    many[[0, -1]] = True
    return np.repeat(many, size)


def candidates(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, later): class ids of neighbours in some tree, each pair once; later is 0 where the first trees have it.
    And (cid, region): the entries of all regions of more than WIDTH + 1, with some of smaller ones."""
    spark = classes.sparkSession
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    entries = classes.select("cid", "sig", tree).select(
        F.expr(f"concat(unhex(lpad(hex(tree), 2, '0')), substring(sig, {KEY} * tree + 1, {KEY}))").alias("key"), "cid"
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = entries.repartitionByRange(n, "key", "cid").sortWithinPartitions("key", "cid")
    near = scratch.save(order.mapInArrow(_neighbours, PAIRS), "near")
    ends = near.where("part IS NOT NULL").select("part", "at", "a", "key").collect()  # 2 * WIDTH a partition at most
    pairs = near.where("b IS NOT NULL").select("a", "b", "later")
    dense = near.where("part IS NULL AND b IS NULL").select(F.col("a").alias("cid"), F.col("key").alias("region"))
    ends.sort()
    if len(ends) > 1:
        keys = np.frombuffer(b"".join(bytes(r.key) for r in ends), np.uint8).reshape(len(ends), 1 + KEY)
        a, b, later, _ = _pairs(keys, np.array([r.a for r in ends]), np.array([r.part for r in ends]))
        pairs = pairs.unionByName(spark.createDataFrame(pa.table({"a": a, "b": b, "later": later.astype(np.int32)})))
    return scratch.save(pairs.groupBy("a", "b").agg(F.min("later").alias("later")), "pairs"), dense


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are similar enough on their full sets."""
    one, two = (sets.select(F.col("cid").alias(c), F.col("s").alias(f"s_{c}")) for c in "ab")

    def run(batches):
        words = _Words()
        for batch in batches:
            keep, seen = [], {}
            for a, b, ta, tb in zip(*(batch.column(k) for k in range(4))):
                both = []
                for key, t in ((a.as_py(), ta), (b.as_py(), tb)):
                    if key not in seen:
                        if len(seen) > 200:
                            seen.clear()
                        seen[key] = shingles(t.as_py(), words)
                    both.append(seen[key])
                x, y = both
                if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                    keep.append(False)
                    continue
                k = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * k >= PERCENT * (len(x) + len(y) - k))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b")
    return joined.mapInArrow(run, "a long, b long")


def _across(dense: DataFrame, named: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): labels to be joined, by all similar pairs across components of named(cid, n, label) within a region."""
    entries = scratch.save(dense.join(named.select("cid", "n", "label"), "cid"), "dense")
    weight = F.sum(F.greatest("n", F.lit(LEAST)))
    each = entries.groupBy("region", "label").agg(F.count("*").alias("n"), weight.alias("w"))
    most = F.max(F.struct("n", "label", "w")).alias("most")
    split = each.groupBy("region").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("w"), most)
    split = split.where(f"labels > 1 AND n > {WIDTH + 1}")
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    split = scratch.save(split.select("region", F.col("most.label").alias("top"), blocks(F.col("w") - F.col("most.w")).alias("others"), blocks(F.col("most.w")).alias("tops")), "split")

    # Blocks 0 to others - 1 are compared with one another and themselves, and with those of the largest component.
    slot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    is_top = F.col("label") == F.col("top")
    own = F.when(is_top, F.col("others") + slot("tops")).otherwise(slot("others"))
    last = F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    units = entries.join(split, "region").select("region", "cid", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("to"))
    units = scratch.save(units.select("region", F.least("own", "to").alias("x"), F.greatest("own", "to").alias("y"), "own", "cid", "label"), "units")

    def hashed(batches):
        words = _Words()
        for batch in batches:
            s = pa.array([shingles(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], names=["cid", "s"])

    sets = scratch.save(texts.join(units.select("cid").distinct(), "cid").select("cid", "s").mapInArrow(hashed, "cid long, s binary"), "hashed")
    dealt = units.join(sets, "cid").select("region", "x", "y", "own", "label", "s")
    dealt = dealt.repartition("region", "x", "y").sortWithinPartitions("region", "x", "y")

    def run(batches):
        for unit in _units(batches):
            links = _joined(*unit)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return scratch.save(dealt.mapInArrow(run, "a long, b long").distinct(), "across")


def _units(batches) -> Iterator[tuple[list, list]]:
    """Of entries sorted by unit: the (label, set) of its one block and of its other, which may be the same."""
    unit, sides = None, ([], [])
    done = lambda: (sides[0], sides[0] if unit[1] == unit[2] else sides[1])
    for batch in batches:
        region, x, y, own, label = (batch.column(k).to_pylist() for k in range(5))
        for i, s in enumerate(batch.column(5)):
            if (region[i], x[i], y[i]) != unit:
                if unit is not None:
                    yield done()
                unit, sides = (region[i], x[i], y[i]), ([], [])
            sides[own[i] != x[i]].append((label[i], np.frombuffer(s.as_py(), np.uint64)))
    if unit is not None:
        yield done()


def _joined(one: list, two: list) -> list[tuple[int, int]]:
    """Links between labels, as few as join what the similar pairs of two blocks join."""
    if not one or not two:
        return []
    (la, lb), (sa, sb) = (np.array([e[0] for e in side]) for side in (one, two)), (np.array([len(e[1]) for e in side]) for side in (one, two))
    n, total = len(one), sa.sum()
    h, at = np.unique(np.concatenate([e[1] for e in (*one, *two)]), return_inverse=True)
    shared = (np.bincount(at[:total], minlength=len(h)) > 0) & (np.bincount(at[total:], minlength=len(h)) > 0)
    keep = shared[at]
    column = (np.cumsum(shared) - 1)[at[keep]]
    row = np.repeat(np.arange(n + len(two)), np.concatenate([sa, sb]))[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common, wide = np.zeros((n, len(two)), np.int64), max(64, CELLS // (n + len(two)))
    for c in range(0, int(shared.sum()), wide):
        of = slice(*np.searchsorted(column, [c, c + wide]))
        m = np.zeros((n + len(two), wide), np.float32)
        m[row[of], column[of] - c] = 1
        common += (m[:n] @ m[n:].T).astype(np.int64)
    i, j = np.nonzero((100 * common >= PERCENT * (sa[:, None] + sb - common)) & (la[:, None] != lb))
    root: dict[int, int] = {}

    def find(p: int) -> int:
        while (q := root.get(p, p)) != p:
            root[p] = root.get(q, q)
            p = q
        return p

    out = []
    for a, b in np.unique(np.stack([la[i], lb[j]], axis=1), axis=0).tolist():
        p, q = find(a), find(b)
        if p != q:
            root[p] = q
            out.append((a, b))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    made = scratch.save(_sets(docs, id_col, text_col), "sets")
    groups = made.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = scratch.save(groups.where("rep IS NOT NULL").withColumn("cid", F.monotonically_increasing_id()), "classes")
    pairs, dense = candidates(classes, scratch)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "rep", "digest"), "cid")
    texts = scratch.save(_texts(docs, scratch.save(wanted, "wanted"), id_col, text_col), "texts")

    first = scratch.save(_confirmed(pairs.where("later = 0"), texts), "first")
    labels = scratch.save(graph.components(first, scratch, "g"), "labels")
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    rest = pairs.where("later = 1").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")
    second = scratch.save(_confirmed(rest, texts), "second")
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(second)
    labels = graph.components(links, scratch, "h")

    # Both written, so that the join by label reads two plain exchanges, of which Spark can split a large component.
    named = classes.select("cid", "n", "digest", "rep").join(labels, F.col("cid") == F.col("node"), "left")
    named = scratch.save(named.select("cid", "n", "digest", "rep", F.coalesce("label", "cid").alias("label")), "named")
    across = _across(dense, named, texts, scratch)
    if not across.isEmpty():
        moved = scratch.save(graph.components(across, scratch, "i").select(F.col("node").alias("label"), F.col("label").alias("to")), "moved")
        named = named.join(moved, "label", "left").select("digest", "rep", F.coalesce("to", "label").alias("label"))
        named = scratch.save(named, "renamed")
    least = scratch.save(named.groupBy("label").agg(F.min("rep").alias("component")), "least")
    named = scratch.save(named.select("digest", "label").join(least, "label").select("digest", "component"), "components")
    out = made.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    scratch.drop("classes", "near", "pairs", "wanted", "texts", "first", "labels", "second", "named", "least", "dense", "split", "units", "hashed", "across", "moved", "renamed")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, s): the text of each wanted class (cid, rep, digest), one row a class.

    A bitmap of BITS bits, one for each hash of a wanted id, is all that is broadcast, whatever their number; it keeps
    most other texts out of the shuffle. What passes is joined by the digest of its set, as ids need not be unique.
    """
    spark = docs.sparkSession
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(BITS))
    words = wanted.select(slot("rep").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
    words = words.agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(BITS // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def pick(batches) -> Iterator[pa.RecordBatch]:
        import xxhash

        own, bits = _Words(), shared.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            hit = np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)
            s = batch.column(1).take(pa.array(hit))
            digests = [xxhash.xxh3_128_digest(shingles(t.as_py() or b"", own).tobytes()) for t in s]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), s], names=["digest", "s"])

    given = docs.select(slot(id_col).alias("slot"), F.col(text_col).cast("binary").alias("s")).mapInArrow(pick, "digest binary, s binary")
    found = given.join(wanted.select("cid", "digest"), "digest").select("cid", "s")
    return found.groupBy("cid").agg(F.first("s").alias("s")) if _repeats(docs, id_col) else found


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether rows repeat an id, so that a class's text may come more than once."""
    return bool(docs.groupBy(id_col).count().where("count > 1").limit(1).count())


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component; columns as they are. Rows with a null id are documents each."""
    # Each null gets an id of its own, after all others, so that it is decided by row; they are written to keep it so.
    none = docs.where(F.col(id_col).isNull())
    if none.isEmpty():
        return _kept(docs, docs.select(id_col, text_col), id_col, text_col)
    kind = docs.schema[id_col].dataType
    row = F.monotonically_increasing_id()
    if kind.simpleString() == "string":
        own = F.concat(F.lit(chr(0x10FFFF)), F.lit(uuid.uuid4().hex), row.cast("string"))
    else:
        own = (F.lit(docs.agg(F.max(id_col)).first()[0] or 0).cast("long") + 1 + row).cast(kind)
    none = Scratch(docs.sparkSession, "neardup").save(none.withColumn("__own", own), "none")
    all_ = docs.where(F.col(id_col).isNotNull()).withColumn("__own", F.col(id_col)).unionByName(none)
    return _kept(all_, all_.select("__own", text_col), "__own", text_col).select(*docs.columns)


def _kept(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    found = near_duplicates(texts, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col(id_col) == F.col("__id"), "left_semi")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM doc),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM own),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT own.doc_id, len(s) AS n_shingles, min(r.b) AS component_id, own.doc_id = min(r.b) AS kept
FROM own JOIN reach r ON r.a = own.doc_id GROUP BY own.doc_id, s"""
