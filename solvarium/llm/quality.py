"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of WORDS words. Each passage is encoded from which words it holds (a histogram of hashed
words, case aside), from what they look like (a histogram of hashed shapes: letters, digits and signs, runs collapsed),
from repetition, variety and lengths, and from the document's size. A run of more than LONGEST bytes without white space
counts as several words, so scripts without spaces and long encoded blocks are read whole.
The network is h = tanh(Wx + b), gated attention a = softmax(w . (tanh(Vh) * sigmoid(Uh))) over the document's
passages, and sigmoid(c . sum(a h) + d). Only documents have labels; the attention weights are learned from them.

Training takes at most SAMPLE labelled documents, the first in an order by a hash of the id, so it is the same at
every size; what reaches the driver is their passages' features, and the labels joined are broadcast (SAMPLE rows).
Scoring maps over whole texts in Arrow batches, without a shuffle.

Defined cases: a null or empty text has one passage of no words and a score like any other; several labels of one
document are averaged, null labels are left out; without labels every score is 0.5; rows are independent, so repeated
rows and duplicate ids are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvarium.llm._shared import table

WORDS = 64
SHAPES, LEXICAL = 128, 256
LONGEST = 48
HIDDEN, GATE = 24, 12
SAMPLE = 4000
EPOCHS, RATE, DECAY, SEED = 40, 0.01, 1e-4, 7
EXTRA = 9
WIDTH = SHAPES + LEXICAL + EXTRA
#: Words whose codes a worker keeps.
KEPT = 200_000

_CLASS = bytes(
    97 if 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if c >= 128 else c for c in range(256)
)


class _Codes(dict):
    """A word's code: shape bucket (bits 0 to 7), length (8 to 15), and 48 bits of hash, the lowest of which are its bucket."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        shape, last = bytearray(), 0
        for c in word.translate(_CLASS):
            if c != last:
                shape.append(c)
            last = c
        bucket = xxhash.xxh64_intdigest(bytes(shape[:12])) % SHAPES
        code = bucket | len(word) << 8 | (xxhash.xxh64_intdigest(word.lower()) >> 16) << 16
        if len(self) >= KEPT:
            self.clear()
        self[word] = code
        return code


def _words(text: bytes) -> list[bytes]:
    said = text.split()
    if said and len(max(said, key=len)) > LONGEST:
        return [w[k : k + LONGEST] for w in said for k in range(0, len(w), LONGEST)]
    return said


def encode(texts: list[bytes], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (n, WIDTH) of all texts, and how many passages each text has (1 at least)."""
    said = [_words(t) for t in texts]
    n = np.array([len(w) for w in said], dtype=np.int64)
    code = np.fromiter((c for w in said for c in map(codes.__getitem__, w)), dtype=np.uint64, count=int(n.sum()))
    passages = np.maximum(1, -(-n // WORDS))
    first = np.cumsum(passages) - passages
    at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(first, n) + at // WORDS
    total = int(passages.sum())
    x = np.zeros((total, WIDTH), dtype=np.float32)
    size = np.bincount(own, minlength=total).astype(np.float32)
    safe = np.maximum(size, 1)
    shape = (code & np.uint64(0xFF)).astype(np.int64)
    lexical = ((code >> np.uint64(16)) % np.uint64(LEXICAL)).astype(np.int64)
    for begin, width, bucket in ((0, SHAPES, shape), (SHAPES, LEXICAL, lexical)):
        many = np.bincount(own * width + bucket, minlength=total * width).reshape(total, width)
        x[:, begin : begin + width] = np.sqrt(many / safe[:, None])
    length = ((code >> np.uint64(8)) & np.uint64(0xFF)).astype(np.float32)
    mean = np.bincount(own, length, minlength=total) / safe
    again = np.zeros(len(code), dtype=bool)
    if len(code):
        again[1:] = (code[1:] == code[:-1]) & (at[1:] > 0)
    kinds = _kinds(own, code)
    extra = SHAPES + LEXICAL
    x[:, extra] = mean / 8
    x[:, extra + 1] = np.sqrt(np.maximum(0, np.bincount(own, length * length, minlength=total) / safe - mean * mean)) / 4
    x[:, extra + 2] = np.bincount(own, again, minlength=total) / safe
    x[:, extra + 3] = np.bincount(kinds, minlength=total) / safe
    x[:, extra + 4] = np.log1p(size) / 4
    document = np.repeat(np.arange(len(texts)), passages)
    lines = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.float32)
    x[:, extra + 5] = (np.log1p(n) / 8)[document]
    x[:, extra + 6] = (np.log1p(n / lines) / 4)[document]
    x[:, extra + 7] = (n < 12)[document]
    x[:, extra + 8] = 1
    return x, passages


def _kinds(own: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The passage of each distinct (passage, word)."""
    key = np.unique((own.astype(np.uint64) << np.uint64(40)) | (code >> np.uint64(24)))
    return (key >> np.uint64(40)).astype(np.int64)


@dataclass
class Model:
    """Weights by name; `mean` and `scale` standardise features."""

    weights: dict[str, np.ndarray] | None
    mean: np.ndarray
    scale: np.ndarray
    base: float = 0.5

    def forward(self, x: np.ndarray, passages: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.weights, np.cumsum(passages) - passages
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (t * g) @ p["w"]
        own = np.repeat(np.arange(len(passages)), passages)
        e = np.exp(e - np.maximum.reduceat(e, first)[own])
        a = e / np.add.reduceat(e, first)[own]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "own": own, "first": first, "score": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def score(self, x: np.ndarray, passages: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(passages):
            return np.full(len(passages), self.base)
        return self.forward((x - self.mean) / self.scale, passages)["score"].astype(np.float64)


def fit(x: np.ndarray, passages: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the log loss of documents, in batches of 64 documents."""
    if not len(y) or y.min() == y.max():
        return Model(None, np.zeros(WIDTH), np.ones(WIDTH), float(y[0]) if len(y) else 0.5)
    r = np.random.default_rng(SEED)
    model = Model(None, x.mean(axis=0), np.maximum(x.std(axis=0), 0.02))
    model.scale[SHAPES : SHAPES + LEXICAL] *= 2  # many and rare: they tell less, each
    x = x - model.mean.astype(np.float32)
    x /= model.scale.astype(np.float32)
    p = {"W": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE))}
    p |= {"U": r.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": r.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    p = model.weights = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    first, step = np.cumsum(passages) - passages, 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for docs in np.array_split(order, max(1, len(y) // 64)):
            n = passages[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own = x[rows]
            f = model.forward(own, n)
            g = _gradient(p, f, own, f["score"] - y[docs])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in p:
                d = g[k] + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _gradient(p: dict, f: dict, x: np.ndarray, wrong: np.ndarray) -> dict[str, np.ndarray]:
    k = len(wrong)
    dz = (wrong[:, None] * p["c"])[f["own"]] / k
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["first"])[f["own"]])
    dt, dg = de[:, None] * p["w"] * f["g"], de[:, None] * p["w"] * f["t"]
    dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
    du = dh * (1 - f["h"] ** 2)
    return {
        "W": x.T @ du, "b": du.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
        "w": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ wrong / k, "d": np.array([wrong.sum() / k], dtype=np.float32),
    }


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts in groups of some 2 MB."""
    own, size = [], 0
    for t in texts:
        t = t.as_py() or b""
        own.append(t)
        size += len(t)
        if size > 2 << 20:
            yield own
            own, size = [], 0
    if own:
        yield own


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__text")).join(F.broadcast(known), "__id")

    def run(batches):
        codes = _Codes()
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                x, n = encode(texts, codes)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(n)),
                        batch.column(2).slice(at, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array([zlib.compress(x[b - k : b].astype("<f4").tobytes(), 1) for b, k in zip(ends, n)], pa.binary()),
                    ],
                    names=["id", "y", "n", "x"],
                )
                at += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("__id", "__text", "__y").mapInArrow(run, f"id {kind}, y double, n long, x binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    if not got:
        return fit(np.zeros((0, WIDTH)), np.zeros(0, np.int64), np.zeros(0))
    x = np.frombuffer(bytearray().join(zlib.decompress(r["x"]) for r in got), "<f4").reshape(-1, WIDTH)
    return fit(x, np.array([r["n"] for r in got]), np.array([r["y"] for r in got], dtype=np.float32))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with `score_col`, replaced if there."""
    docs = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches):
        codes = _Codes()
        for batch in batches:
            said = [shared.value.score(*encode(texts, codes)) for texts in _chunks(batch.column(n))]
            scores = pa.array(np.concatenate(said) if said else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], scores], names=[*batch.schema.names[:n], score_col])

    raw = next(name for k in range(n + 1) if (name := f"__raw{k}") not in docs.columns)
    given = docs.withColumn(raw, F.col(text_col).cast("binary"))
    return given.mapInArrow(run, docs.withColumn(score_col, F.lit(0.0)).schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
