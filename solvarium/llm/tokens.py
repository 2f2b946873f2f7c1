"""Token counts of flat, unindexed token files, by a scan for end-of-document ids.

A token file is little-endian 16-bit ids and nothing else; each document ends with the separator id. Files are cut into
blocks of fixed size that tasks read on their own, wherever documents begin. In a block, one vector comparison finds the
separators and their differences give the lengths of the documents that lie inside. What a block can't know is how long
the document was before it began: the tokens since the last separator of the blocks before, a prefix scan over one
narrow row a block (its number of separators and the tokens left after the last). Only its result meets the lengths, in
a join by block, and is added to each block's first.

The writer makes such files from documents (rolling by size, temporary names, a manifest written last), with a list of
their ids in file order beside them, so that counts can be given by document; the scan itself reads token files alone.

Defined cases: a null or empty text is a document of 0 tokens; the separator's own text in a document is ordinary text
and gives no separator; tokens after a file's last separator are a last document, marked as not closed; a file of odd
length is an error; repeated rows and ids are documents each; no document, no file, no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, shared_uri, table
from solvarium.llm.packing import _encoder, _groups, tokenizer_path

SEPARATOR = 49407
BLOCK_BYTES = 4 << 20
ROLL_BYTES = 128 << 20
FILES = "file string, bytes long"


def write(docs: DataFrame, root: str, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, separator: int = SEPARATOR, roll_bytes: int = ROLL_BYTES) -> tuple[DataFrame, DataFrame]:
    """Writes token files under `root`; returns (file, bytes) and (file, ordinal, id): which document stands where."""
    path = path or tokenizer_path()
    end = separator.to_bytes(2, "little")
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "tokens")

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        encode, out, name, size, n = _encoder(path, special=False), None, "", 0, 0
        for batch in batches:
            files, ordinals, sizes = [], [], []
            for texts in _groups(batch.column(1)):
                for ids in encode(texts):
                    if out is None:  # a name of its own for each attempt; the manifest says which count
                        name, size, n = f"{uuid.uuid4().hex}.tokens", 0, 0
                        out = store.open_output_stream(f"{base}/{name}")
                    data = np.frombuffer(ids, "<u4").astype("<u2").tobytes() + end
                    out.write(data)
                    size += len(data)
                    files.append(name)
                    ordinals.append(n)
                    sizes.append(size)
                    n += 1
                    if size >= roll_bytes:
                        out.close()
                        out = None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), pa.array(sizes, pa.int64())], names=["id", "file", "ordinal", "end"])
        if out is not None:
            out.close()

    made = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, file string, ordinal long, end long")
    made = scratch.save(made, "order")
    return made.groupBy("file").agg(F.max("end").alias("bytes")), made.select("file", "ordinal", "id")


def scan_block(ids: np.ndarray, separator: int) -> tuple[np.ndarray, int]:
    """Lengths of the documents that end in the block, the first counted from the block's start, and the tokens left."""
    at = np.flatnonzero(ids == separator)
    lengths = np.diff(at, prepend=-1) - 1
    return lengths, len(ids) - (int(at[-1]) + 1 if len(at) else 0)


def scan(files: DataFrame, root: str, *, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in files(file, bytes)."""
    block_bytes -= block_bytes % 2
    blocks = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("bytes") - 1) / block_bytes)))).alias("block"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                if row["bytes"] % 2:
                    raise ValueError(f"{row['file']} is no file of 16-bit ids")
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    f.seek(row["block"] * block_bytes)
                    raw = f.read(min(block_bytes, row["bytes"] - row["block"] * block_bytes))
                lengths, tail = scan_block(np.frombuffer(raw, "<u2"), separator)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), *(pa.array([v], pa.int64()) for v in (row["block"], len(lengths), tail)), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "n", "tail", "lengths"],
                )

    # Written, so that the prefix scan reads the narrow columns alone and the lengths stay out of its shuffles.
    found = blocks.repartition("file", "block").mapInArrow(run, "file string, block long, n long, tail long, lengths array<long>")
    found = Scratch(files.sparkSession, "scan").save(found, "blocks")
    # The prefix scan: all tails so far, less those up to the last block that holds a separator.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = found.select("file", "block", "n", "tail").withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0))).withColumn("docs", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut_ = F.last(F.when(F.col("n") > 0, F.col("tails")), ignorenulls=True).over(before)
    seen = seen.withColumn("carry", F.col("tails") - F.coalesce(cut_, F.lit(0)))
    last = F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()
    rest = F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    seen = seen.select("file", "block", "docs", "carry", F.when(last & (rest > 0), rest).alias("rest"))
    seen = found.select("file", "block", "lengths").join(seen, ["file", "block"])
    full = F.transform("lengths", lambda n, i: F.struct((n + F.when(i == 0, F.col("carry")).otherwise(0)).alias("n"), F.lit(True).alias("closed")))
    full = F.when(F.col("rest").isNotNull(), F.array_append(full, F.struct(F.col("rest").alias("n"), F.lit(False).alias("closed")))).otherwise(full)
    out = seen.select("file", "docs", F.posexplode(full).alias("i", "d"))
    return out.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), F.col("d.n").alias("n_tokens"), F.col("d.closed").alias("closed"))


def query(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_uri(spark)}/solvarium/tokens-{uuid.uuid4().hex}"
    files, order = write(table(spark, sf_dir, "documents").select("doc_id", "text"), root)
    counted = scan(files, root)
    # Both sides grow with the documents but compress to little, which would pass for small enough to broadcast.
    return order.hint("merge").join(counted, ["file", "ordinal"]).select(F.col("id").alias("doc_id"), "n_tokens")
