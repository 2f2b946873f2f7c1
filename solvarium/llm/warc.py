"""Deterministic sharded WARC writer, and the reader of what it wrote.

Order. Records are range-sorted by id, then by payload digest. Spark's own range bounds come from a random sample, so here
a shard ends where the exact bytes of all records before reach its share, wherever ids lie and however many pages have
one id; the same pages and the same number of shards always give the same files, byte for byte.

Duplicates. Payload digests go, without payloads, through one grouping; which pages revisit which is then merged into
the sorted stream as short rows beside the pages, so payloads are shuffled once, and a hot payload's pages meet in no
task. Groups and joins there are by digest over narrow rows, combined before the shuffle.

Files. A task writes its shard as gzip members, one a record, and rolls to the next file by compressed size. Files have
temporary names of the attempt; each leaves a manifest row. Rows of attempts that Spark kept are renamed to final names
in a second job, that may be repeated, and the manifest is written last: readers take only files it names, so a lost
executor leaves orphans and no wrong data.

Defined cases: a null payload is empty; a null url is the empty URL; pages with a null id sort first, count as smaller
than any id, and revisit a page with one; of repeated rows with the id that is the response, the first is the response
and the rest revisit it; no page, no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvarium.llm._shared import Scratch, shared_uri, table

ROLL_BYTES = 64 << 20
#: What a null id counts as in the order.
LEAST = -(1 << 63)
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, file long, name string, temporary string, records long, bytes long, sha1 string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None)]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(*of: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(map(str, of)))}>"


def page_record(page_id, url: str, payload: bytes, copy: int, refers_to, revisit: bool) -> bytes:
    """A response with its payload, or a revisit without; headers and digests are made anew from the payload."""
    digest = base32_sha1(payload)
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [
        ("WARC-Record-ID", _urn(page_id, digest, copy)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _urn(refers_to, digest, 0) if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("X-Payload-Length", len(payload)),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # the header's time is 0
    return z.compress(data) + z.flush()


class _Roller:
    """Files of one shard, under temporary names."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.shard, self.roll, self.rows = shard, roll_bytes, []
        self.attempt, self.out = uuid.uuid4().hex, None

    def write(self, record: bytes) -> None:
        if self.out is None:
            name = f"shard-{self.shard:05d}-{len(self.rows):05d}.warc.gz"
            self.row = {"shard": self.shard, "file": len(self.rows), "name": name, "temporary": f"_temporary/{self.attempt}-{name}", "records": 0, "bytes": 0}
            self.sum = hashlib.sha1()
            self.fs.create_dir(f"{self.base}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.base}/{self.row['temporary']}", compression=None)
            info = f"software: solvarium\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
            self._put(_gzip(_record("warcinfo", [("WARC-Record-ID", _urn(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)))
        self._put(_gzip(record))
        self.row["records"] += 1
        if self.row["bytes"] >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.row["bytes"] += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append(self.row | {"sha1": self.sum.hexdigest()})
            self.out = None


def write(
    pages: DataFrame,
    root: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shards: int | None = None,
    roll_bytes: int = ROLL_BYTES,
    revisit_from: int = 0,
) -> DataFrame:
    """Writes the pages as WARC files under `root`; returns the manifest. Payloads under `revisit_from` bytes are never revisited."""
    spark = pages.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    made = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    scratch = Scratch(spark, "warc")
    short = scratch.save(made.select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")), "digests")

    shard = _bounds(short, shards, scratch)
    groups = short.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("rows"))
    groups = scratch.save(groups.where("rows > 1").select("digest", "keeper"), "groups")
    marks = short.join(groups, "digest").where("id IS NULL OR id <= keeper").select("id", "digest", "keeper").distinct()

    stream = made.select("id", "url", "payload", F.lit(1).alias("kind"), F.sha1("payload").alias("digest"), F.lit(None).cast("long").alias("keeper"))
    stream = stream.unionByName(marks.select("id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("kind"), "digest", "keeper"))
    stream = stream.repartitionById(shards, shard(F.col("id"), F.col("digest"))).sortWithinPartitions("id", "digest", "kind", "url")

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = _Roller(root, TaskContext.get().partitionId(), roll_bytes)
        here, marked, copies = object(), {}, {}
        for batch in batches:
            for page_id, url, body, kind, digest, keeper in zip(*(batch[i] for i in range(6))):
                page_id = page_id.as_py()
                if page_id != here:
                    here, marked, copies = page_id, {}, {}
                if kind.as_py() == 0:
                    marked[digest.as_py()] = keeper.as_py()
                    continue
                body = body.as_py()
                own = digest.as_py()
                copy = copies[own] = copies.get(own, -1) + 1
                revisit = own in marked and (page_id != marked[own] or copy > 0)
                out.write(page_record(page_id, url.as_py(), body, copy, marked.get(own), revisit))
        out.close()
        yield pa.RecordBatch.from_pylist(out.rows, schema=_arrow())

    written = scratch.save(stream.mapInArrow(run, MANIFEST), "manifest")
    commit(written, root).write.json(f"{root}/manifest", mode="overwrite")
    scratch.drop("digests", "groups", "order", "manifest")
    _delete(spark, f"{root}/_temporary")
    return manifest(spark, root)


def _arrow() -> pa.Schema:
    kind = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kind[t]) for n, t in (x.split() for x in MANIFEST.split(", "))])


def _bounds(short: DataFrame, shards: int, scratch: Scratch):
    """A function from (id, digest) to the shard: the rows in that order are cut where their exact bytes reach a shard's
    share. Spark's range partitions, whose bounds come from a sample, only divide the work: where bytes add up to a
    multiple of the share doesn't depend on them."""
    order = short.select(F.coalesce("id", F.lit(LEAST)).alias("id"), F.coalesce("digest", F.lit("")).alias("digest"), (F.col("n") + 600).alias("n"))
    order = order.groupBy("id", "digest").agg(F.sum("n").alias("n"))  # rows that repeat an id and a payload stay together
    order = order.repartitionByRange(shards, "id", "digest").sortWithinPartitions("id", "digest")
    order = scratch.save(order.withColumn("part", F.spark_partition_id()), "order")
    parts = sorted(order.groupBy("part").agg(F.sum("n").alias("n")).collect())  # `shards` rows at most
    if not parts:
        return lambda *c: F.lit(0)
    before, total = {}, 0
    for r in parts:
        before[r.part], total = total, total + r.n
    start = F.element_at(F.create_map(*[F.lit(v) for p, n in before.items() for v in (p, n)]), F.col("part"))
    upto = start + F.sum("n").over(Window.partitionBy("part").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1))
    slot = lambda c: F.floor(F.coalesce(c, start).cast("double") * shards / total)
    cuts = order.withColumn("slot", slot(upto)).groupBy("slot").agg(F.min(F.struct("id", "digest")).alias("first"))
    cuts = sorted((r.first.id, r.first.digest) for r in cuts.collect())  # `shards` rows at most
    edges = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(d).alias("digest")) for i, d in cuts])
    key = lambda i, d: F.struct(F.coalesce(i, F.lit(LEAST)).alias("id"), F.coalesce(d, F.lit("")).alias("digest"))
    return lambda i, d: F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e <= key(i, d))) - 1).cast("int")


def commit(written: DataFrame, root: str) -> DataFrame:
    """Gives the files of `written` their final names; a file that has its name already is left as it is."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                old, new = f"{base}/{row['temporary']}", f"{base}/{row['name']}"
                if store.get_file_info(old).type != fs.FileType.NotFound:
                    store.move(old, new)
                elif store.get_file_info(new).size != row["bytes"]:
                    raise FileNotFoundError(f"{new}: neither it nor {old} is whole")
            yield batch

    return written.mapInArrow(run, MANIFEST)


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def manifest(spark, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def records(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a gzip WARC stream; one record is held at a time."""
    z, data = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal z
        while chunk := z.unused_data or raw.read(1 << 20):
            if z.eof:
                z = zlib.decompressobj(31)
            if out := z.decompress(chunk):
                data.extend(out)
                return True
        return False

    while data or more():
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a record's headers break off")
        lines = bytes(data[:end]).decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        size = int(headers["content-length"])
        del data[: end + 4]
        while len(data) < size + 4:
            if not more():
                raise ValueError("a record's block breaks off")
        block = bytes(data[:size])
        if data[size : size + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        del data[: size + 4]
        yield headers, block


READ = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(files: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """The pages in the files of a manifest, digests checked; a revisit's payload is null."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{base}/{row['name']}", compression=None) as raw:
                    for h, block in records(raw):
                        if h["warc-type"] == "warcinfo":
                            continue
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-block-digest"] != f"sha1:{base32_sha1(block)}" or h["warc-type"] == "response" and base32_sha1(payload) != digest:
                            raise ValueError(f"{row['name']}: a digest doesn't fit")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        own = payload if with_payload and h["warc-type"] == "response" else None
                        out.append((number("x-page-id"), h["warc-target-uri"], h["warc-type"], int(h["x-payload-length"]), digest, number("x-refers-to-page-id"), own))
                        held += 200 + len(own or b"")
                        if held > 8 << 20:
                            yield _rows(out)
                            out, held = [], 0
        yield _rows(out)

    return files.mapInArrow(run, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in READ.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[t]) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def query(spark, sf_dir: str) -> DataFrame:
    root = f"{shared_uri(spark)}/solvarium/warc-{uuid.uuid4().hex}"
    files = write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), root)
    n = files.count()
    back = read(files.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism))), root, with_payload=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT h, max(page_id) AS keeper FROM p GROUP BY h),
d AS (SELECT p.*, keeper, sha1(p.h) AS hex FROM p JOIN g USING (h)),
b AS (SELECT *, list_transform(range(0, 32), lambda i: CAST(substr(bits, i * 5 + 1, 5) AS VARCHAR)) AS fives
  FROM (SELECT *, CAST(unhex(hex) AS BIT)::VARCHAR AS bits FROM d))
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(fives, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * (f[1] = '1')::INT + 8 * (f[2] = '1')::INT + 4 * (f[3] = '1')::INT + 2 * (f[4] = '1')::INT + (f[5] = '1')::INT AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM b"""
