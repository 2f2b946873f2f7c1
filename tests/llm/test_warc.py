import base64
import gzip
import hashlib
import io
from collections import Counter

from pyspark.sql import functions as F

from solvarium.llm import warc

ROWS = [
    (1, "http://a/\r\nx", "<p>same</p>"),
    (2, "http://b", "<p>same</p>"),
    (3, None, "<p>ünï 日本</p>"),
    (4, "http://c", None),
    (5, "http://d", ""),
    (9, "http://e", "<p>same</p>"),
    (9, "http://e", "<p>same</p>"),
    (7, "http://f", "x" * 200_000),
    (None, "http://g", "<p>ünï 日本</p>"),
    (11, "http://h", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_query_equals_brute_force(spark, tmp_path):
    pages(spark).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in warc.query(spark, str(tmp_path)).collect())
    want = Counter()
    keeper, seen = {}, set()
    for i, _, h in ROWS:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    for i, _, h in ROWS:
        raw = (h or "").encode()
        first = i == keeper[h or ""] and h not in seen
        seen |= {h} if i == keeper[h or ""] else set()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want[i, len(raw), digest, "response" if first else "revisit", None if first else keeper[h or ""]] += 1
    assert got == want


def test_same_files_whatever_the_partitions(spark, tmp_path):
    rows = [(i, f"http://{i}", f"<p>{i % 50}</p>" * (i % 9)) for i in range(400)]
    said = []
    for k in (1, 5):
        files = warc.write(pages(spark, rows).repartition(k), f"file://{tmp_path}/w{k}", shards=3, roll_bytes=3000)
        said.append(sorted((r.name, r.sha1, r.bytes, r.records) for r in files.collect()))
    assert said[0] == said[1] and len(said[0]) > 5
    assert sum(r[3] for r in said[0]) == 400
    assert not (tmp_path / "w1/_temporary").exists()
    for name, sha1, size, n in said[0]:
        data = (tmp_path / "w1" / name).read_bytes()
        assert (hashlib.sha1(data).hexdigest(), len(data)) == (sha1, size)
        plain = gzip.decompress(data)
        assert plain.count(b"WARC/1.1\r\nWARC-Type: ") == n + 1
        ids = [h.get("x-page-id") for h, _ in warc.records(io.BytesIO(data))][1:]
        assert ids == sorted(ids, key=int)
    back = warc.read(warc.manifest(spark, f"file://{tmp_path}/w1"), f"file://{tmp_path}/w1").collect()
    assert {r.id: r.payload.decode() for r in back if r.payload is not None}.items() <= {i: h for i, _, h in rows}.items()


def test_commit_may_be_repeated(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    files = warc.write(pages(spark), root, shards=2)
    assert warc.commit(files, root).count() == files.count()


def test_least_size_and_empty_table(spark, tmp_path):
    files = warc.write(pages(spark), f"file://{tmp_path}/m", shards=2, revisit_from=12)
    back = warc.read(files, f"file://{tmp_path}/m").collect()
    assert {r.id for r in back if r.record_type == "revisit"} == {None}
    none = warc.write(pages(spark).limit(0), f"file://{tmp_path}/n")
    assert none.count() == 0 and warc.read(none, f"file://{tmp_path}/n").count() == 0


def test_shards_are_even_whatever_the_ids(spark, tmp_path):
    """One id far off, one id on a third of the rows, many null ids: no shard holds more than its share and one page."""
    rows = [(k, f"http://{k}", "x" * 500 + str(k)) for k in range(300)] + [(1 << 60, "http://far", "y")]
    rows += [(None, f"http://n{k}", "z" * 500 + str(k)) for k in range(200)] + [(150, f"http://s{k}", "w" * 500 + str(k)) for k in range(250)]
    files = warc.write(pages(spark, rows), f"file://{tmp_path}/s", shards=8).collect()
    by = Counter()
    for r in files:
        by[r.shard] += r.records
    assert len(by) == 8 and max(by.values()) <= len(rows) / 8 + 2
    back = warc.read(warc.manifest(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/s").collect()
    assert sorted((r.id is not None, r.id or 0, r.payload.decode()) for r in back) == sorted((i is not None, i or 0, h) for i, _, h in rows)
