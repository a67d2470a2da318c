import base64
import gzip
import hashlib
import os

import pytest

from tickflow.llm import warc

PAGES = "page_id long, url string, html string, shard int"


def rows():
    out = [(i, f"http://x/{i}", "same" if i % 3 == 0 else f"page {i % 40}", 0) for i in range(0, 120)]
    return out + [(5000, None, None, 0), (5001, "u\r\nv", "", 0), (5002, "long", "é" * 100_000, 0), (None, "n", "no id", 0), (7, "again", "page 7", 0)]


def read(spark, where):
    return spark.createDataFrame([], "a int") if not where else warc.read_warc(spark, where)


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), PAGES)
    where = f"file://{tmp_path}/a"
    files = warc.write_warc(pages, where, min_shards=3, max_file_bytes=4000)
    assert len(files) > 3 and not [f for f in os.listdir(tmp_path / "a") if f.endswith(".tmp")]
    largest = {}
    for i, _, html, _ in rows():
        largest[html or ""] = max(largest.get(html or "", -1), -1 if i is None else i)
    got = read(spark, where).collect()
    assert len(got) == len(rows())
    by = {(i, u or ""): (h or "").encode() for i, u, h, _ in rows()}
    for r in got:
        payload = by[r.page_id, r.url.replace("%0D", "\r").replace("%0A", "\n")]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        first = largest[payload.decode()]
        own = r.page_id is None or r.page_id == first
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first))
        assert r.payload == (payload if own else None)


def test_same_bytes_from_any_partitions(spark, tmp_path):
    pages = spark.createDataFrame(rows(), PAGES)
    for name, n in (("a", 1), ("b", 7)):
        warc.write_warc(pages.repartition(n), f"file://{tmp_path}/{name}", min_shards=5)
    assert sorted(os.listdir(tmp_path / "a")) == sorted(os.listdir(tmp_path / "b"))
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in os.listdir(tmp_path / "a"))
    text = b"".join(gzip.open(tmp_path / "a" / f).read() for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert text.count(b"WARC/1.1\r\n") == len(rows())


def test_threshold_damage_and_empty(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "xx", 0), (2, "b", "xx", 0)], PAGES)
    warc.write_warc(pages, f"file://{tmp_path}/a", min_dedup_bytes=3)
    assert {r.record_type for r in warc.read_warc(spark, f"file://{tmp_path}/a").collect()} == {"response"}
    data = bytearray((tmp_path / "a" / os.listdir(tmp_path / "a")[0]).read_bytes())
    with pytest.raises(ValueError):
        list(warc.parse_file(bytes(data), "0" * 64))
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/b") == []
    assert warc.read_warc(spark, f"file://{tmp_path}/b").count() == 0


def test_ranges_of_sparse_and_repeated_ids(spark, tmp_path):
    noise = [hashlib.sha512(str(k).encode()).hexdigest() * 8 for k in range(900)]
    sparse = [(k * 10**15 + 7, f"s{k}", noise[k], 0) for k in range(300)]
    one = [(None if k % 2 else 5, f"o{k}", noise[k], 0) for k in range(300, 900)]
    pages = spark.createDataFrame(sparse + one, PAGES)
    where, limit = f"file://{tmp_path}/a", 1 << 16
    files = warc.write_warc(pages, where, shard_bytes=1 << 18, min_shards=1, max_file_bytes=limit)
    sizes = {f: os.path.getsize(tmp_path / "a" / f) for f in files}
    assert len(files) <= 2 * -(-sum(sizes.values()) // limit) and len({f.split("-")[1] for f in files}) >= 3
    got = warc.read_warc(spark, where).collect()
    assert sorted(r.url for r in got) == sorted(x[1] for x in sparse + one) and {r.record_type for r in got} == {"response"}
    held = [[r[0] if r[0] is not None else -(1 << 63) for r in warc.parse_file(d, hashlib.sha256(d).hexdigest())] for d in ((tmp_path / "a" / f).read_bytes() for f in sorted(files))]
    assert [x for part in held for x in part] == sorted(x for part in held for x in part)
