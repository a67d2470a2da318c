import zipfile
import zlib

import pytest

from tickflow.llm import media, queries


def test_png_round_trip():
    for payload in (b"", b"x", bytes(range(256)) * 3, b"long " * 50_000):
        assert media.from_png(media.to_png(media.pad(payload))).tobytes() == media.pad(payload)


def test_rows(spark, tmp_path):
    texts = [None, "", "a", "é" * 96, "z" * 192, "long " * 60_000, "a"]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = queries.media_digests(docs, f"file://{tmp_path}").collect()
    assert len(got) == len(texts)
    for r in got:
        raw = media.pad((texts[r.doc_id or 0] or "").encode())
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id or 0] or "").encode()), len(raw))
        assert r.tail_crc32 == zlib.crc32(raw[-16:])
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (2, 6)}) == 1


def test_small_ranges_and_empty(spark, tmp_path):
    docs = spark.createDataFrame([(i, b"%d" % i * 400) for i in range(200)], "doc_id long, payload binary")
    where = f"file://{tmp_path}/a"
    media.write_archives(docs, where, archive_bytes=5000)
    spark.dataSource.register(media.ArchiveSource)
    rows = spark.read.format("media_archive").option("range_bytes", 700).option("batch_bytes", 300).load(where)
    assert sorted(r.doc_id for r in rows.collect()) == list(range(200))
    assert media.write_archives(docs.limit(0), f"file://{tmp_path}/b") == 0
    assert media.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_member_is_read_again(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m", b"data")
    info, calls = zipfile.ZipFile(tmp_path / "a.zip").infolist()[0], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("gone")
        return open(tmp_path / "a.zip", "rb")

    assert media.read_member(flaky, info, wait=0) == b"data"
    info.CRC += 1
    with pytest.raises(ValueError):
        media.read_member(lambda: open(tmp_path / "a.zip", "rb"), info, wait=0)
