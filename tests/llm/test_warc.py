"""Archives: round trip, revisits, dictionary frame and single frames per record."""

import base64
import glob
import hashlib
import struct

import pytest
import zstandard

from insightspark.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string"


def model(rows):
    out, groups = [], {}
    for page_id, _, html, _ in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for body, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        ids.sort(key=lambda i: (i is None, -(i or 0)))
        out += [(i, len(body), digest, "revisit" if n else "response", ids[0] if n else None) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


def pages():
    rows = [(i, f"http://h{i % 3}/{i}", f"<p>page {i % 40} é</p>" * (i % 7), "clash") for i in range(150)]
    rows += [(200, None, None, None), (201, "http://x/\r\nWARC-Type: %41", "", None), (202, "u", "<p>" + "long " * 400_000, None)]
    rows += [(203, "u", "a\r\n\r\nb\r\n\r\n", None), (None, "n", "null id", None), (7, "second", "null id", None), (204, "z", "\0\x01", None)]
    rows += [(300, "a", "tie", None), (300, "b", "tie", None), (300, "b", "tie", None), (299, "c", "tie", None)]
    return rows


@pytest.fixture(scope="module")
def archived(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('warc')}"
    plan = warc.capture_plan(spark.createDataFrame(pages(), SCHEMA).repartition(3))
    return folder, warc.write_archives(plan, folder)


def test_round_trip(spark, archived):
    folder, archives = archived
    found = warc.read_archives(spark, archives, folder, with_payload=True).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=repr) == model(pages())
    whole = {r.page_id: r for r in found if r.record_type == "response"}
    for page_id, url, html, _ in pages():
        if page_id in whole and whole[page_id].url == url:
            assert bytes(whole[page_id].payload).decode() == (html or "")
    assert any(r.url == "http://x/\r\nWARC-Type: %41" for r in found)


def test_a_skippable_dictionary_leads_and_every_record_is_a_frame(archived):
    folder, archives = archived
    names = [r.path for r in archives.collect()]
    assert names and len(glob.glob(f"{folder.removeprefix('file://')}/*.warc.zst")) == len(names)
    for name in names:
        raw = open(f"{folder.removeprefix('file://')}/{name}", "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D and size > 0
        dictionary, rest = zstandard.ZstdCompressionDict(raw[8 : 8 + size]), raw[8 + size :]
        count = 0
        while rest:
            reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
            record = reader.decompress(rest)
            rest, count = reader.unused_data, count + 1
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert count == next(r.records for r in archives.collect() if r.path == name)


def test_the_dictionary_pays():
    records = [b"WARC/1.1\r\nA: %d\r\n\r\n<html><body class='page'><p>text %d</p></body></html>" % (i, i * 7) for i in range(3000)]
    alone = sum(len(zstandard.compress(r)) for r in records)
    assert len(warc.archive_bytes(records)) < 0.8 * alone


def test_changed_payload_is_noticed(spark, tmp_path):
    folder = f"file://{tmp_path}"
    plan = warc.capture_plan(spark.createDataFrame([(1, "u", "x" * 50, None)], SCHEMA))
    archives = warc.write_archives(plan, folder)
    name = archives.first().path
    record = warc.record_bytes({"page_id": 1, "url": "u", "payload": b"x" * 50, "digest": "00" * 20, "revisit": False}, "")
    (tmp_path / name).write_bytes(warc.archive_bytes([record]))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_archives(spark, archives, folder).collect()


def test_empty_table(spark, tmp_path):
    archives = warc.write_archives(warc.capture_plan(spark.createDataFrame([], SCHEMA)), f"file://{tmp_path}")
    assert warc.read_archives(spark, archives, f"file://{tmp_path}").collect() == []
