"""WARC archives of web pages with dictionary compression, written and read by tasks.

Each archive starts with a Zstandard dictionary in a skippable frame; every
record after it is one frame of its own, compressed with that dictionary.  The
dictionary is built from records spread evenly over all of its archive.  Files
go to any store that ``pyarrow.fs`` knows; a task writes under a fresh name and
returns it, and the list of names is written by Spark, so files of lost or repeated
tasks are never read.

Defined cases: null html is an empty payload; a null url is left out; a null
page_id is left out and counts as the smallest; of several rows with equal payload and the same,
largest page_id one is the response and the others revisit it; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch
from insightspark.session import write_once

# A skippable frame that holds a dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
# Uncompressed bytes of one archive, and of the records its dictionary is built from.
ARCHIVE_BYTES = 48 << 20
TRAINING_BYTES = 6 << 20
SLICE_BYTES = 8 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_PAGES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def capture_plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex), head_id, head_url, revisit: what kind each record is.

    Payloads that occur once need no partner, so only those of several rows are written
    and joined; the join's plan follows from their written size.
    """
    rows = pages.select("page_id", "url", payload(F.col("html")).alias("payload")).withColumn(
        "digest", F.sha1("payload")
    )
    groups = (
        rows.groupBy("digest", "page_id").agg(F.max("url").alias("url"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest")
        .agg(F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "url", "n")).alias("head"), F.sum("n").alias("rows"))
    )
    heads = write_once(
        groups.filter("rows > 1").select(
            "digest",
            F.lit(True).alias("grouped"),
            F.col("head.page_id").alias("head_id"),
            F.col("head.url").alias("head_url"),
            F.col("head.n").alias("head_rows"),
        ),
        "warc-heads",
    )
    joined = rows.join(heads, "digest", "left")
    is_head = F.col("grouped").isNull() | F.col("page_id").eqNullSafe(F.col("head_id"))
    if heads.filter("head_rows > 1").isEmpty():
        return joined.withColumn("revisit", ~is_head)
    # Repeated rows: number those that tie, and no others.
    ties = is_head & (F.coalesce("head_rows", F.lit(1)) > 1)
    numbered = joined.filter(ties).withColumn(
        "revisit", F.row_number().over(Window.partitionBy("digest").orderBy(F.col("url").desc_nulls_last())) > 1
    )
    return joined.filter(~ties).withColumn("revisit", ~is_head).unionByName(numbered)


def base32_digest(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record_id(page_id: int | None, digest: str, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(_PAGES, f'{page_id}/{digest}/{extra}')}>"


def _header_value(value: object) -> str:
    """On one line: percent signs and control characters are written as %XX."""
    return re.sub(r"[%\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _parsed_value(value: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value)


def record_bytes(row: dict, name: str) -> bytes:
    """One WARC/1.1 record, head and block, of a row of ``capture_plan``."""
    body, digest = row["payload"], base32_digest(row["digest"])
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    revisit = row["revisit"]
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(row["page_id"], digest, name if revisit else "")),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", row["page_id"]),
        ("X-Payload-Length", len(body)),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(row["head_id"], digest)),
            ("WARC-Refers-To-Target-URI", row["head_url"]),
            ("X-Refers-To-Page-Id", row["head_id"]),
        ]
    block = head if revisit else head + body
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{k}: {_header_value(v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on slices from records all over the archive; of too few, the records themselves."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAINING_BYTES))
    slices = []
    for i, record in enumerate(records):
        parts = [record[k : k + SLICE_BYTES] for k in range(0, len(record), SLICE_BYTES)]
        slices += parts[i % step :: step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, slices, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(slices)[-DICTIONARY_BYTES:])


def archive_bytes(records: list[bytes]) -> bytes:
    dictionary = build_dictionary(records)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
    raw = dictionary.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(compress, records)])


def write_archives(plan: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``plan`` below ``folder``; returns the list of archives: path, records."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                out.write(archive_bytes(held))
            done = record_batch(schema, [[path.rsplit("/", 1)[1]], [len(held)]])
            held.clear()
            return done

        size = n = 0
        for whole in batches:
            for batch in pieces(whole):
                for row in batch.to_pylist():
                    record = record_bytes(row, f"{n}/{row['url']}")
                    n += 1
                    if held and size + len(record) > ARCHIVE_BYTES:
                        yield flush()
                        size = 0
                    held.append(record)
                    size += len(record)
        if held:
            yield flush()

    chosen = plan.select("page_id", "url", "payload", "digest", "head_id", "head_url", "revisit")
    return write_once(map_arrow(chosen, "path string, records bigint", run), "warc-list")


_HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def read_record(stream: io.BufferedIOBase) -> dict | None:
    """The next record of a decompressed stream as its fields and block."""
    if not stream.readline():
        return None
    fields = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, value = _HEADER.fullmatch(line).groups()
        fields[key.decode()] = _parsed_value(value.decode())
    fields["block"] = stream.read(int(fields["Content-Length"]))
    if stream.read(4) != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields


def read_archive(source) -> list:
    """Iterates over the records of an open archive, with its own dictionary."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame leads the archive")
    dictionary = zstandard.ZstdCompressionDict(source.read(size))
    plain = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(source, read_across_frames=True)
    stream = io.BufferedReader(plain, 1 << 20)
    while (record := read_record(stream)) is not None:
        yield record


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload).

    A response's payload is checked against its digest; that of a revisit is null.
    """
    fields = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, held, count = [], 0, 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for r in read_archive(source):
                        count += 1
                        kind, digest = r["WARC-Type"], r["WARC-Payload-Digest"].removeprefix("sha1:")
                        body = r["block"].split(b"\r\n\r\n", 1)[1] if kind == "response" else None
                        if body is not None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"{name}: the payload of {r['WARC-Record-ID']} does not match its digest")
                        out.append(
                            (
                                number(r.get("X-Page-Id")), int(r["X-Payload-Length"]), digest, kind,
                                number(r.get("X-Refers-To-Page-Id")), r.get("WARC-Target-URI"), body,
                            )[: len(schema)]
                        )
                        held += len(body or b"") if with_payload else 0
                        if held > (8 << 20) or len(out) >= 10_000:
                            yield record_batch(schema, list(zip(*out)))
                            out, held = [], 0
                if count != expected:
                    raise ValueError(f"{name}: {count} records instead of {expected}")
                if out:
                    yield record_batch(schema, list(zip(*out)))

    # A task per few archives: the list is short, but its files are large.
    spread = archives.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path")
    return map_arrow(spread, fields + (", payload binary" if with_payload else ""), run)
