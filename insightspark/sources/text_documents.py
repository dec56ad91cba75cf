"""Plain-text and Markdown documents, one row per file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insightspark.errors import DocumentIngestionError
from insightspark.operators.batches import bounded_slices

# Bytes of one part of a file; a part ends with the line that reaches them.
PART_BYTES = 16 << 20

_REPLACEMENT = "\ufffd"
_ESCAPE = "\x10"


def read_text_documents(spark: SparkSession, path, recursive: bool = True) -> DataFrame:
    """(source_file, text) of every file below ``path``, whatever its suffix.

    Invalid UTF-8 bytes are dropped.  Spark spreads the files over tasks and
    reads each one whole, up to 2 GiB; ``read_text_parts`` reads larger ones.
    An empty file has no row, as it would have no chunks.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    try:
        files = reader.load(path)
    except AnalysisException as error:
        raise DocumentIngestionError(f"Document could not be loaded: {error}") from error
    return files.select(F.col("path").alias("source_file"), decode_ignoring_errors(F.col("content")).alias("text"))


def read_text_parts(spark: SparkSession, path, part_bytes: int = PART_BYTES, recursive: bool = True) -> DataFrame:
    """(source_file, part, text): files of any size in parts, which joined by ``part`` are the file's text.

    Spark splits the files into byte ranges, and a task cuts the lines of its ranges into parts
    of about ``part_bytes``; no text is shuffled.  Parts end before a line break, so no
    character is cut, and what is invalid is what is invalid in the whole file.  ``part`` grows along a file, with gaps.

    Reading by lines hides a byte order mark at the start and whether the last line ends with a break.  Both follow
    from the file's size and the sum of its lines, and come as parts of their own: the first one and the last one.
    Defined cases: a file that is empty, or a byte order mark alone, has no row; a line is in one part, however long, and must be below 2 GiB; a
    compressed file is decompressed, and whether its last line ends with a break is not known, so none is given.
    """
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", recursive)
    try:
        lines = reader.text(path)
    except AnalysisException as error:
        raise DocumentIngestionError(f"Document could not be loaded: {error}") from error
    source, size = F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_size").alias("size")
    block = F.col("_metadata.file_block_start").alias("block")
    content = lines.select(source, block, F.col("value").cast("binary").alias("line")).mapInArrow(
        _cut(part_bytes), "source_file string, part bigint, content binary"
    )
    hidden = F.first("size") - F.sum(F.octet_length("value") + 1)
    mark, end = F.when(hidden.isin(2, 3), F.struct(F.lit(-1).cast("long").alias("part"), F.lit("\ufeff").alias("text"))), F.when(
        hidden.isin(0, 3), F.struct(F.first("size").alias("part"), F.lit("\n").alias("text"))
    )
    edges = lines.select(source, size, "value").groupBy("source_file").agg(F.array_compact(F.array(mark, end)).alias("edges"))
    return content.select("source_file", "part", decode_ignoring_errors(F.col("content")).alias("text")).unionByName(
        edges.select("source_file", F.inline("edges"))
    )


def _cut(part_bytes: int):
    """Lines (file, block, line) to parts (file, part, content); the line break before a part is its first byte.

    A part's number is where its block starts plus its place there: a block of n bytes has at most n lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, number = None, [], 0, 0

        def part() -> pa.RecordBatch:
            before = b"" if at[1] + number == 0 else b"\n"
            columns = [pa.array([at[0]]), pa.array([at[1] + number]), pa.array([before + b"\n".join(held)], type=pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["source_file", "part", "content"])

        for whole in batches:
            for batch in bounded_slices(whole):
                for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                    if (file, block) != at:
                        if held:
                            yield part()
                        at, held, size, number = (file, block), [], 0, 0
                    held.append(line)
                    size += len(line) + 1
                    if size >= part_bytes:
                        yield part()
                        held, size, number = [], 0, number + 1
        if held:
            yield part()

    return run


def decode_ignoring_errors(content: Column) -> Column:
    """UTF-8 text without its invalid bytes.

    Spark replaces invalid bytes by U+FFFD.  Those that are really in the text
    are escaped first, so that only the replacements are removed.
    """
    raw = content.cast("string")
    escaped = _replace(_replace(raw, _ESCAPE, _ESCAPE + "a"), _REPLACEMENT, _ESCAPE + "b")
    valid = _replace(F.make_valid_utf8(escaped), _REPLACEMENT, "")
    return _replace(_replace(valid, _ESCAPE + "b", _REPLACEMENT), _ESCAPE + "a", _ESCAPE)


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))
