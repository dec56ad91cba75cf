"""Recursive chunking of documents, and the corpus of all chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.errors import DocumentIngestionError
from insightspark.functions.kinds import column
from insightspark.operators.batches import bounded_slices

CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
# Where a text is cut, best place first; the empty one cuts anywhere.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators=SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, trimmed, neighbours sharing at most ``overlap``.

    Pieces are spans of the text, so nothing is copied before a chunk is cut.
    """
    spans = _chunk_spans(text, 0, len(text), list(separators), size, overlap)
    return [chunk for start, end in spans if (chunk := text[start:end].strip())]


def _chunk_spans(text: str, start: int, end: int, separators: list[str], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    position = next((i for i, s in enumerate(separators) if not s or text.find(s, start, end) >= 0), None)
    if position is None:
        yield start, end
        return
    finer = separators[position + 1 :]
    short: list[tuple[int, int]] = []
    for piece in _pieces(text, start, end, separators[position]):
        if piece[1] - piece[0] < size:
            short.append(piece)
            continue
        yield from _packed(short, size, overlap)
        short = []
        if finer:
            yield from _chunk_spans(text, *piece, finer, size, overlap)
        else:
            yield piece
    yield from _packed(short, size, overlap)


def _pieces(text: str, start: int, end: int, separator: str) -> Iterator[tuple[int, int]]:
    """Spans between separators; a separator opens the span that follows it."""
    if not separator:
        yield from ((i, i + 1) for i in range(start, end))
        return
    opened = start
    cut = text.find(separator, start, end)
    while cut >= 0:
        if cut > opened:
            yield opened, cut
        opened = cut
        cut = text.find(separator, cut + len(separator), end)
    if end > opened:
        yield opened, end


def _packed(pieces: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Adjacent pieces joined while they fit; the next span restarts inside the last one."""
    first = 0
    for last in range(len(pieces)):
        stop = pieces[last][1]
        if last > first and stop - pieces[first][0] > size:
            held_until = pieces[last - 1][1]
            yield pieces[first][0], held_until
            while first < last and (held_until - pieces[first][0] > overlap or stop - pieces[first][0] > size):
                first += 1
    if pieces:
        yield pieces[first][0], pieces[-1][1]


def chunk_documents(
    documents: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: the other columns of ``documents``, ``chunk_idx``, ``chunk``.

    The packing of pieces is sequential within one document, so a small helper
    runs on slices of Arrow batches of about as many bytes, and gives a batch of
    chunks for each.  A document without text has no chunks.
    """
    rest = [c for c in documents.columns if c != text]
    schema = T.StructType(
        [*[documents.schema[c] for c in rest], T.StructField("chunk_idx", T.IntegerType()), T.StructField("chunk", T.StringType())]
    )
    names = [*rest, "chunk_idx", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded_slices(whole):
                chunks = [[] if x is None else split_text(x, size, overlap) for x in batch.column(len(rest)).to_pylist()]
                owner = pa.array([i for i, own in enumerate(chunks) for _ in own], pa.int64())
                number = pa.array([n for own in chunks for n in range(len(own))], pa.int32())
                texts = pa.array([x for own in chunks for x in own], pa.string())
                yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[:-1]], number, texts], names=names)

    return documents.select(*[column(c) for c in rest], column(text)).mapInArrow(run, schema)


def corpus(documents: DataFrame, text: str = "text", fail_fast: bool = True) -> tuple[DataFrame, DataFrame]:
    """(chunks, bad documents) of all loaded documents.

    A bad document has no text.  With ``fail_fast`` the first one found raises
    ``DocumentIngestionError``; otherwise they are only listed.  A corpus
    without any usable text has no chunks.  Order chunks by document and
    ``chunk_idx``.
    """
    bad = documents.where(F.col(text).isNull()).drop(text)
    if fail_fast:
        first = bad.first()
        if first is not None:
            raise DocumentIngestionError(f"Document could not be loaded: {first.asDict()}")
    return chunk_documents(documents.where(F.col(text).isNotNull()), text), bad
