"""CSV records with line breaks inside quotes, from files that are split over tasks.

What a line does to the quotes depends on whether it begins inside some: it has two
outcomes, one for each case.  Outcomes of lines compose to those of blocks, and blocks in the order of
their file tell how each begins.  Then every block makes its own records; the pieces of
a record that crosses blocks, two a block at most, are put together afterwards.

A quote counts where it begins a cell; other quotes, such as inch marks, are text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from insightspark.errors import DataIngestionError

# Outcomes: bit 0 is whether a line that begins outside ends inside quotes, bit 1 the same for one that begins inside.
_CLOSES, _SWAPS, _KEEPS, _OPENS = range(4)
_UNQUOTED, _QUOTED, _CLOSED, _AT_START = range(4)
_WHOLE, _HEAD, _TAIL, _MIDDLE = range(4)

Batches = Iterator[pa.RecordBatch]


def ends_inside(line: Column, begins_inside: bool) -> Column:
    """Whether a line that begins outside (inside) quotes ends inside some."""
    before = F.split(line, '"', -1)

    def quote(state: Column, text: Column) -> Column:
        """The state after a quote that follows ``text``."""
        return (
            F.when(state == _QUOTED, _CLOSED)
            .when(text.endswith(","), _QUOTED)
            .when((text == "") & state.isin(_CLOSED, _AT_START), _QUOTED)
            .otherwise(_UNQUOTED)
        )

    start = F.lit(_QUOTED if begins_inside else _AT_START)
    return F.aggregate(F.slice(before, F.lit(1), F.size(before) - 1), start, quote) == _QUOTED


def _outcome(line: Column) -> Column:
    both = ends_inside(line, False).cast("int") + 2 * ends_inside(line, True).cast("int")
    return F.when(line.contains('"'), both).otherwise(_KEEPS)


def _lines(spark: SparkSession, path) -> DataFrame:
    """file, block, outcome, value: the lines of a task are in the order of the file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), _outcome(F.col("value")).alias("outcome"), "value"
    )


def _states(outcomes: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each line ends inside quotes, if the first one begins so or not."""
    fixed = (outcomes == _CLOSES) | (outcomes == _OPENS)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(outcomes)), -1))
    swaps = np.cumsum(outcomes == _SWAPS)
    base = np.where(last >= 0, outcomes[last] == _OPENS, inside)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return base ^ (since % 2 == 1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batch by (file, block), in order."""
    blocks, files = batch.column(1).to_numpy(), batch.column(0).dictionary_encode()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        if end > start:
            yield files.dictionary[int(codes[start])].as_py(), int(blocks[start]), batch.slice(start, end - start)


def _compose(batches: Batches) -> Batches:
    """file, block, outcome of the whole block."""
    found: dict[tuple[str, int], list[bool]] = {}
    for batch in batches:
        for file, block, rows in _runs(batch):
            ends = found.setdefault((file, block), [False, True])
            outcomes = rows.column(2).to_numpy()
            for i, inside in enumerate(ends):
                ends[i] = bool(_states(outcomes, inside)[-1])
    names = list(found)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([f for f, _ in names], pa.string()),
            pa.array([b for _, b in names], pa.int64()),
            pa.array([int(x) + 2 * int(y) for x, y in found.values()], pa.int32()),
        ],
        names=["file", "block", "outcome"],
    )


class BlockStarts:
    """Per file, the blocks after which the quotes open or close."""

    def __init__(self, outcomes: list[tuple[str, int, int]]):
        self._changes: dict[str, tuple[list[int], list[bool]]] = {}
        for file, block, outcome in sorted(outcomes):
            blocks, states = self._changes.setdefault(file, ([], []))
            before = states[-1] if states else False
            after = bool(outcome >> int(before) & 1)
            if after != before:
                blocks.append(block)
                states.append(after)
        self.unclosed = sorted(f for f, (_, states) in self._changes.items() if states and states[-1])

    def inside(self, file: str, block: int) -> bool:
        blocks, states = self._changes.get(file, ([], []))
        at = bisect_left(blocks, block)
        return states[at - 1] if at else False

    @property
    def crossed(self) -> bool:
        """Whether any record crosses blocks."""
        return any(blocks for blocks, _ in self._changes.values())


class _Maker:
    """The records of one task's lines."""

    def __init__(self, starts: BlockStarts):
        self.starts = starts
        self.key: tuple[str, int] | None = None
        self.inside = False
        # Lines of a record that goes on, whether it began in an earlier block, and whether the file's first record came.
        self.open: list[str] = []
        self.earlier = False
        self.named = False
        self.out: list[tuple[str, int, int, bool, str]] = []

    def put(self, kind: int, text: str) -> None:
        if kind == _WHOLE and not text.strip():
            return
        file, block = self.key
        first = block == 0 and not self.named and kind in (_WHOLE, _HEAD)
        self.named = self.named or first
        self.out.append((file, block, kind, first, text))

    def end_block(self) -> None:
        if self.open:
            self.put(_MIDDLE if self.earlier else _HEAD, "\n".join(self.open))
        self.open = []

    def add(self, file: str, block: int, rows: pa.RecordBatch) -> None:
        if self.key != (file, block):
            self.end_block()
            self.key, self.named = (file, block), False
            self.inside = self.earlier = self.starts.inside(file, block)
        ends = _states(rows.column(2).to_numpy(), self.inside)
        lines = rows.column(3)
        firsts = np.flatnonzero(~np.concatenate([[self.inside], ends[:-1]]))
        self.inside = bool(ends[-1])
        head = int(firsts[0]) if len(firsts) else len(lines)
        self.open += lines.slice(0, head).to_pylist()
        if not len(firsts):
            return
        if self.open:
            self.put(_TAIL if self.earlier else _WHOLE, "\n".join(self.open))
        self.open, self.earlier = [], False
        # All records but one that goes on, joined at once.
        if self.inside:
            self.open = lines.slice(int(firsts[-1])).to_pylist()
            offsets = firsts
        else:
            offsets = np.append(firsts, len(lines))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines), "\n") if len(offsets) > 1 else []
        for text in joined:
            self.put(_WHOLE, text.as_py())

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * 5
        self.out = []
        types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "kind", "first", "record"])


def record_texts(spark: SparkSession, path) -> DataFrame:
    """file, first, record: the text of each record that is not blank; ``first`` marks a file's header.

    Raises ``DataIngestionError`` for a file that ends inside quotes.  The driver sees a number per block that holds
    quotes with line breaks, as it sees every block when it plans a scan.
    """
    lines = _lines(spark, path)
    changed = lines.where(F.col("outcome") != _KEEPS).select("file", "block", "outcome")
    starts = BlockStarts([tuple(r) for r in changed.mapInArrow(_compose, "file string, block bigint, outcome int").collect()])
    if starts.unclosed:
        raise DataIngestionError(f"Could not parse file: a quote is never closed in {', '.join(starts.unclosed[:5])}")

    def make(batches: Batches) -> Batches:
        maker = _Maker(starts)
        for batch in batches:
            for file, block, rows in _runs(batch):
                maker.add(file, block, rows)
            yield maker.taken()
        maker.end_block()
        yield maker.taken()

    made = lines.mapInArrow(make, "file string, block bigint, kind int, first boolean, record string")
    records = made.where(F.col("kind") == _WHOLE).select("file", "first", "record")
    if starts.crossed:
        # A tail comes before what else its block has.
        place = F.struct("block", F.when(F.col("kind") == _TAIL, 0).otherwise(1).alias("order"))
        pieces = made.where(F.col("kind") != _WHOLE).withColumn("place", place)
        number = F.count_if(F.col("kind") == _HEAD).over(Window.partitionBy("file").orderBy("place"))
        whole = (
            pieces.withColumn("number", number)
            .groupBy("file", "number")
            .agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("place", "record")))["record"].alias("parts"))
            .select("file", "first", F.array_join("parts", "\n").alias("record"))
        )
        records = records.unionByName(whole)
    bare = F.regexp_replace("record", r"\r\z", "")
    return records.select("file", "first", F.when(F.col("first"), F.regexp_replace(bare, "^\ufeff", "")).otherwise(bare).alias("record"))
