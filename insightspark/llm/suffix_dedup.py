"""Removal of repeated byte strings with enhanced suffix arrays, over whole texts.

Every run of ``LENGTH`` bytes has an anchor, the place of its smallest hash of
``GRAM`` bytes, and equal runs have it at the same offset.  Neighbouring runs
with one anchor form a context; only its two hashes are shuffled:

1. Contexts that occur more than once are covered as a whole.
2. Anchors with different contexts are where repeats begin and end.  The bytes of
   these contexts are dealt out by anchor; a task sorts their suffixes and
   finds the maximal repeats by scanning the common-prefix tree.
3. Anchors with more than ``MOST`` different contexts, which would make a large group,
   are settled by counting their runs' 128-bit hashes instead.

Each byte of an occurrence of such a repeat is removed.

Defined cases: a null text is empty and keeps nothing; texts shorter than
``LENGTH`` are kept; matches never cross documents; a null doc_id is a document like any other; rows
that repeat doc_id and text are documents each, so they repeat each other; an
empty table gives none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch
from insightspark.llm.suffixes import covered, maximal_repeats
from insightspark.session import write_once

LENGTH = 200
GRAM = 64
MOST = 6_000
# Bytes of a text whose runs are looked at together, and of contexts sorted together.
CHUNK = 1 << 20
SORTED_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POSITION = np.uint64((1 << 24) - 1)
_KEYS = ["k1", "k2"]
_NO_ID = -(2**63)


class GramHasher:
    """Hashes of all substrings of ``gram`` bytes, from one running sum."""

    def __init__(self, gram: int):
        self.gram = gram
        self._powers = self._inverse = np.zeros(0, dtype=np.uint64)

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self._powers):
            size = max(n, 1 << 16)
            self._powers = np.cumprod(np.full(size, _BASE, dtype=np.uint64))
            self._inverse = np.cumprod(np.full(size, pow(_BASE, -1, 2**64), dtype=np.uint64))
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=sums[1:])
        h = (sums[self.gram :] - sums[: -self.gram]) * self._inverse[: n - self.gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def contexts(data: np.ndarray, hasher: GramHasher, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first byte, bytes) of each context of ``data``, which has at least ``length`` bytes.

    The minimum over a sliding window of hashes, its place in the low bits, comes
    from running minima over blocks from both sides.
    """
    h = hasher(data)
    width = length - hasher.gram + 1
    runs = len(data) - length + 1
    key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-len(key) % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:runs], ahead[width - 1 : width - 1 + runs]) & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return h[anchor[first]], first, np.diff(np.append(first, runs)) + length - 1


def _keyed(documents: DataFrame) -> DataFrame:
    """Documents with keys without nulls: the id and a hash of the text, so rows that share an id stay apart."""
    text = F.coalesce("text", F.lit(""))
    return documents.withColumn("k1", F.coalesce(F.col("doc_id"), F.lit(_NO_ID))).withColumn("k2", F.xxhash64(text, F.col("doc_id").isNull()))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def context_hashes(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """k1, k2, h (of the anchor), t (of the whole context), start, size, weight.

    A context that a document holds several times gives one row with their number as weight, and
    what all of them cover gives rows of weight 2 under a hash of their own.  So
    a line that fills long documents does not fill a task.
    """

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        hasher = GramHasher(gram)
        for whole in batches:
            for batch in pieces(whole):
                rows, hs, ts, starts, sizes = [], [], [], [], []
                for i, text in enumerate(batch.column(2).to_pylist()):
                    raw = _bytes(text)
                    for offset in range(0, len(raw) - length + 1, CHUNK):
                        part = raw[offset : offset + CHUNK + length - 1]
                        h, first, size = contexts(np.frombuffer(part, dtype=np.uint8), hasher, length)
                        digest = xxhash.xxh3_64_intdigest
                        ts += [digest(part[s : s + n]) for s, n in zip(first.tolist(), size.tolist())]
                        rows.append(np.full(len(h), i))
                        hs.append(h)
                        starts.append(first + offset)
                        sizes.append(size)
                if rows:
                    found = [np.concatenate(rows), np.concatenate(hs).view(np.int64), np.array(ts, dtype=np.uint64).view(np.int64)]
                    owner, *columns = _combined(*found, np.concatenate(starts), np.concatenate(sizes))
                    at = pa.array(owner)
                    yield record_batch(schema, [batch.column(0).take(at), batch.column(1).take(at), *columns])

    fields = "k1 bigint, k2 bigint, h bigint, t bigint, start bigint, size bigint, weight bigint"
    return map_arrow(keyed.select(*_KEYS, "text"), fields, run)


def _combined(owner: np.ndarray, h: np.ndarray, t: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows (owner, h, t, start, size, weight) with equal contexts of one owner counted together."""
    order = np.lexsort((start, t, h, owner))
    owner, h, t, start, size = (x[order] for x in (owner, h, t, start, size))
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
    group = np.cumsum(new) - 1
    weight = np.bincount(group)
    again = np.flatnonzero(weight[group] > 1)
    again = again[np.lexsort((start[again], owner[again]))]
    spans: list[list[int]] = []
    for o, a, b in zip(owner[again].tolist(), start[again].tolist(), (start + size)[again].tolist()):
        if spans and spans[-1][0] == o and a <= spans[-1][2]:
            spans[-1][2] = max(b, spans[-1][2])
        else:
            spans.append([o, a, b])
    table = np.array(spans, dtype=np.int64).reshape(-1, 3)
    own = h[again[:1]].repeat(len(table)) + (table[:, 0] * 2**40 + table[:, 1]) * np.int64(-7046029254386353131)
    return (
        np.concatenate([owner[new], table[:, 0]]), np.concatenate([h[new], own]), np.concatenate([t[new], own]),
        np.concatenate([start[new], table[:, 1]]), np.concatenate([size[new], table[:, 2] - table[:, 1]]),
        np.concatenate([weight, np.full(len(table), 2)]),
    )


def _context_bytes(chosen: DataFrame, keyed: DataFrame) -> DataFrame:
    """h, once, k1, k2, start, context: the bytes of chosen contexts, cut from their documents."""
    wanted = chosen.groupBy(*_KEYS).agg(F.collect_list(F.struct("h", "once", "start", "size")).alias("cuts"))
    rows = keyed.select(*_KEYS, "text").join(wanted, _KEYS).select(*_KEYS, "text", "cuts")

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole, 2 << 20):
                out = []
                for k1, k2, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                    raw = _bytes(text)
                    out += [(c["h"], c["once"], k1, k2, c["start"], raw[c["start"] : c["start"] + c["size"]]) for c in cuts]
                if out:
                    yield record_batch(schema, list(zip(*out)))

    return map_arrow(rows, "h bigint, once boolean, k1 bigint, k2 bigint, start bigint, context binary", run)


def _spans_by_suffixes(cut: DataFrame, length: int) -> DataFrame:
    """k1, k2, first, end of what repeats within contexts that occur once; anchors lie together in a task."""
    dealt = cut.repartition("h").sortWithinPartitions("h")

    def settle(rows: list[tuple]) -> list[tuple]:
        strings = [r[5] for r in rows]
        repeats, starts, left = maximal_repeats(strings, length)
        mask = covered(repeats, len(left))
        edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
        firsts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        owner = np.searchsorted(starts, firsts, side="right") - 1
        return [
            (rows[o][2], rows[o][3], int(rows[o][4] + a - starts[o]), int(rows[o][4] + b - starts[o]))
            for o, a, b in zip(owner.tolist(), firsts.tolist(), ends.tolist())
            if rows[o][1]
        ]

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SORTED_BYTES and row[0] != held[-1][0]:
                    if out := settle(held):
                        yield record_batch(schema, list(zip(*out)))
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held and (out := settle(held)):
            yield record_batch(schema, list(zip(*out)))

    return map_arrow(dealt, "k1 bigint, k2 bigint, first bigint, end bigint", run)


def _spans_by_counts(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many contexts: every run is a row of hashes, and hashes are counted."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole, 1 << 20):
                out = []
                for _, once, k1, k2, start, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    for s in range(len(raw) - length + 1):
                        digest = xxhash.xxh3_128_digest(raw[s : s + length])
                        low, high = np.frombuffer(digest, dtype=np.int64).tolist()
                        out.append((low, high, once, k1, k2, start + s))
                yield record_batch(schema, list(zip(*out)) if out else [[] for _ in schema])

    runs = map_arrow(cut, "low bigint, high bigint, once boolean, k1 bigint, k2 bigint, first bigint", run)
    runs = write_once(runs, "hot-runs")
    often = runs.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("low", "high")
    return runs.filter("once").join(often, ["low", "high"]).select(*_KEYS, "first", (F.col("first") + length).alias("end"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """k1, k2, first, end: byte spans that together are all that repeats.

    An anchor that a passage of very many documents shares has a row per document.  Anchors are counted by
    aggregations, which combine in each task, and met again by joins, whose hot keys AQE splits.
    """
    # Written, for the hashes of what a document covers several times follow its batch.
    hashes = write_once(context_hashes(keyed, length, gram), "hashes")
    anchors = hashes.groupBy("h").agg(F.sum("weight").alias("n"), (F.min("t") != F.max("t")).alias("split")).filter("n > 1")
    found = write_once(hashes.join(anchors.select("h", "split"), "h"), "contexts")
    span = [*_KEYS, F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("end")]
    # An anchor with one context occurs as often as that context; contexts of the others are counted.
    parted = found.filter("split")
    counted = write_once(
        parted.groupBy("h", "t").agg(F.min(F.struct(*_KEYS, "start", "size")).alias("one"), (F.sum("weight") == 1).alias("once")), "counted"
    )
    again = parted.join(counted.filter("NOT once").select("h", "t"), ["h", "t"])
    whole = found.filter("NOT split").select(*span).unionByName(again.select(*span))
    # One occurrence of each different context is enough to compare with.
    chosen = counted.select("h", "once", "one.*")
    sizes = write_once(chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("h"), "hot-anchors")
    if sizes.isEmpty():
        return whole.unionByName(_spans_by_suffixes(_context_bytes(chosen, keyed), length))
    cut = write_once(_context_bytes(chosen, keyed), "context-bytes")
    hot = cut.join(sizes, "h", "left_semi")
    cold = cut.join(sizes, "h", "left_anti")
    return whole.unionByName(_spans_by_suffixes(cold, length)).unionByName(_spans_by_counts(hot, length))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: overlapping and touching spans become one."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    ``kept_text`` holds the remaining bytes but for parts of characters that were cut.    The spans of one document meet in one row; their number is bounded by its length.
    """
    keyed = _keyed(documents.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]))
    spans = repeated_spans(keyed, length, gram, most)
    lists = spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    rest = [c for c in keep if c not in ("doc_id", "text")]
    rows = keyed.select(*_KEYS, "text", *rest).join(lists, _KEYS, "left").select("k1", "text", "spans", *rest)
    extra = [rows.schema[c] for c in rest]
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()), *extra, T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType()),
        ]
    )

    def run(batches: Batches, arrow: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole):
                out = []
                ids = [None if x == _NO_ID else x for x in batch.column(0).to_pylist()]
                for text, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    raw = _bytes(text)
                    cuts = merged([(s["first"], s["end"]) for s in spans_ or ()])
                    edges = [0, *(x for cut in cuts for x in cut), len(raw)]
                    left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(raw), len(raw) - len(left), len(cuts), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
                columns = list(zip(*out)) if out else [[]] * 5
                yield record_batch(arrow, [ids, *batch.columns[3:], *columns])

    return map_arrow(rows, schema, run)
