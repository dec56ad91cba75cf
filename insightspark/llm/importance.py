"""Importance resampling towards a target distribution of hashed word n-grams.

Every text is a bag of runs of one to three words, counted in buckets of their CRC-32.  The
bucket counts of all documents and of all target texts give a gain per bucket, an array; a
document's weight is the sum of its features' gains.  Weights with Gumbel noise from the
document's id are scores whose largest form a draw without replacement.  The k-th score is found by
distributed quickselect, and the winners alone are sorted and ranked.

A feature's CRC follows from those of its words: CRC-32 is linear, so the CRC of a string with another behind
it is the first one moved on by the other's length, by table, xor the other.  Each distinct word is hashed once a batch.

Defined cases: a null or empty text, and one without words, has no features, weight 0 and takes no part in the draw;
a null doc_id has the noise of ``42:`` and comes last among ties; repeated rows take part each, and of rows
that tie in score and doc_id those with fewer features go first, then any; an empty table gives none; a text is
cut for hashing at word borders, with two words carried over, so its length does not matter; without target texts all
gains follow from the documents alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch
from insightspark.llm.quickselect import at_most, kth_key, ranked
from insightspark.session import write_once

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
_BATCH = 4 << 20
# A text is hashed in runs of about so many bytes.
_RUN = 4 << 20
# Moves by fewer bytes come from one table.
_SHORT = 64

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _move_tables() -> np.ndarray:
    """[bytes, place, value]: a CRC's byte at a place, moved on by so many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    tables = np.zeros((_SHORT, 4, 256), dtype=np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _SHORT):
        before = tables[n - 1]
        tables[n] = (before >> 8) ^ step[before & 255]
    return tables


_MOVE = _move_tables()


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC moved on by so many bytes."""
    if len(by) and by.max() >= _SHORT:
        # By doubling: a move's square moves twice as far.
        out, rest, table = moved(crc, by % _SHORT), by // _SHORT, _MOVE[_SHORT - 1]
        table = _moved_once(_MOVE[1], table)
        while rest.any():
            out = np.where(rest & 1, _moved_once(table, out), out)
            table, rest = _moved_once(table, table), rest >> 1
        return out
    flat = _MOVE.reshape(-1)
    at = by.astype(np.int64) << 10
    out = flat[at + (crc & 255)]
    for place in (1, 2, 3):
        out ^= flat[at + (place << 8) + (crc >> np.uint32(8 * place) & 255)]
    return out


def _moved_once(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRCs moved by one [place, value] table."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def _runs(text: bytes) -> Iterator[bytes]:
    """A text in runs that end between words."""
    start = 0
    while start < len(text):
        end = start + _RUN
        if end < len(text):
            step = 1 << 16
            while True:
                gap = np.flatnonzero(~_WORD[np.frombuffer(text[end : end + step], dtype=np.uint8)])
                end = end + int(gap[0]) if len(gap) else min(end + step, len(text))
                if len(gap) or end == len(text):
                    break
        yield text[start:end]
        start = end
    if not text:
        yield text


class Words:
    """Words in a row: their CRCs alone and with a blank behind, their bytes, and the texts they are of."""

    def __init__(self, crc: np.ndarray, spaced: np.ndarray, length: np.ndarray, owner: np.ndarray):
        self.crc, self.spaced, self.length, self.owner = crc, spaced, length, owner

    @classmethod
    def of(cls, texts: list[bytes], numbers: np.ndarray) -> Words:
        data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        inside = _WORD[data]
        edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        length = ends - starts
        offsets = np.concatenate([[0], np.cumsum(length)])
        rows = pa.Array.from_buffers(
            pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[inside]))]
        ).dictionary_encode()
        distinct = rows.dictionary.to_pylist()
        at = rows.indices.to_numpy()
        crc = np.fromiter((zlib.crc32(w) for w in distinct), dtype=np.uint32, count=len(distinct))[at]
        spaced = np.fromiter((zlib.crc32(w + b" ") for w in distinct), dtype=np.uint32, count=len(distinct))[at]
        borders = np.cumsum([len(x) + 1 for x in texts])
        return cls(crc, spaced, length, numbers[np.searchsorted(borders, starts, side="right")])

    def after(self, other: Words | None) -> tuple[Words, int]:
        """These words behind the last two of ``other``, and how many those are."""
        if other is None:
            return self, 0
        columns = [np.concatenate([y[-2:], x]) for x, y in zip(self._columns(), other._columns())]
        return Words(*columns), min(2, len(other.owner))

    def _columns(self) -> tuple[np.ndarray, ...]:
        return self.crc, self.spaced, self.length, self.owner

    def runs(self, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, CRC) of every run of one to three words of a text that ends behind the first ``skip`` words."""
        one, two, three = self.owner[skip:], slice(max(skip - 1, 0), None), slice(max(skip - 2, 0), None)
        spaced_pair = moved(self.spaced[:-1], self.length[1:] + 1) ^ self.spaced[1:]
        pair = moved(self.spaced[:-1], self.length[1:]) ^ self.crc[1:]
        triple = moved(spaced_pair[:-1], self.length[2:]) ^ self.crc[2:]
        same_pair, same_triple = self.owner[1:] == self.owner[:-1], self.owner[2:] == self.owner[:-2]
        owners = [one, self.owner[1:][two][same_pair[two]], self.owner[2:][three][same_triple[three]]]
        crcs = [self.crc[skip:], pair[two][same_pair[two]], triple[three][same_triple[three]]]
        return np.concatenate(owners), np.concatenate(crcs)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each word, text of each feature, bucket of each feature) for all texts, a few MB at a time."""
    short = [i for i, x in enumerate(texts) if len(x) <= _RUN]
    sizes = np.cumsum([len(texts[i]) for i in short])
    groups = np.split(np.array(short, dtype=np.int64), np.flatnonzero(np.diff(sizes // _RUN)) + 1)
    for group in groups:
        words = Words.of([texts[i] for i in group], group)
        owner, crc = words.runs(0)
        yield words.owner, owner, (crc % np.uint32(BUCKETS)).astype(np.int64)
    for number in (i for i, x in enumerate(texts) if len(x) > _RUN):
        before = None
        for run in _runs(texts[number]):
            own = Words.of([run], np.array([number]))
            words, skip = own.after(before)
            owner, crc = words.runs(skip)
            yield own.owner, owner, (crc % np.uint32(BUCKETS)).astype(np.int64)
            before = words


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall in each bucket.  A task sends one row per bucket it has."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                for _, _, buckets in features(_bytes_of(batch.column(0))):
                    total += np.bincount(buckets, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield record_batch(schema, [there, total[there]])

    counted = map_arrow(texts.select(F.col("text").cast("binary")), "bucket bigint, n bigint", run)
    out = np.zeros(BUCKETS, dtype=np.int64)
    # The driver sees a row per bucket, a fixed number.
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains_of(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln(target share / own share)), both smoothed by one."""
    s, t = int(own.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((b + 1) * (s + BUCKETS)) / float((a + 1) * (t + BUCKETS))))
            for a, b in zip(own.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def weighed(documents: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole, _BATCH):
                n = batch.num_rows
                words, counts, sums = (np.zeros(n, dtype=np.int64) for _ in range(3))
                for word_of, owner, buckets in features(_bytes_of(batch.column(1))):
                    words += np.bincount(word_of, minlength=n)
                    counts += np.bincount(owner, minlength=n)
                    # Sums of whole numbers, exact in doubles.
                    sums += np.bincount(owner, weights=gains[buckets], minlength=n).astype(np.int64)
                yield record_batch(schema, [batch.column(0), words, counts, sums])

    return map_arrow(
        documents.select("doc_id", F.col("text").cast("binary")), "doc_id bigint, n_words bigint, n_features bigint, weight bigint", run
    )


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn): one row per document.

    Of the N documents with at least ``least_words`` words floor(percent N / 100) are drawn.
    """
    gains = gains_of(bucket_counts(documents), bucket_counts(target))
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weighed(documents, gains).withColumn("score", F.col("weight") + noise)
    # Keys ascend, so the largest score is first; numbering rows tells repeated ones apart.
    keys = ["_score", "_no_id", "_id", "n_features", "_row"]
    rows = write_once(
        scored.withColumns(
            {
                "_score": -F.col("score"),
                "_no_id": F.col("doc_id").isNull().cast("bigint"),
                "_id": F.coalesce("doc_id", F.lit(0).cast("bigint")),
                "_row": F.monotonically_increasing_id(),
            }
        ),
        "importance-scores",
    )
    fit = F.col("n_words") >= least_words
    k = percent * rows.filter(fit).count() // 100
    last = kth_key(rows.filter(fit), keys, k)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    drawn = fit & at_most(keys, last)
    losers = rows.filter(~drawn).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked(rows.filter(drawn), keys).select(*columns, "rank").unionByName(losers)
