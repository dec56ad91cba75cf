"""Packing by concatenate and cut: two passes of prefix sums and fixed windows.

The first pass tokenizes every text, once, and writes the ids with their place
in the partition.  Prefix sums over the partitions' totals give every document
its place in the one long row of ids, and the second pass cuts that row
at every multiple of the window.  Only the last sequence can be short.

Defined cases: a null text is empty and still has its end id; repeated rows and
null doc_ids are packed like any other; an empty table gives no piece; texts of
any length are cut over as many sequences as they need.
"""

from __future__ import annotations

import base64
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch, texts_of
from insightspark.session import shared_folder

WINDOW = 1024
END_ID = 0
# Bytes of text whose words are encoded together; their words, ids and places take about 15 times that.
BATCH_BYTES = 4 << 20


class Vocabulary(NamedTuple):
    """Paths of the ``tokenizers`` file and of the same vocabulary as ranks, and the pattern of the parts."""

    file: str
    ranks: str
    pattern: str


class IdEncoder:
    """Ids of whole texts by the vocabulary file of a ``tokenizers`` byte-level BPE.

    A blank before a visible character always starts a new part before the
    merges.  So where every blank is followed by one, the words of a batch are
    looked up among its distinct words, which are encoded once each, by
    ``tiktoken`` with the same vocabulary as ranks: the ids are equal and it
    takes a third of the time.  Other texts, and those that spell a special
    token, are encoded by ``tokenizers`` in one call.
    """

    _OTHER = re.compile(r"[ ]\s|[ ]\Z")

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self._special = [t.content for t in self._model.get_added_tokens_decoder().values()]
        self._opens = np.zeros(max(merges.values()) + 1, dtype=bool)
        self._opens[[rank for token, rank in merges.items() if token.startswith(b" ")]] = True

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self._model.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_blank(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of " word" for every word, and the number of ids of each."""
        step = max(1, int(len(words) * (64 << 10) / max(sum(map(len, words)), 1)))
        lines = [" " + " ".join(words[i : i + step]) for i in range(0, len(words), step)]
        ids = [np.array(self._fast.encode_ordinary(line), dtype="<u4") for line in lines]
        ids = np.concatenate(ids) if ids else np.zeros(0, dtype="<u4")
        first = np.flatnonzero(self._opens[ids])
        assert len(first) == len(words), "a word must open with a blank's token"
        return ids, np.diff(np.append(first, len(ids)))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, ``end_id`` after each, and the number of ids of each text."""
        odd = [i for i, x in enumerate(texts) if self._OTHER.search(x) or any(s in x for s in self._special)]
        alone = dict(zip(odd, self._each([texts[i] for i in odd])))
        split = pc.split_pattern(pa.array(["" if i in alone else x for i, x in enumerate(texts)], pa.string()), " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        firsts, place = np.unique(index[bounds[:-1]], return_inverse=True)
        rest = np.ones(len(index), dtype=bool)
        rest[bounds[:-1]] = False
        used, index[rest] = np.unique(index[rest], return_inverse=True)
        ids, lengths = self._after_blank([words[i] for i in used])
        # Table of entries: words after a blank, first words, texts encoded alone, the end.
        first_ids = self._each([words[i] for i in firsts])
        extra = [*first_ids, *alone.values(), np.array([end_id], dtype="<u4")]
        index[bounds[:-1]] = len(used) + place
        for n, i in enumerate(odd):
            index[bounds[i]] = len(used) + len(first_ids) + n
        table = np.concatenate([ids, *extra])
        lengths = np.concatenate([lengths, [len(x) for x in extra]]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        index = np.insert(index, bounds[1:], len(lengths) - 1)
        bounds = bounds + np.arange(len(bounds))
        each = lengths[index]
        upto = np.concatenate([[0], np.cumsum(each)])
        gathered = np.repeat(starts[index] - upto[:-1], each)
        gathered += np.arange(len(gathered))
        return table[gathered], np.diff(upto[bounds])


_ENCODERS: dict[Vocabulary, IdEncoder] = {}


def worker_encoder(vocabulary: Vocabulary) -> IdEncoder:
    """One encoder per Python worker, for later tasks too."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = IdEncoder(*vocabulary)
    return _ENCODERS[vocabulary]


def token_rows(batches: Batches, schema: pa.Schema, encoder: IdEncoder, part: int, end_id: int) -> Batches:
    """The rows of ``tokenized`` for one part, a little of the texts at a time."""
    before = 0
    for whole in batches:
        for batch in pieces(whole, BATCH_BYTES):
            ids, counts = encoder.encode(texts_of(batch.column(1)), end_id)
            upto = np.concatenate([[0], np.cumsum(counts)])
            packed = pa.Array.from_buffers(
                pa.binary(), len(counts), [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids)]
            )
            yield record_batch(schema, [batch.column(0), np.full(len(counts), part), before + upto[:-1], counts, packed])
            before += int(upto[-1])


def tokenized(documents: DataFrame, vocabulary: Vocabulary, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before (ids before the document in its part), doc_tokens, ids (32-bit, little-endian)."""

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        return token_rows(batches, schema, worker_encoder(vocabulary), TaskContext.get().partitionId(), end_id)

    return map_arrow(
        documents.select("doc_id", "text"), "doc_id bigint, part bigint, before bigint, doc_tokens bigint, ids binary", run
    )


def pack(documents: DataFrame, vocabulary: Vocabulary, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    The ids are written to the shared folder and read back.  The driver sees one
    total per task of the first pass, and sends the sums to the second.
    """
    spark = documents.sparkSession
    path = shared_folder(spark, "token-ids")
    tokenized(documents, vocabulary).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema("doc_id bigint, part bigint, before bigint, doc_tokens bigint, ids binary").parquet(path)
    totals = sorted((r.part, r.total) for r in rows.groupBy("part").agg(F.sum("doc_tokens").alias("total")).collect())
    sums = np.cumsum([0] + [total for _, total in totals])
    base = dict(zip([part for part, _ in totals], sums.tolist()))
    fields = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole):
                out = []
                for doc_id, part, before, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
                    place, start = base[part] + before, 0
                    while start < count:
                        sequence, offset = divmod(place + start, window)
                        length = min(window - offset, count - start)
                        piece = ids[4 * start : 4 * (start + length)]
                        out.append((doc_id, start, length, zlib.crc32(piece), count, sequence, offset, piece)[: len(schema)])
                        start += length
                yield record_batch(schema, list(zip(*out)) if out else [[] for _ in schema])

    return map_arrow(rows, fields + (", ids binary" if with_ids else ""), run)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, n_tokens, ids padded to ``window``.

    A sequence whose length is a power of two stays as it is.  At most
    ``window`` pieces meet in one row.
    """
    rows = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    joined = F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    pad = F.when(
        F.bit_count("n_tokens") == 1, F.lit(b"")
    ).otherwise(F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (window - F.col("n_tokens")).cast("int"))))
    return rows.select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"))
