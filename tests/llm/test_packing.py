"""Packing against the tokenizer itself."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from insightspark.llm import packing
from insightspark.llm.queries import public_vocabulary

TEXTS = [
    "", None, " ", "a", " a", "a  b", "a \nb", "a\n b", "a\t b", "\n", "a ", "<|endoftext|>x y", "it's  don't 12 ab12 é ü  x",
    "a b c  d", "x\x1c y \x1c z", "a\r\n b  c   d", "Ġx Ġ ĠĠ a", "a\n\n\n b", "é  b  c", "x　 y", "word " * 4000 + "end",
    "Ta, te-ti; to!! tu %%% 4026083977531332 thön | er", "bëta gamła", "\U0001f600 \U0001f600\U0001f600 x",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_tokenizers(tokenizer):
    encoder = packing.IdEncoder(*public_vocabulary())
    texts = [t or "" for t in TEXTS]
    ids, counts = encoder.encode(texts, 0)
    ends = np.cumsum(counts)
    for text, end, count in zip(texts, ends, counts):
        assert ids[end - count : end].tolist() == ids_of(tokenizer, text), repr(text[:50])
    assert encoder.encode([""], 5)[0].tolist() == [5]


def test_real_texts(spark, tokenizer):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text for r in rows]
    ids, counts = packing.IdEncoder(*public_vocabulary()).encode(texts, 0)
    assert ids.tolist() == [i for t in texts for i in ids_of(tokenizer, t)] and counts.sum() == len(ids)


@pytest.mark.parametrize("parts", [1, 4])
def test_pieces_are_gapless(spark, tokenizer, parts):
    rows = [(i if i != 3 else None, t, "clash") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(parts)
    found = packing.pack(frame, public_vocabulary(), window=64, with_ids=True)
    pieces = sorted(found.collect(), key=lambda r: (r.sequence_id, r.offset))
    place = 0
    for r in pieces:
        assert divmod(place, 64) == (r.sequence_id, r.offset) and 0 < r.length <= 64 - r.offset
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        place += r.length
    joined = sorted(b for b in split_documents(pieces))
    assert joined == sorted((r[0] if r[0] is not None else -1, ids_of(tokenizer, r[1])) for r in rows)
    whole = packing.sequences(found, 64).orderBy("sequence_id").collect()
    assert [len(s.ids) // 4 for s in whole[:-1]] == [64] * (len(whole) - 1)
    last = place % 64 or 64
    assert len(whole[-1].ids) // 4 == (last if last & (last - 1) == 0 else 64)


def split_documents(pieces):
    ids = []
    for r in pieces:
        assert r.start == len(ids)
        ids += np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        if len(ids) == r.doc_tokens:
            yield (r.doc_id if r.doc_id is not None else -1, ids)
            ids = []
    assert not ids


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), public_vocabulary()).collect() == []


def test_a_batch_takes_little_memory():
    """A task's memory does not follow the size of Spark's batches."""
    rng = random.Random(3)
    some = ["".join(rng.choices("aeinrst", k=5)) for _ in range(20_000)]
    texts = [" ".join(rng.choices(some, k=500)) for _ in range(8000)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(texts)], names=["doc_id", "text"])
    assert whole.nbytes > 23e6
    kinds = {"doc_id": pa.int64(), "part": pa.int64(), "before": pa.int64(), "doc_tokens": pa.int64(), "ids": pa.binary()}
    encoder, held = packing.worker_encoder(public_vocabulary()), 0
    assert packing.worker_encoder(public_vocabulary()) is encoder
    tracemalloc.start()
    for batch in packing.token_rows(iter([whole]), pa.schema(kinds), encoder, 2, 0):
        ids, counts = np.frombuffer(batch["ids"].buffers()[2], "<u4"), batch["doc_tokens"].to_numpy()
        assert batch["before"][0].as_py() == held and batch["part"][0].as_py() == 2 and len(ids) == counts.sum()
        held += len(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
