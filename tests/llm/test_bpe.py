"""Byte-level BPE against tiktoken, decoding against Python's UTF-8."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from insightspark.llm import bpe
from insightspark.llm.queries import op12_bpe_transducer, public_ranks

ODD = [
    "", None, " ", "a", "  a \n\n b", "it's DON'T 12ab", "<|endoftext|>", "\x00\x01", "é ü ß", "日本語の文字", "🙂👍🏽 x", "a" * 5000, "ab" * 3000,
    "9" * 2000, " " * 700 + "x", "!?" * 900, "Zażółć gęślą", "न्तुम", "x \x1c y\x1d z \x85 a\xa0 b \u2003 c", " lead", "trail ", "a \n b  c", "\r\n \t x",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_ranks().file)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_ranks())


def test_ids_equal_the_librarys(encoder, library):
    for text in ODD:
        assert encoder.encode(text or "") == library.encode_ordinary(text or ""), repr((text or "")[:40])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcdeinrst", max_size=60), st.text("aàáâ", max_size=40)))
def test_any_text_goes_there_and_back(encoder, ranks, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text)
    assert bpe.Decoder(ranks).decode(ids) == text


def test_few_states_give_the_same_ids(library):
    small = bpe.Encoder(public_ranks(), states=3, words=2)
    for text in ["the transducer forgets everything again and again", "aaaaaaabababab" * 50, "日本語の文字"]:
        assert small.encode(text) == library.encode_ordinary(text)
        assert len(small.transducer._states) <= 4


def test_lookahead_is_bounded(encoder):
    """A long word's ids come out on the way: no state holds back more than a few."""
    encoder.encode("ab" * 4000 + "a" * 4000)
    assert max(len(ahead) for state in encoder.transducer._states for ahead in state[1::2]) <= 12


def small_vocabulary(seed: int) -> dict[bytes, int]:
    """Bytes of three letters and random products of earlier tokens: ranks in an order no training would give."""
    rng = random.Random(seed)
    tokens = [bytes([i]) for i in range(256)]
    letters = [b"a", b"b", b"c"]
    pool = list(letters)
    while len(pool) < 25:
        new = rng.choice(pool) + rng.choice(pool)
        if new not in pool and len(new) < 7:
            pool.append(new)
    rest = pool[3:]
    rng.shuffle(rest)
    return {token: rank for rank, token in enumerate(tokens + rest)}


@pytest.mark.parametrize("seed", range(12))
def test_ranks_in_any_order(seed):
    ranks = small_vocabulary(seed)
    library = tiktoken.Encoding("small", pat_str=r"[abc]+", mergeable_ranks=ranks, special_tokens={})
    transducer = bpe.Transducer(ranks)
    rng = random.Random(seed)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert transducer.encode(word.encode()) == library.encode_ordinary(word), word


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"\xf0", b"\x9f", b"\x99", b"\x82", b"\xe0", b"\xa0", b"\xed", b"a", b"\xc3", b"\xa9", b"\xff", b"\xf4", b"\x90"]), max_size=12), st.data())
def test_the_utf8_machine_is_pythons(parts, data):
    whole = b"".join(parts)
    machine, out, rest = bpe.Utf8Stream(), [], whole
    while rest:
        n = data.draw(st.integers(1, len(rest)))
        out.append(machine.feed(rest[:n]))
        rest = rest[n:]
        assert len(machine.held) <= 3
    out.append(machine.end())
    assert "".join(out) == whole.decode("utf-8", "replace")


def test_decoding_streams(encoder, ranks):
    text = "🙂 日本 é"
    single = [ranks[bytes([b])] for b in text.encode()]
    assert list(bpe.Decoder(ranks).stream(single)) == list(text)
    assert bpe.Decoder(ranks).decode(single[:2]) == "�"


def test_documents(spark, library):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(0, "again", 1), (None, "no id", 2), (0, "again", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    found = sorted(map(tuple, bpe.decode_documents(bpe.encode_documents(frame, public_ranks()), public_ranks()).collect()), key=repr)
    expected = [(i, library.encode_ordinary(t or ""), t or "") for i, t, _ in rows]
    assert found == sorted(expected, key=repr)
    both = bpe.encode_documents(frame, public_ranks(), decoded=True)
    assert sorted(map(tuple, both.collect()), key=repr) == found
    broken = spark.range(1).selectExpr("'a' AS doc_id", "CAST(X'61FF62' AS STRING) AS text")
    assert bpe.encode_documents(broken, public_ranks()).first()["ids"] == library.encode_ordinary("a�b")
    none = bpe.decode_documents(bpe.encode_documents(frame.limit(0), public_ranks()), public_ranks())
    assert none.count() == 0 and none.columns == ["doc_id", "ids", "text"]
    nulls = spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")
    assert bpe.decode_documents(nulls, public_ranks()).first()["text"] == ""


def test_query_on_whole_table(spark, library):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: tuple(r)[1:] for r in op12_bpe_transducer(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc_id] == (len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest())


def test_texts_side_by_side(ranks, library, monkeypatch):
    """Words of a batch share their reading, and no pair of tokens is judged twice."""
    asked = []
    follows = bpe.Transducer._follows
    monkeypatch.setattr(bpe.Transducer, "_follows", lambda self, *pair: asked.append(pair) or follows(self, *pair))
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("aeinrstäñ.,X🙂日", k=rng.randint(1, 12))) for _ in range(80)) for _ in range(60)]
    texts += [t or "" for t in ODD] + ["tail\n", "a b\n", "x" * 63 + " " + "y" * 64 + " " + "z" * 65, "a\x1c b \x85 c"]
    expected = [library.encode_ordinary(t) for t in texts]
    for states, words in ((bpe.STATES, bpe.WORDS), (3000, 50), (3, 2)):
        encoder = bpe.Encoder(public_ranks(), states=states, words=words)
        for _ in range(2):  # the second time from what is known
            del asked[:]
            found = encoder.encode_all(texts)
            assert [memoryview(x).cast("i").tolist() for x in found] == expected
            if states == bpe.STATES:
                assert len(asked) == len(set(asked))
        assert len(encoder.transducer._states) <= states + 1
    flat = np.frombuffer(b"".join(found), dtype=np.int32)
    offsets = np.cumsum([0, *map(len, expected)])
    assert bpe.Decoder(ranks).decode_all(flat, offsets).to_pylist() == texts
    parts = [[ranks[bytes([b])] for b in x] for x in ("é🙂 a".encode(), b"\xf0\x9f", b"\x9f a\xc3", b"", b"\xc3\xa9", b"\xe6a\xe6\xe6")]
    broken = np.array([i for x in parts for i in x], dtype=np.int32)
    texts = bpe.Decoder(ranks).decode_all(broken, np.cumsum([0, *map(len, parts)])).to_pylist()
    assert texts == ["é🙂 a", "�", "� a�", "", "é", "�a��"]


def test_states_hold_no_dead_ways(ranks, library):
    """A way at a node without longer tokens cannot go on, so no state keeps it; the walk over pieces judges as all pairs do."""
    encoder = bpe.Encoder(public_ranks())
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices(["er", "ung", "heit", "ä", "schl", "q", "ti"], k=rng.randint(1, 6))) for _ in range(60)) for _ in range(30)]
    texts += ["a  b c", "", "x\n y z"]
    found = encoder.encode_all(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in found] == [library.encode_ordinary(t) for t in texts]
    transducer = encoder.transducer
    longer = {key >> 8 for key in transducer._edges}
    assert all(node in longer for state in transducer._states for node in state[2::2])
    for pair, follows in transducer._pairs.items():
        if pair >= 0:
            both = [transducer._bytes[pair >> 32], transducer._bytes[pair & 0xFFFFFFFF]]
            assert follows == (bpe.merge_steps(b"".join(both), ranks)[0] == both)


def test_new_edges_do_not_copy_old_ones():
    edges = bpe._Edges()
    edges.add(np.arange(5000), list(range(5000)), [7] * 5000)
    before = edges.targets
    for i in range(5000, 6000):
        edges.add(np.array([i]), [i], [8])
    assert edges.targets is before
    found = edges.find(np.arange(6001))
    assert found[-1] == -1 and (edges.targets[found[:-1]] == np.arange(6000)).all() and (edges.emits[found[5000:-1]] == 8).all()


def test_lone_surrogates(encoder):
    assert encoder.encode_all(["a\ud800 b", "c  d", "e f"]) == [encoder.encode_all([x])[0] for x in ("a? b", "c  d", "e f")]
