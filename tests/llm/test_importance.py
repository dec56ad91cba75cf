"""Importance resampling against plain counting and sorting, and quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from insightspark.llm import importance
from insightspark.llm.queries import op11_importance_draw
from insightspark.llm.quickselect import kth_key, ranked


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def buckets_of(text):
    words = words_of(text)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return [zlib.crc32(g.encode()) % 10000 for g in grams]


def expected(rows, target, percent=5):
    """(doc_id, n_features, weight, score, rank) by sorting everything."""
    own, theirs = Counter(b for _, t in rows for b in buckets_of(t)), Counter(b for t in target for b in buckets_of(t))
    s, t = sum(own.values()), sum(theirs.values())
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in own}
    out = []
    for doc_id, text in rows:
        found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_moving_a_crc():
    rng = random.Random(1)
    for n in [0, 1, 2, 63, 64, 65, 127, 128, 1000, 4097, 70_000]:
        a, b = rng.randbytes(9), rng.randbytes(n)
        crc = importance.moved(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(crc) == zlib.crc32(a + b), n


ODD = ["", None, " ", "one", "One TWO", "é Ä ß ÄÄ x", "a" * 300 + " " + "b" * 70 + " c", "[x]{y}`z`@1/2:3", "\x00a\x7fb", "日本 語", "w " * 30]


def test_buckets_of_odd_texts():
    texts = [(t or "").encode() for t in ODD]
    grouped = {i: [] for i in range(len(ODD))}
    for _, owner, buckets in importance.features(texts):
        for i, b in zip(owner.tolist(), buckets.tolist()):
            grouped[i].append(b)
    for i, text in enumerate(ODD):
        assert sorted(grouped[i]) == sorted(buckets_of(text)), text


@pytest.mark.parametrize("run", [1, 7, 40])
def test_texts_cut_into_runs(monkeypatch, run):
    monkeypatch.setattr(importance, "_RUN", run)
    texts = ["the quick brown fox jumps over the lazy dog " * 5, "a bb ccc", "x", "", "longwordwithoutanyblank" * 4 + " y z"]
    got = Counter()
    words = Counter()
    for word_of, owner, buckets in importance.features([t.encode() for t in texts]):
        got.update(zip(owner.tolist(), buckets.tolist()))
        words.update(word_of.tolist())
    assert got == Counter((i, b) for i, t in enumerate(texts) for b in buckets_of(t))
    assert all(words[i] == len(words_of(t)) for i, t in enumerate(texts))


def test_defined_cases(spark):
    rng = random.Random(5)
    vocabulary = ["ja", "nein", "Wort", "tief", "Meer", "see", "42", "ó"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += list(enumerate(ODD)) + [(None, "see Meer " * 20), (None, "see Meer " * 20), (7, "tief " * 25), (7, "tief " * 25)] * 3
    target = ["see meer see meer tief", None, "", "Meer " * 40]
    frame = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id bigint, text string, score int, rank int, weight string").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 40, 100):
        assert found(importance.resample(frame, goal, percent)) == expected(rows, target, percent)
    assert importance.resample(frame.limit(0), goal).count() == 0
    assert found(importance.resample(frame.filter("doc_id < 5"), goal.limit(0))) == expected([r for r in rows if r[0] is not None and r[0] < 5], [])


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("text").collect()]
    assert found(op11_importance_draw(spark, folder)) == expected(rows, target)


@pytest.mark.parametrize("pivots", [1, 4])
def test_quickselect_is_sorting(spark, pivots):
    rng = random.Random(pivots)
    data = [(rng.randint(-3, 3), i) for i in range(300)]
    frame = spark.createDataFrame(data, "a bigint, b bigint").repartition(3)
    for k in (1, 2, 150, 299, 300):
        assert kth_key(frame, ["a", "b"], k, pivots) == sorted(data)[k - 1]
    assert kth_key(frame, ["a", "b"], 301, pivots) is None and kth_key(frame, ["a", "b"], 0, pivots) is None
    # Equal keys: the k-th of them is that key.
    assert kth_key(frame, ["a"], 5, pivots) == (sorted(data)[4][0],)


def test_ranks_over_ranges(spark):
    frame = spark.range(1000).selectExpr("-id AS a", "id AS b")
    assert [r["rank"] for r in ranked(frame, ["a"]).orderBy("a").collect()] == list(range(1, 1001))

