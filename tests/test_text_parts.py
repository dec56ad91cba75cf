"""Files in parts against the same files read whole."""

import os
import random
from urllib.parse import unquote

import pytest

from insightspark.errors import DocumentIngestionError
from insightspark.sources.text_documents import read_text_documents, read_text_parts

CASES = {
    "plain": b"one\ntwo\nthree",
    "ended": b"one\ntwo\n",
    "breaks": b"\n\n\n",
    "one break": b"\n",
    "carriage": b"a\r\nb\r\n\r\nc\rd",
    "marked": b"\xef\xbb\xbfone\ntwo",
    "marked and ended": b"\xef\xbb\xbfone\ntwo\n",
    "mark alone": b"\xef\xbb\xbf",
    "replacement": "a�b\n�\x10\n".encode(),
    "torn": b"caf\xc3\n\xa9 \xe2\x82\n\xac \xf0\x9f\x98\n\x80\xff\n",
    "long line": b"x" * 3000 + "\né€\U0001f600".encode() * 40,
    "empty": b"",
}


def written(tmp_path):
    rng = random.Random(2)
    words = ["wort", "été", "漢字", "\U0001f600", "", "a b"]
    for name, data in CASES.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    (tmp_path / "below").mkdir()
    big = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(2000))
    (tmp_path / "below" / "big.md").write_text(big, encoding="utf-8")
    return str(tmp_path)


def name(source_file):
    return os.path.basename(unquote(source_file))


@pytest.mark.parametrize("ranges, part_bytes", [(128 << 20, 16 << 20), (700, 90), (700, 1), (4096, 1000)])
def test_parts_joined_are_the_whole_text(spark, tmp_path, ranges, part_bytes):
    path, setting = written(tmp_path), "spark.sql.files.maxPartitionBytes"
    whole = {name(r.source_file): r.text for r in read_text_documents(spark, path).collect()}
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(ranges))
    try:
        parts = read_text_parts(spark, path, part_bytes)
        found = sorted((name(r.source_file), r.part, r.text) for r in parts.collect())
        tasks = parts.rdd.getNumPartitions()
    finally:
        spark.conf.set(setting, before)
    texts = {}
    for file, _, text in found:
        texts[file] = texts.get(file, "") + text
    assert len({(file, part) for file, part, _ in found}) == len(found)
    assert whole.pop("mark alone.txt") == "\ufeff"  # has no line, so no part
    assert texts == whole
    if part_bytes < 1000:
        big = [text for file, _, text in found if file.endswith("big.md")]
        assert len(big) > 100 and tasks > 20
        assert max(len(t.encode()) for t in big) < part_bytes + 700


def test_texts_are_not_shuffled(spark, tmp_path):
    plan = read_text_parts(spark, written(tmp_path))._jdf.queryExecution().executedPlan().toString()
    arrow = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in arrow[: arrow.index("FileScan")]


def test_a_missing_folder(spark, tmp_path):
    with pytest.raises(DocumentIngestionError):
        read_text_parts(spark, str(tmp_path / "absent"))
