"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in Arrow batches.  Trees are fitted on a
bounded sample of labelled rows (``SAMPLE``), chosen by a hash of doc_id, and
flattened into arrays; a batch of documents walks all trees at once.

Defined cases: a null text counts as empty and gets a score like any other;
labels without a quality are not used, of several labels of one document the
largest counts; a null doc_id is never labelled and never held out; without any
usable label every score is 0.5; repeated rows each get a row; an empty table
gives none.  Inputs of a score are statistics of the text only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insightspark.llm.common import Batches, map_arrow, pieces, record_batch, texts_of

# Labelled rows a model is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5

STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "white", "line_ends", "marks", "symbols", "bars", "beyond_ascii",
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "distinct_lines", "line_length",
    "words_with_symbols", "sentence_ends", "sentence_length", "top_word",
)


def _byte_classes() -> np.ndarray:
    table = np.full(256, 7, dtype=np.uint8)  # 7: other symbols
    for first, last, kind in ((65, 90, 0), (97, 122, 1), (48, 57, 2), (128, 255, 8)):
        table[first : last + 1] = kind
    for chars, kind in ((b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".,;:?'\"-()", 5), (b"|", 6)):
        table[list(chars)] = kind
    return table


_CLASSES = _byte_classes()
_SYMBOLS = frozenset("!#$%&*+/<=>@[\\]^_`{|}~")


def document_statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(len(data), 1)
    kinds = np.bincount(_CLASSES[data], minlength=9) / n
    words = text.split()
    lines = [line for line in text.split("\n") if line]
    k = max(len(words), 1)
    lengths = list(map(len, words)) or [0]
    ends = sum(text.count(c) for c in ".?!")
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    odd = sum(c for word, c in counts.items() if not _SYMBOLS.isdisjoint(word))
    return [
        math.log1p(len(data)), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[7], kinds[6], kinds[8],
        math.log1p(len(words)), sum(lengths) / k, math.log1p(max(lengths)), len(counts) / k,
        len(set(zip(words, words[1:]))) / k, len(set(lines)) / max(len(lines), 1), math.log1p(n / max(len(lines), 1)),
        odd / k, ends / k, math.log1p(k / max(ends, 1)), max(counts.values(), default=0) / k,
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of equal depth as arrays: [tree, inner node] and [tree, leaf]."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities: every row walks all trees together, a level per step."""
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(rows), 1 / (1 + math.exp(-self.base)))
        each = np.arange(trees)[None, :]
        at = np.arange(len(rows))[:, None]
        node = np.zeros((len(rows), trees), dtype=np.int64)
        for _ in range(int(math.log2(inner + 1))):
            node = 2 * node + 1 + (rows[at, self.feature[each, node]] > self.threshold[each, node])
        total = self.base + self.leaf[each, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(
    rows: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, penalty: float = 1.0
) -> Trees:
    """Boosted trees on histograms of binned statistics, with the logistic loss."""
    if not len(labels):
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    base = math.log(share / (1 - share))
    width = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    total = np.full(len(labels), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = p - labels, p * (1 - p)
        node = np.zeros(len(labels), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            for f in range(width):
                place = local * bins + binned[:, f]
                g = np.bincount(place, gradient, count * bins).reshape(count, bins)
                h = np.bincount(place, curvature, count * bins).reshape(count, bins)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl**2 / (hl + penalty) + (ga - gl) ** 2 / (ha - hl + penalty) - ga**2 / (ha + penalty)
                gain = np.where((hl > 0.5) & (ha - hl > 0.5), gain, 0.0)[:, : len(edges[f])]
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                better = gain[np.arange(count), cut] > best
                best = np.where(better, gain[np.arange(count), cut], best)
                feature[t, first : first + count][better] = f
                threshold[t, first : first + count][better] = edges[f][cut][better]
            at = np.arange(len(labels))
            node = 2 * node + 1 + (rows[at, feature[t, node]] > threshold[t, node])
        local = node - inner
        g, h = np.bincount(local, gradient, inner + 1), np.bincount(local, curvature, inner + 1)
        leaf[t] = -rate * g / (h + penalty)
        total = total + leaf[t, local]
    return Trees(base, feature, threshold, leaf)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    usable = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
    )
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` short rows, so the broadcast is bounded.
    labelled = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names = ", ".join(f"{s} double" for s in STATISTICS)

    def run(batches: Batches, schema: pa.Schema) -> Batches:
        for batch in batches:
            rows = [document_statistics(x) for x in texts_of(batch.column(1))]
            yield record_batch(schema, [batch.column(0), batch.column(2), *zip(*rows)] if rows else [[] for _ in schema])

    measured = map_arrow(labelled, f"doc_id bigint, quality int, {names}", run).dropDuplicates(["doc_id"])
    table = measured.orderBy("doc_id").limit(sample).toPandas()
    return fit_trees(table[list(STATISTICS)].to_numpy(float), (table["quality"].to_numpy() > 0).astype(float))


def score_quality(documents: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with held_out, score and predicted; columns of these names are replaced."""
    own = [c for c in documents.columns if c not in ("held_out", "score", "predicted")]
    rows = documents.select(*[F.col(f"`{c}`") for c in own], held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([*rows.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    place = own.index("text")

    def run(batches: Batches, arrow: pa.Schema) -> Batches:
        for whole in batches:
            for batch in pieces(whole):
                stats = [document_statistics(x) for x in texts_of(batch.column(place))]
                score = trees.score(np.array(stats, dtype=float).reshape(len(stats), len(STATISTICS)))
                yield record_batch(arrow, [*batch.columns, score, (score >= threshold).astype(np.int32)])

    return map_arrow(rows, schema, run)
