"""Quality classifier: a generalised additive model with pairwise interactions over features of the text.

Cyclic boosting: in each round every feature in turn gets one shallow tree over its bins, fitted to the current gradient and
added to that feature's table; then the pairs of features that explain most of what is left get small trees over two
features. A score is the sum of looked-up table cells. The sample it learns from is bounded by a parameter; features are
made of the whole text of every row.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, text_batches

FEATURES = (
    "log_bytes", "word_bytes", "spaces", "lines", "digits", "upper", "beyond_ascii", "full_stops", "commas", "exclamations", "bars",
    "odd_signs", "other_signs", "distinct_words", "top_word", "repeats", "longest_word", "distinct_lines",
)
GROUPS = {"spaces": b" \t", "lines": b"\n", "digits": b"0123456789", "upper": bytes(range(65, 91)), "beyond_ascii": bytes(range(128, 256)), "full_stops": b".", "commas": b",", "exclamations": b"!", "bars": b"|", "odd_signs": b"%$#&*", "other_signs": b"+-/:;<=>?@[\\]^_`{}~()\"'"}
COUNTED = np.zeros((256, len(GROUPS)))
for _k, _of in enumerate(GROUPS.values()):
    COUNTED[list(_of), _k] = 1


def features(text: str) -> np.ndarray:
    """All FEATURES of a text; an empty one has zeros."""
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return np.zeros(len(FEATURES))
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ COUNTED / n
    words = data.split()
    k = max(len(words), 1)
    lines = data.split(b"\n")
    counts = Counter(words)
    again = sum(map(operator.eq, words, words[1:]))
    most, longest = max(counts.values(), default=0), max(map(len, counts), default=0)
    return np.array([np.log(n), sum(map(len, words)) / k, *shares, len(counts) / k, most / k, again / k, np.log1p(longest), len(set(lines)) / len(lines)])


@dataclass
class Model:
    """cuts: bin borders by feature; tables: one value for each bin; pairs: (i, j, coarse table)."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    def pair_bin(self, f: int, b: np.ndarray) -> np.ndarray:
        return b * self.coarse // (len(self.cuts[f]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = self.bias + sum(t[b[:, f]] for f, t in enumerate(self.tables))
        for i, j, t in self.pairs:
            total = total + t[self.pair_bin(i, b[:, i]), self.pair_bin(j, b[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    return g / (h + smooth)


def _tree(g: np.ndarray, h: np.ndarray, smooth: float) -> np.ndarray:
    """A tree of depth two over ordered bins with sums of gradients and hessians: values by bin."""

    def cut(lo: int, hi: int) -> int:
        a, c = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        gain = a**2 / (c + smooth) + (a[-1] - a) ** 2 / (c[-1] - c + smooth)
        return lo + int(np.argmax(gain)) + 1

    n = len(g)
    mid = cut(0, n)
    ends = sorted({0, cut(0, mid), mid, cut(mid, n) if mid < n else n, n})
    out = np.empty(n)
    for lo, hi in zip(ends, ends[1:], strict=False):
        out[lo:hi] = _leaf(g[lo:hi].sum(), h[lo:hi].sum(), smooth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """The best tree that cuts each of two features once: values by cell, and its gain."""
    a, c = (np.cumsum(np.cumsum(x, 0), 1) for x in (g, h))
    gain, parts = 0.0, []
    for s, t in ((a, c),):
        row_g, row_h, col_g, col_h = s[:, -1:], t[:, -1:], s[-1:, :], t[-1:, :]
        parts = [(s, t), (row_g - s, row_h - t), (col_g - s, col_h - t), (s[-1, -1] - row_g - col_g + s, t[-1, -1] - row_h - col_h + t)]
        gain = sum(x**2 / (y + smooth) for x, y in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    places = (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])
    for (x, y), at in zip(parts, places, strict=True):
        out[at] = _leaf(x[i, j], y[i, j], smooth)
    return out, float(gain[i, j] - a[-1, -1] ** 2 / (c[-1, -1] + smooth))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 8, rate: float = 0.15, smooth: float = 3.0) -> Model:
    """Learns from features x and labels y (0 or 1). No rows, or one label alone, give a model of its share (0.5 for none)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(y) else np.empty(0) for f in range(x.shape[1])]
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], [], coarse)
    if len(y) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    total = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            if len(t) < 2:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)), smooth)
            t += step
            total += step[b[:, f]]
    small = np.stack([model.pair_bin(f, b[:, f]) for f in range(x.shape[1])], axis=1)

    def cell_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        at = small[:, i] * coarse + small[:, j]
        return tuple(np.bincount(at, v, coarse * coarse).reshape(coarse, coarse) for v in slopes())

    found = sorted(((_quadrants(*cell_sums(i, j), smooth)[1], i, j) for i in range(x.shape[1]) for j in range(i)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((coarse, coarse))) for _, i, j in found]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            step = rate * _quadrants(*cell_sums(i, j), smooth)[0]
            t += step
            total += step[small[:, i], small[:, j]]
    for f, t in enumerate(model.tables):  # tables are centred, as their mean is part of the bias
        mean = float(np.average(t, weights=np.bincount(b[:, f], minlength=len(t))))
        t -= mean
        model.bias += mean
    return model


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from at most `sample` labelled rows that are not held out: those whose ids' hashes are smallest.

    An id with several labels counts with the smallest; null ids or labels are left out; of rows of docs that share an id
    all are used. The sample's ids, at most `sample` of them, are broadcast, so texts are not shuffled.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label"))
    chosen = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    met = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def run(batches):
        for b in batches:
            x = [features(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    got = sorted((tuple(r.x), r.label) for r in met.select("text", F.col("label").cast("int")).mapInArrow(run, "x array<double>, label int").collect())
    return fit(np.array([x for x, _ in got]).reshape(-1, len(FEATURES)), np.array([y for _, y in got], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", into: str = "score") -> DataFrame:
    """docs, all columns and rows, with the score (0 to 1, higher for label 1) in the column `into`, which gets a `_` if docs
    has it. Null and empty texts are scored by their features, zeros. No rows in, no rows out."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = fresh(docs, into)
    text_batches(docs.sparkSession)

    @F.pandas_udf("double")  # texts alone go to Python, and come back as a number
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(kept.value.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))))

    return docs.withColumn(name, of(F.col(text_col)))
