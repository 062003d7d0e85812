"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

An n-gram is a run of letters and single spaces of the lower-cased text; it is known by its hash bucket. First every bucket's
documents are counted by label over the sample, in the tasks and by one aggregate; the log of the ratio of the two smoothed
shares scales the bucket's presence in a text. Buckets that say next to nothing are left out. Then a ridge logistic regression is fitted
to the scaled features. Learning is bounded by `sample` and `bits`; scores are made of the whole text of every row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh
from tidemark.llm.quality import held_out

SIZES = (3, 4, 5)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Code points of texts that are hashed at once; a longer text is hashed alone.
AT_ONCE = 1 << 16


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, with one space before and after each word, and each one's row. All that are no
    letters are spaces."""
    spaced = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "replace"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in spaced])
    letter = letter_table()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    keep[:1] = True
    return np.where(letter, points, 32)[keep].astype(np.uint64), row[keep]


def buckets(texts: list[str], bits: int, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of each text, with repeats; with `kept`, only of buckets whose mark is set."""
    points, row = letters(texts)
    hashed = points * MIX
    rolling, rows, found = hashed, [row[:0]], [row[:0]]
    for n in range(2, max(SIZES) + 1):
        if len(points) < n:
            break
        rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint64(29))) * MIX + hashed[n - 1 :]
        if n in SIZES:
            bucket = ((rolling * MIX) >> np.uint64(64 - bits)).astype(np.int32)
            start = np.arange(len(bucket)) if kept is None else np.flatnonzero(kept[bucket])
            start = start[row[start] == row[start + n - 1]]  # no n-gram goes over to the next text
            rows.append(row[start])
            found.append(bucket[start])
    return np.concatenate(rows), np.concatenate(found)


def parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about AT_ONCE code points, each text whole."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def present(texts: list[str | None], bits: int, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) once for each text that has a bucket whose mark in `kept` is set, sorted."""
    out = [np.empty(0, np.int64)]
    for a, b in parts(texts):
        row, bucket = buckets([t or "" for t in texts[a:b]], bits, kept)
        out.append(np.unique(((row.astype(np.int64) + a) << bits) | bucket))
    both = np.concatenate(out)
    return both >> bits, both & ((1 << bits) - 1)


def count_texts(texts: list[str | None], labels: list[int], sums: np.ndarray, bits: int) -> None:
    """Adds one to sums[label, bucket] for each text that has the bucket."""
    last = np.zeros(1 << bits, np.int32)
    for t, y in zip(texts, labels, strict=True):
        bucket = buckets([t or ""], bits)[1]
        place = np.arange(len(bucket), dtype=np.int32)
        last[bucket] = place
        sums[y, bucket[last[bucket] == place]] += 1  # each bucket once: where it was put last


@dataclass
class Model:
    """weights: one for each bucket, 0 where it is left out; marks: where they are not 0."""

    bits: int
    bias: float
    weights: np.ndarray
    marks: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, bucket = present(texts, self.bits, self.marks)
        total = self.bias + np.bincount(row, self.weights[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def log_ratios(pos: np.ndarray, neg: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """The log of the ratio of smoothed shares of both labels, for the counts of all buckets that occur."""
    return np.log((pos + smooth) / (pos + smooth).sum()) - np.log((neg + smooth) / (neg + smooth).sum())


def regress(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, n_cols: int, ridge: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of least mean log loss plus half of ridge times the squared weights: accelerated gradient steps, each
    column with a step of its own that cannot overshoot. Both labels weigh the same in all."""
    n, share = len(y), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    reach = (np.bincount(row, np.abs(x), n) + 1) * weight  # of each row, with the bias
    rate = 1 / (np.bincount(col, np.abs(x) * reach[row], n_cols) / (4 * n) + ridge)
    bias_rate = 4 * n / reach.sum()
    w, ahead, bias, bias_ahead, t = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0, 1.0
    for _ in range(steps):
        total = np.bincount(row, x * ahead[col], n) + bias_ahead
        off = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y) * weight
        new = ahead - rate * (np.bincount(col, x * off[row], n_cols) / n + ridge * ahead)
        new_bias = bias_ahead - bias_rate * off.mean()
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        push = (before - 1) / t
        ahead, bias_ahead, w, bias = new + push * (new - w), new_bias + push * (new_bias - bias), new, new_bias
    return w, bias


def train(
    docs: DataFrame, labels: DataFrame, sample: int = 20_000, bits: int = 21, least_docs: int = 5, least_ratio: float = 1.0, ridge: float = 1e-2,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Learns from at most `sample` labelled rows that are not held out: those whose ids' hashes are smallest.

    An id with several labels counts with the largest; null ids or labels are left out; of rows of docs that share an id all
    are used; null texts are empty. As toxic texts are
    few, both labels weigh the same in the fit, so a score is no share of texts. Kept are buckets in at least `least_docs` texts whose log-count ratio is at least `least_ratio`
    away from 0; there are 2 ** bits buckets at most. With no rows every score is 0.25, with one label alone its smoothed share.
    The sample's ids are broadcast, so texts are not shuffled.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    chosen = rows.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    met = (
        docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", (F.col("label") > 0).cast("int").alias("label"))
    )

    def counted(batches):
        sums = np.zeros((2, 1 << bits), np.int32)
        seen = np.zeros(2, np.int64)
        for b in batches:
            y = b.column(1).to_pylist()
            count_texts(b.column(0).to_pylist(), y, sums, bits)
            seen += np.bincount(y, minlength=2)
        some = np.flatnonzero(sums.any(0))
        columns = [np.r_[-1, some].astype(np.int32), np.r_[seen[1], sums[1][some]].astype(np.int64), np.r_[seen[0], sums[0][some]].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "pos", "neg"])

    summed = met.mapInArrow(counted, "bucket int, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    bucket, pos, neg = (c.to_numpy() for c in summed.orderBy("bucket").toArrow().columns)
    texts = bucket < 0  # the row that has the numbers of texts
    n_pos, n_neg = int(pos[texts].sum()), int(neg[texts].sum())
    share = (n_pos + 0.5) / (n_pos + n_neg + 2)
    model = Model(bits, float(np.log(share / (1 - share))), np.zeros(1 << bits, np.float32), np.zeros(1 << bits, bool))
    if not n_pos or not n_neg:
        return model
    bucket, pos, neg = bucket[~texts], pos[~texts], neg[~texts]
    ratio = log_ratios(pos, neg)
    use = (pos + neg >= least_docs) & (np.abs(ratio) >= least_ratio)
    bucket, ratio = bucket[use], ratio[use]
    if not len(bucket):
        return model
    model.marks[bucket] = True
    marks = docs.sparkSession.sparkContext.broadcast(model.marks)

    def listed(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            row, bucket = present(texts, bits, marks.value)
            offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))), b.column(1)], names=["buckets", "label"])

    got = met.mapInArrow(listed, "buckets array<int>, label int").toArrow()
    marks.unpersist()
    lists = got.column("buckets").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = np.zeros(1 << bits, np.int32)
    place[bucket] = np.arange(len(bucket))
    col = place[lists.flatten().to_numpy()]
    w, model.bias = regress(row, col, ratio[col], got.column("label").to_numpy().astype(float), len(bucket), ridge)
    model.weights[bucket] = w * ratio
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs, all columns and rows, with the score (0 to 1, higher for toxic) in the column `into`, which gets a `_` if docs has
    it. Null and empty texts have no n-grams and so the model's bias. Repeated rows are scored alike. No rows in, no rows out."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = fresh(docs, into)

    @F.pandas_udf("double")  # texts alone go to Python, and come back as a number
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(kept.value.score(texts.tolist()))

    return docs.withColumn(name, of(F.col(text_col)))
