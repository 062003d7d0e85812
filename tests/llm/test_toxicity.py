"""The toxicity classifier: held-out labels, sums over single n-grams, ratios and the fit by plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.quality import held_out
from tidemark.llm.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels)


def grams(text):
    """Every n-gram of a text, by its words."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    flat = f" {' '.join(words)} "
    return {flat[i : i + n] for n in toxicity.SIZES for i in range(len(flat) - n + 1)}


def bucket_of(gram, bits):
    """The bucket of one n-gram, step by step."""
    top, mix = (1 << 64) - 1, int(toxicity.MIX)
    h = ord(gram[0]) * mix & top
    for c in gram[1:]:
        h = (((h ^ (h >> 29)) * mix) + ord(c) * mix) & top
    return (h * mix & top) >> (64 - bits)


ODD = ["", None, " ", "a", "An idiot, an IDIOT!", "é😀 中文 ½ ſ", "x\nidiot\tloser", "word " * 3000 + "scum", "\x00\x0b"]


def test_scores_are_sums_over_single_grams(model):
    plain = [model.bias + sum(float(model.weights[b]) for b in {bucket_of(g, model.bits) for g in grams(t or "")}) for t in ODD]
    assert np.allclose(model.score(ODD), 1 / (1 + np.exp(-np.clip(plain, -30, 30))))
    assert np.allclose(model.score(ODD[::-1])[::-1], model.score(ODD)) and len(model.score([])) == 0


def test_counts_and_ratios_equal_plain_ones():
    sums = np.zeros((2, 1 << 12), np.int32)
    toxicity.count_texts(ODD, [0, 1] * 4 + [0], sums, 12)
    for y in (0, 1):
        want = np.zeros(1 << 12)
        for t in ODD[y::2]:
            want[list({bucket_of(g, 12) for g in grams(t or "")})] += 1
        assert (sums[y] == want).all()
    ratio = toxicity.log_ratios(np.array([3, 0]), np.array([1, 6]))
    assert np.allclose(ratio, [np.log(4 / 5) - np.log(2 / 9), np.log(1 / 5) - np.log(7 / 9)])


def test_fit_is_where_the_slope_is_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)) * (rng.random((80, 5)) < 0.5)
    y = (x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 80) > 0.3).astype(float)
    row, col = np.nonzero(x)
    w, bias = toxicity.regress(row, col, x[row, col], y, 5, 0.05, 2000)
    off = (1 / (1 + np.exp(-(x @ w + bias))) - y) * np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    assert np.abs(x.T @ off / 80 + 0.05 * w).max() < 1e-6 and abs(off.mean()) < 1e-6


def test_held_out_labels(spark):
    rows = QUERIES["op11_toxicity"](spark, LARGER)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and rows.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    met = rows.where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in met)
    assert len(met) > 500 and right >= 0.95 * len(met)
    caught = [r.predicted for r in met if r.toxic and r.quality]  # junk texts have labels that their words do not bear out
    assert sum(caught) >= 0.8 * len(caught)
    assert sum(r.predicted for r in met if not r.toxic) <= 0.01 * len(met)


def test_odd_rows_and_labels(spark, model):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)] + [(4, ODD[4], 1), (None, "An idiot", 1), (None, None, None)], "doc_id long, text string, score int").withColumn("label", F.lit("x"))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "label", "score_"] and got.count() == docs.count()
    assert all(0 <= r.score_ <= 1 for r in got.collect())
    assert len({r.score_ for r in got.where("doc_id = 4").collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    none = toxicity.train(docs, labels)
    assert np.allclose(none.score(["", "idiot", None]), 0.25)
    one = toxicity.train(docs, spark.createDataFrame([(i, 0) for i in range(9)] + [(None, 1), (1, None)], "doc_id long, toxic int"))
    assert (one.score(["idiot"]) < 0.1).all()


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"vile{i} words here" if i % 2 else "kind words here") for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert (a.weights == b.weights).all() and a.bias == b.bias
    assert a.score(["vile9 words"])[0] > 0.5 > a.score(["kind words"])[0]
