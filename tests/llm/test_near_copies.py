"""Near copies against brute force over all pairs of shingle sets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import near_copies, simhash

WORDS = [f"w{k}" for k in range(3000)]


def families(seed: int) -> list[tuple[int, str | None]]:
    """Texts of 3 to 600 words, each with copies from equal to half as similar, texts that share a long passage, odd ones."""
    rng = np.random.default_rng(seed)
    texts: list[str | None] = ["", None, " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f", "a b c d e f"]
    passage = list(rng.choice(WORDS, 60))
    for n in (3, 8, 12, 30, 60, 200, 600):
        for _ in range(6):
            base = list(rng.choice(WORDS, n))
            texts.append(" ".join(base))
            for share in (0, 0.01, 0.02, 0.03, 0.04, 0.08, 0.2):
                copy = [w if rng.random() >= share else str(rng.choice(WORDS)) for w in base]
                texts.append(" ".join(copy))
            texts += [" ".join(base[: int(n * 0.9)]).upper(), " ".join(passage + base), " ".join(base[: n // 2])]
    order = rng.permutation(len(texts))
    return [(int(k), t) for k, t in zip(order, texts, strict=True)]


def brute(rows):
    sets = [(d, frozenset(simhash.shingle_hashes(t or "", 5))) for d, t in rows]
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
                one, other = find(a), find(b)
                top[max(one, other)] = min(one, other)
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize("cell,part_bytes", [(4096, 1 << 23), (4, 1 << 23), (4096, 2000)])
def test_groups_equal_brute_force(spark, monkeypatch, cell, part_bytes):
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "PART_BYTES", part_bytes)
    rows = families(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit("clash")).withColumn("Fp", F.lit(1))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(docs).collect()}
    assert got == want
    assert len(set(want.values())) < len(want) * 0.8
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_shuffle_join_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SMALL", 0)
    rows = families(8)
    got = {r.doc_id: r.component_id for r in near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_null_ids_repeats_and_no_rows(spark):
    text = " ".join(WORDS[:50])
    rows = [(None, text), (4, text), (4, "another text that is not the same at all"), (9, text + " more"), (None, "alone among all the others here"), (12, None), (11, "")]
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.component_id or 0) for r in got) == [(False, 0, 0), (False, 0, 4), (True, 4, 4), (True, 4, 4), (True, 9, 4), (True, 11, 11), (True, 12, 11)]
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5
    assert near_copies.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_family_is_checked_row_by_row(spark):
    """A thousand variants of one text are one group."""
    rng = np.random.default_rng(3)
    base = list(rng.choice(WORDS, 300))
    rows = []
    for k in range(1000):
        copy = list(base)
        copy[int(rng.integers(300))] = f"new{k}"
        rows.append((k, " ".join(copy)))
    got = near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
