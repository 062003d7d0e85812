"""The network of the secret scans: its threshold where findings are rare, and where its training windows lie."""

import numpy as np
import pytest

from tidemark.llm import secrets


def test_threshold_keeps_the_recall_where_findings_are_rare():
    x = np.full((400, secrets.LEFT + secrets.MID + secrets.RIGHT), 17, np.uint8)
    y = np.r_[np.ones(20), np.zeros(380)]  # what cannot be told apart scores about 0.05
    net = secrets.fit(x, y, epochs=1)
    assert net.threshold < 0.5 and (net.score(x[y == 1]) >= net.threshold).mean() >= 0.95


def test_training_windows_come_from_the_whole_text():
    text = " ".join(f"identifier{i:06d}x" for i in range(400)) + " password=hunter2hunter2 " * 200
    rows = secrets.drawn_rows(text, 64)
    assert len(rows) == 64 and 0 < sum(y for _, y in rows) < 64
    assert len(secrets.drawn_rows(text, 10_000)) == len(secrets.training_rows(text))


def draw(rng, n, of):
    return "".join(rng.choice(list(of), n))


HEX, UPPER, MIXED = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with secrets that rules find, and with names, versions and addresses that are none."""
    rng = np.random.default_rng(5)
    word = lambda: draw(rng, int(rng.integers(3, 9)), "abcdefghijklmnopqrst")
    said = lambda x: f"{word()} {word()} {word()} {x} {word()} {word()}."
    rows = []
    for _ in range(250):
        rows += [said(f'token = "{draw(rng, 40, HEX)}"'), said(f"password={draw(rng, 14, MIXED)}"), said("AKIA" + draw(rng, 16, UPPER)), said(f"{word()}.{rng.integers(99)}@mail{rng.integers(9)}.example.com"), said(f"{word()}-v{rng.integers(20)}.{rng.integers(10)}.tar")]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_network_finds_secrets_that_rules_miss(spark, corpus):
    net = secrets.train(corpus)
    rng = np.random.default_rng(6)
    word = lambda: draw(rng, int(rng.integers(3, 9)), "abcdefghijklmnopqrst")
    hidden = [f"{word()} {word()} {v} {word()} {word()}." for _ in range(60) for v in (draw(rng, 40, HEX.upper()), draw(rng, 14, MIXED) + "7a", "ASIA" + draw(rng, 15, UPPER) + "7")]
    clean = [f"{word()} {word()} {v} {word()} {word()}." for _ in range(90) for v in (f"{word()}.{rng.integers(99)}@mail{rng.integers(9)}.example.com", f"{word()}-v{rng.integers(20)}.{rng.integers(10)}.tar")]
    assert not any(secrets.by_rule(t) for t in hidden + clean)
    assert sum(any(k == "model" for _, _, k in row) for row in secrets.spans_of(hidden, net)) >= 0.9 * len(hidden)
    assert sum(map(bool, secrets.spans_of(clean, net))) <= 0.05 * len(clean)
    df = spark.createDataFrame([(1, hidden[0]), (None, hidden[1]), (3, None), (3, ""), (5, clean[0] + " password=abcdefgh"), (6, "a1" * 40_000)], "doc_id long, text string")
    got = {(r.doc_id, k): r for k, r in enumerate(secrets.digests(df, net).collect())}
    assert got[1, 0].spans.startswith("model:") and got[1, 0].n_over == got[1, 0].n_candidates == 1
    assert got[3, 2].spans == got[3, 3].spans == "" and got[5, 4].n_assign == 1 and len(got) == 6
    assert secrets.digests(df.where("false"), net).count() == 0


def test_disguise_hides_findings_from_the_rules():
    for text in ('x token = "' + "ab12" * 10 + '" y', "my password=Abc123xyz now", "AKIA" + "Q1" * 8):
        for start, end, kind in secrets.by_rule(text):
            hidden = secrets.disguised(text, start, end, kind)
            if kind == "hex":  # the keyword before it still gives it away; the finding of the keyword covers it
                assert hidden is None
                continue
            said, s, e = hidden
            assert not secrets.by_rule(said) and len(said[s:e]) >= 6


def test_scan_keeps_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "password=abcdefgh", "mine")], "doc_id long, text string, secrets string")
    row = secrets.scan(df, None).first()
    assert row.secrets == "mine" and row.secrets_[0].kind == "assign"
