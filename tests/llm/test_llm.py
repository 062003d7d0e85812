"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import additive, chat, components, line_dedup, media, packing, quality, secrets, simhash, tokens, warc
from tidemark.llm.queries import PATTERN, RANKS, SPECIAL

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n\n", "one line that repeats\nand another one here", "one line that repeats\nunique text of this document", "ONE LINE THAT REPEATS \r\nx", "é😀 中文 ½ ſ", "a" * 5000, "word " * 3000, "\x00\x0b \x85"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("n_dropped"), F.lit(1).alias("score"))
    odd = spark.createDataFrame([(10_000 + i, t, "y", 2) for i, t in enumerate(ODD)] + [(10_004, ODD[4], "y", 2), (None, ODD[5], "y", 2), (None, None, "y", 2)], "doc_id long, text string, n_dropped string, score int")
    return real.union(odd).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_dropped string")


def test_bpe_equals_tiktoken_and_round_trips(docs, rows, spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = tokens.encode(docs, RANKS, PATTERN)
    want = sorted((d or -1, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for d, t in rows)
    assert sorted((r.doc_id or -1, bytes(r.ids)) for r in got.collect()) == want
    back = tokens.decode(got, RANKS, PATTERN, step=7)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((d or -1, t or "") for d, t in rows)
    assert tokens.encode(empty(spark), RANKS, PATTERN).count() == 0


def test_utf8_stream_in_any_cut():
    data = "a é 中 😀 z".encode() + b"\xff" + "é".encode()
    for cut in range(1, 6):
        s = tokens.Utf8Stream()
        assert "".join(s.feed(data[i : i + cut]) for i in range(0, len(data), cut)) + s.end() == data.decode("utf-8", "replace")


def brute_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), (True, d)), (d is not None, d or 0))
    return sorted((d is not None, d or 0, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < least or first[key(x)] == (d is not None, d or 0))) for d, t in rows)


def test_line_dedup(docs, rows, spark):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in got.collect()) == brute_lines(rows)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def brute_groups(rows, width, radius):
    prints = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)))
    ids = sorted({d for d, _ in rows if d is not None})
    top = {d: d for d in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    known = [(d, p) for (d, _), p in zip(rows, prints, strict=True) if d is not None]
    for i, (a, p) in enumerate(known):
        for b, q in known[:i]:
            if (p ^ q).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    by_print = {}
    for d, p in known:
        by_print[p] = find(d)
    return [(d, p, by_print.get(p) if d is None else find(d)) for (d, _), p in zip(rows, prints, strict=True)]


def test_simhash_groups(docs, rows, spark):
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_groups(docs, 3, 3).collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(brute_groups(rows, 3, 3), key=order)
    assert simhash.near_groups(empty(spark), 3, 3).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_pairs(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 1 << 63, 9, dtype=np.uint64)[rng.integers(0, 9, 500)]
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False)) for _ in range(500)], np.uint64)
    fp, cell = centre ^ flips, np.sort(rng.integers(0, 4, 500))
    size = np.bincount(cell)
    order = np.argsort(-size[cell], kind="stable")
    fp, cell = fp[order], cell[order]
    got = {(int(i), int(j)) for a, b in simhash.near_rows(fp, cell, radius) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for j in range(500) for i in range(j) if cell[i] == cell[j] and int(fp[i] ^ fp[j]).bit_count() <= radius}


def test_large_cells_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rng = np.random.default_rng(1)
    prints = list(dict.fromkeys(int(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), False))) for _ in range(150)))
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    edges = simhash.near_edges(spark.createDataFrame(signed, "fp long, node long"), 3)
    found = {r.node: r.component for r in components.components(edges).collect()}
    want = {d: c for d, _, c in _closure(prints)}
    assert all(found.get(i, i) == want[i] for i in range(len(prints)))


def _closure(prints):
    top = list(range(len(prints)))
    for _ in prints:
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 3:
                    top[i] = top[j] = min(top[i], top[j])
    return [(i, prints[i], t) for i, t in enumerate(top)]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components.components(chain).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert components.components(chain.where("a > 500")).count() == 0


def test_packing_against_the_tokenizer(docs, rows, spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = docs.select("doc_id", "text").union(spark.createDataFrame([(20_000, "a <|endoftext|> b")], "doc_id long, text string"))
    got = packing.pack(packing.pieces(mixed, RANKS, PATTERN, SPECIAL)).collect()
    want = []
    for d, t in [*rows, (20_000, "a <|endoftext|> b")]:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want += [(d or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= 1.1 * -(-total // 2048) + 1
    assert packing.pack(packing.pieces(empty(spark), RANKS, PATTERN, SPECIAL)).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_plan_respects_every_capacity(by):
    rng = np.random.default_rng(3)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 200, 3000), return_counts=True), strict=True)}
    cap = packing.Capacity(tokens=400, documents=5, attention=60_000)
    runs, n = packing.plan(counts, cap, by)
    bins, seen = defaultdict(list), defaultdict(int)
    for length, lo, hi, first, offset in runs:
        seen[length] += hi - lo
        for k in range(hi - lo):
            bins[first + k].append((offset, length))
    assert seen == counts and len(bins) == n
    for places in bins.values():
        lengths = [x for _, x in places]
        assert sum(lengths) <= 400 and len(lengths) <= 5 and sum(x * x for x in lengths) <= 60_000
        assert sorted(o for o, _ in places) == [sum(x for o2, x in places if o2 < o) for o in sorted(o for o, _ in places)]


def brute_secrets(text):
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_secret_rules(rows):
    odd = ["secret=token:abcdefgh", 'API_KEY = "' + "ab12" * 9, "paſſword=abcdefgh", "AKIAAKIA" + "A1" * 8, "f" * 24 + "g" + "e" * 23, "token==abcdef password: x", "K" * 99]
    for text in [*odd, *[t or "" for _, t in rows]]:
        assert secrets.by_rule(text) == brute_secrets(text)


def test_secret_network_learns(docs, spark):
    net = secrets.train(docs)
    assert [c for c in secrets.mask(docs, net).columns] == docs.columns
    assert secrets.mask(docs, net).where("text like '%password=%'").count() == 0
    rng = np.random.default_rng(0)
    tok = lambda n, of: "".join(rng.choice(list(of), n))
    pos = ["x key " + tok(30, "0123456789abcdef") + " y" for _ in range(60)]
    neg = ["see mail" + tok(8, "abcdefgh") + str(k) + ".example.com now" for k in range(60)]
    x = [w for t in pos + neg for s, e in secrets.candidates(t)[:1] for w in secrets.windows(t, s, e)[:1]]
    y = np.array([1.0] * 60 + [0.0] * (len(x) - 60))
    fitted = secrets.fit(np.array(x, np.uint8), y)
    p = fitted.score(np.array(x, np.uint8))
    assert (p[y == 1] >= fitted.threshold).mean() >= 0.9 and (p[y == 0] >= fitted.threshold).mean() <= 0.05
    assert secrets.fit(np.zeros((3, 80), np.uint8), np.ones(3)).threshold > 1
    assert secrets.scan(empty(spark), net).count() == 0


def test_quality_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(d, labels)
    got = quality.score(d, model).join(labels.where(quality.held_out("doc_id")), "doc_id").select("score", "quality").collect()
    good = [r.score >= 0.3 for r in got if r.quality == 1]
    bad = [r.score < 0.3 for r in got if r.quality == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) >= 0.8
    odd = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5)], "doc_id long, text string, score double")
    assert quality.score(odd, model).columns == ["doc_id", "text", "score", "score_"]
    assert quality.score(odd.where("false"), model).count() == 0
    assert quality.fit(np.zeros((0, 18)), np.zeros(0)).score(np.zeros((1, 18)))[0] == 0.5


def test_search_recall_and_exclusions(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    bad = spark.createDataFrame([(100_000, None), (100_020, [0.0] * 64), (100_040, [float("nan")] + [1.0] * 63), (100_060, [None] + [1.0] * 63), (None, [1.0] * 64), (100_080, [1.0])], "vec_id long, embedding array<float>")
    got = additive.search(vectors.union(bad), F.col("vec_id") % 20 == 0).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    by = defaultdict(dict)
    for r in got:
        by[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = 0
    assert set(by) == {i for i in data if i % 20 == 0}
    for q, found in by.items():
        exact = sorted(((-float(data[q] @ v), i) for i, v in data.items() if i != q))[:20]
        assert sorted(found) == list(range(1, 21))
        assert all(abs(data[q] @ data[i] - s) < 1e-9 for i, s in found.values())
        hits += len({i for i, _ in found.values()} & {i for _, i in exact})
    assert hits >= 0.9 * 20 * len(by)
    assert additive.search(vectors.where("false"), F.col("vec_id") % 20 == 0).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in additive.search(same, F.col("vec_id") == 0).orderBy("rank").collect()] == list(range(1, 21))


def test_search_by_distance_in_many_blocks(spark, monkeypatch):
    for name, value in (("QUERIES", 7), ("FEWEST", 7), ("CODES", 100)):
        monkeypatch.setattr(additive, name, value)
    rng = np.random.default_rng(3)
    data = {k: rng.normal(0, rng.uniform(0.2, 3), 16).astype(np.float32) for k in range(400)}
    df = spark.createDataFrame([(k, v.tolist(), "clash") for k, v in data.items()], "vec_id long, embedding array<float>, codes string")
    hits = 0
    for measure, far in (("distance", True), ("product", False)):
        got = additive.search(df, F.col("vec_id") % 10 == 0, k=5, shortlist=40, measure=measure).collect()
        for q in range(0, 400, 10):
            score = lambda i: -float(np.linalg.norm(data[q].astype(float) - data[i])) if far else float(data[q].astype(float) @ data[i])  # noqa: B023, E731
            exact = sorted((i for i in data if i != q), key=lambda i: (-score(i), i))[:5]  # noqa: B023
            rows = {r["rank"]: r for r in got if r.query_id == q}
            assert sorted(rows) == [1, 2, 3, 4, 5] and all(abs(score(r.vec_id) - r.score) < 1e-6 for r in rows.values())
            hits += len({r.vec_id for r in rows.values()} & set(exact))
    assert hits >= 0.9 * 2 * 40 * 5


def test_search_finds_all_neighbours_among_near_copies(spark):
    rng = np.random.default_rng(5)
    centres = 8 * rng.normal(size=(3, 16)) / 4
    data = np.r_[rng.normal(size=(300, 16)), centres[rng.integers(0, 3, 1500)] + 1e-4 * rng.normal(size=(1500, 16))].astype(np.float32)
    data[1000] = 1e30  # beyond single precision when squared
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    got = additive.search(df, F.col("vec_id") % 100 == 50, shortlist=30, sample=200, codebooks=4).collect()
    for q in range(50, len(data), 100):
        want = sorted((i for i in range(len(data)) if i != q), key=lambda i: (-float(data[q].astype(float) @ data[i].astype(float)), i))[:20]  # noqa: B023
        assert {r.vec_id for r in got if r.query_id == q} == set(want)


def test_chat_keeps_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 2)
    talk = lambda c, *said: [(c, i, "user" if i % 2 == 0 else "assistant", s) for i, s in enumerate(said)]
    turns = talk(1, "a", "b") + talk(2, "a", "b", "c") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "b") + [(6, None, None, None), (None, 0, "user", "a"), (4, 0, "user", "a")] + talk(7, "a", "b", "c", "d", "e") + [(8, 5, "user", "a"), (8, 9, "assistant", "x"), (8, 10, "user", "z")]
    got = chat.render(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), "<", ">", block=2).orderBy("conv_id", "part").collect()
    assert {r.conv_id for r in got} == {5, 6, 7, 8}
    assert "".join(r.rendered for r in got if r.conv_id == 7) == "<user\na><assistant\nb><user\nc><assistant\nd><user\ne>"
    assert [(r.part, r.n_turns) for r in got if r.conv_id == 7] == [(0, 2), (1, 2), (2, 1)]
    assert chat.render(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_captures_of_many_runs_and_ranges_come_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 3)
    monkeypatch.setattr(warc, "RANGE", 8)
    monkeypatch.setattr(warc, "PACKET", 2)
    pages = [(k, f"http://h{k % 5}.example/{k % 3}", f"page {k % 7}") for k in range(60)] + [(None, None, None), (7, "http://h2.example/1", "page 0")]
    found = warc.capture_history(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), F.lit("2024-01-01T00:00:00Z"), path=str(tmp_path / "m"))
    assert found.rdd.getNumPartitions() == 8
    got = [(r.urlkey, r.timestamp, r.page_id is not None, r.page_id or 0) for r in found.collect()]
    assert got == sorted(got) and sorted(p for *_, p in got) == sorted(p or 0 for p, _, _ in pages)


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 600
    pages = [(1, "http://www.B.example/x?q=1", long), (2, "http://b.example/x?q=1", long), (3, None, None), (4, "no url", "WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n\r\n" + long), (5, "http://a.example/WARC/1.1", "short"), (6, "http://a.example", "short"), (None, "http://c.example", long), (2, "http://b.example/x?q=1", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    found = warc.capture_history(df, path=path).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == sorted(
        ((p or 0), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == long and p != 2 else "response", 2 if h == long and p != 2 else None) for p, _, h in pages
    )
    keys = [(r.urlkey, r.timestamp) for r in found]
    assert keys == sorted(keys) and "example,b)/x?q=1" in {k for k, _ in keys}
    assert {r.page_id: r.html for r in warc.read(spark, path).collect()}[4] == pages[3][2]
    assert warc.capture_history(df.where("false"), path=str(tmp_path / "e")).count() == 0


def test_header_values_never_come_from_urls(spark, tmp_path):
    """Any line end in a URL, followed by what looks like a header; clashing columns and a very long page beside it."""
    long = "x" * 2_000_000
    pages = [(k, f"http://a.example/{k}{c}{h}", long if k == 3 else f"page {k}", "r") for k, (c, h) in enumerate((c, h) for c in warc.BREAKS for h in ("WARC-Refers-To: <urn:page:77>", "WARC-Payload-Length: 5", "WARC-Date: 1999-01-01T00:00:00Z", "WARC-Type: revisit", "WARC-Payload-Digest: sha1:00"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, refers_to string").withColumns({"payload_digest": F.lit("d"), "timestamp": F.lit("t")})
    path = str(tmp_path / "u")
    for r in warc.capture_history(df, path=path).collect():
        html = pages[r.page_id][2]
        assert (r.payload_bytes, r.record_type, r.refers_to, r.timestamp[:4]) == (len(html), "response", None, "2024") and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()
    urls = [r.url for r in warc.read(spark, path).collect()]
    assert len(urls) == len(pages) and not any(c in u for u in urls for c in warc.BREAKS) and any("%E2%80%A8WARC-Refers-To" in u for u in urls)


def test_loser_tree():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.integers(0, 50, rng.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_images_find_crops_and_edits(spark):
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 256, (40, 32), dtype=np.uint8).repeat(2, 0).repeat(2, 1) for _ in range(3)]
    edited = base[0].copy()
    edited[10:20, 10:30] = 7
    images = [(1, base[0]), (2, base[1]), (3, base[2]), (4, base[0][20:, 8:]), (5, edited), (6, base[1]), (6, base[1])]
    df = spark.createDataFrame([(i, a.shape[1], a.tobytes()) for i, a in images] + [(7, 4, None), (8, 5, b"123"), (None, 2, b"1234")], "image_id long, width int, pixels binary")
    got = {r.image_id: r for r in media.copy_groups(df).collect()}
    assert {i: r.group_id for i, r in got.items() if i} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1, 6: 2, 7: 7, 8: 8}
    assert got[7].n_corners == 0 and media.copy_groups(df.where("false")).count() == 0


def test_page_images_hold_the_whole_text():
    text = "a b\n\n" + "w " * 70 + "\nlast"
    page = media.page_image(text)
    assert page.shape == (2 * (1 + 3 + 1), 64) and media.page_image("").shape == (2, 64)
    assert page[-1, 0] == xxhash.xxh32_intdigest(b"last") & 255


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "secret scans", "best-fit packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()


def test_pipeline_stages_take_odd_documents(spark, docs):
    """Nulls in any column, empty and long texts, repeated rows, clashing names and empty tables go through every stage."""
    import corpus_pipeline

    odd = docs.where("doc_id >= 10000 or doc_id is null").withColumnsRenamed({"n_dropped": "bands", "score": "Team"})
    odd = odd.union(odd.where("doc_id = 10004")).withColumn("secrets", F.lit(None).cast("string"))
    for start in (odd, odd.where("false")):
        kept = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == start.columns
        assert kept.count() <= start.count()
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() >= kept.count() * (start is odd)
