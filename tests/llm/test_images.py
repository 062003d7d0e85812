"""Descriptors and copy groups of images: neighbours on a canvas, noise, and links that no smallest image of a cell shows."""

from collections import namedtuple

import numpy as np
import pyarrow as pa

from tidemark.llm import media


def alone_or_beside(images):
    """Descriptors of each image, from a canvas of all."""
    canvas, starts = media._canvas(images)
    level, y, x, turn, bits = media.describe(canvas)
    at = np.searchsorted(starts - media.MARGIN // 2, y, side="right") - 1
    return [sorted(map(tuple, np.c_[level, y - starts[at], x, turn, bits][at == k].tolist())) for k in range(len(images))]


def test_descriptors_do_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (h, w), np.uint8).repeat(2, 0).repeat(2, 1) for h, w in [(1, 32), (2, 32), (4, 32), (3, 20), (4, 32), (9, 41), (2, 32), (30, 32), (1, 5)] * 4]
    alone = [alone_or_beside([i])[0] for i in images]
    assert sum(map(len, alone)) > 100 and {d[0] for a in alone for d in a} == {0, 1}
    order = rng.permutation(len(images))
    together = alone_or_beside([images[k] for k in order])
    assert alone_or_beside(images) == alone and together == [alone[k] for k in order]


def groups_of(spark, images):
    df = spark.createDataFrame([(i, a.shape[1], a.tobytes()) for i, a in images], "image_id long, width int, pixels binary")
    return {r.image_id: r.group_id for r in media.copy_groups(df).collect()}


def test_every_two_descriptors_within_three_bits_meet(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (200, 128), np.uint8)
    other = bits.copy()
    for row in other:
        row[rng.choice(128, 3, replace=False)] ^= 1
    packed = [np.packbits(b, axis=1, bitorder="little").view(np.int64).tolist() for b in (bits, other)]
    rows = [(2 * k + side, 0, *words[k], 1) for side, words in enumerate(packed) for k in range(len(bits))]
    found = spark.createDataFrame(rows, "image_id long, pos long, d1 long, d2 long, n long")
    met = {(r.a, r.b) for r in media.matches(media.shared_cells(found)).collect()}
    assert met == {(2 * k + 1, 2 * k) for k in range(len(bits))}


def test_images_with_pixel_noise_are_copies(spark):
    rng = np.random.default_rng(6)
    base = [rng.integers(0, 256, (40, 32), np.uint8).repeat(2, 0).repeat(2, 1) for _ in range(4)]
    noisy = [np.clip(b + rng.normal(0, 10, b.shape), 0, 255).astype(np.uint8) for b in base]
    got = groups_of(spark, [*enumerate(base), *enumerate(noisy, 4)])
    assert got == {i: i % 4 for i in range(8)}


def chunks(rng, n, rows):
    return [rng.integers(0, 256, (rows, 32), np.uint8).repeat(2, 0).repeat(2, 1) for _ in range(n)]


def test_copies_are_found_behind_smaller_images_that_share_their_corners(spark):
    rng = np.random.default_rng(8)
    parts, own = chunks(rng, 4, 40), chunks(rng, 4, 160)
    whole = np.concatenate(parts)
    images = [*enumerate((np.concatenate(p) for p in zip(own, parts)), 1), (10, whole), (11, whole)]
    assert groups_of(spark, images) == {1: 1, 2: 2, 3: 3, 4: 4, 10: 10, 11: 10}


def copies(one, two, n_one, n_two):
    """Whether two lists of descriptors agree on a move, by plain loops over all pairs of corners."""
    places = {}
    words = [np.array([[r.d1, r.d2] for r in of], np.int64).view(np.uint32) for of in (one, two)]
    apart = words[0][:, None] ^ words[1][None]
    for i, j in zip(*np.nonzero((apart == 0).any(2) & (np.bitwise_count(apart).sum(2) <= 12)), strict=True):
        for way, (p, q) in enumerate(((one[i], two[j]), (two[j], one[i]))):
            turn, scale = (p.turn - q.turn) % 24, 2.0 ** (p.level - q.level)
            c, s = np.cos(turn * np.pi / 12), np.sin(turn * np.pi / 12)
            dy, dx = p.y - scale * (q.y * c + q.x * s), p.x - scale * (q.x * c - q.y * s)
            for oy in (0, 0.5):
                for ox in (0, 0.5):
                    key = (way, turn, scale, oy, ox, np.floor(dy / 6 + oy), np.floor(dx / 6 + ox))
                    places.setdefault(key, set()).add((p.level, p.y, p.x, p.turn))
    most = max(map(len, places.values()), default=0)
    return (most >= 4 or most == n_one == n_two) and most >= 0.3 * min(n_one, n_two)


def test_groups_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    parts, own = chunks(rng, 30, 12) + chunks(rng, 12, 20), chunks(rng, 20, 80)
    images = [(k, np.concatenate([own[k % 20], parts[rng.integers(len(parts))], parts[0]])) for k in range(60)]
    images += [(3, images[10][1]), (12, images[12][1])]  # repeated ids
    df = spark.createDataFrame([(i, a.shape[1], a.tobytes()) for i, a in images], "image_id long, width int, pixels binary")
    rows = {}
    for r in media.descriptors(df).where("y is not null").collect():
        rows.setdefault(r.image_id, []).append(r)
    sizes = {i: max(r.n for r in of) for i, of in rows.items()}
    wanted = {i: i for i in range(60)}
    for x in rows:
        for y in rows:
            if x < y and copies(rows[x], rows[y], sizes[x], sizes[y]):
                old, new = max(wanted[x], wanted[y]), min(wanted[x], wanted[y])
                wanted = {i: new if g == old else g for i, g in wanted.items()}
    got = groups_of(spark, images)
    assert got == wanted and 5 < len(set(got.values())) < 55


def test_groups_do_not_depend_on_the_order_of_ids(spark):
    rng = np.random.default_rng(10)
    parts, own = chunks(rng, 30, 12) + chunks(rng, 12, 20), chunks(rng, 20, 60)
    images = [np.concatenate([own[k % 20], parts[rng.integers(len(parts))], parts[0]]) for k in range(40)]
    images += [np.rot90(images[3]), np.rot90(images[4], 2), images[5], images[6], images[6]]
    sets = []
    for ids in (range(45), range(45, 0, -1), rng.permutation(45).tolist()):
        own_of = dict(zip(ids, range(45), strict=True))
        groups = {}
        for i, g in groups_of(spark, list(zip(ids, images, strict=True))).items():
            groups.setdefault(g, set()).add(own_of[i])
        assert all(g == min(i for i in own_of if own_of[i] in m) for g, m in groups.items())
        sets.append(sorted(map(sorted, groups.values())))
    assert sets[0] == sets[1] == sets[2] and [5, 25, 42] in [[x for x in g if x in (5, 25, 42)] for g in sets[0]]
    assert any({6, 43, 44} <= set(g) for g in sets[0])


def test_images_with_the_same_corners_meet_as_one(spark):
    rng = np.random.default_rng(11)
    whole, other = chunks(rng, 2, 40)
    images = [(7, whole), (2, whole), (5, whole[:60]), (9, other), (4, whole), (4, other), (3, other[:4] * 0 + 128), (1, other[:4] * 0 + 128)]
    df = spark.createDataFrame([(i, a.shape[1], a.tobytes()) for i, a in images], "image_id long, width int, pixels binary")
    got = {r.image_id: (r.group_id, r.n_links) for r in media.copy_groups(df).collect()}
    assert {i: g for i, (g, _) in got.items()} == {7: 2, 2: 2, 5: 2, 4: 2, 9: 2, 3: 3, 1: 1}  # 4 is both images
    assert got[7] == (2, 1) and got[2] == (2, 0)


def test_votes_of_no_matches_and_of_too_few():
    none, some = np.empty(0, np.int64), np.arange(3) * 1000 * (1 << 27)
    assert media.most_agreeing(none, none, none, np.array([1, 4])).tolist() == [0, 0]
    assert media.most_agreeing(np.array([0, 1, 1]), some, some, np.array([2, 2])).tolist() == [0, 2]
    assert media.most_agreeing(np.array([0, 1, 1]), some, some, np.array([1, 3])).tolist() == [1, 0]
    assert media.most_agreeing(np.array([1, 1, 1]), some[[0, 1, 1]], some[[0, 1, 1]], np.array([1, 1])).tolist() == [0, 2]


def test_cells_are_dealt_out_once(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, 60, rng.integers(0, 256, (60, 60)).astype(np.uint8).tobytes()) for i in range(4)], "image_id long, width int, pixels binary")
    found = media.packed(media.descriptors(df))
    cells = media.shared_cells(found.union(found.selectExpr("image_id + 10", "pos", "d1", "d2", "n")))
    cells.collect()
    plan = cells._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(key") == 1 and "Join" not in plan
    assert cells.count() == cells.where("b is not null or image_id < 10").count() > 0
    assert all(a == b + 10 and p == q for a, b, p, q in media.matches(cells).collect())


Corner = namedtuple("Corner", "level y x turn d1 d2")


def made_up_lists(rng, images=50):
    """Corners that images share, at moves of few kinds, with up to 12 bits turned over, among them the first of a word; all (image,
    team, corners)."""
    words = rng.integers(-(1 << 63), (1 << 63) - 1, (12, 2))
    out = []
    for i in range(images):
        of = []
        for k in rng.choice(12, 9, replace=False).tolist():
            at = rng.integers(0, 3, 2) * 40 if rng.random() < 0.3 else (i % 4) * np.array([50, 10])
            turned = rng.choice(np.r_[:32, 63], 6, replace=False) + rng.integers(0, 2) * 64
            bits = [int(words[k, h]) ^ sum(1 << int(b) % 64 for b in turned if b // 64 == h) for h in (0, 1)]
            bits = [b - (1 << 64) if b >= 1 << 63 else b + (1 << 64) if b < -(1 << 63) else b for b in bits]
            of.append(Corner(0, int(20 * k + at[0]), int(7 * k % 30 + at[1]), 0, *bits))
        out.append((int(i * 7 % images), int(i % 9 // 3 * 100 if i % 9 < 5 else 1000 + i), of))
    return out


def wanted_links(lists):
    return {(max(i, j), min(i, j)) for i, t, x in lists for j, u, y in lists if t < u and copies(x, y, len(x), len(y))}


def top_groups(edges):
    groups = {}
    for a, b in edges:
        one = groups.get(a, {a}) | groups.get(b, {b})
        groups |= dict.fromkeys(one, one)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def position(c):
    return ((c.y << 20 | c.x) * 4 + c.level) * 32 + c.turn


def test_links_of_blocks_are_those_of_plain_loops_and_few_rows(spark):
    lists = made_up_lists(np.random.default_rng(12))
    wanted = wanted_links(lists)
    rows = [(i, t, len(x), [position(c) for c in x], [c.d1 for c in x], [c.d2 for c in x]) for i, t, x in lists]
    df = spark.createDataFrame(rows, "image_id long, team long, n_corners long, pos array<long>, d1 array<long>, d2 array<long>")
    for most in (10_000, 50):
        got = [tuple(r) for r in media.rival_links(df, 4, 0.3, most).collect()]
        counts = {}
        for a, _, n in got:
            counts[a] = counts.get(a, 0) + n
        assert {a: n for a, n in counts.items() if n} == {a: sum(i == a for i, _ in wanted) for a in {i for i, _ in wanted}}
        assert top_groups((a, b) for a, b, _ in got) == top_groups(wanted)
        assert len(wanted) > 200 and len(got) <= (4 if most > 50 else 9) * len(lists)


def test_links_of_a_block_do_not_depend_on_how_many_pairs_are_in_a_step(monkeypatch):
    lists = made_up_lists(np.random.default_rng(13))
    wanted = wanted_links(lists)
    table = pa.table({
        "cell": pa.array([0] * len(lists), pa.int32()), "side": pa.array([0] * len(lists), pa.int32()), "image_id": [i for i, _, _ in lists], "team": [t for _, t, _ in lists],
        "n_corners": [len(x) for *_, x in lists], "pos": [[position(c) for c in x] for *_, x in lists], "d1": [[c.d1 for c in x] for *_, x in lists], "d2": [[c.d2 for c in x] for *_, x in lists],
    })
    for pairs in (1, 37, 1 << 20):
        monkeypatch.setattr(media, "PAIRS", pairs)
        (got,) = media.block_links(table, 4, 0.3)
        assert sum(got["n"].to_pylist()) == len(wanted) > 200 and len(got) <= len(lists)
        assert top_groups(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == top_groups(wanted)
    (none,) = media.block_links(table.set_column(1, "side", pa.array([1] * len(lists), pa.int32())), 4, 0.3)  # the other block has no images
    assert len(none) == 0


def test_matches_tell_bits_apart_by_all_64(spark):
    bits = np.array([[5, 9], [-(1 << 63) + 5, 9]], np.int64).view(np.uint64)  # one bit apart, the first of a word
    ((i, j),) = media.rival_matches(np.array([0, 1]), np.array([0, 1]), bits, np.array([0, 1]), np.array([0, 1]))
    assert (i.tolist(), j.tolist()) == ([0], [1])


def test_corners_that_match_no_other_team_are_left_out():
    rng = np.random.default_rng(14)
    rows = []
    for cell in range(40):
        n = int(rng.integers(2, 9))
        base = rng.integers(-(1 << 63), (1 << 63) - 1)
        for _ in range(n):
            flips = rng.choice(64, int(rng.integers(0, 16)), replace=False)
            half = np.uint64(int(base) % (1 << 64) ^ sum(1 << int(b) for b in flips)).view(np.int64)
            rows.append((cell, len(rows), 7, int(half), int(rng.integers(0, 4)), int(rng.integers(0, 3))))
    near = lambda r, q: (int(r[3]) ^ int(q[3])).__and__((1 << 64) - 1).bit_count() + (r[4] ^ q[4]).bit_count() <= 12
    wanted = [r[1] for r in rows if any(r[0] == q[0] and r[5] != q[5] and near(r, q) for q in rows)]
    names = ["key", "image_id", "pos", "half", "quarter", "team"]
    table = pa.Table.from_arrays([pa.array(c, pa.int32() if k == "quarter" else pa.int64()) for k, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)
    got = [i for b in media.matched_corners(table) for i in b["image_id"].to_pylist()]
    assert got == wanted and 20 < len(got) < len(rows)
