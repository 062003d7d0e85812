"""Local image descriptors for columns of images: copies that were cropped, shifted, turned or edited in part.

Corners are found at several scales; each gets an orientation from its surroundings' intensity centroid and a string of binary
brightness tests turned by it. Strings meet in tables by their parts: strings that differ in fewer bits than there are
tables share a part. Matches of two images vote for the turn, scale and shift that they imply; images with enough votes for
one of these are copies, and copies of copies form groups.

Images whose corners are all the same are one image, that of the smallest id, until groups are told. Cells are compared
twice. First every descriptor meets its cell's first, so a cell that a third of all images share makes as many rows as it has
members. Then images of one cell that are not in one group by then meet each other, so no link between groups is lost. For that
images with enough corners that match in such cells are dealt into blocks; every two blocks meet in a task, which finds all
matches, counts votes and tells how many links each image has and a forest of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import release, remove, settle, small
from tidemark.llm.components import components
from tidemark.llm.simhash import CELL, top_of
from tidemark.sources.bucketed import bucketed, stored

#: Radius of what a descriptor sees, of the square in which a corner must be the greatest, and orientations told apart.
REACH, APART, TURNS, LEVELS, BITS, TABLES = 7, 9, 24, 2, 128, 4
#: Bits by which descriptors in one cell may differ.
MOST_BITS = 12
#: Blocks of images at least, corners in a block, pairs of corners that are looked at at once, and bytes of lists. Matters of cost.
BLOCKS, BLOCK, PAIRS, LIST_BYTES = 4, 3 << 19, 1 << 20, 2 << 20
#: Grey between images above each other, and beside them. Corners and their strength reach two pixels out of an image at every
#: level: with this much grey no level sees, or suppresses, across images. Even, so that levels fit.
MARGIN, SIDE = (max(REACH, APART) + 5) << (LEVELS - 1), (REACH + 3) << (LEVELS - 1)
#: Pixels that are worked on at once: few enough to stay in a core's cache.
CANVAS = 1 << 17
#: Corners must be at least as strong as this share of the strongest that 8-bit pixels allow.
STRENGTH = 2e-3
WORDS_A_ROW, WORD_PIXELS = 32, 2


def _tests() -> np.ndarray:
    """Pairs of places (turn, test, y x y x) inside the reach, drawn once from a fixed seed and turned."""
    rng = np.random.default_rng(12)
    spots = rng.normal(0, REACH / 2.5, (4 * BITS, 2, 2))
    spots = spots[(np.hypot(*np.moveaxis(spots, 2, 0)) <= REACH - 0.8).all(1) & (np.abs(spots[:, 0] - spots[:, 1]).max(1) >= 1.5)][:BITS]
    turned = []
    for k in range(TURNS):
        a = 2 * np.pi * k / TURNS
        turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
        turned.append(np.rint(spots @ turn.T).astype(np.int64))
    return np.stack(turned)


TESTS = _tests()


def _box(a: np.ndarray) -> np.ndarray:
    """Sums over squares of three pixels; beyond the border there is nothing. Each sum is made of its own pixels alone, in
    one order, so a shifted image has exactly the shifted sums."""
    for axis in (0, 1):
        lo, hi = [slice(None)] * 2, [slice(None)] * 2
        lo[axis], hi[axis] = slice(None, -1), slice(1, None)
        out = a.copy()
        out[tuple(hi)] += a[tuple(lo)]
        out[tuple(lo)] += a[tuple(hi)]
        a = out
    return a


def _greatest(a: np.ndarray, r: int) -> np.ndarray:
    """The greatest value of each square of 2 r + 1 pixels, by windows that double."""
    for axis in (0, 1):
        n = a.shape[axis]
        at = lambda lo, hi, axis=axis: tuple(slice(lo, hi) if k == axis else slice(None) for k in (0, 1))
        out = np.zeros_like(a, shape=tuple(m + 2 * r if k == axis else m for k, m in enumerate(a.shape)))
        out[at(r, r + n)] = a
        wide = 1
        while wide < 2 * r + 1:
            step = min(wide, 2 * r + 1 - wide)
            out = np.maximum(out[at(None, -step)], out[at(step, None)])
            wide += step
        a = out
    return a


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of corners: Harris responses over STRENGTH that are the greatest nearby; of equal ones the first."""
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    gy[1:-1], gx[:, 1:-1] = image[2:] - image[:-2], image[:, 2:] - image[:, :-2]
    xx, yy, xy = _box(gx * gx), _box(gy * gy), _box(gx * gy)
    response = np.rint((xx * yy - xy * xy - 0.05 * (xx + yy) ** 2) / 1e4)
    response[(response < STRENGTH * 255.0**4 * 9 / 1e4)] = 0
    top = (response == _greatest(response, APART)) & (response > 0)
    top[:REACH], top[-REACH:], top[:, :REACH], top[:, -REACH:] = False, False, False, False
    order = np.where(top, np.arange(top.size, 0, -1, dtype=np.int32).reshape(top.shape), 0)
    return np.nonzero(top & (order == _greatest(order, APART)))


def describe(image: np.ndarray) -> tuple[np.ndarray, ...]:
    """(level, y, x, turn, bits as two words) of the corners of a float image; y and x in the image's own pixels. What
    lies beyond the image counts as middle grey; images need a margin of REACH pixels a level to have corners at their edge."""
    found = []
    for level in range(LEVELS):
        if level:
            h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
            image = (image[:h:2, :w:2] + image[1:h:2, :w:2] + image[:h:2, 1:w:2] + image[1:h:2, 1:w:2]) / 4
        if min(image.shape) <= 2 * REACH:
            break
        y, x = corners(image)
        if not len(y):
            continue
        smooth = _box(image)
        span = np.arange(-4, 5)
        dy, dx = (a[np.hypot(*np.meshgrid(span, span, indexing="ij")) <= 4.2] for a in np.meshgrid(span, span, indexing="ij"))
        near = image[y[:, None] + dy, x[:, None] + dx]
        angle = np.arctan2((near * dy).sum(1), (near * dx).sum(1))
        turn = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
        t = TESTS[turn]
        first, second = (smooth[y[:, None] + t[:, :, k, 0], x[:, None] + t[:, :, k, 1]] for k in (0, 1))
        bits = np.packbits(first < second - 0.5, axis=1, bitorder="little").view(np.int64)
        found.append((np.full(len(y), level), y << level, x << level, turn, bits))
    if not found:
        return (*[np.empty(0, np.int64)] * 4, np.empty((0, 2), np.int64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def page_image(text: str) -> np.ndarray:
    """A picture of the whole text: each word is a square whose grey is its hash, lines begin at the left and wrap."""
    lines = [line.split() for line in text.encode("utf-8", "replace").lower().split(b"\n")]
    lengths = np.array([len(line) for line in lines])
    rows = -(-lengths // WORDS_A_ROW)
    grey = np.fromiter((xxhash.xxh32_intdigest(w) & 255 for line in lines for w in line), np.uint8, int(lengths.sum()))
    at = np.arange(len(grey)) + np.repeat((np.cumsum(rows) - rows) * WORDS_A_ROW - (np.cumsum(lengths) - lengths), lengths)
    page = np.full((max(int(rows.sum()), 1), WORDS_A_ROW), 128, np.uint8)
    page.reshape(-1)[at] = grey
    return page.repeat(WORD_PIXELS, 0).repeat(WORD_PIXELS, 1)


def page_images(docs: DataFrame) -> DataFrame:
    """(image_id, width, pixels) of every document's whole text. A null or empty text is one grey row."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                pages = [page_image(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p.shape[1] for p in pages], pa.int32()), pa.array([p.tobytes() for p in pages], pa.binary())], names=["image_id", "width", "pixels"])

    return docs.select(F.col("doc_id").cast("long").alias("image_id"), "text").mapInArrow(run, "image_id long, width int, pixels binary")


def _canvas(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Images below each other with margins of middle grey, and the row at which each begins."""
    heights = [-(-len(i) // 2) * 2 + MARGIN for i in images]
    starts = MARGIN + np.cumsum([0, *heights[:-1]])
    canvas = np.full((int(starts[-1]) + heights[-1], max(i.shape[1] for i in images) // 2 * 2 + 2 + 2 * SIDE), 128, np.float32)
    for s, i in zip(starts, images, strict=True):
        canvas[s : s + len(i), SIDE : SIDE + i.shape[1]] = i
    return canvas - 128, starts


def descriptors(images: DataFrame) -> DataFrame:
    """(image_id, level, y, x, turn, d1, d2, n) for each corner of (image_id, width, pixels), a byte a pixel, row by row; n
    is how many corners the image has. An image without corners is one row, with n 0 and nulls.

    Images that are null, empty or whose pixels do not fill whole rows have none, nor have rows with a null id.
    """
    names = ["image_id", "level", "y", "x", "turn", "d1", "d2", "n"]
    kinds = [pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3]

    def run(batches):
        ids: list[int] = []
        kept: list[np.ndarray] = []

        def batch(*columns):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def out():
            canvas, starts = _canvas(kept)
            level, y, x, turn, bits = describe(canvas)
            at = np.searchsorted(starts - MARGIN // 2, y, side="right") - 1
            held = np.bincount(at, minlength=len(ids))
            yield batch(np.array(ids, np.int64)[at], level, y - starts[at], x - SIDE, turn, bits[:, 0].copy(), bits[:, 1].copy(), held[at])
            yield bare([i for i, n in zip(ids, held, strict=True) if not n])

        def bare(of):
            return batch(of, *[[None] * len(of)] * 6, [0] * len(of))

        size = 0
        for b in batches:
            none = []
            for image, width, pixels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if image is None or not pixels or not width or width < 1 or len(pixels) % width:
                    none.append(image)
                    continue
                ids.append(image)
                kept.append(np.frombuffer(pixels, np.uint8).reshape(-1, width))
                size += len(pixels) + 16 * width
                if size >= CANVAS:
                    yield from out()
                    ids, kept, size = [], [], 0
            yield bare(none)
        if kept:
            yield from out()

    return images.select("image_id", "width", "pixels").mapInArrow(run, "image_id long, level int, y int, x int, turn int, d1 long, d2 long, n long")


def packed(found: DataFrame) -> DataFrame:
    """(image_id, pos, d1, d2, n): level, y, x and turn of a corner in one number, for smaller rows; pos is null for no corner."""
    pos = ((F.col("y").cast("long") * (1 << 20) + F.col("x")) * 4 + F.col("level")) * 32 + F.col("turn")
    return found.select("image_id", pos.alias("pos"), "d1", "d2", "n")


def looks() -> list[F.Column]:
    """Two numbers, look_1 and look_2, that all corners of an image make together, in any order."""
    return [F.bit_xor(F.xxhash64(F.lit(k), "pos", "d1", "d2")).alias(f"look_{k}") for k in (1, 2)]


def same_corners(sizes: DataFrame) -> DataFrame:
    """(a, b): images whose corners all lie at the same places with the same bits, and the smallest of these. sizes: (image_id,
    n_corners, repeated, look_1, look_2). All corners agree on one move, so these are links by any count of votes."""
    alike = ["n_corners", "look_1", "look_2"]
    single = sizes.where("not repeated")
    least = single.groupBy(*alike).agg(F.min("image_id").alias("b"))
    return single.join(least, alike).where("image_id > b").select(F.col("image_id").alias("a"), "b")


def in_tables(found: DataFrame) -> DataFrame:
    """(key, image_id, pos, half, quarter) of packed() for each of TABLES tables: the key is the table and its part of the bits,
    half and quarter are the other bits, in one order for all rows of a table."""
    low, high = (lambda d: F.col(d).bitwiseAND(0xFFFFFFFF)), (lambda d: F.shiftrightunsigned(d, 32))
    signed = lambda part: F.shiftright(F.shiftleft(part, 32), 32).cast("int")
    row = lambda t, part, quarter, half: F.struct((F.lit(t << 32) + part).alias("key"), F.col(half).alias("half"), signed(quarter).alias("quarter"))
    rows = [row(t, one(own), rest(own), other) for t, (own, other, one, rest) in enumerate([("d1", "d2", low, high), ("d1", "d2", high, low), ("d2", "d1", low, high), ("d2", "d1", high, low)])]
    return found.select("image_id", "pos", F.explode(F.array(*rows)).alias("row")).select("row.key", "image_id", "pos", "row.half", "row.quarter")


def shared_cells(found: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of in_tables() in cells of two images or more, dealt out by key once; b and pos_b are the image and corner of the cell's
    first row, that of the smallest image, if this row matches it, else null."""
    rows = in_tables(found)
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    own = Window.partitionBy("key")
    met = rows.withColumn("q", F.min(F.struct("image_id", "pos", "half", "quarter")).over(own)).withColumn("high", F.max("image_id").over(own)).where("q.image_id < high")
    quarters = F.col("quarter").bitwiseXOR(F.col("q.quarter")).cast("long").bitwiseAND(0xFFFFFFFF)  # bit_count extends the sign
    hit = (F.col("image_id") > F.col("q.image_id")) & (F.bit_count(F.col("half").bitwiseXOR(F.col("q.half"))) + F.bit_count(quarters) <= most_bits)
    return met.select("key", "image_id", "pos", "half", "quarter", F.when(hit, F.col("q.image_id")).alias("b"), F.when(hit, F.col("q.pos")).alias("pos_b"))


def matches(cells: DataFrame) -> DataFrame:
    """(a, b, pos_a, pos_b): descriptors of image a that match one of image b < a. Each row of shared_cells() is compared with
    its cell's of the smallest image. Descriptors that differ in fewer than TABLES bits always share a cell."""
    return cells.where("b is not null").select(F.col("image_id").alias("a"), "b", F.col("pos").alias("pos_a"), "pos_b")


def _unpacked(pos: np.ndarray) -> tuple[np.ndarray, ...]:
    return pos & 31, pos >> 5 & 3, pos >> 7 & 0xFFFFF, pos >> 27


def most_agreeing(pair: np.ndarray, pos_a: np.ndarray, pos_b: np.ndarray, needed: np.ndarray, bin_pixels: float = 6.0) -> np.ndarray:
    """How many places of each pair's corners imply about the same move at most, 0 if fewer than needed; matches are of pairs 0, 1, ..
    Bins overlap by half, so no border between bins parts like moves; moves count from b to a and from a to b, so nothing
    depends on which id is the smaller."""
    most = np.zeros(len(needed), np.int64)
    for p, q in ((pos_a, pos_b), (pos_b, pos_a)):
        (p_turn, p_level, p_x, p_y), (q_turn, q_level, q_x, q_y) = _unpacked(p), _unpacked(q)
        turn, zoom = (p_turn - q_turn) % TURNS, p_level - q_level
        a, s = turn * (2 * np.pi / TURNS), 2.0**zoom
        dy, dx = p_y - s * (q_y * np.cos(a) + q_x * np.sin(a)), p_x - s * (q_x * np.cos(a) - q_y * np.sin(a))
        for oy, ox in ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5)):
            y, x = (np.floor(d / bin_pixels + o).astype(np.int64) for d, o in ((dy, oy), (dx, ox)))
            move = ((turn * 8 + zoom + 4) << 56) + ((y & 0xFFFFFFF) << 28) + (x & 0xFFFFFFF)
            order = np.lexsort((move, pair))
            for last in (False, True):  # first all matches of a bin, then places of bins with enough matches
                if not len(order):
                    break
                of, m = pair[order], move[order]
                if last:
                    once = np.r_[True, (of[1:] != of[:-1]) | (m[1:] != m[:-1]) | (p[order][1:] != p[order][:-1])]
                    of, m = of[once], m[once]
                at = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (m[1:] != m[:-1])])
                n = np.diff(np.r_[at, len(of)])
                if last:
                    np.maximum.at(most, of[at], n)
                else:
                    order = order[np.repeat(n >= needed[of[at]], n)]
                    order = order[np.lexsort((p[order], move[order], pair[order]))]
    most[most < needed] = 0
    return most


def by_runs(rows: DataFrame, keys: list[str], work, kind: str, most_bytes: int, dealt: bool = False) -> DataFrame:
    """What `work` makes of whole runs of rows with equal keys: it takes an Arrow table of many runs at a time, its columns those
    of `rows`, and yields batches of the given kind. About `most_bytes` are held, more only for a single run. dealt: rows with equal
    keys are in one partition already."""

    def run(batches):
        kept, held, most = [], 0, most_bytes
        for batch in batches:
            kept.append(batch)
            held += batch.nbytes
            if held < most:
                continue
            table = pa.Table.from_batches(kept)
            end = np.logical_or.reduce([np.diff(table[k].to_numpy()) != 0 for k in keys]).nonzero()[0]
            cut = int(end[-1]) + 1 if len(end) else 0  # the last run may go on
            if cut:
                yield from work(table.slice(0, cut))
            kept = pa.Table.from_batches(table.slice(cut).combine_chunks().to_batches(), table.schema).to_batches()
            held = sum(b.nbytes for b in kept)
            most = max(most_bytes, 2 * held)
        if kept:
            yield from work(pa.Table.from_batches(kept))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows if dealt else rows.repartition(n, *keys)).sortWithinPartitions(*keys).mapInArrow(run, kind)


def spans(n: np.ndarray, most: int):
    """Ranges (from, to) of places in n that sum to at most `most`, more only for a single place."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(int(np.searchsorted(ends, ends[at] - n[at] + most, side="right")), at + 1)
        yield at, to
        at = to


def _voted(n: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, votes: int, share: float) -> np.ndarray:
    return (n > 0) & ((n >= votes) | ((n == n_a) & (n == n_b))) & (n >= share * np.minimum(n_a, n_b))


def rival_matches(of: np.ndarray, team: np.ndarray, bits: np.ndarray, asking: np.ndarray, asked: np.ndarray):
    """Arrays (i, j) of all matches of corners `asking` with corners `asked` of images of a greater team, all matches of an asking
    image in one step, about PAIRS pairs of one cell a step. `of` is each corner's image, ascending in `asking`; bits are two words
    a corner. Corners that share several parts meet in the table of the first."""
    parts = bits.view(np.uint32)
    sorts, froms, counts = [], [], []
    for t in range(TABLES):
        keys = parts[asked, t].astype(np.uint64) << np.uint64(32) | team[of[asked]].astype(np.uint64)
        order = np.argsort(keys)
        keys, own = keys[order], parts[asking, t].astype(np.uint64) << np.uint64(32)
        low = np.searchsorted(keys, own | team[of[asking]].astype(np.uint64), side="right")
        sorts.append(asked[order].astype(np.int32))
        froms.append(low.astype(np.int32))
        counts.append(np.searchsorted(keys, own | np.uint64(0xFFFFFFFF), side="right").astype(np.int32) - froms[-1])
    first = np.flatnonzero(np.r_[True, of[asking][1:] != of[asking][:-1]]) if len(asking) else asking
    ends = np.r_[first[1:], len(asking)]
    for s, e in spans(np.add.reduceat(sum(counts), first, dtype=np.int64) if len(first) else first, PAIRS):
        hits = []
        for t in range(TABLES):
            n, low = counts[t][first[s] : ends[e - 1]], froms[t][first[s] : ends[e - 1]]
            for k, m in spans(n, PAIRS):
                i = np.repeat(np.arange(k, m), n[k:m])
                j = sorts[t][np.arange(len(i)) - np.repeat(np.cumsum(n[k:m]) - n[k:m], n[k:m]) + low[i]]
                i = asking[first[s] + i]
                near = np.bitwise_count(bits[i] ^ bits[j]).sum(1) <= MOST_BITS
                i, j = i[near], j[near]
                new = ~(parts[i, :t] == parts[j, :t]).any(1)
                hits.append(np.stack([i[new], j[new]]))
        yield np.concatenate(hits, axis=1)


def block_links(cells: pa.Table, votes: int, share: float):
    """Batches (a, b, n) for each whole cell of two blocks of images, rows (cell, side, image_id, team, n_corners, pos, d1, d2): n
    copies of image a have smaller ids and lie in another team and on the other side (1 or 2; all lie on side 0 if a block meets
    itself). Edges (a, b) connect all copies, and are no more than images."""
    cell = cells.column(0).to_numpy()
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    for s, e in zip(at.tolist(), [*at[1:].tolist(), len(cell)], strict=True):
        part = cells.slice(s, e - s)
        part = part.take(pa.array(np.argsort(part["image_id"].to_numpy())))  # ids and places in one order
        side, image, team, size = (part.column(k).to_numpy() for k in range(1, 5))
        lists = [pa.concat_arrays(part.column(k).chunks) for k in range(5, 8)]
        of = np.repeat(np.arange(len(image)), lists[0].value_lengths().to_numpy())
        pos, *words = (x.flatten().to_numpy() for x in lists)
        bits, team = np.stack(words, axis=1).view(np.uint64), np.unique(team, return_inverse=True)[1]
        own, low, high = (np.flatnonzero(side[of] == k) for k in range(3))
        top, n = np.arange(len(image)), np.zeros(len(image), np.int64)
        for one, two in ((own, own), (low, high), (high, low)):
            for i, j in rival_matches(of, team, bits, one, two):
                pairs, pair, count = np.unique(of[i] * len(image) + of[j], return_inverse=True, return_counts=True)
                least = np.minimum(size[pairs // len(image)], size[pairs % len(image)])
                needed = np.maximum(np.ceil(share * least - 1e-9).astype(np.int64), np.minimum(votes, least))
                enough = count >= needed
                pairs, needed, place = pairs[enough], needed[enough], np.cumsum(enough) - 1
                kept = enough[pair]
                x, y = pairs // len(image), pairs % len(image)
                keep = _voted(most_agreeing(place[pair[kept]], pos[i[kept]], pos[j[kept]], needed), size[x], size[y], votes, share)
                x, y = x[keep], y[keep]
                n += np.bincount(np.maximum(x, y), minlength=len(image))
                for u, v in zip(x.tolist(), y.tolist(), strict=True):
                    u, v = top_of(top, u), top_of(top, v)
                    top[max(u, v)] = min(u, v)
                while (top[top] != top).any():
                    top = top[top]
        told = (n > 0) | (top != np.arange(len(image)))
        yield pa.RecordBatch.from_arrays([pa.array(image[told]), pa.array(image[top[told]]), pa.array(n[told])], names=["a", "b", "n"])


def matched_corners(cells: pa.Table):
    """Those rows (key, image_id, pos, half, quarter, team) of whole cells that match one of another team; of cells with more than CELL rows
    all. Two corners that share several parts count in the table of the first."""
    key, half, quarter, team = (cells[c].to_numpy() for c in ("key", "half", "quarter", "team"))
    half, quarter, table = half.view(np.uint64), quarter.view(np.uint32), key >> 32
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[at, len(key)])
    live = np.repeat(size > CELL, size)
    left = np.where(live, 0, np.repeat(at + size, size) - np.arange(len(key)) - 1)  # rows of the cell after this one
    for s, e in spans(left, PAIRS):
        n = left[s:e]
        i = np.repeat(np.arange(s, e), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
        halves, quarters = half[i] ^ half[j], quarter[i] ^ quarter[j]
        hit = np.flatnonzero((np.bitwise_count(halves) + np.bitwise_count(quarters) <= MOST_BITS) & (team[i] != team[j]))
        i, j, halves, quarters = i[hit], j[hit], halves[hit], quarters[hit]
        met = ((table[i] % 2 == 1) & (quarters == 0)) | ((table[i] > 1) & ((halves.astype(np.uint32) == 0) | (halves >> np.uint64(32) == 0)))  # in a table before
        live[i[~met]] = live[j[~met]] = True
    yield from cells.filter(pa.array(live)).to_batches()


def rival_lists(cells: DataFrame, groups: DataFrame, sizes: DataFrame, votes: int) -> DataFrame:
    """(image_id, team, n_corners, pos, d1, d2): images with enough corners that match corners of other teams, and lists of these corners.
    A team is a group so far. cells: shared_cells(), sizes: (image_id, n_corners, repeated)."""
    teams = cells.join(small(groups.select(F.col("node").alias("image_id"), "component")), "image_id", "left").withColumn("team", F.coalesce("component", "image_id"))
    of = Window.partitionBy("key")  # leaves a cell's rows beside each other
    mixed = teams.withColumn("low", F.min("team").over(of)).withColumn("high", F.max("team").over(of)).where("low < high").select("key", "image_id", "pos", "half", "quarter", "team")
    live = by_runs(mixed, ["key"], matched_corners, "key long, image_id long, pos long, half long, quarter int, team long", LIST_BYTES, dealt=True)
    table, part, rest = F.shiftright("key", 32), F.col("key").bitwiseAND(0xFFFFFFFF), F.col("quarter").cast("long")
    own = F.when(table % 2 == 0, F.shiftleft(rest, 32).bitwiseOR(part)).otherwise(F.shiftleft(part, 32).bitwiseOR(rest.bitwiseAND(0xFFFFFFFF)))
    live = live.select("image_id", "team", "pos", F.when(table < 2, own).otherwise(F.col("half")).alias("d1"), F.when(table < 2, F.col("half")).otherwise(own).alias("d2"))
    lists = live.repartition("image_id").groupBy("image_id").agg(F.max("team").alias("team"), F.collect_set(F.struct("pos", "d1", "d2")).alias("corners"), F.size(F.collect_set("pos")).alias("total"))
    lists = lists.join(sizes.select("image_id", "n_corners"), "image_id")
    if sizes.where("repeated").isEmpty():  # images under one id can have several places that agree with a single one of another image
        lists = lists.where(F.col("total") >= F.least(F.lit(votes), "n_corners"))  # others are no one's copies
    return lists.select("image_id", "team", "n_corners", *(F.col(f"corners.{c}").alias(c) for c in ("pos", "d1", "d2")))


def rival_links(lists: DataFrame, votes: int, share: float, most: int = BLOCK) -> DataFrame:
    """(a, b, n) of block_links() over all pairs of rival_lists(), each pair once. Images are dealt into blocks of about `most` corners, every
    two blocks meet in a task, so what travels is the lists times the number of blocks, and neither matches nor pairs are rows."""
    blocks = max(BLOCKS, -(-(lists.agg(F.sum(F.size("pos"))).first()[0] or 0) // most))
    dealt = lists.withColumn("block", F.pmod(F.xxhash64("image_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = F.greatest("block", "other") * F.lit(blocks) + F.least("block", "other")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    rows = dealt.select(cell.alias("cell"), side.alias("side"), "image_id", "team", "n_corners", "pos", "d1", "d2")
    return by_runs(rows, ["cell"], lambda t: block_links(t, votes, share), "a long, b long, n long", LIST_BYTES)


def consensus(matched: DataFrame, sizes: DataFrame, votes: int = 4, share: float = 0.3) -> DataFrame:
    """(a, b) of images with enough corners that imply about the same move: at least `votes`, or all of both, and `share` of
    the corners of the one with fewer. sizes: (image_id, n_corners). No matches, no rows."""

    def counted(table):
        a, b, pos_a, pos_b = (c.to_numpy() for c in table.columns)
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        n = most_agreeing(np.cumsum(first) - 1, pos_a, pos_b, np.ones(int(first.sum()), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[first], b[first], n)], names=["a", "b", "votes"])

    counts = by_runs(matched.select("a", "b", "pos_a", "pos_b"), ["a", "b"], counted, "a long, b long, votes long", LIST_BYTES)
    n = sizes.select("image_id", "n_corners")
    both = counts.join(n.toDF("a", "n_a"), "a").join(n.toDF("b", "n_b"), "b")
    enough = (F.col("votes") >= votes) | ((F.col("votes") == F.col("n_a")) & (F.col("votes") == F.col("n_b")))
    return both.where(enough & (F.col("votes") >= share * F.least("n_a", "n_b"))).select("a", "b")


def copy_groups(images: DataFrame, votes: int = 4, share: float = 0.3) -> DataFrame:
    """(image_id, n_corners, group_id, n_links) for every image of (image_id, width, pixels): group_id is the smallest id of its
    copies, n_links counts the smaller images by which it came into its group (not all of a large group's pairs; an image whose
    corners are all those of a smaller one has that one).

    Two images are copies if at least `votes` corners agree on a move, and these are `share` of the corners of the one
    with fewer; with less than `votes` corners all of both must. An image without corners is a group by itself. Rows with a null id keep a null group; rows that repeat
    an id are one image, with the most corners of them. No rows in, no rows out.
    """
    spark = images.sparkSession
    every = stored(packed(descriptors(images)))
    ids, found = every.select("image_id").distinct(), every.where("pos is not null")
    sizes = settle(found.groupBy("image_id").agg(F.max("n").alias("n_corners"), (F.count("*") > F.max("n")).alias("repeated"), *looks()))
    twins = settle(same_corners(sizes))
    found = found.join(small(twins.select(F.col("a").alias("image_id"))), "image_id", "left_anti")
    cells, where = bucketed(shared_cells(found), "key", dealt=True)
    release(spark)
    first = settle(consensus(matches(cells), sizes, votes, share))
    lists = stored(rival_lists(cells, components(first), sizes, votes))
    del cells
    remove(spark, where)
    release(spark)
    one = F.lit(1).cast("long").alias("n")  # no link is of two kinds: second ones are of different groups of first ones, twins are in no cell
    sure = first.select("a", "b", one).union(settle(rival_links(lists, votes, share))).union(twins.select("a", "b", one))
    groups = components(sure.select("a", "b"))
    linked = sure.groupBy("a").agg(F.sum("n").alias("n_links"))
    return (
        ids.join(sizes.select("image_id", "n_corners"), "image_id", "left").join(groups, ids["image_id"] == groups["node"], "left").join(linked, ids["image_id"] == linked["a"], "left")
        .select("image_id", F.coalesce("n_corners", F.lit(0).cast("long")).alias("n_corners"), F.coalesce("component", "image_id").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
