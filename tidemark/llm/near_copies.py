"""Near copies by similarity of shingle sets, with SimHash fingerprints compared in bit planes and an exact check behind them.

Two texts are linked if the Jaccard similarity of their sets of word shingles is at least `similarity`. At 0.8 fingerprints
of 64 bits differ in 10 bits on average, too many for blocks of equal bits to find, so the cells in which fingerprints meet
are bands of MinHash values of the same shingles. In a cell the planes of simhash.near_rows compare the fingerprints, and
what is left is checked on the whole shingle sets, which the cell's rows bring along. Texts with one shingle set are one
class from the start.

Each text first meets the smallest document of its bands, so a large group of copies mostly costs one check a row. Then
cells whose rows are not in one group by then go through the planes: each pair of different groups is compared in the first band
that it shares, and a task puts out a forest of the links that it finds, no more rows than it has read. No pair of texts
is ever a row, and no link between groups is lost. Cells with many rows, or with many bytes of shingles, are cut in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle, text_batches
from tidemark.llm.components import components
from tidemark.llm.simhash import CELL, by_cells, in_parts, majority_bits, near_rows, shingle_hashes, top_of

#: MinHash values: bands of so many values each. Two sets of similarity 0.8 miss all bands once in 20 million.
BANDS, ROWS = 32, 4
#: Bits by which fingerprints in one cell may differ. At similarity 0.8 they differ in 10 bits (standard deviation 3), in 12
#: where texts have very few shingles; unrelated ones in 32 (4).
REACH = 26
#: MinHash values, of all bands, that two texts must share. At similarity 0.8 they share 102 (standard deviation 4.5) and
#: fewer than 77 once in 13 million.
SHARED = 77
#: Bytes of shingles in a part of a cell.
PART_BYTES = 8 << 20
#: A table of at most so many ids or keys is broadcast; a larger one is joined by a shuffle.
SMALL = 200_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def minhash(hashes: np.ndarray, sizes: np.ndarray):
    """For each of the BANDS * ROWS orders the least hash of each run of `sizes` hashes, none empty."""
    starts = np.cumsum(sizes) - sizes
    flip, times = _odd(BANDS * ROWS, 1), _odd(BANDS * ROWS, 2)
    turned = np.empty_like(hashes)
    for k in range(BANDS * ROWS):
        np.bitwise_xor(hashes, flip[k], out=turned)
        np.multiply(turned, times[k], out=turned)
        yield np.minimum.reduceat(turned, starts)


def band_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of `sizes` distinct hashes, none empty, its bands: an array of runs x BANDS keys."""
    mix = _odd(BANDS, 3)
    keys = np.empty((len(sizes), BANDS), np.uint64)
    for k, least in enumerate(minhash(hashes, sizes)):
        band = k // ROWS
        key = np.full(len(sizes), mix[band]) if k % ROWS == 0 else keys[:, band]
        keys[:, band] = (key ^ least ^ (least >> np.uint64(29))) * mix[band]
        if k % ROWS == ROWS - 1:
            keys[:, band] ^= keys[:, band] >> np.uint64(32)
    return keys


def _sets(texts: list[str | None], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]:
    """The sorted shingle hashes of each text, their numbers, all of them in one array, and the hash of each set."""
    sets = [np.unique(np.array(shingle_hashes(t, width), np.uint64)) if t else np.empty(0, np.uint64) for t in texts]
    return sets, np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate([*sets, np.empty(0, np.uint64)]), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, fp, size, bands): 128-bit hash of the shingle set, fingerprint of the set, number of shingles, keys."""

    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            _, sizes, flat, marks = _sets(b.column(1).to_pylist(), width)
            full = sizes > 0
            keys = band_keys(flat, sizes[full]).view(np.int64).ravel() if len(flat) else np.empty(0, np.int64)
            ends = np.r_[0, np.cumsum(full * BANDS)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(marks, pa.binary()), pa.array(majority_bits(flat, sizes).view(np.int64)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))],
                names=["doc_id", "mark", "fp", "size", "bands"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, mark binary, fp long, size long, bands array<long>")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(mark, mins, shingles) of (text) with words: the whole sorted set as 64-bit hashes, and 16 bits of each MinHash value."""
    text_batches(texts.sparkSession)

    def run(batches):
        for b in batches:
            sets, sizes, flat, marks = _sets(b.column(0).to_pylist(), width)
            full = np.flatnonzero(sizes)
            mins = np.stack([m.astype("<u2") for m in minhash(flat, sizes[full])], 1) if len(full) else np.empty((0, BANDS * ROWS), "<u2")
            yield pa.RecordBatch.from_arrays(
                [pa.array([marks[k] for k in full], pa.binary()), pa.array([m.tobytes() for m in mins], pa.binary()), pa.array([sets[k].tobytes() for k in full], pa.binary())], names=["mark", "mins", "shingles"]
            )

    return texts.select("text").mapInArrow(run, "mark binary, mins binary, shingles binary")


def alike(one: bytes, other: bytes, similarity: float) -> bool:
    """Whether two sorted sets of 64-bit hashes have the similarity."""
    a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two sorted runs
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of those pairs (mark, node, mark_b, node_b) whose shingle sets have the similarity."""
    of_a, of_b = sets.select("mark", F.col("shingles").alias("x")), sets.select(F.col("mark").alias("mark_b"), F.col("shingles").alias("y"))
    both = pairs.join(of_a, "mark").join(of_b, "mark_b").select("node", "node_b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = [alike(x, y, similarity) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def cell_links(fp: np.ndarray, node: np.ndarray, size: np.ndarray, team: np.ndarray, band: np.ndarray, side: np.ndarray, mins: np.ndarray, shingles: np.ndarray, cell: np.ndarray, similarity: float):
    """Links (a, b) that join the teams of many cells' rows as all their links would: fewer than there are teams.

    Rows of one team do not meet. Two rows are compared in the cell of the first band that they share (mins tell), and there in
    the cell of their two parts (side: 0 if the cell is of one part, else 1 or 2). The largest team's rows come last."""
    _, inverse, counts = np.unique(cell, return_inverse=True, return_counts=True)
    order = np.lexsort((team, inverse))
    new = np.r_[True, (inverse[order][1:] != inverse[order][:-1]) | (team[order][1:] != team[order][:-1])]
    held = np.empty(len(node), np.int64)  # rows of the row's team in its cell
    run = np.diff(np.r_[np.flatnonzero(new), len(node)])
    held[order] = np.repeat(run, run)
    order = np.lexsort((team, held, inverse, -counts[inverse]))
    fp, node, size, band, side, shingles = fp.view(np.uint64)[order], node[order], size[order], band[order], side[order], shingles[order]
    mins = np.frombuffer(b"".join(mins[order]), "<u2").reshape(len(node), BANDS * ROWS)
    cell = inverse[order]
    _, team = np.unique(team[order], return_inverse=True)
    ends = np.flatnonzero(np.r_[cell[1:] != cell[:-1], True])
    largest = np.repeat(team[ends], np.diff(np.r_[-1, ends])) == team
    top = np.arange(team.max() + 1)
    a, b = [], []
    for i, j in near_rows(fp, cell, REACH, largest):
        fits = (top[team[i]] != top[team[j]]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[fits], j[fits]
        same = mins[i] == mins[j]
        fits = (same.sum(1) >= SHARED) & (same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band[i])
        for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
            one, other = top_of(top, team[x]), top_of(top, team[y])
            if one != other and alike(shingles[x], shingles[y], similarity):
                top[max(one, other)] = min(one, other)
                a.append(node[x])
                b.append(node[y])
        while (top[top] != top).any():
            top = top[top]
    return np.array(a, np.int64), np.array(b, np.int64)


def _few(df: DataFrame) -> DataFrame:
    """A settled table, marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every row of docs: component_id is the smallest id reachable over links.

    Texts without words (null, empty, blank) are copies of each other; a text with fewer words than a shingle is one shingle.
    A row with a null id takes no part in links unless rows with an id have its shingle set; else its component is null. Rows
    that repeat an id are one node. No rows in, no rows out.
    """
    prints = settle(sketches(docs, width, id_col, text_col))
    classes = settle(prints.where("doc_id is not null").groupBy("mark").agg(F.min_by(F.struct("fp", "size", "bands"), "doc_id").alias("s"), F.min("doc_id").alias("node")).select("mark", "node", "s.*"))
    rows = classes.select("mark", "fp", "node", "size", F.posexplode("bands").alias("band", "key"))
    shared = settle(rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("node", "mark", "fp", "size")).alias("lead")).where("n > 1").select("key", "lead"))
    keyed = settle(rows.join(_few(shared), "key"))
    ids = settle(keyed.select(F.col("node").alias("id")).distinct())
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(_few(ids), "id", "left_semi")
    sets = settle(shingle_sets(texts, width).groupBy("mark").agg(F.first("mins").alias("mins"), F.first("shingles").alias("shingles")))

    lead = F.col("lead")
    near = (F.bit_count(F.col("fp").bitwiseXOR(lead["fp"])) <= REACH) & (F.least("size", lead["size"]) >= similarity * F.greatest("size", lead["size"]) - 1e-9)
    pairs = keyed.where(near & (F.col("node") != lead["node"])).groupBy("mark", "node").agg(F.min("lead").alias("lead"))
    links = settle(checked(pairs.select("mark", "node", lead["mark"].alias("mark_b"), lead["node"].alias("node_b")), sets, similarity))

    teams = keyed.drop("lead").join(_few(settle(components(links))), "node", "left").withColumn("team", F.coalesce("component", "node"))
    mixed = teams.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("team").alias("low"), F.max("team").alias("high")).where("low < high")
    parts = F.ceil(F.greatest(F.col("n") / CELL, F.col("shingles") * 8 / PART_BYTES)).cast("int")
    dealt = in_parts(teams.join(_few(settle(mixed.select("key", parts.alias("parts")))), "key"), "key")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = dealt.select("mark", "fp", "node", "size", "team", "band", side.alias("side"), "cell").join(sets, "mark")
    met = by_cells(dealt.select("fp", "node", "size", "team", "band", "side", "mins", "shingles", "cell"), lambda *columns: cell_links(*columns, similarity))
    links = links.union(met)
    groups = components(links)
    named = classes.join(groups, "node", "left").select("mark", F.coalesce("component", "node").alias("component_id"))
    return prints.select("doc_id", "mark").join(named, "mark", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group, all columns kept. Rows with a null id stay, as do all rows
    that repeat a kept id."""
    others = near_groups(docs, width, similarity, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("other")).distinct()
    return docs.join(others, docs[id_col] == others["other"], "left_anti")
