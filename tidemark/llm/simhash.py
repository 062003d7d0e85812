"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked by bit-sliced comparison.

Fingerprints that differ in at most r bits agree on at least m - r of m blocks. Each choice of m - r blocks is a table;
rows of one table that agree on its blocks form a cell. Cells that hold many rows are cut into parts, and every two parts
meet in a cell of their own, so no task gets an unbounded cell. Inside a task the fingerprints' bits are stored as planes,
64 rows to a word; rows at a fixed offset from each other are compared 64 at a time, with counters that carry from plane
to plane, and words in which no pair is near any more are left out of the remaining planes.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import settle, text_batches
from tidemark.llm.components import components

#: Rows of a cell that one task compares with each other; cells with more rows are cut into parts.
CELL = 4096
#: Rows whose planes are in memory at once, and bytes of what rows bring along.
CHUNK, CHUNK_BYTES = 1 << 16, 32 << 20
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64, seed 42, of each run of `width` words (lower case for A-Z); of all words if they are fewer; none for none."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else []
    h = xxhash.xxh64_intdigest
    return [h(s, 42) for s in map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of `sizes` hashes: bits that are set in over half of them. An empty run gives 0."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    starts = np.cumsum(n) - n
    parts = -(-n // 255)  # a lane of 8 bits holds a count up to 255
    first = np.cumsum(parts) - parts
    at = np.repeat(starts - 255 * first, parts) + 255 * np.arange(parts.sum())
    fingerprints = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, at).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for byte in range(8):
            fingerprints |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = fingerprints
    return out


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A text without words, a null or an empty one has 0."""

    text_batches(docs.sparkSession)
    def run(batches):
        for b in batches:
            hashes = [shingle_hashes(t, width) if t else [] for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter(itertools.chain.from_iterable(hashes), np.uint64, int(sizes.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(majority_bits(flat, sizes).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_rows(fp: np.ndarray, cell: np.ndarray, radius: int, done: np.ndarray | None = None):
    """Pairs of rows (i, j arrays, one offset at a time) of one cell whose fingerprints differ in at most `radius` bits.
    Rows of a cell must lie together, cells in descending size. Rows marked `done` do not meet the rows after them."""
    n = len(fp)
    new = np.r_[True, cell[1:] != cell[:-1]]
    starts = np.flatnonzero(new)
    size = np.diff(np.r_[starts, n])
    left = np.repeat(size, size) - (np.arange(n) - np.repeat(starts, size)) - 1  # rows of the cell after this one
    if done is not None:
        left[done] = 0
    words = -(-n // 64)
    most = int(size.max(initial=1)) - 1
    padded = np.zeros((words + most // 64 + 2) * 64, np.uint64)
    padded[:n] = fp
    planes = np.empty((64, len(padded) // 64), np.uint64)
    for k in range(64):
        bits = ((padded >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
        planes[k] = np.packbits(bits, bitorder="little").view(np.uint64)
    planes = planes[[k for s in range(16) for k in range(s, 64, 16)]]  # bits of all blocks early
    levels = radius.bit_length()
    until = np.cumsum(size)
    for d in range(1, most + 1):
        active = int(until[np.searchsorted(-size, -d) - 1])
        ok = np.packbits(np.pad(left[:active] >= d, (0, -active % 64)), bitorder="little").view(np.uint64)
        w = np.flatnonzero(ok)
        over = ~ok[w]
        count = [np.zeros(len(w), np.uint64) for _ in range(levels)]
        q, r = divmod(d, 64)
        for g in range(0, 64, 8):
            for plane in planes[g : g + 8]:
                far = plane[w + q]
                if r:
                    far = (far >> np.uint64(r)) | (plane[w + q + 1] << np.uint64(64 - r))
                carry = plane[w] ^ far
                for level in range(levels):
                    count[level], carry = count[level] ^ carry, count[level] & carry
                over |= carry
            keep = over != FULL
            if not keep.all():
                w, over, count = w[keep], over[keep], [c[keep] for c in count]
                if not len(w):
                    break
        if not len(w):
            continue
        more, same = np.zeros(len(w), np.uint64), np.full(len(w), FULL)
        for level in reversed(range(levels)):  # count > radius, bit by bit
            wanted = FULL if radius >> level & 1 else np.uint64(0)
            more |= same & count[level] & ~wanted
            same &= ~(count[level] ^ wanted)
        hits = ~(over | more)
        bits = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        i = w[at] * 64 + bit
        yield i, i + d


def top_of(top: np.ndarray, x: int) -> int:
    """The root of x in a forest of parents, with the way there halved."""
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def forest(fp: np.ndarray, node: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) that connect what near_rows finds; not more than there are rows."""
    _, inverse, counts = np.unique(cell, return_inverse=True, return_counts=True)
    order = np.lexsort((node, inverse, -counts[inverse]))
    fp, node, cell = fp[order], node[order], inverse[order]
    top = np.arange(len(fp))
    for i, j in near_rows(fp, cell, radius):
        apart = np.flatnonzero(top[i] != top[j])
        for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True):
            x, y = top_of(top, x), top_of(top, y)
            if x != y:
                top[max(x, y)] = min(x, y)
        while (top[top] != top).any():
            top = top[top]
    moved = np.flatnonzero(top != np.arange(len(fp)))
    return node[moved], node[top[moved]]  # rows of a cell lie in the order of their nodes


def blocks_for(rows: int, radius: int) -> int:
    """How many blocks: enough that a cell holds about one unrelated row. A matter of cost; any choice finds all links."""
    m = radius + 1
    while 64 * (m - radius) // m < np.log2(max(rows, 2)) - 2 and m < radius + 4:
        m += 1
    return m


def near_edges(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between nodes of `classes` (fp long, node long) that connect all pairs within `radius` bits."""
    m = blocks_for(classes.count(), radius)
    edges = np.linspace(0, 64, m + 1).astype(int)
    keys = []
    for t, chosen in enumerate(itertools.combinations(range(m), m - radius)):
        mask = sum((1 << int(edges[k + 1])) - (1 << int(edges[k])) for k in chosen)
        keys.append(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    rows = classes.select("fp", "node", F.explode(F.array(*keys)).alias("key")).select("fp", "node", "key.t", "key.bits")
    large = rows.groupBy("t", "bits").count().where(F.col("count") > CELL).select("t", "bits", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    dealt = in_parts(rows.join(large, ["t", "bits"], "left"), "t", "bits").select("fp", "node", "cell")
    return by_cells(dealt, lambda fp, node, cell: forest(fp.view(np.uint64), node, cell, radius))


def in_parts(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows (fp, parts, keys and others) with a column cell: a key's rows are dealt into its parts, every two parts meet
    in a cell. Null parts mean one."""
    return (
        rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp", "node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("cell", F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")))
    )


def by_cells(dealt: DataFrame, work) -> DataFrame:
    """(a, b) from `work` over whole cells: it takes the columns of `dealt`, the cell last, as arrays of many cells at a time."""

    def run(batches):
        kept: list[tuple] = []
        held = 0

        def out(final: bool):
            nonlocal kept, held
            if not kept:
                return None
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            cell = columns[-1]
            cut = len(cell) if final else int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            kept, held = [] if cut == len(cell) else [tuple(c[cut:] for c in columns)], 0
            a, b = work(*(c[:cut] for c in columns)) if cut else (cell[:0], cell[:0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            kept.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            held += batch.nbytes
            if sum(len(x[0]) for x in kept) >= CHUNK or held >= CHUNK_BYTES:
                yield out(False)
        if last := out(True):
            yield last

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest id reachable over links.

    Texts without words share fingerprint 0 and are linked like any others. A row with a null id has a fingerprint but
    takes no part in links unless rows with an id share its fingerprint; else its component is null. Rows that repeat an
    id are one node. No rows in, no rows out.
    """
    prints = settle(fingerprints(docs, width, id_col, text_col))
    classes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    groups = components(near_edges(classes.where("node is not null"), radius))
    named = classes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
