"""Exact nearest neighbours by boxes.

Items are dealt into cells by nested cuts at medians of a sample; a cell knows the box around its items. Items first meet those of
their own cell. The distance of the k-th found there bounds where nearer ones can be: only in cells whose box comes that close, and
only these are asked in a second round. In a task the same is done once more with small leaves, so that most pairs are never compared.
A row of items carries its list, so what travels is one row for each item and cell asked.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.bucketed import stored

#: Items of a cell, about.
BLOCK = 32768
#: Rows of the sample for each cell.
SAMPLE = 32
#: Items that a step in a task compares with.
LEAF = 256
#: Items asked at a time in a task.
CHUNK = 8192
#: What rounding may add to a bound.
SLACK = 1e-9
LIST = "array<struct<distance: double, neighbour: string>>"
PLACED = "item string, apart string, x array<double>, cell int"
FIRST = f"{PLACED}, limit double, found {LIST}"


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row and feature by feature, so that a distance does not depend on what else is in the block."""
    d = np.zeros(len(x))
    for f in range(x.shape[1]):
        d += (x[:, f] - y[:, f]) ** 2
    return np.sqrt(d)


def _to_boxes(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The distance of each row to each box, 0 inside."""
    d = np.zeros((len(x), len(low)))
    for f in range(x.shape[1]):
        out = np.maximum(low[:, f] - x[:, f, None], x[:, f, None] - high[:, f])
        d += np.maximum(out, 0, out=out) ** 2
    return np.sqrt(d)


def _leaves(x: np.ndarray) -> list[np.ndarray]:
    """Rows in leaves of at most LEAF, by halves along the feature that varies most."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        f, half = np.ptp(x[rows], axis=0).argmax(), len(rows) // 2
        order = np.argpartition(x[rows, f], half)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return done


def _first_k(r: np.ndarray, d: np.ndarray, c: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates (row, distance, place) the first k of each row by distance and place, as two tables filled up with infinity."""
    order = np.lexsort((c, d, r))
    r, d, c = r[order], d[order], c[order]
    at = np.arange(len(r)) - np.searchsorted(r, r)
    kept = at < k
    best, place = np.full((rows, k), np.inf), np.full((rows, k), np.iinfo(np.int64).max)
    best[r[kept], at[kept]], place[r[kept], at[kept]] = d[kept], c[kept]
    return best, place


def nearest(x: np.ndarray, kind: np.ndarray, limit: np.ndarray, of: np.ndarray, kinds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places) of the k nearest rows of `of`, of another kind and no farther than limit, for each row of x; ties go to the
    smaller place, infinity where there are fewer.

    Pairs are looked through by squares and products; those that can count are measured exactly.
    """
    best, place = np.full((len(x), k), np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
    leaves = _leaves(of)
    low, high = (np.array([side(of[rows], axis=0) for rows in leaves]) for side in (np.min, np.max))
    squares, own = (of * of).sum(1), (x * x).sum(1)
    eps = 8 * (x.shape[1] + 4) * np.finfo(float).eps

    def visit(rows: np.ndarray, leaf: np.ndarray) -> None:
        y = of[leaf]
        error = eps * (own[rows, None] + squares[leaf]) + np.finfo(float).tiny
        g = own[rows, None] + squares[leaf] - 2 * (x[rows] @ y.T) - error
        g[kind[rows, None] == kinds[leaf]] = np.inf
        bound = np.minimum(limit[rows], best[rows, -1])
        bound = bound * bound * (1 + SLACK)
        if not np.isfinite(bound).all() and len(leaf) > k:
            bound = np.fmin(bound, (np.partition(g + 2 * error, k - 1, axis=1))[:, k - 1] * (1 + SLACK))
        r, c = np.nonzero(~(g > bound[:, None]) & (g != np.inf))
        d, c = _distances(x[rows[r]], y[c]), leaf[c]
        last, tie = best[rows[r], -1], place[rows[r], -1]
        good = (d <= limit[rows[r]]) & ((d < last) | ((d == last) & (c < tie))) & np.isfinite(d)
        if good.any():
            hit, r = np.unique(r[good], return_inverse=True)
            more, where = _first_k(r, d[good], c[good], len(hit), k)
            more, where = np.concatenate([best[rows[hit]], more], axis=1), np.concatenate([place[rows[hit]], where], axis=1)
            order = np.lexsort((where, more), axis=1)[:, :k]
            best[rows[hit]], place[rows[hit]] = np.take_along_axis(more, order, 1), np.take_along_axis(where, order, 1)

    for i in range(0, len(x) if leaves else 0, CHUNK):
        with np.errstate(over="ignore", invalid="ignore"):
            apart = _to_boxes(x[i : i + CHUNK], low, high)
            reach = lambda: np.minimum(limit[i : i + CHUNK], best[i : i + CHUNK, -1]) * (1 + SLACK) + SLACK
            for _ in range(min(3, len(leaves))):  # each row's nearest leaves first, for a near bound
                first, now = apart.argmin(1), apart.min(1) <= reach()
                for j in np.unique(first[now]):
                    visit(i + np.flatnonzero(now & (first == j)), leaves[j])
                apart[np.arange(len(first)), first] = np.nan_to_num(np.inf)
            for j, leaf in enumerate(leaves):
                rows = np.flatnonzero((apart[:, j] <= reach()) & (apart[:, j] < np.nan_to_num(np.inf)))
                if len(rows):
                    visit(i + rows, leaf)
    return best, place


def _answers(asked: pa.Table, given: pa.Table, k: int, width: int) -> tuple[np.ndarray, pa.Array]:
    """(how far the k-th is, infinity if there are fewer; lists of (distance, neighbour)) for rows asked, which may have a limit."""
    given = given.sort_by("item")
    both = pa.chunked_array([*asked["apart"].chunks, *given["apart"].chunks], pa.string()).combine_chunks()
    kinds = both.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    limit = asked["limit"].to_numpy() if "limit" in asked.column_names else np.full(len(asked), np.inf)
    best, place = nearest(_matrix(asked["x"], width), kinds[: len(asked)], limit, _matrix(given["x"], width), kinds[len(asked) :], k)
    has = np.isfinite(best)
    at = np.concatenate([[0], has.sum(1).cumsum()]).astype(np.int32)
    names = given["item"].combine_chunks().take(pa.array(place[has]))
    pairs = pa.StructArray.from_arrays([pa.array(best[has]), names], ["distance", "neighbour"])
    return best[:, -1], pa.ListArray.from_arrays(pa.array(at), pairs)


def _cuts(points: np.ndarray, cells: int) -> tuple[np.ndarray, ...]:
    """(feature, value, cell or -1, the node of smaller and of larger ones) by node: the points cut into about equal cells. A cell whose points
    are all the same is not cut."""
    nodes: list[list] = []
    cell = 0

    def grow(rows: np.ndarray, cells: int) -> int:
        nonlocal cell
        me = len(nodes)
        nodes.append([0, 0.0, -1, 0, 0])
        part = points[rows]
        for f in np.argsort(-part.std(axis=0), kind="stable") if cells > 1 and len(rows) > 1 else ():
            values = np.sort(part[:, f])
            cut = values[max(len(rows) * (cells // 2) // cells, 1) - 1]
            if cut == values[-1]:
                cut = values[max(np.searchsorted(values, cut) - 1, 0)]
            under = part[:, f] <= cut
            if under.any() and not under.all():
                left = min(max(round(cells * under.mean()), 1), cells - 1)
                nodes[me][:2] = [f, cut]
                nodes[me][3:] = [grow(rows[under], left), grow(rows[~under], cells - left)]
                return me
        nodes[me][2] = cell
        cell += 1
        return me

    grow(np.arange(len(points)), cells)
    return tuple(np.array(c) for c in zip(*nodes, strict=True))


def placed_items(rows: DataFrame, width: int, block: int = BLOCK) -> tuple[DataFrame, range]:
    """(rows (item, apart, x) with their cell, all cells). The cuts are of the rows whose hashes are smallest, a bounded number for each cell;
    only these reach the driver. A cell of more than two blocks, as only copies of one make, is dealt into several by hash."""
    cells = max(-(-rows.count() // block), 1)
    chosen = rows.orderBy(F.xxhash64("item"), "item").limit(SAMPLE * cells).select("x").collect() if cells > 1 else []
    feature, value, leaf, under, over = _cuts(np.array([r.x for r in chosen]).reshape(-1, width), cells)

    def run(batches):
        for b in batches:
            x, node = _matrix(b.column("x"), width), np.zeros(b.num_rows, dtype=np.int64)
            while (inner := np.flatnonzero(leaf[node] < 0)).size:
                n = node[inner]
                node[inner] = np.where(x[inner, feature[n]] <= value[n], under[n], over[n])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf[node].astype(np.int32))], names=[*b.schema.names, "cell"])

    placed = rows.mapInArrow(run, PLACED)
    if cells == 1:
        return placed, range(1)
    sizes = dict(sorted(tuple(r) for r in placed.groupBy("cell").count().collect()))  # a row a cell
    parts = {c: round(n / block) if n > 2 * block else 1 for c, n in sizes.items()}
    start = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    dealt = F.broadcast(rows.sparkSession.createDataFrame([(c, start[c], n) for c, n in parts.items()], "cell int, start int, parts int"))
    own = (F.col("start") + F.pmod(F.xxhash64("item"), F.col("parts"))).cast("int")
    return placed.join(dealt, "cell").select("item", "apart", "x", own.alias("cell")), range(sum(parts.values()))


def _met(asked: DataFrame, given: DataFrame, k: int, width: int, block: int, asks: DataFrame | None = None) -> DataFrame:
    """Rows asked with `found`, their lists from those given in the same cell, and the limit, the distance of a list's k-th. Where all are asked
    for their own cell, a cell is one group; else those who ask a cell (asks: (cell, n), how many) are dealt into parts of about four blocks, and
    the cell meets each part in a task; lists without anyone are left out."""
    if asked is given:

        def own(rows: pa.Table) -> pa.Table:
            limit, found = _answers(rows, rows, k, width)
            return rows.select(["item", "apart", "x", "cell"]).append_column("limit", pa.array(limit)).append_column("found", found)

        return given.groupBy("cell").applyInArrow(own, FIRST)
    sizes = (asked.groupBy("cell").agg(F.count("*").alias("n")) if asks is None else asks).collect()  # a row a cell
    parts = F.broadcast(asked.sparkSession.createDataFrame([(r.cell, max(round(r.n / (4 * block)), 1)) for r in sizes], "cell int, parts int"))
    questions = asked.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int")).drop("parts")
    answers = given.select("item", "apart", "x", "cell").join(parts, "cell").select("item", "apart", "x", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(questions: pa.Table, rows: pa.Table) -> pa.Table:
        limit, found = _answers(questions, rows, k, width)
        met = questions.select(["item", "apart", "x", "cell"]).append_column("limit", pa.array(limit)).append_column("found", found)
        return met.filter(pa.array(np.diff(found.offsets.to_numpy()) > 0))

    return questions.groupBy("cell", "part").cogroup(answers.groupBy("cell", "part")).applyInArrow(run, FIRST)


def cells_in_reach(placed: DataFrame, found: DataFrame, cells: range, k: int, width: int, count: bool = False) -> DataFrame:
    """(item, apart, x, limit, cell): every other cell that can hold a neighbour nearer than, or as near as, the k-th of `found`; count: only
    (cell, n), how many ask it.

    A cell's items are no nearer than its box. Items with fewer than k found may have neighbours in any cell.
    """
    sides = [side(F.col("x")[f]) for side in (F.min, F.max) for f in range(width)]
    boxes = np.full((len(cells), 2, width), np.inf)
    for cell, *side in placed.groupBy("cell").agg(*sides).collect():  # a row a cell
        boxes[cell] = np.array(side).reshape(2, width)
    low, high = boxes[:, 0], boxes[:, 1]
    schema = "cell int, n long" if count else "item string, apart string, x array<double>, limit double, cell int"

    def run(batches):
        for b in batches:
            limit = b.column("limit").to_numpy()
            for i in range(0, b.num_rows, 1024):
                part, own = b.slice(i, 1024), b.column("cell").to_numpy()[i : i + 1024]
                apart = _to_boxes(_matrix(part.column("x"), width), low, high)
                r, c = np.nonzero((apart <= limit[i : i + 1024, None] * (1 + SLACK) + SLACK) & (np.arange(len(low)) != own[:, None]))
                if count:
                    asked, n = np.unique(c, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(asked.astype(np.int32)), pa.array(n.astype(np.int64))], names=["cell", "n"])
                else:
                    picked = part.select(["item", "apart", "x", "limit"]).take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(c.astype(np.int32))], names=["item", "apart", "x", "limit", "cell"])

    reached = found.drop("found").mapInArrow(run, schema)
    return reached.groupBy("cell").agg(F.sum("n").alias("n")) if count else reached


def knn_neighbours(features: DataFrame, columns: Sequence[str], k: int = 5, block: int = BLOCK, apart: str = "item") -> DataFrame:
    """(item, neighbour, distance, rank) of the k nearest others by Euclidean distance; ties go to the smaller item.

    apart: rows alike in this column are no neighbours; by default only the item itself is not. Rows with a null or non-finite
    feature have no neighbours and are none. Items count once each; fewer than k others give fewer rows, no items none.
    """
    width = len(columns)
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = features.select(F.col("item").cast("string").alias("item"), F.col(apart).cast("string").alias("apart"), x.alias("x"))
    rows = stored(rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))))
    placed, cells = placed_items(rows, width, block)
    found = _met(placed, placed, k, width, block)
    if len(cells) > 1:
        first = stored(found)
        asks = cells_in_reach(first, first, cells, k, width, count=True)
        others = _met(cells_in_reach(first, first, cells, k, width), first, k, width, block, asks)
        both = first.select("item", "found").unionByName(others.select("item", "found"))
        found = both.groupBy("item").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    return found.select("item", F.posexplode("found").alias("at", "n")).select("item", "n.neighbour", "n.distance", (F.col("at") + 1).alias("rank"))
