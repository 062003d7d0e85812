"""Nearest neighbours by additive quantisation.

A vector is coded as a sum of one entry from each of several full-dimensional codebooks. Codebooks start as residual
k-means on a bounded sample and are then refitted together by least squares; encoding is a beam search over the codebooks. What
the entries leave is coded by one step along each axis, of the row's own size. A query's inner products with all entries form a
table; a code's score is a sum of looked-up values and of the query's steps, for Euclidean distances less half the stored norm.

A code also stores the norm of what it still leaves, which bounds how far a score can be off. So a row stays in the list of a query
unless k others are surely nearer: on rows that codebooks fit badly, and among many near copies, lists grow and no neighbour is lost.
The lists are ranked by the exact measure of the original vectors.

Queries meet codes in blocks: a block of up to QUERIES queries is in memory while the codes stream by, so codes are shuffled
once for each such block and not once for each query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle

#: Queries that share one pass over codes at most, and at least where tasks are too few for the cores; codes that one task of a
#: pass reads at most. Matters of cost; any choice gives the same rows.
QUERIES, FEWEST, CODES = 4096, 256, 1 << 17
#: Rows that are coded at once; norms that single precision can square.
CHUNK, LARGE = 2048, 1e15


@dataclass
class Books:
    """books: (codebook, entry, dimension)."""

    books: np.ndarray
    beam: int = 4

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of the rows of x: at each codebook the `beam` partial sums nearest to the vector go on."""
        m, k, d = self.books.shape
        n = len(x)
        norms = (self.books**2).sum(2)
        residual, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for b in range(m):
            cost = norms[b] - 2 * residual @ self.books[b].T + (residual**2).sum(2)[:, :, None]
            keep = min(self.beam if b < m - 1 else 1, cost.shape[1] * k)
            at = np.argpartition(cost.reshape(n, -1), keep - 1, axis=1)[:, :keep]
            from_, entry = at // k, at % k
            rows = np.arange(n)[:, None]
            residual = residual[rows, from_] - self.books[b][entry]
            codes = np.concatenate([codes[rows, from_], entry[..., None].astype(np.uint8)], axis=2)
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[b][codes[:, b]] for b in range(len(self.books)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def fit(x: np.ndarray, codebooks: int = 32, entries: int = 64, beam: int = 4, rounds: int = 2, seed: int = 7) -> Books:
    """Codebooks from sample rows x. Fewer rows than entries make for repeated entries; no rows for zeros."""
    rng, (n, d) = np.random.default_rng(seed), x.shape
    if not n:
        return Books(np.zeros((codebooks, entries, d), np.float32), beam)
    residual, found = x.astype(np.float32), []
    for _ in range(codebooks):
        c = _kmeans(residual, entries, rng)
        found.append(c)
        residual = residual - c[np.argmin((c**2).sum(1) - 2 * residual @ c.T, axis=1)]
    out = Books(np.stack(found), beam)
    for _ in range(rounds):
        codes = np.concatenate([out.encode(x[i : i + 512]) for i in range(0, n, 512)])
        flat = codes.astype(np.int64) + entries * np.arange(codebooks)
        gram, right = np.zeros((codebooks * entries,) * 2), np.zeros((codebooks * entries, d))
        for b in range(codebooks):
            np.add.at(right, flat[:, b], x)
            for c in range(codebooks):
                np.add.at(gram, (flat[:, b], flat[:, c]), 1.0)
        gram[np.diag_indices_from(gram)] += 0.1
        right += 0.1 * out.books.reshape(-1, d)  # entries that are not used stay where they are
        out = Books(np.linalg.solve(gram, right).reshape(codebooks, entries, d).astype(np.float32), beam)
    return out


def usable(vector: Column, d: int | None = None) -> Column:
    """True for vectors that are not null, have no null or non-finite component, and are not all zero (and have d components)."""
    ok = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0), F.lit(False))
    return ok if d is None else ok & (F.size(vector) == d)


def _steps(x: np.ndarray, books: Books) -> tuple[np.ndarray, ...]:
    """(codes, steps, size of a step, error, half) of rows x: a query's product with a row is off by at most its norm times the error,
    rounding of single precision included. Rows too large for single precision have an infinite error. half is half the squared norm."""
    m, _, d = books.books.shape
    fits = np.sqrt((x**2).sum(1)) < LARGE
    safe = np.where(fits[:, None], x, 0)
    codes = np.concatenate([books.encode(safe[i : i + 512].astype(np.float32)) for i in range(0, len(x), 512)])
    left, spent = safe.copy(), np.zeros(len(x))
    for b in range(m):
        entries = books.books[b].astype(float)[codes[:, b]]
        left -= entries
        spent += np.sqrt((entries**2).sum(1))
    size = (np.abs(left).max(1) / 127).astype(np.float32)
    steps = np.rint(left / np.where(size > 0, size, 1)[:, None].astype(float)).clip(-127, 127).astype(np.int8)
    coarse = steps * size[:, None].astype(float)
    error = np.sqrt(((left - coarse) ** 2).sum(1)) + (d + m + 8) * 2.0**-22 * (spent + np.sqrt((coarse**2).sum(1)))
    return codes, steps, size, np.where(fits, error, np.inf).astype(np.float32) * np.float32(1.000001), (x**2).sum(1) / 2


def search(vectors: DataFrame, queries: Column, k: int = 20, shortlist: int = 400, sample: int = 16_384, codebooks: int = 32, id_col: str = "vec_id", vec_col: str = "embedding", measure: str = "product") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row of `queries`, itself left out; by inner product, or with
    `measure` "distance" by the Euclidean distance, whose negative is the score then.

    Vectors that are not usable, and rows with a null id, take no part; of vectors of several lengths those of the most frequent
    one do (ties: the longer). Ties of score go to the smaller id. Rows that repeat an id count as one candidate each,
    but never for a query of the same id. Codebooks learn from at most `sample` rows; every row is coded and scored, but of equal vectors only
    the k + 1 smallest ids, as no others can be in a result. A task that holds `shortlist` rows for each of its queries sifts them, and
    puts out those that may still be neighbours. No usable rows in, no rows out.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), queries.alias("asks"))
    lengths = rows.where(usable(F.col("v"))).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = lengths["d"], lengths["count"]
    rows = rows.where(usable(F.col("v"), d))
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    seen = np.array([r.v for r in some], float).reshape(-1, d)
    kept = spark.sparkContext.broadcast(fit(seen[np.sqrt((seen**2).sum(1)) < LARGE].astype(np.float32), codebooks))
    fields = ("codes", "steps", "sizes", "errors", "halves")

    def code(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
            for i in range(0, len(x), CHUNK):
                ids = b.column(0).slice(i, CHUNK).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), *[pa.array([v.tobytes()]) for v in _steps(x[i : i + CHUNK], kept.value)]], names=["ids", *fields])

    firsts = rows.select("id", "v").withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    coded = settle(firsts.select("id", "v").mapInArrow(code, "ids array<long>, " + ", ".join(f"{c} binary" for c in fields)))
    asked = rows.where("asks").select("id", "v")
    n_asked = asked.count()
    groups = -(-n // CODES)
    spread = min(-(-n_asked // FEWEST), -(-2 * spark.sparkContext.defaultParallelism // groups))
    blocks = max(-(-n_asked // QUERIES), spread, 1)
    every = lambda upto: F.explode(F.sequence(F.lit(0), F.lit(upto - 1)))
    block_rows = (
        asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("items"))
        .select("block", every(groups).alias("part"), F.lit(0).alias("kind"), F.col("items.id").alias("ids"), F.flatten("items.v").alias("v"), *[F.lit(None).cast("binary").alias(c) for c in fields])
    )
    code_rows = coded.select(every(blocks).alias("block"), F.pmod(F.hash(F.get("ids", F.lit(0))), F.lit(groups)).cast("int").alias("part"), F.lit(1).alias("kind"), "ids", F.array().cast(rows.schema["v"].dataType).alias("v"), *fields)
    far = measure == "distance"

    def pass_over(batches):
        now, ids, tables, held = None, None, None, []

        def out():
            q, c = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            return pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c)], names=["query_id", "vec_id"])

        def sifted():
            got = [np.concatenate(v) for v in zip(*held, strict=True)] if held else [np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.float32)]
            may = got[2] >= least[got[0]]
            return [tuple(v[may] for v in got)]

        for b in batches:
            for block, part, kind, row_ids, v, *coded_rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 0:
                    if now is not None:
                        held = sifted()
                        yield out()
                    now, ids, held = (block, part), np.array(row_ids, np.int64), []
                    asked_x = np.array(v, float).reshape(-1, d)
                    q = asked_x.astype(np.float32)
                    length = (np.sqrt((asked_x**2).sum(1)) * 1.000001).astype(np.float32)
                    tables = np.einsum("qd,mkd->mqk", q, kept.value.books, optimize=True)
                    # surest: lower bounds of the k surely nearest; least: what an upper bound must reach
                    surest, least = np.empty((len(ids), 0), np.float32), np.full(len(ids), -np.inf, np.float32)
                elif now == (block, part):
                    all_i = np.array(row_ids, np.int64)
                    all_c, all_s = (np.frombuffer(x, t).reshape(len(all_i), -1) for x, t in zip(coded_rows[:2], (np.uint8, np.int8), strict=True))
                    all_z, all_e, all_h = (np.frombuffer(x, t) for x, t in zip(coded_rows[2:], (np.float32, np.float32, np.float64), strict=True))
                    wide = max(256, (1 << 22) // max(len(ids), 1))
                    for i in range(0, len(all_i), wide):
                        c, at, half = all_c[i : i + wide], all_i[i : i + wide], all_h[i : i + wide]
                        s = tables[0][:, c[:, 0]]
                        for m in range(1, codebooks):
                            s += tables[m][:, c[:, m]]
                        with np.errstate(invalid="ignore", over="ignore"):
                            s += q @ (all_s[i : i + wide].astype(np.float32) * all_z[i : i + wide, None]).T
                            off = np.multiply.outer(length, all_e[i : i + wide]) + np.float32(1e-37)
                            if far:
                                s -= half.astype(np.float32)
                                off += (half * 2.0**-21).astype(np.float32)
                            unsure = ~(np.isfinite(s) & np.isfinite(off))
                            low, high = np.where(unsure, -np.inf, s - off), np.where(unsure, np.inf, s + off)
                        own = ids[:, None] == at[None, :]
                        low[own] = -np.inf
                        surest = np.concatenate([surest, low], 1)
                        if surest.shape[1] > k:
                            surest = -np.partition(-surest, k - 1, axis=1)[:, :k]
                        if surest.shape[1] == k:
                            least = surest.min(1)
                        r, col = np.nonzero((high >= least[:, None]) & ~own)
                        held.append((r, at[col], high[r, col]))
                        if sum(len(h[0]) for h in held) > shortlist * len(ids):
                            held = sifted()
                            if len(held[0][0]) > shortlist * len(ids) / 2:
                                yield out()
                                held = []
        if now is not None:
            held = sifted()
            yield out()

    near = block_rows.unionByName(code_rows).repartition(blocks * groups, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(pass_over, "query_id long, vec_id long").distinct()
    total = lambda f: F.aggregate(F.zip_with("qv", "v", lambda a, b: f(a.cast("double"), b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    exact = -F.sqrt(total(lambda a, b: (a - b) * (a - b))) if far else total(lambda a, b: a * b)
    scored = (
        near.join(rows.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        .select("query_id", "vec_id", exact.alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
