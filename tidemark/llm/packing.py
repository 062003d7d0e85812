"""Best-fit packing of tokenised documents into training sequences with several capacities.

Pieces of the same length are alike, so the plan is made over the counts by length, of which there are as many as a
sequence has tokens at most, however many documents there are: lengths in descending order go, many pieces at a time, into the
open sequences (kept as groups of like ones) that fit best. The plan is a list of runs: the pieces of one length with
ranks from x to y go, one each, into consecutive sequences at one offset. Pieces get their ranks by counts per salt,
never by one sort over a length that many pieces share.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import salts, settle, text_batches
from tidemark.llm.tokens import Splitter, parse_ranks, read_ranks

#: How many pieces of text one Python worker remembers, in two generations.
MAX_PIECES = 400_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most. attention: the sum of squared piece lengths. Defaults for documents and attention
    never bind before tokens do; lower ones do."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def sizes(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length])

    def most(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention])


def plan(counts: dict[int, int], cap: Capacity = Capacity(), by: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, rank from, rank until, first sequence, offset) and the number of sequences.

    by="norm": the open sequences whose weighted residual is smallest after the piece went in; by="dot": those with the largest
    weighted product of residual and piece. Capacities count as shares. Every constraint holds for every sequence.
    Ties go to the sequences opened first. A piece that fits no empty sequence is an error.
    """
    most = cap.most()
    w = np.array(weights)
    room = np.empty((0, 3), np.int64)  # what is left, by group of like sequences
    many, first = np.empty(0, np.int64), np.empty(0, np.int64)
    runs, opened = [], 0
    for length in sorted((x for x, c in counts.items() if c), reverse=True):
        size, left, rank = cap.sizes(length), counts[length], 0
        if (size > most).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((room >= size).all(axis=1))
            if len(fits):
                share = room[fits] / most
                score = -((w * (share - size / most) ** 2).sum(axis=1)) if by == "norm" else (w * share * size / most).sum(axis=1)
                g = int(fits[np.argmax(score)])
            else:
                each = int((most // size).min())
                g, new = len(many), -(-left // each)
                room = np.vstack([room, most])
                many, first = np.append(many, new), np.append(first, opened)
                opened += new
            take = min(left, int(many[g]))
            runs.append((length, rank, rank + take, int(first[g]), int(cap.tokens - room[g, 0])))
            if take < many[g]:  # the rest of the group stays as it was
                room = np.vstack([room, room[g]])
                many, first = np.append(many, many[g] - take), np.append(first, first[g] + take)
                many[g] = take
            room[g] = room[g] - size
            left, rank = left - take, rank + take
        open_ = room[:, :2].min(axis=1) > 0
        room, many, first = room[open_], many[open_], first[open_]
    return runs, opened


def best_plan(counts: dict[int, int], cap: Capacity = Capacity()) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan with fewer sequences of the two selection rules."""
    return min((plan(counts, cap, by) for by in ("norm", "dot")), key=lambda p: p[1])


class Encoder:
    """Ids as the JSON tokenizer gives them, without added special tokens; its one special string in a text is one id."""

    def __init__(self, ranks: bytes, pattern: str, special: tuple[str, int]):
        import tiktoken

        table = parse_ranks(ranks)
        self.one = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.split, self.special = Splitter(pattern), special
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        if len(self.young) >= MAX_PIECES:
            self.old, self.young = self.young, {}
        got = self.old.get(p)
        self.young[p] = got = np.array(self.one(p), "<u4").tobytes() if got is None else got
        return got

    def plain(self, text: str) -> bytes:
        pieces = self.split(text)
        got = list(map(self.young.get, pieces))
        if None in got:
            got = [self.piece(p) if g is None else g for p, g in zip(pieces, got, strict=True)]
        return b"".join(got)

    def __call__(self, text: str) -> bytes:
        mark, number = self.special
        return np.uint32(number).tobytes().join(map(self.plain, text.split(mark))) if mark in text else self.plain(text)


def special_of(path: str) -> tuple[str, int]:
    """The one special string of a JSON tokenizer, and its id."""
    with open(path, encoding="utf-8") as f:
        (one,) = json.load(f)["added_tokens"]
    return one["content"], one["id"]


_encoders: dict[int, Encoder] = {}


def pieces(docs: DataFrame, ranks_path: str, pattern: str, special: tuple[str, int], tokens: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and the id `end`.

    Documents longer than `tokens` are cut so that every piece but the first is full. A null or empty text has the id
    `end` alone. Ids may be null or repeated: each row is a document by itself. No rows in, no rows out.
    """
    text_batches(docs.sparkSession)
    kept = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    stop = np.uint32(end).tobytes()

    def run(batches):
        key = hash((kept.value, pattern, special))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(kept.value, pattern, special)
        encode = _encoders[key]
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (encode(text) if text else b"") + stop
                n = len(ids) // 4
                cuts = [0, *range(n % tokens or tokens, n, tokens), n]
                rows += [(doc, k, x, y - x, zlib.crc32(ids[4 * x : 4 * y])) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
            doc, k, start, length, crc = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(doc, b.column(0).type), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """The rows of pieces() with sequence_id and offset. Every piece gets a place; ties (like pieces) go by id, piece and
    checksum, and rows alike in all of that are interchangeable."""
    spark = cut.sparkSession
    cut = settle(cut)
    n = salts(spark)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).cast("int"))
    counts = settle(salted.groupBy("length", "salt").count())
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}  # as many rows as lengths: at most cap.tokens
    runs, _ = best_plan(totals, cap)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    kept = spark.sparkContext.broadcast(table)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (
        salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.asc_nulls_first("doc_id"), "piece", "ids_crc32")) - 1)
        .join(counts.withColumn("before", before).drop("count"), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    )

    def run(batches):
        plan_ = kept.value
        keys = plan_[:, 0] << 48 | plan_[:, 1]
        for b in batches:
            length, rank = (b.column(k).to_numpy() for k in (3, 5))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan_[at, 3] + rank - plan_[at, 1]), pa.array(plan_[at, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
