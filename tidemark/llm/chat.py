"""Chat formatting: logged conversations that are prefixes of longer ones go, the rest are rendered. DataFrame functions only.

Every turn gets the hash of its conversation up to it: the exclusive or of hashes of (position, role, text), which can be
summed up block by block, so a conversation with very many turns is no single task's work. A conversation whose whole
hash is the hash of a longer one's prefix is a snapshot of that one; of equal conversations the smallest id stays. Equality is
that of two 64-bit hashes and the number of turns; texts are not compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle

#: Turns that are put in order, summed up and rendered together.
BLOCK = 1024


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, place, role, text, h1, h2) for each turn of (conv_id, turn, role, text).

    place counts from 1 in the order of turn (null first), role and text; null roles and texts are empty; rows alike in
    all four columns are one turn; rows with a null conv_id belong to no conversation and are left out.
    """
    rows = settle(
        turns.where("conv_id is not null")
        .select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct().withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))))
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "block").count().select("conv_id", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    placed = rows.withColumn("at", F.row_number().over(inside)).join(counts, ["conv_id", "block"]).withColumn("place", F.col("before") + F.col("at"))
    hashed = placed.select(
        "conv_id", "block", "place", "role", "text", F.xxhash64("place", "role", "text").alias("h1"), F.xxhash64(F.lit(1), "place", "role", "text").alias("h2")
    )
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"))
    bases = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")])
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = hashed.select("conv_id", "block", "place", "role", "text", *[F.bit_xor(h).over(upto).alias(h) for h in ("h1", "h2")])
    return own.join(bases, ["conv_id", "block"]).select("conv_id", "block", "place", "role", "text", *[F.col(h).bitwiseXOR(F.col(s)).alias(h) for h, s in (("h1", "s1"), ("h2", "s2"))])


def maximal(turns: DataFrame) -> DataFrame:
    """The turns, as prefix_hashes() gives them, of conversations that are no prefix of another one nor equal to one with a smaller id."""
    hashed = settle(prefix_hashes(turns))
    lengths = hashed.groupBy("conv_id").agg(F.max("place").alias("n"))
    ends = hashed.select("conv_id", "place", "h1", "h2").join(lengths, "conv_id")
    whole = ends.where("place = n").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = ends.where("place < n").select("place", "h1", "h2").distinct()
    kept = whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id")
    return hashed.join(kept, "conv_id", "left_semi")


def render(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>\n", block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, rendered) of the maximal conversations of (conv_id, turn, role, text).

    A turn is `start`, role, a line end, text, `end`. A conversation of more than `block` turns is rendered in several parts,
    from 0, which follow each other without anything between. No rows in, no rows out.
    """
    pieces = maximal(turns).select("conv_id", F.floor((F.col("place") - 1) / block).alias("part"), "place", F.concat(F.lit(start), "role", F.lit("\n"), "text", F.lit(end)).alias("piece"))
    gathered = pieces.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    return gathered.select("conv_id", "part", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.col("pieces.piece"), "").alias("rendered"))
