"""Line dedup over whole corpora, in DataFrame functions only.

Every line's key is hashed to 128 bits. A hash of these and of a salt of the document is cut into equal ranges, one a partition,
whose bounds need no sample because hashes are uniform; so a line that a third of all documents hold is spread over many ranges. Rows are
sorted within by document and position. One streaming pass finds the first document of each (hash, salt); a second one, over those first documents alone
and in ranges of the hash itself, finds the first of each hash. What leaves the shuffle are runs of lines per document, and what is returned is a
run-length bitmap of the lines that stay; text is touched again only where the bitmap is applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, salts

#: White space that does not count at either end of a line (fixed values).
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without BLANK at both ends and with A-Z in lower case; other letters keep their case."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def range_of(hashed: Column, parts: int) -> Column:
    """parts * hash / 2 ** 64: which of `parts` equal ranges of unsigned hashes this one is in."""
    return F.shiftright(F.shiftrightunsigned(hashed, 32) * parts, 32).cast("int")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc_id, text_hash, n_dropped, drop_runs) for each document that loses lines; drop_runs has (first, last) line numbers.

    A key of at least `min_chars` code points stays in the smallest id that holds it, with all its lines there, and loses
    its lines in every other. A null or empty text is one empty line. A null id counts as smaller than any other. Rows
    that repeat an id are one document as far as its lines' keys go; text_hash tells their different texts apart.
    Ties cannot arise: ids decide. No rows in, no rows out.
    """
    n = salts(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = (
        docs.select(F.col(id_col).alias("doc"), text.alias("text"))
        .select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
            F.pmod(F.hash("doc"), F.lit(n)).alias("salt"), "doc", "text_hash", "pos",
        )
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.withColumn("range", range_of(F.xxhash64("h1", "salt"), parts))
    order = [F.asc_nulls_first("doc"), F.asc("pos")]
    upto = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = lines.repartitionById(parts, F.col("range"))
    seen = dealt.withColumn("own", F.col("doc").eqNullSafe(F.first("doc").over(upto("range", "h1", "h2", "salt"))))
    rest = (
        seen.where("own").select("h1", "h2", "doc", "text_hash", "pos").withColumn("range", range_of(F.col("h1"), parts)).repartitionById(parts, F.col("range"))
        .withColumn("own", F.col("doc").eqNullSafe(F.first("doc").over(upto("range", "h1", "h2"))))
    )
    drops = seen.where(~F.col("own")).select("doc", "text_hash", "pos").union(rest.where(~F.col("own")).select("doc", "text_hash", "pos"))
    places = F.col("places")
    starts = F.filter(places, lambda x, i: (i == 0) | (F.get(places, i - 1) < x - 1))
    ends = F.filter(places, lambda x, i: (i == F.size(places) - 1) | (F.get(places, i + 1) > x + 1))
    return (
        drops.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("places"))
        .select(F.col("doc").alias("doc_id"), "text_hash", F.size(places).cast("long").alias("n_dropped"), F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("drop_runs"))
    )


def keep_runs(drop_runs: Column, n_lines: Column) -> Column:
    """The bitmap of the lines that stay, as (first, last) line numbers, from the runs of those that go; null runs mean that all stay."""

    def part(k: Column) -> Column:
        first = F.when(k == 0, F.lit(0)).otherwise(F.get(drop_runs, k - 1)["last"] + 1)
        last = F.when(k == F.size(drop_runs), n_lines - 1).otherwise(F.get(drop_runs, k)["first"] - 1)
        return F.struct(first.alias("first"), last.alias("last"))

    between = F.filter(F.transform(F.sequence(F.lit(0), F.size(drop_runs)), part), lambda r: r["first"] <= r["last"])
    return F.when(drop_runs.isNull(), F.array(F.struct(F.lit(0).alias("first"), (n_lines - 1).alias("last")))).otherwise(between)


def kept_text(text: Column, runs: Column) -> Column:
    """The lines of `runs` alone; a null text counts as empty."""
    lines = lines_of(text)
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["first"] + 1, r["last"] - r["first"] + 1))), "\n")
    whole = (F.size(runs) == 1) & (F.get(runs, F.lit(0))["first"] == 0) & (F.get(runs, F.lit(0))["last"] == F.size(lines) - 1)
    return F.when(whole, F.coalesce(text, F.lit(""))).otherwise(kept)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, into: tuple[str, str] = ("n_dropped", "keep_runs")) -> DataFrame:
    """docs, all columns and rows, with each row's number of dropped lines and bitmap of kept ones in the two columns named by `into` (a name
    docs has gets a `_`)."""
    count, runs = fresh(docs, *into)
    doc, text_hash, dropped = fresh(docs, "line_doc", "line_text_hash", "line_drop_runs")
    maps = drop_bitmaps(docs, id_col, text_col, min_chars).toDF(doc, text_hash, count, dropped)
    same = docs[id_col].eqNullSafe(maps[doc]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == maps[text_hash])
    kept = keep_runs(maps[dropped], F.size(lines_of(docs[text_col])))
    return docs.join(maps, same, "left").select(*[docs[c] for c in docs.columns], F.coalesce(maps[count], F.lit(0).cast("long")).alias(count), kept.alias(runs))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with repeated lines taken out of the text: same columns, same rows, other texts only where lines went.

    A null text stays null. Nulls, ties, repeated rows and empty tables: see drop_bitmaps.
    """
    count, runs = fresh(docs, "n_dropped", "keep_runs")
    found = with_bitmaps(docs, id_col, text_col, min_chars, (count, runs))
    new = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(kept_text(F.col(text_col), F.col(runs)))
    return found.withColumn(text_col, new).select(*docs.columns)
