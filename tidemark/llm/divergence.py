"""Source divergence audit: how far the sources of a language lie apart in their terms, and which terms set a source off.

Terms are counted by language and source in the tasks, then by one aggregate. The value of a pair of sources is a sum over all kept
terms, but most counts are 0: with every count 0 it is a constant times their number. What differs is corrected. A count by
itself, the partner's being 0, is corrected by a histogram of each source's counts. Two counts together are corrected over a frequent-pattern
tree: a term's row holds its nonzero counts in the order of sources; equal rows are one with a multiplicity; rows are
sorted over the cluster and inserted in trees, a chunk of a range each, where rows that begin alike share nodes. A node meets each of its ancestors
once, with its multiplicity. All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle, small

#: Letters of terms in lower case; any other byte below 128 ends a term (fixed values, see the contract).
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Counts that a task holds before it passes them on, and documents between two looks at their number.
HELD, AT_ONCE = 500_000, 256
UNIT = 1_000_000_000
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs) summed; a row with a null term for each group that occurs. Every row is a document; null
    texts, languages and sources are ''."""

    def run(batches):
        counts, found = defaultdict(Counter), defaultdict(Counter)

        def out():
            for (lang, source), c in counts.items():
                terms = [None, *c]
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(terms)), pa.repeat(pa.scalar(source, pa.string()), len(terms)), pa.array(terms, pa.binary())]
                columns += [pa.array([0, *c.values()], pa.int64()), pa.array([0, *map(found[lang, source].__getitem__, c)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            found.clear()

        for b in batches:
            for start in range(0, b.num_rows, AT_ONCE):
                for text, *g in zip(*(c.to_pylist() for c in b.slice(start, AT_ONCE).columns), strict=True):
                    words = text.encode("utf-8", "replace").translate(TERM_BYTES).split()
                    counts[tuple(g)].update(words)
                    found[tuple(g)].update(set(words))
                if sum(map(len, counts.values())) >= HELD:
                    yield from out()
        yield from out()

    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    counted = docs.select(*parts).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), in decimals, so that no count overflows; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    upper = F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + 2).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", upper, (wide(total) + 2 * wide(terms)).cast("decimal(20,0)")) + 1)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); p and q are at most UNIT + 1, so that a long holds all."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def tree_corrections(starts: np.ndarray, place: np.ndarray, p: np.ndarray, p0: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, correction) summed by pairs a < b of sources' places, over a tree of sorted rows.

    Row r has the items from starts[r] to starts[r + 1], each a source's place, its share p and its share p0 for a count of 0, and stands
    for times[r] terms. An item is a new node unless the row before begins alike up to it. A node's multiplicity is summed
    over all rows that pass it; it meets each of its ancestors, which are the items before it in its own row, once.
    """
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    depth = np.arange(len(place)) - starts[row]
    before = starts[np.maximum(row - 1, 0)] + depth  # the item of the row before at this depth
    has = (row > 0) & (depth < sizes[np.maximum(row - 1, 0)])
    before = np.where(has, before, 0)
    alike = has & (place == place[before]) & (p == p[before])
    first = np.minimum.reduceat(np.where(alike, len(place), depth), starts[:-1]) if len(place) else depth
    new = depth >= first[row]
    node = np.where(new, np.arange(len(place)), before)
    while (node[node] != node).any():
        node = node[node]
    passes = np.zeros(len(place), np.int64)
    np.add.at(passes, node, times[row])
    at, up = np.flatnonzero(new), 1
    width = int(place.max(initial=0)) + 1
    pairs, values = [], []
    while len(at := at[depth[at] >= up]):
        over = at - up
        f = lambda x, y: (x - y) ** 2 // (x + y)
        both = f(p[over], p[at]) - f(p[over], p0[at]) - f(p0[over], p[at]) + f(p0[over], p0[at])
        key, where = np.unique(place[over] * width + place[at], return_inverse=True)
        sums = np.zeros(len(key), np.int64)
        np.add.at(sums, where, both * passes[at])
        pairs.append(key)
        values.append(sums)
        up += 1
    if not pairs:
        return (np.empty(0, np.int64),) * 3
    key, where = np.unique(np.concatenate(pairs), return_inverse=True)
    sums = np.zeros(len(key), np.int64)
    np.add.at(sums, where, np.concatenate(values))
    return key // width, key % width, sums


def tree_pairs(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value) from rows (lang, path, times), whose paths are arrays of (place, p, p0); equal rows are one."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                lists = part.column(1)
                items = lists.flatten()
                starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
                a, b, v = tree_corrections(starts, *(items.field(k).to_numpy().astype(np.int64) for k in range(3)), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([langs[lo]] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(v)], names=["lang", "a", "b", "value"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "lang", "path").sortWithinPartitions("lang", "path").mapInArrow(run, "lang string, a long, b long, value long")


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has every other source of the language, part `term` the first `top`
    terms that the source uses more than the language does.

    Terms in fewer than `least_docs` rows of their language are left out. Every row is a document, rows that repeat an id too; null texts,
    languages and sources are ''. Groups without terms take part with counts of 0; a language without kept terms gives
    pairs of value 0 and no terms. Ties in value go by item. No rows in, no rows out. A term's row and a language's list of sources are held whole: both
    are no longer than one source's share of the result.
    """
    counts = settle(term_counts(docs, text_col, lang_col, source_col))
    found = counts.where("term is not null")
    kept = settle(
        found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("uses"))
        .where(F.col("docs") >= least_docs).select("lang", "term", F.col("n").alias("lang_n"), "uses")
    )
    used = kept.select("lang", "term", "lang_n", F.inline("uses"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    sources = settle(
        counts.where("term is null").select(*GROUP).join(used.groupBy(*GROUP).agg(F.sum("n").alias("total")), GROUP, "left").join(small(settle(langs)), "lang", "left")
        .select(*GROUP, F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms"), "lang_total")
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("total", "source")) - 1)
        .withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms")))
    )
    entries = used.join(small(sources), GROUP).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    item = F.struct("place", "p", "p0")
    rows = entries.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path")).groupBy("lang", "path").agg(F.count("*").alias("times"))
    together = tree_pairs(rows)
    others = small(sources.select("lang", F.col("place").alias("b"), F.col("p0").alias("q0"), "terms"))
    alone = (
        entries.groupBy("lang", F.col("place").alias("a"), "p", "p0").agg(F.count("*").alias("times")).join(others, "lang").where("a <> b")
        .select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ((apart(F.col("p"), F.col("q0")) - apart(F.col("p0"), F.col("q0"))) * F.col("times")).alias("value"))
    )
    never = (
        sources.select("lang", F.col("place").alias("a"), "p0").join(others, "lang").where("a < b")
        .select("lang", "a", "b", F.coalesce(apart(F.col("p0"), F.col("q0")) * F.col("terms"), F.lit(0).cast("long")).alias("value"))
    )
    sums = together.select("lang", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "value").union(alone).union(never).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("place"), F.col("b").alias("other")), F.struct(F.col("b").alias("place"), F.col("a").alias("other")))).alias("way")).select("lang", "value", "way.*")
    named = small(sources.select("lang", "place", "source"))
    pairs = both.join(named, ["lang", "place"]).join(named.select("lang", F.col("place").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    terms = (
        entries.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("p > q")
        .select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    )
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))
    columns = [*GROUP, "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).withColumn("rank", rank).select(*columns).union(terms.withColumn("rank", rank).where(F.col("rank") <= top).select(*columns))
