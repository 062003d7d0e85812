"""WARC archives of page captures, with revisit records for equal payloads, and a globally ordered capture index.

Records are written and read by Spark's text source, with the end of a record and the start of the next as separators, so
archives can lie in any store. An archive is compressed and read by one task, and its number of records is bounded. The index is merged
externally: tasks sort runs of captures and cut them at bounds of ranges of (URL key, timestamp, id) into packets of bounded
size; a range's task reads its packets of each run one after the other and merges the runs with a loser tree. Order comes from the sorted runs and the tree; Spark sorts no capture.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, islice, pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import settle, shared_dir, small

#: How records begin and end (fixed by WARC 1.1), and what a revisit's profile says.
MAGIC, CRLF = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF
#: Captures that a task sorts at once, captures of a range, about, and of a packet, at most.
RUN, RANGE, PACKET = 50_000, 100_000, 2_000
#: Line ends of any kind; in URLs they are percent-encoded (the set of Unicode's line separators, fixed values).
BREAKS = "\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: A header of our own: a mark that is drawn for each folder of archives, so that no payload can look like a record's start.
MARK = "WARC-Archive-Mark: "
INDEX = "urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def url_key(url: Column) -> Column:
    """The host's labels in reverse and what follows, in lower case: com,example)/path?query. What has no host counts as it is."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\d*\.", "")
    path, query = (F.lower(F.try_parse_url(url, F.lit(p))) for p in ("PATH", "QUERY"))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.coalesce(path, F.lit("/")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    return F.coalesce(key, F.lower(url), F.lit(""))


def with_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): of equal payloads of at least `least` bytes all but
    that of the largest id refer to it. Null html is empty. A null id refers to the largest id there is, if any; rows
    that repeat the largest id do not refer to themselves. Digests that occur once are left out of the join, the others are broadcast if
    they are few, so pages are not shuffled for them; beyond that a digest that many pages share is a skewed key that Spark splits."""
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    held = base.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    held = small(settle(held.where("holder is not null")))
    return base.join(held, "payload_digest", "left").select(*base.columns, F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def records(captures: DataFrame, mark: str) -> DataFrame:
    """(value): one record's text for each row of with_revisits() with a column `timestamp`, without the two line ends that close it."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    body = F.concat(F.lit(HTTP + "Content-Length: "), F.octet_length("html").cast("string"), F.lit(2 * CRLF), F.col("html"))
    encoded = F.col("url")
    for c in BREAKS:
        encoded = F.replace(encoded, F.lit(c), F.lit("".join(f"%{byte:02X}" for byte in c.encode())))
    url = F.when(F.col("url").rlike(f"[{BREAKS}]"), encoded).otherwise(F.col("url"))
    rows = captures.withColumn("block", F.when(F.col("refers_to").isNull(), body).otherwise(""))
    return rows.select(
        F.concat(
            F.lit(MAGIC + CRLF + MARK + mark + CRLF), line("WARC-Type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")),
            line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))), line("WARC-Target-URI", url), line("WARC-Date", F.col("timestamp")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            line("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit(PROFILE))),
            F.lit("Content-Type: application/http; msgtype=response" + CRLF), line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF), F.col("block"),
        ).alias("value")
    )


def write(captures: DataFrame, path: str, most_records: int = 20_000) -> None:
    """Archives in the folder `path`; a part file of Spark's is an archive of at most `most_records` whole records."""
    records(captures, uuid.uuid4().hex).write.options(lineSep=2 * CRLF, compression="gzip", maxRecordsPerFile=most_records).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, timestamp, html, payload_bytes, payload_digest, record_type, refers_to, file); html is null for revisits.

    Lengths are checked against each record's header and digests against the payload; a record that does not fit its
    header is an error. Line ends in URLs come back percent-encoded; a null URL comes back null. A folder without records gives no rows.
    """
    head = spark.read.option("lineSep", CRLF).text(path).where(F.col("value").startswith(MARK)).first()  # of the first record there is
    start = MAGIC + CRLF + (head[0] + CRLF if head else "")
    raw = spark.read.option("lineSep", start).text(path).select("value", F.col("_metadata.file_path").alias("file")).where("value <> ''")
    cut = F.instr("value", 2 * CRLF)
    parts = raw.select("file", F.substring("value", F.lit(1), cut + 1).alias("head"), F.substring("value", cut + 4, F.char_length("value") - cut - 7).alias("block"))
    got = lambda name: F.nullif(F.regexp_extract("head", rf"(?md)^{name}: ([^\r\n]*)", 1), F.lit(""))
    number = lambda name: F.nullif(F.regexp_extract("head", rf"(?md)^{name}: <urn:page:(-?\d+)>", 1), F.lit("")).cast("long")
    at = F.instr("block", 2 * CRLF)
    body = F.substring("block", at + 4, F.char_length("block"))
    read_ = parts.select(
        number("WARC-Record-ID").alias("page_id"), got("WARC-Target-URI").alias("url"), got("WARC-Date").alias("timestamp"),
        F.when(got("WARC-Type") == "response", body).alias("html"),
        got("WARC-Payload-Length").cast("long").alias("payload_bytes"), F.regexp_extract("head", r"(?md)^WARC-Payload-Digest: sha1:([0-9a-f]+)", 1).alias("payload_digest"),
        got("WARC-Type").alias("record_type"), number("WARC-Refers-To").alias("refers_to"), "file",
        (got("Content-Length").cast("long") == F.octet_length("block")).alias("whole"),
    )
    right = F.col("whole") & (F.col("html").isNull() | (F.sha1("html") == F.col("payload_digest")))
    return read_.withColumn("payload_digest", F.when(right, F.col("payload_digest")).otherwise(F.raise_error("a WARC record does not fit its header"))).drop("whole")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner goes up; taking the winner replays
    one path only, so a row costs as many comparisons as the tree is high."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.lost = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.lost[node] = (a, b) if self.before(a, b) else (b, a)
        self.top = winners[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator:
        while (head := self.heads[self.top]) is not None:
            yield head
            at = self.top
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node:
                if self.before(self.lost[node], at):
                    self.lost[node], at = at, self.lost[node]
                node //= 2
            self.top = at


def _keys(rows: pa.RecordBatch | pa.Table) -> list[tuple]:
    page = rows.column("page_id").to_pylist()
    return [(u or "", t or "", p is not None, p or 0) for u, t, p in zip(rows.column("urlkey").to_pylist(), rows.column("timestamp").to_pylist(), page, strict=True)]


def range_bounds(keys: DataFrame, ranges: int) -> list[tuple]:
    """The least key of each range but the first, from a sample of about 100 rows a range; a row a range reaches the driver."""
    sampled = keys.sample(min(1.0, 100 * ranges / max(keys.count(), 1)), seed=1) if ranges > 1 else keys.limit(0)
    least = sampled.repartitionByRange(ranges, *keys.columns).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*keys.columns)).alias("k")).select("k.*")
    return sorted((u or "", t or "", p is not None, p or 0) for u, t, p in least.collect())[1:]


def index(captures: DataFrame) -> DataFrame:
    """The columns of INDEX for each row of read(), ordered by URL key, timestamp and id within and across partitions.

    Ties (repeated rows) keep the order of their runs; null ids come first. No rows in, no rows out. A range's task holds its packets, as
    bytes, and one opened packet of each run.
    """
    names = ["urlkey", "timestamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
    rows = settle(captures.withColumn("urlkey", url_key(F.col("url"))).select(*names))
    ranges = max(-(-rows.count() // RANGE), 1)
    bounds = range_bounds(rows.select("urlkey", "timestamp", "page_id"), ranges)

    def sort_runs(batches):
        kept: list[pa.RecordBatch] = []
        n = 0

        def out():
            nonlocal kept, n
            whole = pa.Table.from_batches(kept)
            keys = _keys(whole)
            order = sorted(range(len(keys)), key=keys.__getitem__)
            whole, keys = whole.take(order), [keys[i] for i in order]
            cuts = [0, *(bisect_left(keys, b) for b in bounds), len(keys)]
            packets = [(r, i, min(i + PACKET, hi)) for r, (lo, hi) in enumerate(pairwise(cuts)) for i in range(lo, hi, PACKET)]
            for r, lo, hi in packets:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(whole.slice(lo, hi - lo).combine_chunks())
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()), pa.array([lo], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range", "run", "at", "packet"])
            kept, n = [], n + 1

        for b in batches:
            for i in range(0, b.num_rows, RUN):
                kept.append(b.slice(i, RUN))
                if sum(k.num_rows for k in kept) >= RUN:
                    yield from out()
        if kept:
            yield from out()

    def opened(r: int, packets: list[bytes]) -> Iterator[tuple]:
        for packet in packets:
            part = pa.ipc.open_stream(packet).read_all()
            yield from ((key, r, i, part) for i, key in enumerate(_keys(part)))

    def merge(batches):
        runs: dict[int, list[bytes]] = {}
        for b in batches:  # packets of a range come by run and in each run's order
            for run, packet in zip(b.column("run").to_pylist(), b.column("packet").to_pylist(), strict=True):
                runs.setdefault(run, []).append(packet)
        merged = iter(LoserTree([opened(r, packets) for r, packets in enumerate(runs.values())]))
        while found := list(islice(merged, 10_000)):
            own = {id(part): part for *_, part in found}
            starts = dict(zip(own, accumulate((part.num_rows for part in own.values()), initial=0), strict=False))
            yield from pa.concat_tables(own.values()).select(names).take([starts[id(part)] + i for _, _, i, part in found]).to_batches()

    packets = rows.mapInArrow(sort_runs, "range int, run long, at int, packet binary")
    return packets.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("run", "at").mapInArrow(merge, INDEX)


def capture_history(pages: DataFrame, timestamp: Column | None = None, least: int = 1000, path: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) to archives, reads these back and returns their index, a row for each page.

    Pages have no time of capture of their own unless `timestamp` gives one; else it is page_id seconds after 2024-01-01. A null id
    is the first second; null URLs have the key ''; rows that repeat an id are captures of their own. No pages, no rows.
    """
    spark = pages.sparkSession
    when = F.col("page_id") if timestamp is None else None
    stamp = timestamp if when is None else F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.coalesce(when, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(with_revisits(pages, least).withColumn("timestamp", stamp), path)
    return index(read(spark, path))
