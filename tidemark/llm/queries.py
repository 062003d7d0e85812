"""The queries of this subpackage, one for each operator, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import additive, chat, clustering, divergence, line_dedup, media, packing, quality, secrets, simhash, tokens, toxicity, warc
from tidemark.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SPECIAL = packing.special_of(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text, runs = F.col("text"), F.col("keep_runs")
    return line_dedup.with_bitmaps(docs).select(
        "doc_id", F.size(line_dedup.lines_of(text)).cast("long").alias("n_lines"), "n_dropped",
        F.sha2(line_dedup.kept_text(text, runs), 256).alias("kept_sha256"),
    )


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.render(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "part", "n_turns", F.char_length("rendered").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(docs, secrets.train(docs))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(quality.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), RANKS, PATTERN, SPECIAL))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_history(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table has images, so the pictures are of the documents' pages, made from their whole texts."""
    found = media.copy_groups(media.page_images(table(spark, sf_dir, "documents")))
    return found.select(F.col("image_id").alias("doc_id"), "n_corners", "group_id", "n_links")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(quality.held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, _ = clustering.clusters(table(spark, sf_dir, "embeddings"))
    found = clustering.with_inertia(rows, centroids)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_chat, op4_secrets, op5_simhash, op6_additive, op7_quality, op8_packing, op9_warc, op10_images, op11_toxicity, op12_clusters, op13_divergence)
}


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds of op12 one after the other: all distances of all vectors each time."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT n, vec_id, v.x, min(struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS best FROM v, c{r} c GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, list(y ORDER BY i) AS x FROM (
    SELECT c, i, CAST((s - ((s % m) + m) % m) // m AS BIGINT) AS y FROM (SELECT best.c AS c, i, sum(x[i]) AS s, count(*) AS m FROM a{r}, range(1, 65) g(i) GROUP BY 1, 2)) GROUP BY c)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(s.x, o.x) AS x FROM c{r} o LEFT JOIN s{r} s USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(best.c AS INT) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


ORACLES: dict[str, str] = {
    "op2_line_dedup": """
WITH lines AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), firsts AS (SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE first_doc <> doc_id) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE first_doc IS NULL OR first_doc = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN firsts USING (key) GROUP BY doc_id""",
    "op3_chat": """
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER own AS place FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
    WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), so_far AS (
    SELECT conv_id, place, max(place) OVER (PARTITION BY conv_id) AS n, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY place) AS said FROM turns
), kept AS (
    SELECT min(conv_id) AS conv_id FROM so_far w WHERE place = n AND NOT EXISTS (SELECT 1 FROM so_far i WHERE i.place = w.place AND i.n > i.place AND i.said = w.said) GROUP BY said
)
SELECT conv_id, (place - 1) // 1024 AS part, count(*) AS n_turns, sum(length('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10))) AS n_chars,
    sha256(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY place)) AS rendered_sha256
FROM turns WHERE conv_id IN (SELECT conv_id FROM kept) GROUP BY conv_id, part""",
    "op9_warc": """
WITH sized AS (SELECT page_id, sha1(encode(coalesce(html, ''))) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
held AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS holder FROM sized)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN holder <> page_id THEN holder END AS refers_to FROM held""",
    "op12_clusters": _cluster_sql(),
    "op13_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
uses AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total, any_value(coalesce(v.terms, 0)) AS terms FROM groups g LEFT JOIN uses u USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS terms FROM kept GROUP BY 1) v ON v.lang = g.lang GROUP BY ALL),
shares AS (
    SELECT s.lang, s.source, k.term, coalesce(u.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(u.n, 0) + 2)) // (s.total + 2 * s.terms) AS BIGINT) AS p
    FROM sizes s JOIN kept k USING (lang) LEFT JOIN uses u ON u.lang = s.lang AND u.source = s.source AND u.term = k.term
), whole AS (
    SELECT lang, term, CAST(1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS p FROM (SELECT lang, term, sum(n) AS n FROM uses GROUP BY ALL)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS f FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
    ON z.lang = a.lang AND z.s = a.source AND z.t = b.source
), terms AS (
    SELECT lang, source, term AS item, (x.p - w.p) * (x.p - w.p) // (x.p + w.p) AS value FROM shares x JOIN whole w USING (lang, term) WHERE n > 0 AND x.p > w.p
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (
    SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT *, 'term' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
) WHERE part = 'pair' OR rank <= 10""",
}
