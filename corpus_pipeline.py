"""A training corpus from raw documents: quality, repeated lines, near-duplicates, secrets, packing.

Each stage works on all that the one before it kept; between stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, near_copies, packing, quality, secrets
from tidemark.llm.common import remove, shared_dir, table
from tidemark.llm.queries import PATTERN, RANKS, SPECIAL

#: Documents with a lower score go.
LEAST_QUALITY = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good, all columns kept."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.where(scored[scored.columns[-1]] >= LEAST_QUALITY).select(*docs.columns)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document that has them. Documents stay, even if no line does."""
    return line_dedup.dedup_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more over shingles of five words the document with the smallest id."""
    return near_copies.keep_one(docs, width=5, similarity=0.8)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts replaced by a mark."""
    return secrets.mask(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence."""
    return packing.pack(packing.pieces(docs, RANKS, PATTERN, SPECIAL))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", first_lines),
    ("simhash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL can express neither the classifier nor the network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents` to packed pieces.

    Documents with null ids stay documents of their own; null texts stay null until they are packed as empty ones; of repeated
    rows each is kept or goes with the others of its id. An empty table gives no rows.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)  # nothing reads it any more
        last = path
    return docs
