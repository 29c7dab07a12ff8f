"""The corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Each stage works on the documents that the one before it kept; all but the last return the columns
of documents.

Defined results: rows with a null text go with the quality rules, as do empty and blank ones; rows with a
null id are judged like others and go last among near copies; rows that repeat are near copies of one
another, so that one stays; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import line_dedup, ngram_join, packing, quality_rules, secrets
from siftline.llm.common import documents, dropped, free_name, handed_over, identified


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines. Exact and near copies count as one page, wordless texts too."""
    row = free_name(docs, "_row")
    rows = identified(docs, row)
    groups = ngram_join.grouped(rows, row)
    # pages without words have a null page: they hold no line, and count as one page
    pages_of = groups.select(F.col("id").alias(row), F.when(F.col("n") > 0, F.col("component")).alias("page"))
    # a line on two distinct pages is the least that a ratio can judge, whatever the source's size
    cleaned = line_dedup.without_boilerplate(rows, min_pages=2, min_line_pages=2, pages_of=pages_of)
    return with_length(cleaned.select(*[F.col(f"`{c}`") for c in docs.columns]))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return ngram_join.one_per_group(docs)


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with live-looking credentials replaced."""
    names = docs.columns
    found = secrets.scanned(docs)
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("secrets")))
    return with_length(clean.select(*[F.col(f"`{c}`") for c in names]))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place there."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


def with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text where documents have that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


STAGES = [
    ("quality rules", good_quality),
    ("line dedup", own_lines),
    ("n-gram Jaccard join", distinct_texts),
    ("secret scans", no_secrets),
    ("best-fit packing", sequences),
]
#: SQL expresses neither the near-duplicate groups nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before = None
    for _, stage in STAGES[:-1]:
        docs = handed_over(lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
