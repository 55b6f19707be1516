"""Cleans documents in stages; each stage's rows are written as Parquet and read again by the next.

Quality classifier, n-gram Jaccard join, suffix-array dedup, benchmark decontamination, byte-level BPE. All stages but
the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalspark.llm import byte_bpe, decontamination, ngram_join, quality, suffix_dedup
from zonalspark.llm.common import forget, read, recorded, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Numbers of removed documents up to this number are broadcast (8 MB), beyond it they are joined by a shuffle.
BROADCAST = 1_000_000


#: Intermediate tables of the last stage that ran in each application.
LEFT: dict[str, list[str]] = {}
#: Bytes of rows that go to a Python worker at once.
BATCH = "8m"


def stage(f: Callable) -> Callable:
    """When a stage begins, the one before has been written, so the tables that it used go. Batches of rows that go to Python
    workers are bounded by bytes, so what a task holds doesn't depend on how long texts are."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = LEFT.setdefault(spark.sparkContext.applicationId, [])
        forget(spark, left)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
        with recorded() as paths:
            out = f(spark, docs, sf_dir)
        left.extend(paths)
        return out

    return begin


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, written, since ids may be null or repeated."""
    return stored(docs.select(*COLUMNS).withColumn("row_no", F.monotonically_increasing_id()), "numbered")


def without(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """docs whose row_no isn't in numbers."""
    numbers = stored(numbers.distinct(), "removed")
    return docs.join(F.broadcast(numbers) if numbers.count() <= BROADCAST else numbers, "row_no", "left_anti").select(*COLUMNS)


@stage
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; their texts stay as they are, nulls too."""
    scorer = quality.fit(docs, read(spark, sf_dir, "labels"))
    both = docs.select(*COLUMNS).withColumn("content", F.col("text"))
    return quality.score(both, scorer, "content", COLUMNS, "quality_score").where("quality_score >= 0.5").select(*COLUMNS)


@stage
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null ids last), of each group of near copies; of repeated rows without words
    one. Different texts under one id, or without one, stay."""
    rows = numbered(docs)
    groups = stored(ngram_join.similar(rows, "row_no").select("row_no", "n_shingles", "component_id"), "near-copies")
    linked = groups.where("n_shingles > 0").join(rows.select("row_no", "doc_id"), "row_no")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_no")
    first = linked.groupBy("component_id").agg(F.min_by("row_no", order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = linked.join(first, "component_id").where("row_no <> first").select("row_no")
    wordless = stored(groups.where("n_shingles = 0").select("row_no"), "wordless")
    blank = stored(rows.join(F.broadcast(wordless) if wordless.count() <= BROADCAST else wordless, "row_no"), "blank")
    again = blank.select("row_no").join(blank.groupBy(*COLUMNS).agg(F.min("row_no").alias("row_no")).select("row_no"), "row_no", "left_anti")
    return without(rows, copies.union(again))


@stage
def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated strings; of a character that is cut through no byte stays."""
    left = suffix_dedup.dedup(docs, keep=("doc_id", "lang", "source"))
    # a cut character leaves bytes that are no UTF-8; they decode to U+FFFD, which goes unless the bytes hold it
    text = F.expr("if(is_valid_utf8(cast(kept as string)), cast(kept as string), replace(make_valid_utf8(cast(kept as string)), '\\uFFFD', ''))")
    return left.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@stage
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no, or too little, of the benchmark."""
    rows = numbered(docs)
    found = decontamination.decontaminate(rows, read(spark, sf_dir, "benchmark"), "row_no")
    return without(rows, found.where("contaminated").select("row_no"))


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and of what they decode to."""
    return byte_bpe.digests(byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("quality_classifier", good), ("ngram_join", distinct), ("suffix_dedup", unrepeated), ("decontamination", uncontaminated), ("byte_bpe", encoded)]

#: SQL can't express the classifier; tests hold all of run() against its stages written out plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stored(f(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
