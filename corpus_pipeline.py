"""The corpus pipeline: five of the training-data operators, one after the other, over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm import language_id, line_dedup, mixing, near_text, sentencepiece_codec, simhash
from loam.llm.common import release_shuffles, table, word_count, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown go."""
    return language_id.reject_unknown(docs)


def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document of which nothing stays goes too."""
    return line_dedup.dedup_lines(docs).filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that with the smallest (doc_id, hash of the text), null ids last.

    Two texts are near copies by op4's SimHash (4 bits or fewer), or where they share four fifths of their 5-word shingles, which
    SimHash alone leaves apart at 5 to 14 bits. Both kinds of links make one set of components, so that a chain may hold either.
    Ids need not be unique: rows with the same id, or none, go only where they are near copies. Rows alike in id and hash go by their other columns.
    """
    texts = docs.select(near_text.fp_of("text").alias("doc_id"), "text")  # op4's operator, told apart by text
    hashed = simhash.near_duplicates(texts).filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    hashed = written(hashed.distinct(), "pipeline-simhash")
    release_shuffles(spark)
    rows = near_text.near_duplicates(docs, hashed).groupBy("root", "doc_id", "fp").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n")
    first = rows.groupBy("root").agg(F.min(rank).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.fp").alias("__fp"), F.col("x.n").alias("__n"))
    first = written(first, "pipeline-first")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__fp"))
    stay = docs.withColumn("__own", near_text.fp_of("text")).join(first, same)
    if first.filter("__n > 1").isEmpty():
        return stay.select(*docs.columns)
    twice = stay.filter("__n > 1").groupBy("__id", "__own").agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return stay.filter("__n = 1").select(*docs.columns).unionByName(twice)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or twice.

    Rows that share a doc_id are told apart by source, size and text; of rows alike in all, as many are repeated as the mix says.
    """
    source, size = mixing.pattern_of(F.array("source")), word_count(F.col("text"))
    own = F.struct("doc_id", source.alias("pattern"), size.alias("size"), F.xxhash64("text").alias("tie"))
    taken = mixing.mix(docs, F.array("source")).groupBy(F.struct("doc_id", "pattern", "size", "tie").alias("__taken"))
    taken = written(taken.agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")).filter("__copies > 0"), "pipeline-taken")
    rows = docs.withColumn("__key", own).join(taken, F.col("__key").eqNullSafe(F.col("__taken")))
    alone, times = rows.filter("__n = 1").select(*docs.columns, "__copies"), F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    if not taken.filter("__n > 1").isEmpty():  # rows alike share the copies
        place = F.row_number().over(Window.partitionBy("__key").orderBy(*docs.columns))
        each = (F.floor(F.col("__copies") / F.col("__n")) + (place <= F.col("__copies") % F.col("__n")).cast("long")).alias("__copies")
        alone = alone.unionByName(rows.filter("__n > 1").select(*docs.columns, each).filter("__copies > 0"))
    return alone.withColumn("__copy", times).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they give the text back."""
    return sentencepiece_codec.round_trip(docs)


STAGES = [
    ("language ID", known_language),
    ("line dedup", no_repeated_lines),
    ("near-dedup", no_near_duplicates),
    ("mixing", target_mix),
    ("SentencePiece", tokenised),
]

#: The language model, XXH64 and the tokenizer are beyond SQL; the test runs a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k + 1}")
    return docs
