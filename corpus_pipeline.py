"""A corpus pipeline: quality rules, exact duplicates, near duplicates, mixing by source, packing.

Each stage takes the documents that the one before kept, as read back from Parquet, and all but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm.exact_dedup import exact_dedup
from voxelspark.llm.mixing import mix_sources, mixed_documents
from voxelspark.llm.ngram_join import ngram_jaccard_join
from voxelspark.llm.packing import pack, token_pieces
from voxelspark.llm.queries import public_tokenizer
from voxelspark.llm.repetition import clean_documents
from voxelspark.llm.runtime import Scratch, read


_ROW = "__stage_row"


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Adds a number that names a row: its id, or where ids repeat or are null, one in the order of the ids, nulls last."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if repeated.isEmpty():
        return docs.withColumn(_ROW, F.col("doc_id"))
    order = F.col("doc_id").asc_nulls_last()
    rows = docs.repartitionByRange(order).sortWithinPartitions(order).withColumn(_ROW, F.monotonically_increasing_id())
    return Scratch(spark, "rows").table(rows, "rows")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The numbered rows that are not among the dropped ones."""
    return rows.join(dropped.select(F.col("doc_id").alias("__dropped")), F.col(_ROW) == F.col("__dropped"), "left_anti").drop(_ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat themselves or have fewer than 10 words (null and empty texts too)."""
    return clean_documents(docs, least_words=5, most_covered=20, most_longest=50)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is equal but for white space, repeated rows included."""
    rows = _numbered(spark, docs)
    return _without(rows, exact_dedup(rows, id_col=_ROW).where("not kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of similarity 0.8 on five-word shingles.

    Texts without words are in no component and stay."""
    rows = _numbered(spark, docs)
    return _without(rows, ngram_jaccard_join(rows, id_col=_ROW, width=5, percent=80).where("doc_id != component_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources have their target weights; a row for each repetition."""
    rows = _numbered(spark, docs)
    mixed = mixed_documents(rows, mix_sources(rows, cap=3, id_col=_ROW), id_col=_ROW)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    pieces = token_pieces(docs, public_tokenizer("byte_bpe_50k.json"))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix),
    ("packing", packing),
]

#: Tokens and near duplicates have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
