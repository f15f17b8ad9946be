"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), keeps documents' columns (all but the last)
and is written as Parquet and read again before the next one runs. Columns may have any
names: those a stage does not need travel in a struct.

Rows are judged one by one, also where ids are missing or repeated: then a stage works with
row numbers in the order of doc_id (nulls first) and text. Null and empty texts have no words.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import op1_substring_dedup, op5_decontamination, op8_packing, op9_quality_rules, op10_ngram_jaccard
from tidegraph.llm.common import repeated_ids, table, written


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): one id for each row, row with all columns.

    The id is the row's own where ids are whole and unique, else its number in the order of id and text.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if docs.where("doc_id IS NULL").isEmpty() and not repeated_ids(docs):
        return whole.select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.text", "row")
    # sorted by ranges: the numbers grow with the order; written, so that they never change
    return written(whole.orderBy("row.doc_id", "row.text").select(F.monotonically_increasing_id().alias("doc_id"), "row.text", "row"), "numbered")


def columns_of(docs: DataFrame, **new) -> list:
    """The original columns from ``row``, some of them with new values."""
    return [new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their failed lines; texts without words are rejected, repeated rows judged alike."""
    return op9_quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest id. Documents without words stay."""
    rows = numbered(docs)
    kept = op10_ngram_jaccard.similar_groups(rows.select("doc_id", "text")).where("doc_id = component_id").select("doc_id")
    return rows.join(kept, "doc_id", "left_semi").select(*columns_of(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that lost words become the words they kept; a document that lost all of its words goes."""
    cut = op1_substring_dedup.dedup(numbered(docs), carried=("row",)).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return cut.select(*columns_of(docs, text=text, n_chars=F.length(F.coalesce(text, F.lit(""))).cast("long")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; an empty benchmark takes none away."""
    rows = numbered(docs)
    found = op5_decontamination.contaminated(rows.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*columns_of(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences; rows with equal or no doc_id are packed each for itself under that id."""
    return op8_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Packing needs a tokenizer and decontamination a latent space: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
