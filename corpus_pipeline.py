"""A training-data pipeline of five operators, each stage written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of docs, whatever further columns there are:

1. quality: documents that the ordinal classifier rejects go. Null and empty texts are scored as texts without words; repeated rows and ids are scored one by one.
2. lines: lines found in several documents stay in one of them, the one with the largest id. Null and empty texts come back empty; rows that repeat an id count as one document, and each loses its own lines; a null id ranks below all others.
3. near duplicates: of each group of similar documents the one with the smallest id stays, so there are no ties. Null, empty and blank texts are similar to nothing and stay, as do rows with a null id; rows that repeat an id belong together and stay or go together.
4. decontamination: documents that hold a window of a benchmark item go. Null and empty texts hold none; repeated rows are judged one by one.
5. pieces: every document that is left as SentencePiece ids, with the digest of the text that they decode to. Null and empty texts have no ids.

Empty tables go through all stages and give no rows. Texts are treated whole, however long: stages 1 and 3 to 5 turn a bounded slice of texts, or one text, into Python objects at a time; stage 2 stays within Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, jaccard, linededup, piececode, quality
from tallyloom.llm.common import save, table, workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the rated documents among docs."""
    return quality.select_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts lose repeated lines; n_chars, where present, is counted again."""
    out = linededup.dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more."""
    return jaccard.keep_one_of_each(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = piececode.encode(docs, decoded=True)
    return out.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", F.sha2("text", 256).alias("text_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", piece_stage),
]

#: The classifier and the encoder are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    root = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"{root}/stage{k}")
    return docs
