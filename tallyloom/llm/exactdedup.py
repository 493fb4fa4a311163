"""Exact dedup: a log-structured merge index over digests of white-space-free texts, with byte verification of its hits.

Batches (memtables) are reduced to one entry a digest and looked up in the index: its filter settles most digests, the others are merge-joined with the sorted runs. New digests are flushed as a sorted run, known ones are kept beside the runs; compaction keeps the entry that wins (most code points in the original text, then the smallest id). Documents whose digest stands alone are done. A filter of the digests that don't keeps all other texts out of the shuffle; the texts that pass are compared byte by byte, as the smallest and the largest text of each digest, which pre-aggregates before the shuffle; should two different texts ever share a digest, that digest's rows are grouped by the text itself. Texts of any length are treated whole.

Defined results: null counts as empty; rows with a null id lose ties; rows that repeat an id and a length are tied and share one fate; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import BLANKS, save, table, text_or_empty, workspace
from tallyloom.llm.runs import SortedRuns, bits_for, filter_of, may_hold

#: Shares that the rows of one digest are dealt over.
SALTS = 16


def _best():
    """Smallest first: longer original, then ids before none, then the smaller id."""
    return F.struct((-F.col("n_points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))


def _salt():
    return F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per row of docs: its id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    root = workspace(spark, "digest-runs")
    row = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    digests = row.select("id", F.length("text").alias("n_points"), F.translate("text", BLANKS, "").alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))

    records = digests.select("id", "n_points", "digest", F.pmod(F.xxhash64("id", "digest"), F.lit(batches)).cast("int").alias("batch"))
    records.write.partitionBy("batch").parquet(f"{root}/records")
    stored = spark.read.schema(records.schema).parquet(f"{root}/records")

    bits = bits_for(stored.count())
    runs = SortedRuns(spark, f"{root}/runs", "digest", lambda: [F.min("best").alias("best"), F.sum("size").alias("size")], fanout, bits)
    for b in range(batches):
        runs.add(stored.where(F.col("batch") == b).groupBy("digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("size")))
    hits = save(runs.entries().where("size > 1"), f"{root}/hits")

    # byte verification of the hits
    dealt = hits.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asked = may_hold(digests.drop("n_points"), filter_of(hits, "digest", bits), "digest", bits).where("maybe")
    suspects = asked.withColumn("salt", _salt()).join(dealt.hint("shuffle_hash"), ["digest", "salt"], "left_semi")
    checked = save(suspects.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low <> high").select("digest"), f"{root}/collisions")

    groups = hits.select("digest", "best", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = stored.withColumn("salt", _salt()).join(groups, ["digest", "salt"], "left")
    size = F.coalesce("size", F.lit(1)).cast("bigint")
    kept = F.col("best").isNull() | (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.points") == -F.col("n_points")))
    keep_id = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    text_sha = F.lower(F.hex("digest")).alias("text_sha256")
    if checked.isEmpty():
        return found.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), text_sha)

    # two texts share a digest: their rows are grouped by the text
    clean = found.join(checked, "digest", "left_anti").select(F.col("id").alias(id_col), keep_id.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), text_sha)
    mixed = digests.join(checked, "digest", "left_semi")
    by_text = mixed.groupBy("norm").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("size"))
    apart = mixed.join(by_text, "norm").select(F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.points") == -F.col("n_points"))).alias("kept"), text_sha)
    return clean.unionByName(apart)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as norm
  from documents
), g as (
  select *, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from g
"""
