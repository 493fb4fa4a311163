"""Line dedup: levelled sorted runs of line digests tell how many documents hold a line; each document then loses the lines that another one keeps.

The corpus goes through in batches, split by document. A batch is reduced to one entry a line digest (documents that hold it, largest document) and merge-anti-joined with the runs: digests that are new become a sorted run, those that are known are kept beside the runs as counts to be added. Runs are compacted level by level. A line's fate depends on the documents of all batches, so the lines that go are decided once all batches are in: they are merge-joined with the digests that reached the limit, and every line but the keeper's is taken out. Only 16-byte digests and positions are shuffled by line; texts move once, by document, whatever their length.

Defined results: null and empty texts are one empty line, which is never dropped; a null id is one document that ranks below all others; rows that repeat an id count as one document, and each row loses its own lines; ties cannot arise, as the largest id keeps the line; an empty table gives no rows. Other columns of the input are kept, whatever their names; only n_lines and n_dropped are replaced, if these counts are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import lower_ascii, save, strip_blanks, table, text_or_empty, workspace
from tallyloom.llm.runs import SortedRuns, bits_for


def line_digest(line):
    """16 bytes of the SHA-256 of a line's key: ends stripped of ASCII white space, A-Z lower-cased."""
    return F.substring(F.unhex(F.sha2(lower_ascii(strip_blanks(line)), 256)), 1, 16)


def long_lines(row: DataFrame, min_chars: int) -> DataFrame:
    """id, row_key, pos and digest of each line whose key is long enough."""
    lines = row.select("id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(F.length(strip_blanks(F.col("line"))) >= min_chars).select("id", "row_key", "pos", line_digest(F.col("line")).alias("digest"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2, counts: bool = True) -> DataFrame:
    """docs with repeated lines taken out of the text and, if counts are wanted, n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    root = workspace(spark, "line-runs")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    row = docs.select(rest, F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("row_key", F.xxhash64("id", "text"))

    lines = long_lines(row.select("id", "row_key", "text"), min_chars).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    lines.write.partitionBy("batch").parquet(f"{root}/lines")
    stored = spark.read.schema(lines.schema).parquet(f"{root}/lines")

    runs = SortedRuns(spark, f"{root}/runs", "digest", lambda: [F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")], fanout, bits_for(stored.count()))
    for b in range(batches):
        per_doc = stored.where(F.col("batch") == b).groupBy("digest", "id").agg(F.lit(1).alias("one"))
        runs.add(per_doc.groupBy("digest").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper")))

    repeated = runs.entries().where(F.col("n_docs") >= min_docs).select("digest", "keeper")
    lost = (
        stored.select("digest", "id", "row_key", "pos")
        .join(repeated, "digest")
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("row_key").alias("lost_key"), F.col("id").alias("lost_id"))
        .agg(F.collect_set("pos").alias("lost"))
    )
    lost = save(lost, f"{root}/lost")
    joined = row.join(lost.hint("shuffle_hash"), (F.col("row_key") == F.col("lost_key")) & F.col("id").eqNullSafe(F.col("lost_id")), "left")

    # the one-element array binds the split text to a name, so that it is split once a document
    kept_lines = F.transform(
        F.array(F.split("text", "\n", -1)),
        lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("lost")), lambda i: F.get(a, i)), "\n"),
    )
    kept = F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept_lines[0])
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).cast("bigint")
    out = [kept.alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if not counts:
        return joined.select(*out)
    return joined.select(*out, n_lines.alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
with l as (
  select doc_id, unnest(generate_series(1, len(a))) as pos, unnest(a) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), r as (
  select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), j as (
  select k.doc_id, k.pos, k.line, r.key is not null and k.doc_id <> r.keeper as lost from k left join r on k.key = r.key
)
select doc_id, count(*) as n_lines, cast(count(*) filter (where lost) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from j group by doc_id
"""
