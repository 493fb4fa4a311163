"""The relations of this library made from the test tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.schema import CALLS

_CALLS = """
select {columns} from (
  select event_id, timestamp, category, command_text, sha1(command_text) as command_hash, bytes_before,
         case when pt then bytes_before else {div} end as bytes_after,
         cast(case when category = 'error' then 1 + event_id % 2 else 0 end as int) as exit_code,
         case when pt then 1 else 0 end as passthrough,
         case when pt then 'passthrough' when category = 'click' then 'git.status'
              when category = 'purchase' then 'git.diff' when category = 'error' then 'test'
              else '' end as strategy
  from (select event_id, {seconds} as timestamp, event_type as category,
               (event_type = 'view' or event_id % 11 = 0) as pt,
               cast(round(value * 100) as bigint) as bytes_before,
               case when event_type = 'view' then concat('cat f', cast(user_id as {text}), '.txt')
                    when event_type = 'click' and event_id % 2 = 0 then concat('git log -n ', cast(user_id as {text}))
                    when event_type = 'click' then concat('git log u', cast(user_id as {text}))
                    when event_type = 'signup' and user_id % 5 = 0 then ''
                    when event_type = 'signup' then concat('find . -name x', cast(user_id as {text}))
                    when event_type = 'error' then concat('pytest t', cast(user_id as {text}))
                    else concat('git diff p', cast(user_id as {text})) end as command_text
        from {source}) e) c
"""
CALLS_SQL = _CALLS.format(columns="*", div="(bytes_before * (event_id % 7)) // 5", seconds="epoch_us(ts) // 1000000", text="varchar", source="events")
LINES_SQL = """
select doc_id, cast(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as int) as pos,
       unnest(string_split(text, chr(10))) as line from documents
"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows from events, with event_id as a last sort key."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sql = _CALLS.format(columns="event_id, " + ", ".join(f.name for f in CALLS), div="bytes_before * (event_id % 7) div 5", seconds="unix_seconds(cast(ts as timestamp))", text="string", source="{events}")
    return spark.sql(sql, events=events)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
