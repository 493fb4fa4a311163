"""Order operators over the lines of all documents as one relation, and what they give in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import ordered as O
from tallyloom.sources import derived

ORDER = ["doc_id", "pos"]
SHOWN = ["line_no", *ORDER, "line"]


def _lines(spark: SparkSession, sf: str) -> O.Ranged:
    return O.ranged(derived.lines(spark, sf), ORDER)


def order_head(spark: SparkSession, sf: str) -> DataFrame:
    return O.head(_lines(spark, sf), 1000).select(*SHOWN)


def order_tail(spark: SparkSession, sf: str) -> DataFrame:
    return O.tail(_lines(spark, sf), 1000).select(*SHOWN)


def order_sort(spark: SparkSession, sf: str) -> DataFrame:
    """All lines by number, then by bytes, equal ones in their old order."""
    return O.sort_lines(derived.lines(spark, sf), ORDER, numeric=True).rows.select(*SHOWN)


def order_uniq(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of equal lines of all documents in a row, runs that go on in the next document included."""
    return O.uniq(_lines(spark, sf))


def order_wc(spark: SparkSession, sf: str) -> DataFrame:
    return O.wc(derived.lines(spark, sf))


def order_rg(spark: SparkSession, sf: str) -> DataFrame:
    return O.rg(_lines(spark, sf), r"\b[A-Z]\w+ing\b").select(*SHOWN)


def order_cap(spark: SparkSession, sf: str) -> DataFrame:
    return O.cap(_lines(spark, sf), 500, 60)


QUERIES = {"order_head": order_head, "order_tail": order_tail, "order_sort": order_sort, "order_uniq": order_uniq, "order_wc": order_wc, "order_rg": order_rg, "order_cap": order_cap}

_LINES = f"with lines as ({derived.LINES_SQL}), numbered as (select row_number() over (order by doc_id, pos) - 1 as line_no, count(*) over () as total, doc_id, pos, line from lines)"
_SHOWN = "line_no, doc_id, pos, line"
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"

ORACLE_SQL = {
    "order_head": f"{_LINES} select {_SHOWN} from numbered where line_no < 1000",
    "order_tail": f"{_LINES} select {_SHOWN} from numbered where line_no >= total - 1000",
    "order_sort": f"""with lines as ({derived.LINES_SQL}), keyed as (select *, coalesce(try_cast(nullif(regexp_extract(line, '^\\s*(-?\\d{{1,18}})', 1), '') as bigint), 0) as k from lines)
      select row_number() over (order by k, line, doc_id, pos) - 1 as line_no, doc_id, pos, line from keyed""",
    "order_uniq": f"""{_LINES}, m as (select *, line_no = 0 or line is distinct from lag(line) over (order by line_no) as starts from numbered),
      r as (select *, sum(starts::int) over (order by line_no) - 1 as run from m) select cast(run as bigint) as pos, any_value(line) as line, count(*) as n from r group by run""",
    "order_wc": f"{_LINES} select count(*) as lines, cast(sum(len(list_filter(string_split_regex(coalesce(line, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) as bigint) as words, cast(sum(strlen(coalesce(line, '')) + 1) as bigint) as bytes from numbered",
    "order_rg": f"{_LINES} select {_SHOWN} from numbered where regexp_matches(line, '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])[A-Z]{_WORD}+ing($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])')",
    "order_cap": f"""{_LINES}, cut as (select *, case when length(line) <= 60 then line else line[:60] || '...(truncated)' end as shown from numbered)
      select line_no as pos, shown as line from cut where total <= 500 or line_no < 250
      union all select line_no - (total - 500) + 1, shown from cut where total > 500 and line_no >= total - 250
      union all select 250, printf('{O.OMITTED}', cast(max(total) - 500 as bigint)) from cut having max(total) > 500""",
}
