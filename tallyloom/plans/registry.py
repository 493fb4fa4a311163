"""Registered queries and their DuckDB counterparts, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import groups as G
from tallyloom.functions import text as X
from tallyloom.functions.arrays import let
from tallyloom.functions.rules import apply_rules
from tallyloom.operators import accounting, ledger, lines, route, sessions
from tallyloom.plans import ordering, reports, routing, streams, texts
from tallyloom.sources import derived, sinks

DAY = 86400


def _now(calls) -> int:
    """The time of the latest call stands for the present."""
    return calls.agg(F.max("timestamp")).first()[0]


def _lines_of(rows, text):
    return lines.explode_lines(rows, "doc_id", text)


def _ledger(report):
    return lambda spark, sf: report(derived.calls(spark, sf))


def _recent(report):
    def query(spark, sf):
        calls = derived.calls(spark, sf)
        return report(calls, _now(calls))

    return query


RULES = [{"strip_lines_matching": r"^\s*The\b", "keep_lines_matching": r"e[rn]", "replace": {"pattern": r"(\w+) of (\w+)", "replacement": r"\2<\1>"}, "max_lines": 6, "tail_lines": 4, "dedupe_lines": True}]


def _captures(spark, sf):
    """Documents as what `cat` and `run` have printed."""
    docs = derived.documents(spark, sf)
    tool = F.when(F.col("doc_id") % 3 == 0, "cat").when(F.col("doc_id") % 3 == 1, "digest").otherwise("unknown")
    return docs.select(F.col("doc_id").alias("capture_id"), tool.alias("tool"), F.array(F.lit("f")).alias("args"), F.coalesce("text", F.lit("")).alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("exit_code"))


def _totals_by_strategy(spark, sf):
    rows = accounting.account(route.compact(_captures(spark, sf)))
    return rows.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_before").alias("before"), F.sum("bytes_after").alias("after"))


def _match_rows(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", F.concat("role", F.lit(":"), F.regexp_replace("text", "\n", " ")).alias("line"))
    texts = lines.implode_lines(talk.withColumn("pos", F.col("turn")), "conv_id")
    found = texts.select("conv_id", F.explode(G.match_groups(F.col("text"))).alias("g"))
    return found.select("conv_id", F.col("g.key").alias("file"), F.size("g.vals").cast("bigint").alias("n"), F.col("g.vals")[0].alias("first_match"))


def _url_paths(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").where("url is not null")
    return lines.path_rows(pages, F.col("url"))


def _rule_rows(spark, sf):
    docs = derived.documents(spark, sf)
    return _lines_of(docs, apply_rules(F.col("text"), F.lit("any"), RULES))


def _retained(spark, sf):
    calls = derived.calls(spark, sf)
    return sinks.retained(calls, _now(calls), 10).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def _distinct_runs(spark, sf):
    return lines.run_rows(derived.documents(spark, sf), "doc_id", F.col("text"))


QUERIES = {
    "totals": _ledger(ledger.totals),
    "top_saved": _ledger(ledger.top_saved),
    "top_calls": _ledger(ledger.top_calls),
    "strategy_breakdown": _ledger(ledger.strategy_breakdown),
    "daily_saved": _ledger(ledger.daily_saved),
    "savings_graph": _ledger(ledger.savings_graph),
    "history": lambda spark, sf: ledger.history(derived.calls(spark, sf), tie="event_id"),
    "discover": _ledger(ledger.discover),
    "sessions": _ledger(sessions.sessions),
    "repeated": _recent(ledger.repeated),
    "failing": _recent(ledger.failing),
    "passthrough_cost": _recent(ledger.passthrough_cost),
    "suggestions": _recent(lambda calls, now: ledger.suggestions(ledger.repeated(calls, now, days=3650, top=200))),
    "retention": _retained,
    "line_collapse": _distinct_runs,
    "line_rle_redacted": lambda spark, sf: lines.run_rows(derived.documents(spark, sf), "doc_id", F.col("text"), redacted=True),
    "line_dedupe": lambda spark, sf: lines.distinct_rows(derived.documents(spark, sf), "doc_id", F.col("text")),
    "head_tail_cap": lambda spark, sf: _lines_of(derived.documents(spark, sf), X.cap(F.col("text"), 8, 40)),
    "digest": lambda spark, sf: _lines_of(derived.documents(spark, sf), X.digest(F.col("text"))),
    "rule_keep_strip": _rule_rows,
    "secret_lines": lambda spark, sf: lines.secret_rows(derived.lines(spark, sf)),
    "path_groups": _url_paths,
    "match_groups": _match_rows,
    "first_k_per_group": lambda spark, sf: lines.first_k(derived.calls(spark, sf).select("category", "event_id", "timestamp"), ["category"], ["timestamp", "event_id"], 5),
    "byte_accounting": _totals_by_strategy,
    "ledger_status": _ledger(ledger.status),
    "text_total": _ledger(ledger.text_report),
    "text_breakdown": _ledger(lambda calls: ledger.text_report(calls, "breakdown")),
    "text_daily": _ledger(lambda calls: ledger.text_report(calls, "daily")),
    "text_graph": _ledger(lambda calls: ledger.text_report(calls, "graph")),
    "insights_text": _recent(ledger.insights_text),
    "insights_json": _recent(ledger.insights_json),
}

_CALLS = f"with calls as ({derived.CALLS_SQL}), "
_LINES = f"with lines as ({derived.LINES_SQL}), "
_SAVED = "greatest(0, bytes_before - bytes_after)"
_RECENT = f"{_CALLS} recent as (select * from calls where command_text <> '' and timestamp >= (select max(timestamp) from calls) - {7 * DAY})"
_RUNS = """
  , marked as (select *, line is distinct from lag(line) over (partition by doc_id order by pos) or row_number() over (partition by doc_id order by pos) = 1 as starts from {lines}),
  numbered as (select *, sum(starts::int) over (partition by doc_id order by pos) as run from marked)
  select doc_id, cast(run - 1 as int) as pos, any_value(line) as line, count(*) as n from numbered group by doc_id, run
"""
_SECRET = "regexp_matches(lower(line), 'secret|token|password|accesskey|credential|aws_access_key_id|aws_secret_access_key')"
_CLOSED = """
  sized as (select doc_id, a, len(a) as n, shut from (
    select doc_id, case when text like '%' || chr(10) then string_split(text[:-2], chr(10)) else string_split(text, chr(10)) end as a, text like '%' || chr(10) as shut from documents where text is not null))
"""

ORACLE_SQL = {
    "totals": f"{_CALLS} t as (select cast(coalesce(sum({_SAVED}), 0) as bigint) as saved, count(*) as calls, cast(coalesce(sum(bytes_before), 0) as bigint) as raw from calls) select saved, calls, raw, saved // 4 as estimated_tokens, case when raw > 0 then round(saved / raw * 100, 1) else 0.0 end as savings_percent from t",
    "top_saved": f"{_CALLS} t as (select category, cast(sum({_SAVED}) as bigint) as saved from calls group by category) select * from t order by saved desc, category limit 5",
    "top_calls": f"{_CALLS} t as (select category, count(*) as calls from calls group by category) select * from t order by calls desc, category limit 5",
    "strategy_breakdown": f"{_CALLS} t as (select strategy, cast(sum({_SAVED}) as bigint) as saved, count(*) as calls from calls where strategy <> '' group by strategy) select *, case when sum(saved) over () > 0 then round(saved / sum(saved) over () * 100, 1) else 0.0 end as percent from t order by saved desc, strategy",
    "daily_saved": f"{_CALLS} t as (select cast(make_timestamp(timestamp * 1000000) as date) as day, cast(sum({_SAVED}) as bigint) as saved from calls group by 1) select * from t order by day",
    "savings_graph": f"{_CALLS} t as (select cast(make_timestamp(timestamp * 1000000) as date) as day, cast(sum({_SAVED}) as bigint) as saved from calls group by 1) select *, repeat('#', cast(saved // greatest(1, max(saved) over () // 10) as int)) as bar from t order by day",
    "history": f"{_CALLS} t as (select * from calls order by timestamp desc, event_id desc limit 10) select strftime(make_timestamp(timestamp * 1000000), '%Y-%m-%d %H:%M:%S') as time, category, {_SAVED} as saved from t",
    "discover": f"{_CALLS} t as (select category, count(*) as n from calls where passthrough = 1 group by category) select category from t order by n desc, category",
    "sessions": f"{_CALLS} t as (select *, coalesce(timestamp - lag(timestamp) over (order by timestamp) > 1800, true) as starts from calls), s as (select *, sum(starts::int) over (order by timestamp rows unbounded preceding) as session from t) select strftime(make_timestamp(min(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S') as start, count(*) as calls, round(avg((passthrough = 0)::int) * 100, 1) as adoption from s group by session order by start",
    "repeated": f"{_RECENT} select command_text, count(*) as n, cast(sum({_SAVED}) as bigint) as saved from recent group by command_text order by n desc, saved desc, command_text limit 10",
    "failing": f"{_RECENT} select command_text, count(*) as n, max(exit_code) as last_exit from recent where exit_code <> 0 group by command_text order by n desc, last_exit desc, command_text limit 10",
    "passthrough_cost": f"{_RECENT} select command_text, count(*) as n, cast(sum(bytes_before) as bigint) as raw from recent where passthrough = 1 group by command_text order by raw desc, n desc, command_text limit 10",
    "suggestions": f"""{_CALLS} top as (
        select command_text as t, count(*) as n, sum({_SAVED}) as saved from calls where command_text <> '' and timestamp >= (select max(timestamp) from calls) - {3650 * DAY}
        group by command_text order by n desc, saved desc, t limit 200),
      w as (select *, string_split(t, ' ') as words from top)
      select '{ledger.HINT_LOG}' || t as suggestion from w where t like 'git log%' and len(list_filter(words, lambda x: x = '-1' or starts_with(x, '-n') or starts_with(x, '--max-count'))) = 0
      union select '{ledger.HINT_FIND}' || t from w where t like 'find . -name%' and not contains(t, '-maxdepth')
      union select 'файл читается ' || cast(sum(n) as varchar) || ' раз: рассмотрите однократное чтение — ' || words[-1] from w where t like 'cat %' and len(words) >= 2 group by words[-1] having sum(n) >= 3
      order by suggestion""",
    "retention": f"{_CALLS} t as (select * from calls where timestamp >= (select max(timestamp) from calls) - {10 * DAY}) select category, count(*) as n from t group by category",
    "line_collapse": _LINES.rstrip(", ") + _RUNS.format(lines="lines"),
    "line_rle_redacted": f"{_LINES} clean as (select * from lines where not {_SECRET})" + _RUNS.format(lines="clean"),
    "line_dedupe": f"{_LINES} f as (select doc_id, line, min(pos) as p from lines group by doc_id, line) select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as int) as pos, line from f",
    "head_tail_cap": f"""with {_CLOSED},
      c as (select doc_id, n, shut, list_transform(a, lambda x: case when length(x) <= 40 then x else x[:40] || '...(truncated)' end) as a from sized),
      k as (select doc_id, case when n <= 8 then a else list_concat(a[1:4], ['...[truncated: ' || cast(n - 8 as varchar) || ' lines omitted — сузьте команду]'], a[n - 3 : n]) end as a, shut from c),
      j as (select doc_id, array_to_string(a, chr(10)) || case when shut then chr(10) else '' end as t from k)
      select doc_id, cast(unnest(generate_series(0, len(string_split(t, chr(10))) - 1)) as int) as pos, unnest(string_split(t, chr(10))) as line from j""",
    "digest": f"""with {_CLOSED},
      k as (select doc_id, case when n <= 20 then (case when shut then list_append(a, '') else a end) else list_concat(a[1:10], ['... (' || cast(n - 20 as varchar) || ' lines skipped — сузьте команду)'], a[n - 9 : n]) end as a from sized)
      select doc_id, cast(unnest(generate_series(0, len(a) - 1)) as int) as pos, unnest(a) as line from k""",
    "secret_lines": f"{_LINES} s as (select * from lines where {_SECRET}) select * from s",
    "path_groups": """with p as (select distinct regexp_replace(regexp_extract(url, '^(.*/)', 1), '/+$', '') as dir, regexp_extract(url, '([^/]*)$', 1) as name from pages where url is not null),
      r as (select *, row_number() over (partition by dir order by name) as rank, count(*) over (partition by dir) as n from p)
      select dir, n, string_agg(name, ',' order by rank) as names from r where rank <= 10 group by dir, n""",
    "match_groups": """with l as (select conv_id, turn, role as file, replace(text, chr(10), ' ') as rest from conversations)
      select conv_id, file, count(*) as n, arg_min(rest, turn)[:200] as first_match from l group by conv_id, file""",
    "first_k_per_group": f"{_CALLS} r as (select category, event_id, timestamp, cast(row_number() over (partition by category order by timestamp, event_id) as int) as rank, count(*) over (partition by category) as n_group from calls) select * from r where rank <= 5",
    "rule_keep_strip": r"""with d as (select doc_id, string_split(text, chr(10)) as a from documents where text is not null),
      f as (select doc_id, list_transform(list_filter(a, lambda x: not regexp_matches(x, '^\s*The\b') and regexp_matches(x, 'e[rn]')), lambda x: regexp_replace(x, '([\p{L}\p{M}\p{Nd}\p{Pc}]+) of ([\p{L}\p{M}\p{Nd}\p{Pc}]+)', '\2<\1>', 'g')) as a from d),
      t as (select doc_id, a[1:6] as a from f),
      u as (select doc_id, case when len(a) > 4 then a[len(a) - 3 : len(a)] else a end as a from t),
      e as (select doc_id, unnest(a) as line, unnest(generate_series(1, len(a))) as p from u union all select doc_id, '', 1 from u where len(a) = 0),
      g as (select doc_id, line, min(p) as p from e group by doc_id, line)
      select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as int) as pos, line from g""",
    "byte_accounting": f"""with {_CLOSED},
      cat as (select doc_id, unnest(a) as line, unnest(generate_series(1, n)) as pos, shut from sized where doc_id % 3 = 0),
      m as (select *, line is distinct from lag(line) over (partition by doc_id order by pos) or pos = 1 as starts from cat),
      r as (select *, sum(starts::int) over (partition by doc_id order by pos) as run from m),
      g as (select doc_id, run, any_value(line) as line, count(*) as n, bool_or(shut) as shut from r group by doc_id, run),
      o as (select doc_id, shut, case when n > 1 and line <> '' then line || '  [×' || cast(n as varchar) || ']' else line end as line, case when n > 1 and line <> '' then 1 else n end as times from g),
      c as (select doc_id, sum(times * (strlen(case when length(line) <= 300 then line else line[:300] || '...(truncated)' end) + 1)) - 1 + max(shut::int) as after from o group by doc_id),
      k as (select doc_id, case when n <= 20 then array_to_string(a, chr(10)) || case when shut then chr(10) else '' end
            else array_to_string(list_concat(a[1:10], ['... (' || cast(n - 20 as varchar) || ' lines skipped — сузьте команду)'], a[n - 9 : n]), chr(10)) end as t from sized where doc_id % 3 = 1),
      b as (select doc_id, strlen(coalesce(text, '')) as before from documents),
      x as (select 'cat' as strategy, before, coalesce(c.after, 0) as after from b left join c on c.doc_id = b.doc_id where b.doc_id % 3 = 0
            union all select 'digest', before, coalesce(strlen(t) + case when t <> '' and t not like '%' || chr(10) then 1 else 0 end, 0) from b left join k on k.doc_id = b.doc_id where b.doc_id % 3 = 1
            union all select 'passthrough', before, before from b where doc_id % 3 = 2)
      select strategy, count(*) as n, cast(sum(before) as bigint) as before, cast(sum(after) as bigint) as after from x group by strategy""",
}



def _text(query: str, part: int, label: str, order: str) -> str:
    return f"select {part} as part, cast(row_number() over (order by {order}) - 1 as int) as pos, {label} as line from ({ORACLE_SQL[query]})"


ORACLE_SQL |= {
    "ledger_status": f"{_CALLS} t as (select count(*) as calls, min(timestamp) as first, max(timestamp) as last from calls) select * from t",
    "text_breakdown": _text("strategy_breakdown", 0, "printf('%s %d bytes %.1f%% (%d calls)', strategy, saved, percent, calls)", "saved desc, strategy"),
    "text_daily": _text("daily_saved", 0, "printf('%s: %d bytes', cast(day as varchar), saved)", "day"),
    "text_graph": _text("savings_graph", 0, "printf('%s %d %s', cast(day as varchar), saved, bar)", "day"),
    "text_total": f"""select 0 as part, pos, line from (select unnest([0, 1, 2]) as pos, unnest([printf('calls: %d', calls), printf('saved: %d bytes (~%d tokens)', saved, estimated_tokens), printf('savings: %.1f%% of raw bytes', savings_percent)]) as line from ({ORACLE_SQL["totals"]}))
      union all {_text("top_saved", 1, "printf('top saved: %s %d bytes', category, saved)", "saved desc, category")}
      union all {_text("top_calls", 2, "printf('top calls: %s %d', category, calls)", "calls desc, category")}
      union all select * from ({_text("strategy_breakdown", 3, "printf('top strategy: %s %d bytes %.1f%%', strategy, saved, percent)", "saved desc, strategy")}) where pos < 3""",
}
_PARTS = f"""{_RECENT},
  repeated as (select command_text as command, count(*) as calls, cast(sum({_SAVED}) as bigint) as saved_bytes from recent group by 1 order by 2 desc, 3 desc, 1 limit 10),
  failing as (select command_text as command, count(*) as failures, max(exit_code) as last_exit from recent where exit_code <> 0 group by 1 order by 2 desc, 3 desc, 1 limit 10),
  through as (select command_text as command, count(*) as calls, cast(sum(bytes_before) as bigint) as raw_bytes from recent where passthrough = 1 group by 1 order by 3 desc, 2 desc, 1 limit 10),
  w as (select command as t, calls as n, string_split(command, ' ') as words from repeated),
  hints as (select '{ledger.HINT_LOG}' || t as s from w where t like 'git log%' and len(list_filter(words, lambda x: x = '-1' or starts_with(x, '-n') or starts_with(x, '--max-count'))) = 0
    union select '{ledger.HINT_FIND}' || t from w where t like 'find . -name%' and not contains(t, '-maxdepth')
    union select 'файл читается ' || cast(sum(n) as varchar) || ' раз: рассмотрите однократное чтение — ' || words[-1] from w where t like 'cat %' and len(words) >= 2 group by words[-1] having sum(n) >= 3)"""
_SHOWN = [
    ("repeated", "repeated", "calls desc, saved_bytes desc, command", "'  ' || calls || ' calls  ' || saved_bytes || ' bytes saved  ' || command"),
    ("failing", "failing", "failures desc, last_exit desc, command", "'  ' || failures || ' failures  last exit ' || last_exit || '  ' || command"),
    ("passthrough", "through", "raw_bytes desc, calls desc, command", "'  ' || calls || ' calls  ' || raw_bytes || ' raw bytes  ' || command"),
    ("suggestions", "hints", "s", "'  ' || s"),
]
_OBJECT = ", ".join(f"'{name}', (select coalesce(to_json(list({'s' if name == 'suggestions' else 'x'} order by {order})), '[]'::json) from {source} x)" for name, source, order, _ in _SHOWN)
ORACLE_SQL |= {
    "insights_text": f"""{_PARTS}, l as ({" union all ".join(f"select {k} as part, row_number() over (order by {order}) as r, {line} as line from {source} union all select {k}, 0, '{name}:' union all select {k}, 1, '  none' where not exists (from {source})" for k, (name, source, order, line) in enumerate(_SHOWN))})
      select cast(row_number() over (order by part, r) - 1 as int) as pos, line from l""",
    "insights_json": f"{_PARTS} select cast(json_object('days', 7, 'top', 10, {_OBJECT}) as varchar) as value",
}
QUERIES |= ordering.QUERIES | texts.QUERIES | reports.QUERIES | routing.QUERIES | streams.QUERIES
ORACLE_SQL |= ordering.ORACLE_SQL | texts.ORACLE_SQL | reports.ORACLE_SQL | routing.ORACLE_SQL | streams.ORACLE_SQL
