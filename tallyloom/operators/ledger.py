"""Ledger reports: savings, rankings, days, history and advice, as single-pass aggregations.

Sorted reports end in unique keys, so limits are the same on every run. Rankings aggregate before they sort and take the top with one bounded heap a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def saved_bytes() -> Column:
    """Bytes saved by a call, never below 0; null where a side is null."""
    return F.when(F.col("bytes_before") - F.col("bytes_after") > 0, F.col("bytes_before") - F.col("bytes_after")).when(F.col("bytes_before") - F.col("bytes_after") <= 0, F.lit(0))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")


def _percent(part: str, whole: Column) -> Column:
    return F.when(whole > 0, F.round(F.col(part) / whole * 100, 1)).otherwise(F.lit(0.0))


def totals(calls: DataFrame) -> DataFrame:
    """One row: saved and raw bytes, calls, tokens (four bytes each) and percent saved."""
    base = calls.agg(_sum(saved_bytes()).alias("saved"), F.count(F.lit(1)).alias("calls"), _sum(F.col("bytes_before")).alias("raw"))
    return base.select("saved", "calls", "raw", F.expr("saved div 4").alias("estimated_tokens"), _percent("saved", F.col("raw")).alias("savings_percent"))


def top_saved(calls: DataFrame, limit: int = 5) -> DataFrame:
    return calls.groupBy("category").agg(_sum(saved_bytes()).alias("saved")).orderBy(F.desc("saved"), "category").limit(limit)


def top_calls(calls: DataFrame, limit: int = 5) -> DataFrame:
    return calls.groupBy("category").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "category").limit(limit)


def strategy_breakdown(calls: DataFrame, limit: int | None = None) -> DataFrame:
    """Saved bytes by strategy with their share of what all named strategies saved."""
    groups = calls.where("strategy <> ''").groupBy("strategy").agg(_sum(saved_bytes()).alias("saved"), F.count(F.lit(1)).alias("calls"))
    # a window over a handful of aggregated rows
    shares = groups.withColumn("percent", _percent("saved", F.sum("saved").over(Window.partitionBy())))
    ordered = shares.orderBy(F.desc("saved"), "strategy")
    return ordered if limit is None else ordered.limit(limit)


def daily_saved(calls: DataFrame) -> DataFrame:
    """Saved bytes by calendar day of the session's time zone."""
    return calls.groupBy(F.to_date(F.timestamp_seconds("timestamp")).alias("day")).agg(_sum(saved_bytes()).alias("saved")).orderBy("day")


def savings_graph(calls: DataFrame) -> DataFrame:
    """Days with a bar of one mark for each tenth of the best day."""
    days = daily_saved(calls)
    scale = F.greatest(F.lit(1), F.floor(F.max("saved").over(Window.partitionBy()) / 10))
    return days.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("saved") / scale).cast("int"))).orderBy("day")


def history(calls: DataFrame, limit: int = 10, tie: str | None = None) -> DataFrame:
    """The latest calls; `tie` names a column that orders calls of one second."""
    order = [F.desc("timestamp")] + ([F.desc(tie)] if tie else [F.desc("command_hash"), F.desc("category"), F.desc("bytes_before")])
    last = calls.orderBy(*order).limit(limit)
    return last.select(F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("time"), "category", saved_bytes().alias("saved"))


def discover(calls: DataFrame) -> DataFrame:
    """Categories that ran without compaction, the most frequent first."""
    groups = calls.where("passthrough = 1").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return groups.orderBy(F.desc("n"), "category").select("category")


def recent(calls: DataFrame, now: int, days: int = 7) -> DataFrame:
    if days < 0:
        raise ValueError("days must not be negative")
    return calls.where((F.col("timestamp") >= now - days * 86400) & (F.col("command_text") != ""))


def _top(rows: DataFrame, limit: int, *order) -> DataFrame:
    if limit < 1:
        raise ValueError("top must be at least 1")
    return rows.orderBy(*order, "command_text").limit(limit)


def repeated(calls: DataFrame, now: int, days: int = 7, top: int = 10) -> DataFrame:
    rows = recent(calls, now, days).groupBy("command_text").agg(F.count(F.lit(1)).alias("n"), _sum(saved_bytes()).alias("saved"))
    return _top(rows, top, F.desc("n"), F.desc("saved"))


def failing(calls: DataFrame, now: int, days: int = 7, top: int = 10) -> DataFrame:
    """last_exit is the largest exit code, as the ledger's reports have it."""
    rows = recent(calls, now, days).where("exit_code <> 0").groupBy("command_text").agg(F.count(F.lit(1)).alias("n"), F.max("exit_code").alias("last_exit"))
    return _top(rows, top, F.desc("n"), F.desc("last_exit"))


def passthrough_cost(calls: DataFrame, now: int, days: int = 7, top: int = 10) -> DataFrame:
    rows = recent(calls, now, days).where("passthrough = 1").groupBy("command_text").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_before").alias("raw"))
    return _top(rows, top, F.desc("raw"), F.desc("n"))


def rolled_up(rollups: DataFrame, *by: str) -> DataFrame:
    """Calls, raw and saved bytes by any of a roll-up's columns (day, category, strategy, passthrough), without reading calls. By nothing: one row for all."""
    return rollups.groupBy(*by).agg(*[_sum(F.col(c)).alias(c) for c in ("calls", "raw", "saved")])


#: Texts of the hints.
HINT_LOG = "git log без -n: укажите -n N — "
HINT_FIND = "find по всему дереву: укажите -maxdepth или путь — "
HINT_CAT = "файл читается %d раз: рассмотрите однократное чтение — %s"


def suggestions(repeated_rows: DataFrame) -> DataFrame:
    """Hints from the rows that `repeated` shows; one column, distinct and sorted."""
    text = F.col("command_text")
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    limited = F.exists(words, lambda w: (w == "-1") | w.startswith("-n") | w.startswith("--max-count"))
    log = F.when(text.startswith("git log") & ~limited, F.concat(F.lit(HINT_LOG), text))
    find = F.when(text.startswith("find . -name") & ~text.contains("-maxdepth"), F.concat(F.lit(HINT_FIND), text))
    by_row = repeated_rows.select(F.explode(F.array_compact(F.array(log, find))).alias("suggestion"))
    files = repeated_rows.where(text.startswith("cat ") & (F.size(words) >= 2)).groupBy(F.element_at(words, -1).alias("file")).agg(F.sum("n").alias("n"))
    reads = files.where("n >= 3").select(F.format_string(HINT_CAT, "n", "file").alias("suggestion"))
    return by_row.unionByName(reads).distinct().orderBy("suggestion")


def insights(calls: DataFrame, now: int, days: int = 7, top: int = 10) -> dict[str, DataFrame]:
    """The four parts of the insights report, all from one aggregation of the calls by command."""
    failed, through = (F.coalesce(test, F.lit(False)) for test in (F.col("exit_code") != 0, F.col("passthrough") == 1))
    sums = recent(calls, now, days).groupBy("command_text").agg(
        F.count(F.lit(1)).alias("n"),
        _sum(saved_bytes()).alias("saved"),
        F.count_if(failed).alias("failures"),
        F.max(F.when(failed, F.col("exit_code"))).alias("last_exit"),
        F.count_if(through).alias("unchanged"),
        F.sum(F.when(through, F.col("bytes_before"))).alias("raw"),
    )
    often = _top(sums.select("command_text", "n", "saved"), top, F.desc("n"), F.desc("saved"))
    return {
        "repeated": often,
        "failing": _top(sums.where("failures > 0").select("command_text", F.col("failures").alias("n"), "last_exit"), top, F.desc("n"), F.desc("last_exit")),
        "passthrough": _top(sums.where("unchanged > 0").select("command_text", F.col("unchanged").alias("n"), "raw"), top, F.desc("raw"), F.desc("n")),
        "suggestions": suggestions(often),
    }


#: How each part of the insights is printed and ordered, and its names as JSON.
INSIGHTS = {
    "repeated": ("  %d calls  %d bytes saved  %s", ["n", "saved", "command_text"], ["n", "saved"], {"command_text": "command", "n": "calls", "saved": "saved_bytes"}),
    "failing": ("  %d failures  last exit %d  %s", ["n", "last_exit", "command_text"], ["n", "last_exit"], {"command_text": "command", "n": "failures", "last_exit": "last_exit"}),
    "passthrough": ("  %d calls  %d raw bytes  %s", ["n", "raw", "command_text"], ["raw", "n"], {"command_text": "command", "n": "calls", "raw": "raw_bytes"}),
}


def _insight_arrays(calls: DataFrame, now: int, days: int, top: int) -> DataFrame:
    """One row with the four parts as arrays, each in its order and as long as the report shows."""
    parts = insights(calls, now, days, top)
    out = parts["suggestions"].agg(F.array_sort(F.collect_list("suggestion")).alias("suggestions"))
    for name, (_, columns, order, _) in INSIGHTS.items():
        key = [(-F.col(c)).alias(f"k{k}") for k, c in enumerate(order)]
        own = parts[name].agg(F.array_sort(F.collect_list(F.struct(*key, "command_text", *[c for c in columns if c != "command_text"]))).alias(name))
        out = out.withColumn("one", F.lit(1)).join(F.broadcast(own.withColumn("one", F.lit(1))), "one").drop("one")  # each side is a single row
    return out


def insights_json(calls: DataFrame, now: int, days: int = 7, top: int = 10) -> DataFrame:
    """The insights as one JSON object, in one row."""
    row = _insight_arrays(calls, now, days, top)

    def renamed(names: dict[str, str]):
        return lambda r: F.struct(*[r[c].alias(n) for c, n in names.items()])

    shown = [F.transform(name, renamed(names)).alias(name) for name, (_, _, _, names) in INSIGHTS.items()]
    return row.select(F.to_json(F.struct(F.lit(days).alias("days"), F.lit(top).alias("top"), *shown, "suggestions")).alias("value"))


def insights_text(calls: DataFrame, now: int, days: int = 7, top: int = 10) -> DataFrame:
    """(pos, line): the insights as they are printed. A part without rows says so."""
    row = _insight_arrays(calls, now, days, top)

    def printed(label: str, columns: list[str]):
        return lambda r: F.format_string(label, *[r[c] for c in columns])

    lines = {name: F.transform(name, printed(label, columns)) for name, (label, columns, _, _) in INSIGHTS.items()}
    lines["suggestions"] = F.transform("suggestions", lambda s: F.concat(F.lit("  "), s))
    parts = [F.concat(F.array(F.lit(f"{name}:")), F.when(F.size(of) > 0, of).otherwise(F.array(F.lit("  none")))) for name, of in lines.items()]
    return row.select(F.posexplode(F.concat(*parts)).alias("pos", "line"))


def total_report(calls: DataFrame, strategies: int = 5) -> DataFrame:
    """One row with the totals and the three rankings as arrays, in rank order."""

    def ranking(rows: DataFrame, name: str, key: str, value: str) -> DataFrame:
        ranked = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("k"), F.col(key), F.col(value))))
        return rows.agg(F.transform(ranked, lambda r: F.struct(r[key].alias(key), r[value].alias(value))).alias(name))

    # each side is a single row
    parts = [ranking(top_saved(calls), "top_saved", "category", "saved"), ranking(top_calls(calls), "top_calls", "category", "calls"), ranking(strategy_breakdown(calls, strategies), "top_strategies", "strategy", "saved")]
    out = totals(calls).withColumn("one", F.lit(1))
    for part in parts:
        out = out.join(F.broadcast(part.withColumn("one", F.lit(1))), "one")
    return out.drop("one")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def status(calls: DataFrame) -> DataFrame:
    """One row: how many calls the ledger holds, and the first and last second of them."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def text_report(calls: DataFrame, view: str = "total") -> DataFrame:
    """(part, pos, line): the lines of a report as they are printed, in order of part and pos. Each part has at most as many rows as the report shows."""

    def lines(rows: DataFrame, part: int, label: str, *columns: str, order: list[Column]) -> DataFrame:
        pos = F.row_number().over(Window.orderBy(*order)) - 1
        return rows.select(F.lit(part).alias("part"), pos.alias("pos"), F.format_string(label, *columns).alias("line"))

    by_saved = [F.desc("saved"), F.col("strategy")]
    if view == "total":
        sums = totals(calls)
        own = [("calls: %d", "calls"), ("saved: %d bytes (~%d tokens)", "saved", "estimated_tokens"), ("savings: %.1f%% of raw bytes", "savings_percent")]
        head = sums.select(F.lit(0).alias("part"), F.posexplode(F.array(*[F.format_string(*x) for x in own])).alias("pos", "line"))
        saved = lines(top_saved(calls), 1, "top saved: %s %d bytes", "category", "saved", order=[F.desc("saved"), F.col("category")])
        often = lines(top_calls(calls), 2, "top calls: %s %d", "category", "calls", order=[F.desc("calls"), F.col("category")])
        ways = lines(strategy_breakdown(calls, 3), 3, "top strategy: %s %d bytes %.1f%%", "strategy", "saved", "percent", order=by_saved)
        return head.unionByName(saved).unionByName(often).unionByName(ways)
    if view == "breakdown":
        return lines(strategy_breakdown(calls), 0, "%s %d bytes %.1f%% (%d calls)", "strategy", "saved", "percent", "calls", order=by_saved)
    if view == "daily":
        return lines(daily_saved(calls).withColumn("day", F.col("day").cast("string")), 0, "%s: %d bytes", "day", "saved", order=[F.col("day")])
    if view == "graph":
        return lines(savings_graph(calls).withColumn("day", F.col("day").cast("string")), 0, "%s %d %s", "day", "saved", "bar", order=[F.col("day")])
    raise ValueError(f"no such view: {view}")
