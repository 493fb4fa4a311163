"""Order operators over a relation of lines of any size: numbers, head, tail, sort, uniq, wc, rg, caps.

A text in a row is cut and counted within the row; here the lines are rows, so that a text may be larger than any task. `ranged` deals the rows out by ranges of their order, sorts each range and notes, as the rows pass by, each one's place in its range and the run of equal lines that it belongs to there. One small row a range (its size, runs, first and last line) then tells how many rows and runs come before it, and whether its first run goes on from the range before; a run may so go through any number of ranges. Nothing but these small rows is ever ordered in one task. The order must tell all rows apart, or equal keys can neither be dealt over ranges nor numbered the same way again.

Defined results: a null line is a line of its own kind, equal to null lines alone; nulls come first in an order; an empty relation has no lines, and counts as 0 lines, words and bytes; other columns are kept by `ranged`, `head`, `tail`, `sort_lines` and `rg`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.rules import java_pattern
from tallyloom.functions.text import strip_ansi
from tallyloom.sources.store import save, workspace

#: What stands for lines that a cap leaves out.
OMITTED = "...[truncated: %d lines omitted — сузьте команду]"
BLANKS = r"[ \t\n\x0B\f\r]+"


class Ranged:
    """Sorted rows on the shared store, with what is known of each range."""

    def __init__(self, rows: DataFrame, ranges: DataFrame, line_col: str):
        self.stored, self.ranges, self.line = rows, ranges, line_col

    @property
    def rows(self) -> DataFrame:
        """The rows with line_no, from 0 in order, and run, the number of the run of equal lines that a row belongs to."""
        joined = self.stored.join(F.broadcast(self.ranges.select("part", "rows_before", "runs_before")), "part")
        own = [c for c in self.stored.columns if c not in ("part", "spot", "own_run")]
        return joined.select(*[F.col(f"`{c}`") for c in own], (F.col("rows_before") + F.col("spot")).alias("line_no"), (F.col("runs_before") + F.col("own_run")).alias("run"))

    def total(self) -> int:
        return self.ranges.agg(F.sum("n_rows")).first()[0] or 0


def ranged(rows: DataFrame, order: list[str], line_col: str = "line") -> Ranged:
    """rows in the order of some columns (which tell them apart), dealt into ranges."""
    spark = rows.sparkSession
    root = workspace(spark, "ranged")
    clash = {"part", "spot", "own_run", "line_no", "run"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns that are made here: {sorted(clash)}")
    at = rows.columns.index(line_col)
    sorted_rows = rows.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order]).withColumn("part", F.spark_partition_id())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, run, before = 0, -1, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lines = batch.column(at)
            joint = pa.concat_arrays([before if before is not None else lines.slice(0, 1), lines])
            a, b = joint.slice(0, len(lines)), joint.slice(1)
            same = pc.or_(pc.and_(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.equal(a, b), False))
            starts = pc.cast(pc.invert(same), pa.int64())
            runs = pc.add(pc.cumulative_sum(starts), run if before is not None else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(n, n + len(lines)), pa.int64()), runs], [*batch.schema.names, "spot", "own_run"])
            n, run, before = n + len(lines), runs[-1].as_py(), lines.slice(len(lines) - 1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    stored = save(sorted_rows.mapInArrow(count, f"{kinds}, part int, spot bigint, own_run bigint"), f"{root}/rows")
    line = F.struct(F.col(f"`{line_col}`").alias("line"))
    ends = stored.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), (F.max("own_run") + 1).alias("n_runs"), F.min_by(line, "spot").alias("first"), F.max_by(line, "spot").alias("last"))
    ends = save(ends, f"{root}/ranges")
    # one row a range: this is all that is ordered in one task
    order_of = Window.orderBy("part")
    goes_on = F.coalesce((F.col("first") == F.lag("last").over(order_of)) | (F.col("first.line").isNull() & F.lag("last.line").over(order_of).isNull() & F.lag("part").over(order_of).isNotNull()), F.lit(False))
    before = order_of.rowsBetween(Window.unboundedPreceding, -1)
    told = ends.withColumn("joined", goes_on.cast("bigint"))
    told = told.select("part", "n_rows", "n_runs", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("rows_before"), (F.coalesce(F.sum("n_runs").over(before), F.lit(0)) - F.sum("joined").over(order_of)).alias("runs_before"))
    return Ranged(stored, save(told, f"{root}/offsets"), line_col)


def head(lines: Ranged, n: int = 10) -> DataFrame:
    """The first n rows; all but the last -n for a negative n."""
    return lines.rows.where(F.col("line_no") < (n if n >= 0 else lines.total() + n))


def tail(lines: Ranged, n: int = 10, start: bool = False) -> DataFrame:
    """The last n rows; with `start`, all from the n-th on, counted from 1."""
    return lines.rows.where(F.col("line_no") >= (n - 1 if start else lines.total() - n))


def sort_key(line: Column, numeric: bool = False, fold: bool = False) -> list[Column]:
    """What lines are compared by: the number that they begin with (0 if none), lower case, or their bytes."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(line, r"^\s*(-?\d{1,18})", 1), F.lit("S999999999999999999")).cast("bigint"), F.lit(0))
    return ([number] if numeric else []) + ([F.upper(line)] if fold else [])


def sort_lines(rows: DataFrame, order: list[str], line_col: str = "line", reverse: bool = False, unique: bool = False, numeric: bool = False, fold: bool = False) -> Ranged:
    """rows in the order of their lines: by number or without case if asked for, then by bytes, then in their old order. unique: one row a line, the first."""
    if unique:
        least = F.struct(*[F.col(f"`{c}`") for c in order])
        rest = [c for c in rows.columns if c != line_col and c not in order]
        rows = rows.groupBy(line_col).agg(F.min(least).alias("least"), *[F.min_by(F.col(f"`{c}`"), least).alias(c) for c in rest]).select(line_col, "least.*", *[F.col(f"`{c}`") for c in rest])
    keys = sort_key(F.col(f"`{line_col}`"), numeric, fold) + [F.col(f"`{line_col}`")]
    names = [f"sort_key{k}" for k in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys, strict=True)))
    out = ranged(keyed, [*names, *order], line_col)
    if not reverse:
        return Ranged(out.stored.drop(*names), out.ranges, line_col)
    # numbers count down from the last one, over all ranges
    last = out.ranges.agg(F.sum("n_rows").alias("n"), F.max(F.col("runs_before") + F.col("n_runs")).alias("runs")).first()
    turned = out.stored.drop(*names).join(F.broadcast(out.ranges.select("part", "rows_before", "runs_before")), "part")
    spot, run = F.lit((last.n or 0) - 1) - F.col("rows_before") - F.col("spot"), F.lit((last.runs or 0) - 1) - F.col("runs_before") - F.col("own_run")
    spots = turned.select(*[F.col(f"`{c}`") for c in rows.columns], F.lit(0).alias("part"), spot.alias("spot"), run.alias("own_run"))
    zero = F.lit(0).cast("bigint")
    whole = out.ranges.agg(F.sum("n_rows").alias("n_rows")).select(F.lit(0).alias("part"), "n_rows", zero.alias("rows_before"), zero.alias("runs_before"))
    return Ranged(spots, whole, line_col)


def uniq(lines: Ranged, only: str | None = None) -> DataFrame:
    """(pos, line, n) of each run of equal lines, pos counting the runs from 0. only: 'repeated' or 'single' runs. A run's rows are counted where they are and added up."""
    runs = lines.rows.groupBy(F.col("run").alias("pos")).agg(F.first(f"`{lines.line}`").alias("line"), F.count(F.lit(1)).alias("n"))
    return runs if only is None else runs.where("n > 1" if only == "repeated" else "n = 1")


def cap(lines: Ranged, most: int = 500, longest: int = 300) -> DataFrame:
    """(pos, line): at most `most` lines, half of them from the start, the others from the end, and one in between that tells how many were left out; lines are cut to `longest` characters."""
    total, ahead = lines.total(), most // 2
    line = F.col(f"`{lines.line}`")
    cut = F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest), F.lit("...(truncated)"))).otherwise(line)
    if total <= most:
        return lines.rows.select(F.col("line_no").alias("pos"), cut.alias("line"))
    shown = lines.rows.where((F.col("line_no") < ahead) | (F.col("line_no") >= total - (most - ahead)))
    pos = F.when(F.col("line_no") < ahead, F.col("line_no")).otherwise(F.col("line_no") - (total - most) + 1)
    note = lines.stored.sparkSession.createDataFrame([(ahead, OMITTED % (total - most))], "pos bigint, line string")
    return shown.select(pos.alias("pos"), cut.alias("line")).unionByName(note)


def wc(rows: DataFrame, line_col: str = "line") -> DataFrame:
    """One row: lines, words and bytes, a line end counted with every line."""
    line = F.coalesce(F.col(f"`{line_col}`"), F.lit(""))
    words = F.size(F.filter(F.split(line, BLANKS), lambda w: w != ""))
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("lines"), add(words).alias("words"), add(F.octet_length(line) + 1).alias("bytes"))


def rg(lines: Ranged, pattern: str, invert: bool = False, colours: bool = False) -> DataFrame:
    """The rows with a line that the pattern is found in, or isn't, with their numbers. colours: escape codes are no part of a line."""
    line = F.coalesce(F.col(f"`{lines.line}`"), F.lit(""))
    hit = (strip_ansi(line) if colours else line).rlike(java_pattern(pattern))
    return lines.rows.where(~hit if invert else hit)
