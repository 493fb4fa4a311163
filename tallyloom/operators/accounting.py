"""Bytes before and after compaction, and the ledger rows that come of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.sources.schema import CALLS

MOST_TEXT = 4096
#: Strategies whose standard error is shown beside their output.
WITH_ERRORS = ("generic", "errors", "digest")


def shown_bytes(text: Column) -> Column:
    """UTF-8 size with the newline that printing adds."""
    return F.octet_length(text) + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def account(compacted: DataFrame) -> DataFrame:
    """The rows of route.compact with bytes_before and bytes_after."""
    raw = F.octet_length("stdout") + F.octet_length("stderr")
    name, out, err = F.col("strategy"), F.col("output"), F.col("stderr")
    listing = (name == "ls") & ~F.exists(F.coalesce("args", F.array().cast("array<string>")), lambda x: x.startswith("-"))  # printed like a report
    both = name.isin("lossless", "git.show", "git.blame", "git.stash", "ls", "rg", "cat") & ~listing
    exit_note = F.when((name == "generic") & (F.col("exit_code") != 0), F.octet_length(F.format_string("[exit: %d]\n", "exit_code"))).otherwise(0)
    unchanged = (name == "passthrough") | (name == "git.log") | (name.isin("git.diff", "grep", "find") & (out == F.col("stdout")))
    after = F.when(unchanged, raw).when(both, F.octet_length(out) + F.octet_length(err)).when(name == "read", F.octet_length(out)).otherwise(shown_bytes(out) + F.when(name.isin(*WITH_ERRORS), shown_bytes(err)).otherwise(0) + exit_note)
    return compacted.withColumns({"bytes_before": raw.cast("bigint"), "bytes_after": after.cast("bigint")})


def ledger_rows(accounted: DataFrame, now: Column, keep_text: bool = True) -> DataFrame:
    """Rows of CALLS for what was recorded. Command texts are user input: keep_text=False leaves them out."""
    command = F.array_join(F.concat(F.array("tool"), F.col("args")), " ")
    call = F.struct(
        F.sha1(command).alias("command_hash"),
        (F.substring(command, 1, MOST_TEXT) if keep_text else F.lit("")).alias("command_text"),
        F.col("tool").alias("category"),
        "bytes_before",
        "bytes_after",
        "exit_code",
        now.alias("timestamp"),
        "passthrough",
        "strategy",
    )
    # a filter would be pushed below the routes' expressions, copies of which it would then hold; exploding drops rows where it stands
    rows = accounted.select(F.explode(F.when(F.col("recorded"), F.array(call))).alias("call")).select("call.*")
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CALLS])


def tee_wanted(code: Column, raw: Column, enabled: bool = True, mode: str = "failures", policy: str = "auto", min_bytes: int = 0, no_match: Column | None = None) -> Column:
    """Whether a capture's raw output is kept."""
    by_mode = F.lit(True) if policy == "always" or enabled and mode == "always" else code != 0 if enabled and mode == "failures" else F.lit(False)
    if no_match is not None:
        by_mode = by_mode & ~no_match
    return by_mode & (raw >= min_bytes)
