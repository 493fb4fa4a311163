"""Text to text, line by line: escape codes, repeats, caps, digests. Native column expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.arrays import first_n, last_n, let, runs

#: Escape sequences and the markers of shortened text.
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
CLIPPED = "...(truncated)"
OMITTED = "...[truncated: %d lines omitted — сузьте команду]"
SKIPPED = "... (%d lines skipped — сузьте команду)"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def lines_of(text: Column) -> Column:
    """All lines; a final newline gives an empty last one."""
    return F.split(text, "\n", -1)


def closed_lines(text: Column) -> Column:
    """Lines without the empty one behind a final newline."""
    return let(lines_of(text), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def join_lines(a: Column) -> Column:
    return F.array_join(a, "\n")


def trim(text: Column) -> Column:
    """White space of all kinds off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def ltrim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+", "")


def rewrap(text: Column, change) -> Column:
    """Applies change to the array of lines and keeps a final newline. Empty and null texts stay."""
    end = F.when(F.endswith(text, F.lit("\n")), F.lit("\n")).otherwise(F.lit(""))
    return F.when(text.isNull() | (text == ""), text).otherwise(F.concat(join_lines(change(closed_lines(text))), end))


def run_lines(a: Column, label: str, blanks: bool) -> Column:
    """Runs of equal lines as one line with a count; with blanks=False empty lines stay as they are."""

    def show(r: Column) -> Column:
        many = r["n"] > 1 if blanks else (r["n"] > 1) & (r["item"] != "")
        return F.when(many, F.array(F.concat(r["item"], F.format_string(label, r["n"])))).otherwise(F.array_repeat(r["item"], r["n"]))

    return F.flatten(F.transform(runs(a), show))


def collapse(text: Column) -> Column:
    """Neighbouring equal lines as one with its count; nothing is lost."""
    return rewrap(text, lambda a: run_lines(a, "  [×%d]", blanks=False))


def lossless(text: Column) -> Column:
    return collapse(strip_ansi(text))


def clip(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def clip_line(line: Column, limit: int) -> Column:
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(clip(line, limit), F.lit(CLIPPED)))


def cap(text: Column, max_lines: int = 500, max_chars: int = 300) -> Column:
    """Head and tail of a long text around a marker that counts what is left out; long lines are clipped."""
    most = max(1, max_lines)
    head = most // 2

    def shorten(a: Column) -> Column:
        clipped = F.transform(a, lambda x: clip_line(x, max_chars))
        marked = lambda b: F.concat(first_n(b, head), F.array(F.format_string(OMITTED, F.size(b) - most)), last_n(b, most - head))
        return let(clipped, lambda b: F.when(F.size(b) <= max_lines, b).otherwise(marked(b)))

    return rewrap(text, shorten)


def digest(text: Column, n: int = 10) -> Column:
    """First and last n lines of a text of more than 2n."""
    short = lambda a: join_lines(F.concat(first_n(a, n), F.array(F.format_string(SKIPPED, F.size(a) - 2 * n)), last_n(a, n)))
    return let(closed_lines(text), lambda a: F.when(F.size(a) <= 2 * n, text).otherwise(short(a)))


def dedupe_lines(a: Column, limit: int | None = None) -> Column:
    """First appearances in order."""
    return F.array_distinct(a) if limit is None else first_n(F.array_distinct(a), limit)


def section(text: Column, start: str, end: str | None = None) -> Column:
    """What stands between the first start mark and the next end mark, or the text's end; empty without a start."""
    rest = lambda at: F.substring(text, at + len(start), F.length(text))
    cut = lambda r, e: F.when(e > 0, F.substring(r, F.lit(1), e - 1)).otherwise(r)
    body = (lambda at: rest(at)) if end is None else (lambda at: let(rest(at), lambda r: let(F.instr(r, end), lambda e: cut(r, e))))
    return let(F.instr(text, start), lambda at: F.when(at > 0, body(at)).otherwise(F.lit("")))


def first_int(text: Column, pattern: str) -> Column:
    """The first group of the first match as a number; 0 without a match, null for a number that is too large."""
    return as_int(F.regexp_extract(text, pattern, 1))


def as_int(digits: Column) -> Column:
    """Digits as a number; 0 for none, null for a number that is too large."""
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))
