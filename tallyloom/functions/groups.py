"""Ordered grouping of captured listings: status lines, diffs, matches and paths. Groups come in order of first appearance unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.arrays import cut_at_markers, first_n, grouped, keyed, let
from tallyloom.functions.text import clip, join_lines, lines_of

MORE = "  ... (%d more)"


def _full_lines(text: Column) -> Column:
    return F.filter(lines_of(text), lambda x: x != "")


def _more(n: Column, shown: int, label: str = MORE) -> Column:
    """A line that counts what isn't shown, or none."""
    return F.when(n > shown, F.array(F.format_string(label, n - shown))).otherwise(F.array().cast("array<string>"))


def status_groups(text: Column) -> Column:
    """Changed paths by status code."""
    return grouped(keyed(_full_lines(text), lambda x: F.trim(F.substring(x, 1, 2)), lambda x: F.substring(x, F.lit(4), F.length(x))))


def status_text(text: Column, branch: Column, ultra: bool = False, most: int = 200) -> Column:
    def show(g: Column) -> Column:
        n, shown = F.size(g["vals"]), first_n(g["vals"], most)
        if ultra:
            head = F.array(F.concat(g["key"], F.lit(":"), n.cast("string"), F.lit(" "), F.array_join(shown, " ")))
        else:
            head = F.concat(F.array(F.format_string("%s (%d):", g["key"], n)), F.transform(shown, lambda p: F.concat(F.lit("  "), p)))
        return F.concat(head, _more(n, most))

    top = lambda g: F.when(branch.isNotNull(), F.array(F.concat(F.lit("* "), branch))).when(F.size(g) == 0, F.array(F.lit("no commits yet"))).otherwise(F.array().cast("array<string>"))
    return let(status_groups(text), lambda g: join_lines(F.concat(top(g), F.flatten(F.transform(g, show)))))


def diff_path(header: Column) -> Column:
    """The path of a diff, with the old one before it if it differs."""
    bare = F.regexp_replace(header, "^diff --git ", "")
    new = F.regexp_extract(header, "(?s)^.*? b/(.*)$", 1)
    left = F.regexp_extract(header, "(?s)^(.*?) b/", 1)
    old = F.when(left.contains("a/"), F.regexp_extract(left, "(?s)^.*?a/(.*)$", 1)).otherwise(F.regexp_replace(left, "^diff --git ", ""))
    return F.when(~header.contains(" b/"), bare).when(old != new, F.concat(old, F.lit(" -> "), new)).otherwise(old)


def _changed(x: Column, sign: str) -> Column:
    return x.startswith(sign) & ~x.startswith(sign * 3)


def diff_stats(text: Column) -> Column:
    """path, additions, deletions and changed lines of each file of a diff."""
    blocks = cut_at_markers(lines_of(text), lambda x: x.startswith("diff --git "))

    def stats(b: Column) -> Column:
        plus, minus = F.filter(b, lambda x: _changed(x, "+")), F.filter(b, lambda x: _changed(x, "-"))
        return F.struct(diff_path(b[0]).alias("path"), F.size(plus).alias("additions"), F.size(minus).alias("deletions"), F.filter(b, lambda x: _changed(x, "+") | _changed(x, "-")).alias("changed"))

    return F.transform(blocks, stats)


def diff_text(text: Column, shown: int = 5, limit: int = 300) -> Column:
    def show(s: Column) -> Column:
        more = F.when(F.size(s["changed"]) > shown, F.array(F.lit("... (truncated, full in tee)"))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(s["path"], F.format_string("+%d -%d", s["additions"], s["deletions"])), F.transform(first_n(s["changed"], shown), lambda x: clip(x, limit)), more)

    return join_lines(F.flatten(F.transform(diff_stats(text), show)))


def match_groups(text: Column, limit: int = 200) -> Column:
    """Matches by file; lines without a colon go to (no path). Notes on binary files aren't matches."""
    found = F.filter(_full_lines(text), lambda x: ~x.startswith("Binary file "))
    at = lambda x: F.instr(x, ":")
    file = lambda x: F.when(at(x) > 0, F.substring(x, F.lit(1), at(x) - 1)).otherwise(F.lit("(no path)"))
    return grouped(keyed(found, file, lambda x: clip(F.substring(x, at(x) + 1, F.length(x)), limit)))


def match_text(text: Column, shown: int = 5) -> Column:
    binary = F.filter(lines_of(text), lambda x: x.startswith("Binary file "))

    def show(g: Column) -> Column:
        more = F.when(F.size(g["vals"]) > shown, F.array(F.lit("  ..."))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.format_string("%s: %d matches", g["key"], F.size(g["vals"]))), F.transform(first_n(g["vals"], shown), lambda m: F.concat(F.lit("  "), m)), more)

    return join_lines(F.concat(binary, F.flatten(F.transform(match_groups(text), show))))


def dir_name(path: Column) -> Column:
    """What stands before the last slash, without slashes at its end unless there is nothing else."""
    head = F.regexp_extract(path, "(?s)^(.*/)", 1)
    return F.when(head.rlike("^/+$"), head).otherwise(F.regexp_replace(head, r"/+\z", ""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def path_groups(text: Column) -> Column:
    """Names by directory, sorted and distinct."""
    groups = grouped(keyed(_full_lines(text), dir_name, base_name))
    return F.transform(groups, lambda g: F.struct(g["first"].alias("first"), g["key"].alias("key"), F.array_sort(F.array_distinct(g["vals"])).alias("vals")))


def path_text(text: Column, dirs: int = 200, names: int = 10) -> Column:
    def show(g: Column) -> Column:
        n = F.size(g["vals"])
        return F.concat(F.array(F.format_string("%s (%d):", g["key"], n)), F.transform(first_n(g["vals"], names), lambda x: F.concat(F.lit("  "), x)), _more(n, names))

    return let(path_groups(text), lambda g: join_lines(F.concat(F.flatten(F.transform(first_n(g, dirs), show)), _more(F.size(g), dirs, "... (%d more dirs)"))))


def listing_text(path: Column, dirs: Column, files: Column, ultra: bool = False, all_up_to: int = 30, each: int = 10) -> Column:
    """A directory's entries, directories first, both sorted; of more than all_up_to only the first of either kind."""
    total = F.size(dirs) + F.size(files)
    shown = F.when(total <= all_up_to, F.concat(F.array_sort(dirs), F.array_sort(files))).otherwise(F.concat(first_n(F.array_sort(dirs), each), first_n(F.array_sort(files), each)))
    label = F.regexp_replace(path, r"/+\z", "")

    def show(s: Column) -> Column:
        left = total - F.size(s)
        many = total > all_up_to
        if ultra:
            more = F.when(many & (left > 0), F.array(F.format_string("... (%d more)", left))).otherwise(F.array().cast("array<string>"))
            return F.concat(F.array(F.format_string("%s/ (%d): %s", label, total, F.array_join(s, " "))), more)
        more = F.when(many, F.array(F.format_string(MORE, left))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.format_string("%s/ (%d)", label, total)), F.transform(s, lambda x: F.concat(F.lit("  "), x)), more)

    return let(shown, lambda s: join_lines(show(s)))
