"""Test, linter, build and package reports. A state that the last marker line decides is an array cut at its markers; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.arrays import cut_at_markers, leading, let, segments, where_index, without_trailing
from tallyloom.functions.text import as_int, first_int, join_lines, lines_of, ltrim, section, trim


def _none() -> Column:
    return F.array().cast("array<string>")


def _blank(x: Column) -> Column:
    return trim(x) == ""


def _starts(x: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | x.startswith(m)
    return out


def _report(failures: Column, failed: Column, passed: Column) -> Column:
    return F.struct(failures.alias("failures"), failed.try_cast("int").alias("failed"), passed.try_cast("int").alias("passed"))


def _sum_matches(text: Column, pattern: str, group: int) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(0), lambda a, x: F.try_add(a, x.try_cast("int")))


#: Line ends that count within a test summary.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def pytest_report(text: Column) -> Column:
    block = trim(section(text, "=== FAILURES ===\n", "\n=== short test summary info ==="))
    failure = r"(?U)^FAILED\s+(\S+)\s+-\s+(.*)"
    found = F.filter(F.split(section(text, "=== short test summary info ==="), LINE_ENDS, -1), lambda x: x.rlike(failure))

    def item(x: Column) -> Column:
        spec = F.regexp_extract(x, failure, 1)
        return F.struct(F.split_part(spec, F.lit("::"), F.lit(1)).alias("key"), F.concat(spec, F.lit(" - "), F.regexp_extract(x, failure, 2)).alias("val"))

    numbered = F.transform(found, lambda x, i: F.struct(item(x)["key"].alias("key"), i.alias("pos"), item(x)["val"].alias("val")))
    by_file = segments(F.array_sort(numbered), lambda b, i: (i == 0) | (F.get(b, i)["key"] != F.get(b, i - 1)["key"]))
    groups = F.flatten(F.transform(by_file, lambda g: F.concat(F.array(F.concat(g[0]["key"], F.lit(":"))), F.transform(g, lambda x: F.concat(F.lit("  "), x["val"])))))
    parts = F.concat(F.when(block != "", F.array(block)).otherwise(_none()), groups)
    return _report(join_lines(parts), F.try_add(first_int(text, r"(\d+) failed"), first_int(text, r"(\d+) error")), first_int(text, r"(\d+) passed"))


def cargo_test_report(text: Column) -> Column:
    counts = r"(\d+) passed; (\d+) failed"
    return _report(trim(section(text, "failures:", "test result:")), _sum_matches(text, counts, 2), _sum_matches(text, counts, 1))


def go_test_report(text: Column) -> Column:
    a = lines_of(text)
    cut = cut_at_markers(a, lambda x: ~(x.startswith("    ") | x.startswith("\t")))
    kept = F.transform(cut, lambda s: F.when(s[0].startswith("--- FAIL:"), s).when(s[0].startswith("FAIL"), F.array(s[0])).otherwise(_none()))
    count = lambda mark: F.size(F.filter(a, lambda x: x.startswith(mark)))
    return _report(trim(join_lines(F.flatten(kept))), count("--- FAIL:"), count("--- PASS:"))


def jest_report(text: Column) -> Column:
    """Counts come from a line that has both; a run without failures reports 0 and 0."""
    ends = ("PASS ", "FAIL ", "Test Suites:", "Tests:", "Snapshots:", "Time:")
    cut = cut_at_markers(lines_of(text), lambda x: _starts(x, ends))
    kept = F.filter(cut, lambda s: s[0].startswith("FAIL "))
    tests = r"(?U)Tests:\s+(\d+) failed,\s+(\d+) passed"
    return _report(trim(join_lines(F.flatten(kept))), first_int(text, tests), as_int(F.regexp_extract(text, tests, 2)))


def vitest_report(text: Column) -> Column:
    """A failed test is preceded by its file's line only where no other test of that file came between."""
    mark = lambda x: F.substring(ltrim(x), 1, 1)
    cut = cut_at_markers(lines_of(text), lambda x: mark(x).isin("❯", "✓", "×"))

    def show(cut_: Column) -> Column:
        file = lambda i: F.when((i > 0) & (mark(F.get(cut_, i - 1)[0]) == "❯"), F.array(trim(F.substring(ltrim(F.get(cut_, i - 1)[0]), F.lit(2), F.length(F.get(cut_, i - 1)[0]))))).otherwise(_none())
        rest = lambda s: leading(F.slice(s, 2, F.size(s)), lambda x: mark(x) == "→")
        return F.flatten(F.transform(cut_, lambda s, i: F.when(mark(s[0]) == "×", F.concat(file(i), F.array(s[0]), rest(s))).otherwise(_none())))

    tests = r"(?U)Tests\s+(\d+) failed\s*\|\s*(\d+) passed"
    return _report(trim(join_lines(let(cut, show))), first_int(text, tests), as_int(F.regexp_extract(text, tests, 2)))


TEST_REPORTS = {"pytest": pytest_report, "cargo": cargo_test_report, "go": go_test_report, "jest": jest_report, "vitest": vitest_report}


def test_text(report: Column, failures_only: bool = False) -> Column:
    """The report as it is shown; null if its counts couldn't be read."""
    if failures_only:
        return report["failures"]
    known = report["failed"].isNotNull() & report["passed"].isNotNull()
    counter = F.when(known, F.format_string("%d failed, %d passed", report["failed"], report["passed"]))
    return F.when(known, F.concat_ws("\n", F.when(trim(report["failures"]) != "", report["failures"]), counter))


def _with_count(kept: Column, n=F.size) -> Column:
    return let(kept, lambda a: join_lines(F.when(n(a) > 0, F.concat(a, F.array(F.format_string("%d errors", n(a))))).otherwise(a)))


def _matching(pattern: str):
    return lambda text: _with_count(F.filter(lines_of(text), lambda x: x.rlike(pattern)))


ruff_text = _matching(r"(?U)^\S+:\d+:\d+:")
tsc_text = _matching(r"(?U)\(\d+,\d+\):\s*error TS\d+")
golangci_text = _matching(r"(?U)^\S+\.go:\d+:\d+:")


def eslint_text(text: Column) -> Column:
    indented = lambda x: x.startswith(" ") | x.startswith("\t")
    kept = F.filter(lines_of(text), lambda x: ~_blank(x) & ~ltrim(x).startswith("✖") & (~indented(x) | x.contains("error")))
    return _with_count(kept, lambda a: F.size(F.filter(a, indented)))


#: Beginnings of progress lines.
CARGO_PROGRESS = ("   Compiling", "    Finished", "   Building", "    Checking", "       Fresh", "       Dirty", "   Downloading", "     Locking")
NEXT_PROGRESS = ("   ▲", "   Creating", "   Linting", " ✓ Compiled", " ✓ ", "   Generating", "   Finalizing")
UV_PROGRESS = ("Resolved ", "Downloading ", "Prepared ", "Installed ", "Audited ", "Building ", "Updated ", "Uninstalled ")
UV_SPINNER = "[⠋⠙⠹⠸⠼⠴⠦⠧⠇⠏]"
NPM_PROGRESS = ("npm warn ", "npm notice ", "added ", "removed ", "changed ", "audited ", "funding ", "run `npm ")
PIP_PROGRESS = ("Collecting ", "Downloading ", "Using cached ", "Requirement already")
PIP_SUMMARY = ("Installing collected packages:", "Successfully installed", "ERROR", "error:")


def cargo_text(text: Column) -> Column:
    """Error blocks: a line that begins with error and the indented or blank ones below it."""
    told = F.filter(lines_of(text), lambda x: ~_starts(x, CARGO_PROGRESS))
    below = lambda x: (x.startswith(" ") | _blank(x)) & ~x.startswith("    = warning")
    kept = F.flatten(F.filter(cut_at_markers(told, lambda x: ~below(x)), lambda s: s[0].startswith("error")))
    previous = F.regexp_extract(text, r"due to (\d+) previous error", 1)
    n = F.when(previous == "", F.regexp_count(text, F.lit(r"(?m)^error(?:\[|:)"))).otherwise(previous.try_cast("int"))
    return F.when(n.isNotNull(), join_lines(F.concat(without_trailing(kept, _blank), F.array(F.format_string("%d errors", n)))))


def next_text(text: Column) -> Column:
    """From the failure to the line that ends the build."""
    told = F.filter(lines_of(text), lambda x: ~_starts(x, NEXT_PROGRESS))

    def block(a: Column) -> Column:
        first = F.get(where_index(a, lambda b, i: trim(F.get(b, i)) == "Failed to compile."), F.lit(0))
        last = lambda f: F.coalesce(F.get(where_index(a, lambda b, i: (i > f) & F.get(b, i).startswith("> Build failed")), F.lit(0)), F.size(a) - 1)
        return let(first, lambda f: F.when(f.isNull(), _none()).otherwise(F.slice(a, f + 1, last(f) - f + 1)))

    return trim(join_lines(let(told, block)))


def pip_list_text(text: Column) -> Column:
    rule = lambda x: trim(x).rlike("^[- ]+$")
    return join_lines(F.filter(lines_of(text), lambda x: ~_blank(x) & ~ltrim(x).startswith("Package") & ~rule(x)))


def uv_text(text: Column) -> Column:
    kept = F.filter(lines_of(text), lambda x: ~_starts(ltrim(x), UV_PROGRESS) & ~x.rlike(UV_SPINNER))
    return join_lines(without_trailing(kept, _blank))


def npm_list_text(text: Column) -> Column:
    return join_lines(F.filter(lines_of(text), lambda x: ~_blank(x) & _starts(x, (" ", "├", "└", "│"))))


def pnpm_list_text(text: Column) -> Column:
    told = F.filter(lines_of(text), lambda x: ~_blank(x) & ~_starts(ltrim(x), ("Legend:", "project@")))
    first = lambda a: F.get(where_index(a, lambda b, i: trim(F.get(b, i)).endswith(":")), F.lit(0))
    return join_lines(let(told, lambda a: let(first(a), lambda f: F.when(f.isNull(), _none()).otherwise(F.slice(a, f + 1, F.size(a))))))


def npm_install_text(text: Column) -> Column:
    """What isn't progress, with the summary last."""
    told = F.filter(lines_of(text), lambda x: ~_blank(x) & ~_starts(F.lower(trim(x)), NPM_PROGRESS))
    sums = lambda x: ltrim(x).startswith("up to date") | F.lower(x).contains("packages in")
    return let(told, lambda a: join_lines(F.concat(F.filter(a, lambda x: ~sums(x)), F.transform(F.filter(a, sums), trim))))


def pip_install_text(text: Column) -> Column:
    told = F.filter(lines_of(text), lambda x: ~_blank(x) & ~_starts(ltrim(x), PIP_PROGRESS) & (_starts(ltrim(x), PIP_SUMMARY) | ~trim(x).rlike("^[- =]+$")))
    return join_lines(F.transform(told, lambda x: F.when(_starts(ltrim(x), PIP_SUMMARY), trim(x)).otherwise(x)))
