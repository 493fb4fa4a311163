"""From captures to compacted output: each tool's captures go to its text function, and every capture is accounted for.

The tools that occur are branches of one CASE over the row: a single pass without a shuffle. Which ones do is told by a scan of that column alone, so that no expressions are made and compiled for the others, and no Python is started without rows for it. Branches that need Python (JSON of any depth, source outlines) get nulls for the rows of other tools.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import groups as G
from tallyloom.functions import outline as O
from tallyloom.functions import redact as D
from tallyloom.functions import reports as R
from tallyloom.functions import text as X
from tallyloom.functions.rowwise import bound_batches
from tallyloom.functions.rules import apply_rules
from tallyloom.operators.lines import apart
from tallyloom.sources.schema import file_ext

#: Flags that turn compaction off, and what small outputs are.
DIFF_FLAGS = ("--stat", "--numstat", "--name-only", "--name-status", "--check", "--quiet", "--output", "--exit-code")
LOG_FLAGS = ("-p", "--stat", "--graph", "--numstat", "--name-only", "--name-status", "--format", "--pretty")
GREP_FLAGS = ("-h", "-l", "-c", "-o", "-q", "--quiet", "--silent", "-s", "-Z", "--color", "--colour", "--null")
GREP_PREFIXES = ("-A", "-B", "-C", "--after-context=", "--before-context=", "--context=", "--color=", "--colour=")
FIND_FLAGS = ("-print0", "-printf", "-ls", "-delete", "-exec", "-execdir", "-ok", "-okdir", "-fprint", "-fprintf", "-fls")
BRANCH_FLAGS = ("-a", "-r", "-l", "--list", "--show-current", "-v", "--verbose", "-vv", "--no-color")
SMALL_DIFF = SMALL_GREP = 1000
SMALL_FIND = 200
#: What is shown for a file in no language that summaries know.
UNKNOWN, SUMMARIZED = "unknown language", (".py", ".rs", ".ts")
#: Strategies that show nothing but standard error if their command fails.
QUIET = ("git.status", "git.diff", "git.log", "git.branch", "git.mutating", "find", "read", "smart")
LOSSLESS = ("wc", "head", "tail", "sort", "uniq")


def _has(args: Column, *flags: str) -> Column:
    return F.exists(args, lambda x: x.isin(*flags))


class Routes:
    """The routes of each family of tools as (condition, strategy, compacted output); None for output that passes through. The first that holds counts.

    A null output is a command that failed, or a parser that had nothing to work on: the capture is unrecorded. A family's expressions are made when it is asked for, as making all of them takes seconds.
    """

    def __init__(self, rules: list[dict], ultra: bool = False, failures_only: bool = False):
        self.rules, self.ultra, self.failures_only = rules, ultra, failures_only
        self.tool, self.args, self.out, self.branch, self.directories = (F.col(c) for c in ("tool", "args", "stdout", "branch", "directories"))
        self.ok, self.full = F.col("exit_code") == 0, self.out != ""
        self.sub, self.second = (F.coalesce(F.get(self.args, F.lit(k)), F.lit("")) for k in range(2))
        self.rest = F.slice(self.args, 2, F.size(self.args))

    @cached_property
    def lossless(self) -> Column:
        return X.cap(X.lossless(self.out))

    def _pair(self, tool: str, sub: str, second: str) -> Column:
        return (self.tool == tool) & (self.sub == sub) & (self.second == second)

    def git(self) -> list:
        git, sub, rest, ok, out = self.tool == "git", self.sub, self.rest, self.ok, self.out
        return [
            (git & (sub == "status") & (F.size(self.args) == 1), "git.status", F.when(ok, G.status_text(out, self.branch, self.ultra))),
            (git & (sub == "diff") & ~_has(rest, *DIFF_FLAGS), "git.diff", F.when(ok & (F.length(out) <= SMALL_DIFF), out).when(ok, G.diff_text(out))),
            (git & (sub == "log") & ~_has(rest, *LOG_FLAGS), "git.log", F.when(ok, out)),
            (git & (sub == "branch") & ~F.forall(rest, lambda x: x.isin(*BRANCH_FLAGS)), "git.branch", F.when(ok, F.lit("ok"))),
            (git & (sub == "show"), "git.show", self.lossless),
            (git & (sub == "blame"), "git.blame", self.lossless),
            (git & (sub == "stash") & (self.second == "list"), "git.stash", self.lossless),
            (git & (sub == "commit"), "git.mutating", F.when(ok, F.coalesce(F.concat(F.lit("ok "), F.col("revision")), F.lit("ok")))),
            (git & sub.isin("add", "push", "pull", "fetch"), "git.mutating", F.when(ok, F.lit("ok"))),
        ]

    def listing(self) -> list:
        ls, args = self.tool == "ls", self.args
        flags = F.filter(args, lambda x: x.startswith("-"))
        entries = F.filter(F.split(self.out, "\n", -1), lambda x: x != "")
        is_dir = lambda x: F.coalesce(F.array_contains(self.directories, x), F.lit(False))
        known = F.forall(flags, lambda x: x.isin("-l", "-a", "-la", "-al", "-lh", "-lah", "-ahl", "-hal", "-hla", "-alh", "-1", "-F"))
        return [
            (ls & (F.size(flags) > 0) & known & (F.size(args) - F.size(flags) <= 1), "ls", self.lossless),
            (ls & (F.size(flags) == 0) & (F.size(args) <= 1) & self.ok & self.directories.isNotNull(), "ls", G.listing_text(F.coalesce(F.get(args, F.lit(0)), F.lit(".")), F.filter(entries, is_dir), F.filter(entries, lambda x: ~is_dir(x)), self.ultra)),
        ]

    def tree(self) -> list:
        return [((self.tool == "tree") & (F.size(self.args) <= 1) & self.ok & F.col("tree").isNotNull(), "tree", F.col("tree"))]

    def grep(self) -> list:
        plain = ~F.exists(self.args, lambda x: x.isin(*GREP_FLAGS) | x.rlike("^(" + "|".join(GREP_PREFIXES) + ")"))
        return [((self.tool == "grep") & plain, "grep", F.when(F.col("exit_code") == 1, F.lit("no matches")).when(self.ok & (F.length(self.out) <= SMALL_GREP), self.out).when(self.ok, G.match_text(self.out)))]

    def find(self) -> list:
        return [((self.tool == "find") & ~_has(self.args, *FIND_FLAGS), "find", F.when(self.ok & (F.length(self.out) <= SMALL_FIND), self.out).when(self.ok, G.path_text(self.out)))]

    def plain(self) -> list:
        return [(self.tool.isin(*LOSSLESS), "lossless", self.lossless), (self.tool == "rg", "rg", self.lossless), (self.tool == "cat", "cat", self.lossless)]

    def sources(self) -> list:
        out, ok = self.out, self.ok
        ext, level = file_ext(self.sub), F.coalesce(F.get(self.args, F.lit(2)), F.lit("none"))
        read, smart = (self.tool == "read") & ok, self.tool == "smart"
        known = read & F.when(level == "aggressive", ext.isin(*O.OUTLINED)).when(level == "minimal", ext.isin(".py", *O.SLASH_COMMENTS)).otherwise(F.lit(False))
        return [
            (known & (level == "minimal"), "read", O.without_comments(out, ext)),
            (known, "read", O.outline(F.when(known & (level == "aggressive"), out), ext)),
            ((self.tool == "read") & ~ok, "read", F.lit(None).cast("string")),
            (smart & ~ext.isin(*SUMMARIZED), "smart", F.lit(UNKNOWN)),
            (smart, "smart", F.when(ok, O.summary_text(out, ext))),
        ]

    def tests(self) -> list:
        named = {"cargo": self.sub == "test", "go": self.sub == "test"}
        return [((self.tool == name) & named.get(name, F.lit(True)), "test", R.test_text(report(self.out), self.failures_only)) for name, report in R.TEST_REPORTS.items()]

    def linters(self) -> list:
        tool, text = self.tool, self.out
        return [
            (tool == "ruff", "linter", R.ruff_text(text)),
            (tool == "tsc", "linter", R.tsc_text(text)),
            (tool == "eslint", "linter", R.eslint_text(text)),
            (tool == "golangci-lint", "linter", R.golangci_text(text)),
            ((tool == "cargo") & self.sub.isin("", "build", "clippy"), "linter", R.cargo_text(text)),
            (tool == "next", "linter", R.next_text(text)),
        ]

    def packages(self) -> list:
        tool, sub, text = self.tool, self.sub, self.out
        return [
            ((tool == "pip") & (sub == "install"), "package", R.pip_install_text(text)),
            (tool == "pip", "package", R.pip_list_text(text)),
            (((tool == "uv") & (sub == "run")) | self._pair("uv", "pip", "install"), "package", R.uv_text(text)),
            ((tool == "npm") & (sub == "list"), "package", R.npm_list_text(text)),
            ((tool == "pnpm") & (sub == "list"), "package", R.pnpm_list_text(text)),
            (tool.isin("npm", "pnpm") & sub.isin("install", "ci"), "package", R.npm_install_text(text)),
        ]

    def infra(self) -> list:
        tool, sub = self.tool, self.sub
        listed = ((tool == "docker") & sub.isin("ps", "images", "logs")) | self._pair("docker", "compose", "ps") | ((tool == "kubectl") & sub.isin("logs", "get")) | ((tool == "gh") & sub.isin("pr", "issue", "run"))
        return [(listed, "infra", D.compact_infra(self.out))]

    def cloud(self) -> list:
        # nulls for the rows of other tools: JSON is read in Python
        aws = (self.tool == "aws") & (F.size(self.args) > 0)
        return [(aws, "infra", D.compact_cloud(F.when(aws & self.full, self.out)))]

    def generic(self) -> list:
        ran = X.cap(X.lossless(apply_rules(self.out, self.sub, self.rules)))
        return [(self.tool == "run", "generic", F.when(self.ok, ran).otherwise(F.lit(""))), (self.tool == "errors", "errors", F.lit("")), (self.tool == "digest", "digest", X.digest(self.out))]


#: The tools of each family of routes.
FAMILIES = {
    "git": ("git",),
    "listing": ("ls",),
    "tree": ("tree",),
    "grep": ("grep",),
    "find": ("find",),
    "plain": (*LOSSLESS, "rg", "cat"),
    "sources": ("read", "smart"),
    "tests": ("pytest", "cargo", "go", "jest", "vitest"),
    "linters": ("ruff", "tsc", "eslint", "golangci-lint", "cargo", "next"),
    "packages": ("pip", "uv", "npm", "pnpm"),
    "infra": ("docker", "kubectl", "gh"),
    "cloud": ("aws",),
    "generic": ("run", "errors", "digest"),
}


def tools_of(captures: DataFrame) -> list[str]:
    """Which of the tools that have routes occur: at most as many names as there are, from one narrow scan."""
    known = sorted({t for tools in FAMILIES.values() for t in tools})
    return [r.tool for r in captures.where(F.col("tool").isin(*known)).select("tool").distinct().collect()]


def routes(rules: list[dict], ultra: bool = False, failures_only: bool = False, tools: list[str] | None = None) -> list[tuple[Column, str, Column | None]]:
    """The routes of the families that any of the tools is of; of all families without tools."""
    made = Routes(rules, ultra, failures_only)
    return [route for family, members in FAMILIES.items() if tools is None or set(members) & set(tools) for route in getattr(made, family)()]


#: Strategies whose compacted output goes through user rules.
RULED = ("test", "linter", "package", "infra")


def compact(captures: DataFrame, rules: list[dict] | None = None, bypass: list[str] | None = None, ultra: bool = False, failures_only: bool = False, tools: list[str] | None = None) -> DataFrame:
    """captures with strategy, output, passthrough and recorded. Optional columns branch and revision hold what git says of the work tree; directories (array of strings) the names among a listed directory's entries that are directories. Where it is null, as for a listed file, a bare ls passes through; tree (lines.with_trees) the text of the directory's tree, without which `tree` passes through. Trees are shown and not recorded. ultra: the shortest listings; failures_only: test reports without their counts. Commands that failed are shown and not recorded, and so are captures that their parser can't work on (numbers or nesting beyond all measure, bytes that are no UTF-8): they come out raw. An input column with the name of one that is made here comes back as input_<name>. tools: the tools that occur, if they are known; captures of others pass through."""
    bound_batches(captures.sparkSession)
    rules = rules or []
    captures, _ = apart(captures, ("strategy", "output", "passthrough", "recorded", "way", "compacted"))
    rows = captures
    for extra, kind in (("branch", "string"), ("revision", "string"), ("directories", "array<string>"), ("tree", "string")):
        if extra not in rows.columns:
            rows = rows.withColumn(extra, F.lit(None).cast(kind))
    rows = rows.withColumns({"args": F.coalesce("args", F.array().cast("array<string>")), "stdout": F.coalesce("stdout", F.lit("")), "stderr": F.coalesce("stderr", F.lit(""))})
    table = routes(rules, ultra, failures_only, tools_of(captures) if tools is None else tools)
    skip = F.col("tool").isin(*bypass) if bypass else F.lit(False)
    way, strategy = F.when(skip, -1), F.when(F.col("way") < 0, "passthrough")
    shown: dict[int, tuple[Column | None, list[int]]] = {}  # routes that show the same share one branch
    for k, (test, name, text) in enumerate(table):
        way, strategy = way.when(F.coalesce(test, F.lit(False)), k), strategy.when(F.col("way") == k, name)
        shown.setdefault(id(text), (text, []))[1].append(k)
    output = F.when(F.col("way") < 0, F.col("stdout"))
    for text, ways in shown.values():
        output = output.when(F.col("way").isin(*ways), text)
    rows = rows.withColumn("way", way.otherwise(-1)).withColumn("strategy", strategy)
    nothing = F.col("strategy").isin(*RULED) & (F.col("stdout") == "")
    out = rows.withColumn("compacted", F.when(~nothing, output.otherwise(F.col("stdout"))))
    ruled = F.when(F.col("strategy").isin(*RULED) & (F.col("compacted") != ""), apply_rules(F.col("compacted"), F.col("tool"), rules)).otherwise(F.col("compacted"))
    return out.select(*captures.columns, "strategy", F.coalesce(ruled, F.when(F.col("strategy").isin(*QUIET) & (F.col("exit_code") != 0), "").otherwise(F.col("stdout"))).alias("output"), (F.col("strategy") == "passthrough").cast("int").alias("passthrough"), (F.col("compacted").isNotNull() & (F.col("strategy") != "tree") & ~((F.col("strategy") == "smart") & (F.col("compacted") == UNKNOWN))).alias("recorded"))
