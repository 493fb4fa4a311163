"""Queries over commands and captures of every kind, failed ones and null keys included, and what they give in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import classify as C
from tallyloom.functions.rowwise import bound_batches
from tallyloom.operators import accounting, lines, route, ruletable
from tallyloom.plans.reports import K, W
from tallyloom.sources import derived, sinks

#: Commands that may be rewritten, and commands that must not be.
ACCEPTED = [
    "git status", "git status -s", "git diff HEAD", "git log -n 5", "git show HEAD", "git blame f.py", "git rev-parse HEAD", "git add .", "git commit -m 'a b'", "git push", "git pull", "git fetch", "git stash list", "git branch", "git branch -a -v", "git branch --show-current",
    "grep -rn x .", "rg x", "cat f.txt", "tree", "ls", "ls -la src", "ls -1", "find . -name x", "pytest -q", "jest", "vitest run", "tsc --noEmit", "eslint src", "ruff check", "golangci-lint run", "next build", "cargo test", "cargo build", "cargo clippy", "go test ./...",
    "pip list", "pip install x", "npm list", "npm ci", "pnpm install", "uv run x", "uv pip install x", "docker ps", "docker compose ps", "docker logs c", "kubectl get pods", "kubectl logs p", "gh pr list", "gh run view", "wc -l f", "head -5 f", "tail -5 f", "sort f", "uniq f", 'cat "a b.txt"',
]
REJECTED = [
    "git", "git merge x", "git stash", "git stash pop", "git branch new", "git branch -D x", "git diff --output=f", "git log --out x", "git rebase", "ls -Z", "ls a b", "find . -delete", "find . -exec rm", "find . -fprint f", "tail -f log", "tail --follow=name f", "sort -o f f", "sort --output=f f",
    "eslint --fix src", "ruff check --fix", "ruff format", "golangci-lint run --fix", "next build --fix-x", "cargo run", "go build", "pip uninstall x", "npm run x", "pnpm add x", "uv add x", "uv pip list", "docker run x", "docker compose up", "docker compose", "kubectl apply -f x", "gh repo view", "gh",
    "cat a | wc", "cat a; rm b", "cat a && b", "cat a > b", "cat < a", "cat $HOME", "cat `x`", "cat (a)", "cat {a}", "cat #x", "cat 'open", 'cat "open', "tally git status", "rm -rf x", "make", "sudo ls", "LS", " ", "echo x", "./pytest", "cat a & b",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def classified(spark, sf: str):
    """Each event's command: every third from the ledger, the others from the two lists."""
    bound_batches(spark)
    commands = F.array(*[F.lit(c) for c in ACCEPTED + REJECTED])
    own = F.get(commands, (F.col("event_id") % len(ACCEPTED + REJECTED)).cast("int"))
    calls = derived.calls(spark, sf).select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("command_text")).otherwise(own).alias("command")).where("command <> ''")
    return calls.select("event_id", "command", C.rewrite(F.col("command")).alias("rewritten"))


#: Kinds of captures: tool, arguments, standard output (SQL for both engines), exit code, and what is recorded of it: strategy, bytes shown, passthrough. No strategy: nothing is recorded.
KINDS = [
    ("git", ["push"], W, 0, "git.mutating", "3"),
    ("git", ["push"], W, 1, None, "0"),
    ("git", ["diff"], W, 128, None, "0"),
    ("git", ["log"], W, 0, "git.log", "8"),
    ("git", ["branch", "new"], "''", 0, "git.branch", "3"),
    ("git", ["commit"], W, 1, None, "0"),
    ("grep", ["x"], "''", 1, "grep", "11"),
    ("grep", ["x"], W, 2, None, "0"),
    ("grep", ["x"], W, 0, "grep", "8"),
    ("grep", ["-c", "x"], W, 0, "passthrough", "8"),
    ("find", ["."], W, 1, None, "0"),
    ("find", ["."], W, 0, "find", "8"),
    ("read", ["a.py"], W, 1, None, "0"),
    ("smart", ["a.java"], W, 0, None, "0"),
    ("smart", ["a.py"], W, 1, None, "0"),
    ("cat", ["f"], f"concat({W}, chr(10), {W}, chr(10))", 0, "cat", "16"),
    ("digest", [], W, 0, "digest", "9"),
    ("errors", [], W, 3, "errors", "0"),
    ("run", ["make"], W, 2, "generic", "10"),
    ("nope", ["a", "b"], W, 7, "passthrough", "8"),
    ("pytest", [], "'1 passed'", 0, "test", "19"),
    ("ls", [], W, 0, "passthrough", "8"),
    ("ls", ["-la"], W, 0, "ls", "8"),
]


def kinds_of_captures(spark, sf: str):
    pick = lambda values: F.get(F.array(*values), (F.col("doc_id") % len(KINDS)).cast("int"))
    docs = derived.documents(spark, sf).select("doc_id", F.lit(0).alias("pos"))
    text = lambda sql: F.expr(sql.replace("chr(10)", "char(10)"))
    args = [F.array(*[F.lit(a) for a in k[1]]).cast("array<string>") for k in KINDS]
    return docs.select(F.col("doc_id").alias("capture_id"), pick([F.lit(k[0]) for k in KINDS]).alias("tool"), pick(args).alias("args"), pick([text(k[2]) for k in KINDS]).alias("stdout"), F.lit("").alias("stderr"), pick([F.lit(k[3]) for k in KINDS]).alias("exit_code"))


def routed_ledger(spark, sf: str):
    """What the ledger gets of captures that succeed, fail, or pass through."""
    rows = accounting.ledger_rows(accounting.account(route.compact(kinds_of_captures(spark, sf))), F.lit(1_700_000_000))
    return rows.groupBy("command_text", "category", "strategy", "exit_code", "passthrough").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes_before").alias("before"), F.sum("bytes_after").alias("after"))


def _routed_sql() -> str:
    rows = ", ".join(f"({k}, {_quoted(' '.join([tool, *args]))}, {_quoted(tool)}, {_quoted(name) if name else 'null'}, {code}, {shown})" for k, (tool, args, _, code, name, shown) in enumerate(KINDS))
    before = " ".join(f"when {k} then {text}" for k, (_, _, text, _, _, _) in enumerate(KINDS))
    return f"""with k(kind, command_text, category, strategy, exit_code, shown) as (values {rows}),
      d as (select doc_id % {len(KINDS)} as kind, strlen(case doc_id % {len(KINDS)} {before} end) as bytes from (select doc_id, 0 as pos from documents))
      select command_text, category, strategy, exit_code, (strategy = 'passthrough')::int as passthrough, count(*) as n, cast(sum(bytes) as bigint) as before, cast(sum(shown) as bigint) as after
      from d join k using (kind) where strategy is not null group by all"""


def first_of_each(spark, sf: str):
    """A group of null keys is a group."""
    calls = derived.calls(spark, sf).select(F.expr("nullif(category, 'view')").alias("category"), F.expr("nullif(exit_code, 1)").alias("code"), "event_id", "timestamp")
    return lines.first_k(calls, ["category", "code"], ["timestamp", "event_id"], 4)


def old_records(spark, sf: str):
    calls = derived.calls(spark, sf).select(F.col("timestamp").alias("time"), F.col("event_id").cast("string").alias("name"))
    return sinks.expired(calls)


def trees(spark, sf: str):
    """Files at up to three levels, one root for each language of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "doc_id", F.lit(0).alias("pos")).where("lang is not null")
    return lines.tree_rows(docs.select("lang", F.expr(_PATH).alias("path")).distinct(), "lang", F.col("path"), ["skip"], ["*.pyc"], most=60)


_PATH = f"case when {K} < 4 then concat('f', {W}) when {K} < 6 then concat('skip/', {W}) when {K} = 6 then concat('a/', {W}, '.pyc') when {K} < 11 then concat('d', doc_id % 4, '/', {W}) else concat('d', doc_id % 4, '/e', doc_id % 3, '/', {W}, '.py') end"

#: Captures of whole texts that their parsers can't work on, and some that they can: tool, arguments, what stands before the text, whether a byte that is no UTF-8 stands after it, and whether it is recorded.
BROKEN = [
    ("pytest", [], "99999999999 failed", False, False),
    ("pytest", [], "1 failed, 2 passed", False, True),
    ("cargo", ["test"], "2147483647 passed; 0 failed 2 passed; 0 failed", False, False),
    ("cargo", ["build"], "due to 99999999999 previous error", False, False),
    ("jest", [], "Tests: 99999999999 failed, 1 passed", False, False),
    ("vitest", [], "Tests 1 failed | 99999999999 passed", False, False),
    ("go", ["test"], "--- PASS: x", False, True),
    ("aws", ["s3"], "{", True, False),
    ("read", ["a.py", "-l", "aggressive"], "x = 1", True, False),
]


def routed_broken(spark, sf: str):
    """Captures that parsers fail on come out raw and unrecorded, the others of the same job as ever. A column of the captures has the name of one that routing makes."""
    pick = lambda values: F.get(F.array(*values), (F.col("doc_id") % len(BROKEN)).cast("int"))
    docs = derived.documents(spark, sf)
    odd = F.when(pick([F.lit(k[3]) for k in BROKEN]), F.unhex(F.lit("FF")).cast("string")).otherwise(F.lit(""))
    out = F.concat(pick([F.lit(k[2] + "\n") for k in BROKEN]), F.coalesce("text", F.lit("")), odd)
    rows = docs.select(F.col("doc_id").alias("capture_id"), pick([F.lit(k[0]) for k in BROKEN]).alias("tool"), pick([F.array(*[F.lit(a) for a in k[1]]).cast("array<string>") for k in BROKEN]).alias("args"), out.alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("exit_code"), (F.col("doc_id") % len(BROKEN)).alias("strategy"))
    done = route.compact(rows)
    raw = (F.col("output") == F.col("stdout")).cast("bigint")
    return done.groupBy(F.col("input_strategy").alias("kind"), "tool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("recorded").cast("bigint")).alias("n_recorded"), F.sum(raw).alias("n_raw"), F.sum(F.octet_length("stdout")).alias("before"))


def _broken_sql() -> str:
    kinds = ", ".join(f"({k}, {_quoted(tool)}, {len(ahead.encode()) + 1 + odd}, {int(recorded)})" for k, (tool, _, ahead, odd, recorded) in enumerate(BROKEN))
    return f"""select cast(kind as bigint) as kind, tool, count(*) as n, cast(sum(recorded) as bigint) as n_recorded, cast(sum(1 - recorded) as bigint) as n_raw, cast(sum(strlen(coalesce(text, '')) + more) as bigint) as before
      from documents join (values {kinds}) as k(kind, tool, more, recorded) on doc_id % {len(BROKEN)} = kind group by kind, tool"""


QUERIES = {
    "classify_command": classified,
    "routed_ledger": routed_ledger,
    "first_k_null_keys": first_of_each,
    "raw_expired": old_records,
    "tree_listing": trees,
}
ORACLE_SQL = {
    "classify_command": f"""with calls as ({derived.CALLS_SQL}),
      t(place, own, ok) as (values {", ".join(f"({k}, {_quoted(c)}, {str(k < len(ACCEPTED)).lower()})" for k, c in enumerate(ACCEPTED + REJECTED))}),
      c as (select event_id, case when event_id % 3 = 0 then command_text else own end as command, case when event_id % 3 = 0 then not contains(command_text, '#') else ok end as ok from calls join t on t.place = event_id % {len(ACCEPTED + REJECTED)})
      select event_id, command, case when ok then 'tally ' || command end as rewritten from c where command <> ''""",
    "routed_ledger": _routed_sql(),
    "first_k_null_keys": f"with calls as ({derived.CALLS_SQL}), c as (select nullif(category, 'view') as category, nullif(exit_code, 1) as code, event_id, timestamp from calls), r as (select *, cast(row_number() over (partition by category, code order by timestamp, event_id) as int) as rank, count(*) over (partition by category, code) as n_group from c) select * from r where rank <= 4",
    "raw_expired": f"with calls as ({derived.CALLS_SQL}), r as (select timestamp as time, cast(event_id as varchar) as name, row_number() over (order by timestamp desc, cast(event_id as varchar) desc) as rank from calls) select time, name from r where rank > {sinks.KEPT_RAW}",
    "tree_listing": f"""with p as (select distinct lang, string_split({_PATH}, '/') as parts from (select lang, doc_id, 0 as pos from documents where lang is not null)),
      k as (select * from p where not (len(parts) > 1 and parts[1] = 'skip') and not ends_with(parts[-1], '.pyc')),
      a as (select lang, parts[1 : i] as dir, (i = len(parts) - 1)::int as own from (select lang, parts, unnest(generate_series(0, len(parts) - 1)) as i from k)),
      n as (select lang, dir, true as is_dir, sum(own) as direct from a group by lang, dir union all select lang, parts, false, 0 from k),
      s as (select lang, is_dir, direct, len(dir) as depth, case when len(dir) = 0 then '.' else dir[-1] end as name,
        list_transform(generate_series(1, len(dir)), lambda i: {{'d': case when i = len(dir) and not is_dir then 0 else 1 end, 'n': dir[i]}}) as key from n),
      r as (select *, row_number() over (partition by lang order by key) as r, count(*) over (partition by lang) as total from s)
      select lang, cast(r as int) as pos, repeat('  ', depth) || name || case when is_dir then ' (' || direct || ')' else '' end as line from r where r <= 59
      union all select lang, 60, '... (' || total - 59 || ' more)' from r where r = 1 and total > 59""",
}
def routed_trees(spark, sf: str):
    """What `tree` shows of each language's files, through the router."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "doc_id", F.lit(0).alias("pos")).where("lang is not null")
    number = F.ascii("lang") * 256 + F.ascii(F.substring("lang", 2, 1))
    files = docs.select(number.cast("bigint").alias("capture_id"), F.expr(_PATH).alias("path")).distinct()
    captures = docs.select(number.cast("bigint").alias("capture_id"), F.lit("tree").alias("tool"), F.array(F.concat(F.lit("src/"), "lang", F.lit("/"))).alias("args"), F.lit("raw").alias("stdout"), F.lit("").alias("stderr"), F.lit(0).alias("exit_code")).distinct()
    shown = route.compact(lines.with_trees(captures, files, F.col("path"), ignore_dirs=["skip"], ignore_globs=["*.pyc"], most=60))
    return shown.select("capture_id", "strategy", "output", "recorded")


#: Tools that have rules, and rules of each; a rule drops the lines of one length.
RULED_TOOLS, RULES_OF_EACH, LENGTHS, MOST_LINES = 50, 20, 200, 40


def rules_of_tools(spark, sf: str):
    """A thousand rules for fifty tools, and one for all, over documents as the output of sixty tools."""
    docs = derived.documents(spark, sf)
    captures = docs.select(F.col("doc_id").alias("capture_id"), F.concat(F.lit("t"), F.col("doc_id") % (RULED_TOOLS + 10)).alias("tool"), F.col("text").alias("stdout"))
    rule = F.col("id")
    length = ((rule % RULED_TOOLS) * 7 + F.floor(rule / RULED_TOOLS) * 13) % LENGTHS
    table = spark.range(RULED_TOOLS * RULES_OF_EACH).select(rule.alias("pos"), F.concat(F.lit("t"), rule % RULED_TOOLS).alias("match_command"), F.to_json(F.struct(F.format_string("^.{%d}$", length).alias("strip_lines_matching"))).alias("rule"))
    last = spark.range(1).select(F.lit(1 << 40).alias("pos"), F.lit(None).cast("string").alias("match_command"), F.lit('{"max_lines": %d}' % MOST_LINES).alias("rule"))
    out = ruletable.apply_rule_table(captures, table.unionByName(last))
    return out.select("capture_id", "tool", F.size(F.split("stdout", "\n", -1)).alias("n_lines"), F.sha2("stdout", 256).alias("digest"))


QUERIES["rules_of_tools"] = rules_of_tools
ORACLE_SQL["rules_of_tools"] = f"""with d as (select doc_id, doc_id % {RULED_TOOLS + 10} as t, string_split(text, chr(10)) as a from documents where text is not null),
  k as (select doc_id, t, list_filter(a, lambda x: t >= {RULED_TOOLS} or len(list_filter(range(0, {RULES_OF_EACH}), lambda j: (t * 7 + j * 13) % {LENGTHS} = length(x))) = 0)[1:{MOST_LINES}] as a from d)
  select doc_id as capture_id, 't' || t as tool, cast(greatest(len(a), 1) as int) as n_lines, sha256(coalesce(array_to_string(a, chr(10)), '')) as digest from k
  union all select doc_id, 't' || (doc_id % {RULED_TOOLS + 10}), null, null from documents where text is null"""
QUERIES["routed_trees"] = routed_trees
ORACLE_SQL["routed_trees"] = f"""select cast(ascii(lang) * 256 + ascii(lang[2:2]) as bigint) as capture_id, 'tree' as strategy, 'src/' || lang || substring(string_agg(line, chr(10) order by pos), 2) as output, false as recorded
  from ({ORACLE_SQL["tree_listing"]}) group by lang"""
QUERIES["routed_broken"] = routed_broken
ORACLE_SQL["routed_broken"] = _broken_sql()
