"""Report and grouping functions over captures made from the documents, and what they give in DuckDB SQL.

A capture's line is made from the number of its document and its own: LINES holds the same SQL text for both engines. Its last word is a pseudo-random one (W), whose first character (K, 1 to 16) chooses the kind of line, so every kind follows every other.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import groups as G
from tallyloom.functions import reports as R
from tallyloom.sources import derived

W = "substr(md5(concat(doc_id, ':', pos)), 1, 8)"
K = f"instr('0123456789abcdef', substr({W}, 1, 1))"


def _kinds(*parts: str, other: str = W) -> str:
    """A line of the kind that its first character chooses; each part stands for one character, `other` for the rest."""
    return f"case {K} " + " ".join(f"when {k} then {p}" for k, p in enumerate(parts, 1)) + f" else {other} end"


LINES = {
    "ruff": _kinds(f"concat('src/m', doc_id % 7, '.py:', pos + 1, ':', doc_id % 9, ': E501 ', {W})", f"concat('Found ', pos, ' errors ', {W})", f"concat(' src/x.py:1:2: ', {W})", "''", "'a.py:1:2 b'", f"concat('a.py:3:4:', {W})"),
    "tsc": _kinds(f"concat('src/a', pos, '.ts(', pos, ',', doc_id % 30, '): error TS', 2000 + pos, ': ', {W})", "'src/a.ts(1,2): warning TS1'", "'  at (3,4):error TS7'", "'b.ts(1): error TS2'", "''", "'c.ts(1,2):   error TSX'"),
    "golangci-lint": _kinds(f"concat('pkg/f', doc_id % 5, '.go:', pos + 1, ':2: ', {W})", "'x.gox:1:2: no'", "' y.go:1:2: no'", "'level=warning'", "'z.go:1:2: yes (lint)'"),
    "eslint": _kinds(f"concat('/src/f', {W}, '.js')", f"concat('  ', pos, ':3  error  ', {W})", f"concat('  1:2  warning  ', {W})", "''", "'   '", "'✖ 3 problems'", "'  ✖ 1 error'", "'    4:1  error  semi'"),
    "cargo build": _kinds(f"concat('   Compiling ', {W})", f"concat('error[E0308]: ', {W})", f"concat('  --> src/', {W}, '.rs:1:2')", "'    = warning: w'", f"concat('warning: unused ', {W})", "''", "'    Finished dev'", "'error: could not compile'", "'   |'", "' '", "case when doc_id % 3 = 0 then 'due to 7 previous errors' else '  due' end", other="'  = note: n'"),
    "next": _kinds("'   Creating an optimized build'", "case when pos % 3 = 0 then 'Failed to compile.' else '  Failed to compile.' end", "' ✓ Compiled'", "case when pos % 4 = 0 then '> Build failed because of webpack errors' else '> Build' end", "''", f"concat('./src/', {W}, '.tsx')"),
    "pip list": _kinds("'Package    Version'", "'---------- -------'", "''", "'  '", "' - - '", "'--- x'", other=f"concat({W}, ' 1.', pos)"),
    "pip install": _kinds(f"concat('Collecting ', {W})", f"concat('  Downloading ', {W})", "'Successfully installed a-1'", "'   ERROR: no match'", "'  ====  '", "''", "'Installing collected packages: a, b'", "'Requirement already satisfied: c'", "'  error: x '", other=f"concat(' ', {W})"),
    "uv": _kinds("'Resolved 3 packages in 2ms'", "'  Downloading x'", "'⠋ Building'", "''", "' '", "'Audited 2 packages'", f"concat('x⠙', {W})", other=f"concat(' ', {W})"),
    "npm list": _kinds(f"concat('├── ', {W})", f"concat('└── ', {W})", "'│ '", "''", "'    '", "' x@1'", "'app@1.0.0 /srv'"),
    "pnpm list": _kinds("'Legend: production dependency'", "'project@1.0.0 /srv'", "case when pos % 3 = 1 then 'dependencies:' else 'x: y' end", "''", "' devDependencies: '"),
    "npm install": _kinds("'npm warn deprecated x'", "'  added 3 packages in 2s'", "'Up to date, audited 5 packages in 1s'", "'up to date'", "''", "'NPM WARN y'", "'  12 packages in total'", "'run `npm fund` for details'"),
    "pytest": f"case when pos = 0 then '=== test session starts ===' when pos = 1 then '=== FAILURES ===' when pos < 6 then concat('  ', {W}) when pos = 6 then '=== short test summary info ===' when pos < 14 then concat('FAILED tests/t', substr({W}, 1, 1), '.py::test_', {W}, ' - Error: ', {W}) when pos = 14 then concat(pos + doc_id % 9, ' failed, ', doc_id % 50, ' passed, 2 error in 2s') else {W} end",
    "cargo test": f"case pos % 7 when 0 then 'running 2 tests' when 1 then 'failures:' when 2 then concat('    tests::', {W}) when 3 then concat('  ', {W}) when 4 then concat('test result: FAILED. ', doc_id % 10, ' passed; ', pos, ' failed; 0 ignored') else {W} end",
    "go test": _kinds(f"concat('--- FAIL: Test', {W}, ' (0.00s)')", f"concat('    ', {W}, '_test.go:12: no')", "'FAIL'", f"concat('=== RUN   Test', {W})", f"concat('--- PASS: Test', {W})", f"concat(chr(9), {W})", "concat('FAIL', chr(9), 'pkg')", "'    more'", "''", "'    '", other="'ok pkg'"),
    "jest": _kinds(f"concat('FAIL src/', {W}, '.js')", f"concat('PASS src/', {W}, '.js')", f"concat('  ● ', {W})", "''", "'Snapshots:   0 total'", "concat('Tests:       ', pos, ' failed, ', doc_id % 20, ' passed, 9 total')", "'Time: 1 s'", "'Test Suites: 1 failed'"),
    "vitest": _kinds(f"concat(' ❯ src/', {W}, '.test.ts (3 tests)')", f"concat('   × ', {W})", f"concat('     → expected ', {W})", f"concat('   ✓ ', {W})", "'     → again'", f"concat('   × second ', {W})", "concat('      Tests  ', pos, ' failed | ', doc_id % 20, ' passed (9)')", "''", "' ❯ b.test.ts'"),
    "git status": _kinds(f"concat('M  src/', {W})", f"concat('?? ', {W})", f"concat(' M ', {W})", "''", f"concat('A  ', {W})", f"concat('R  a -> ', {W})", other=f"concat('D  ', {W})"),
    "git diff": _kinds(f"concat('diff --git a/f', {W}, ' b/f', {W})", f"concat('diff --git a/f', {W}, ' b/g', {W})", f"concat('+', {W})", f"concat('-', {W})", f"concat('+++ b/', {W})", f"concat('--- a/', {W})", "'+'", "''", "'@@ -1 +1 @@'", other=f"concat('+ ', {W})"),
    "grep": _kinds(f"concat('src/a.py:', pos, ':', {W})", f"concat('src/b.py:', pos, ': ', {W})", "'Binary file x matches'", f"concat('no colon ', {W})", "''", f"concat(':', {W})", other=f"concat('lib/c', doc_id % 3, '.rs:', {W})"),
    "find": _kinds(f"concat('./a/', {W})", f"concat('./b/c/', {W})", f"{W}", f"concat('/', {W})", "''", "'./a/same'", "'/d//e'", other=f"concat('./b/', substr({W}, 1, 1), '/', {W})"),
}


def captures(spark, sf: str, tool: str):
    """doc_id and the text that stands for what a tool has printed."""
    docs = derived.documents(spark, sf).where("text is not null")
    return docs.select("doc_id", F.expr(f"array_join(transform(split(text, '\\n'), (line, pos) -> {LINES[tool].replace('chr(9)', 'char(9)')}), '\\n')").alias("text"))


def _query(tool: str, show):
    return lambda spark, sf: captures(spark, sf, tool).select("doc_id", show(F.col("text")).alias("output"))


def _tests(name: str):
    return lambda text: R.test_text(R.TEST_REPORTS[name](text))


QUERIES = {
    "report_ruff": _query("ruff", R.ruff_text),
    "report_tsc": _query("tsc", R.tsc_text),
    "report_golangci": _query("golangci-lint", R.golangci_text),
    "report_eslint": _query("eslint", R.eslint_text),
    "report_cargo_build": _query("cargo build", R.cargo_text),
    "report_next": _query("next", R.next_text),
    "report_pip_list": _query("pip list", R.pip_list_text),
    "report_pip_install": _query("pip install", R.pip_install_text),
    "report_uv": _query("uv", R.uv_text),
    "report_npm_list": _query("npm list", R.npm_list_text),
    "report_pnpm_list": _query("pnpm list", R.pnpm_list_text),
    "report_npm_install": _query("npm install", R.npm_install_text),
    "report_pytest": _query("pytest", _tests("pytest")),
    "report_cargo_test": _query("cargo test", _tests("cargo")),
    "report_go_test": _query("go test", _tests("go")),
    "report_jest": _query("jest", _tests("jest")),
    "report_vitest": _query("vitest", _tests("vitest")),
    "failures_only_go": _query("go test", lambda text: R.test_text(R.TEST_REPORTS["go"](text), failures_only=True)),
    "group_status": lambda spark, sf: captures(spark, sf, "git status").select("doc_id", G.status_text(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("b"), F.col("doc_id").cast("string")))).alias("output")),
    "group_status_ultra": lambda spark, sf: captures(spark, sf, "git status").select("doc_id", G.status_text(F.col("text"), F.lit(None).cast("string"), ultra=True, most=3).alias("output")),
    "group_diff": _query("git diff", G.diff_text),
    "diff_stats": lambda spark, sf: captures(spark, sf, "git diff").select("doc_id", F.posexplode(G.diff_stats(F.col("text"))).alias("pos", "s")).select("doc_id", "pos", "s.path", F.col("s.additions").cast("bigint").alias("additions"), F.col("s.deletions").cast("bigint").alias("deletions")),
    "group_matches": _query("grep", G.match_text),
    "group_paths": _query("find", G.path_text),
}


def _l(tool: str) -> str:
    """The lines of a tool's captures, and all numbers of documents."""
    return f"with l as (select doc_id, pos, {LINES[tool]} as line from ({derived.LINES_SQL}) where line is not null), d as (select doc_id from documents where text is not null)"


_NL = "chr(10)"
_BLANK = "trim(line) = ''"
_STARTS = lambda *marks: "(" + " or ".join(f"starts_with(line, '{m}')" for m in marks) + ")"
_LSTARTS = lambda *marks: "(" + " or ".join(f"starts_with(ltrim(line), '{m}')" for m in marks) + ")"


def _kept(tool: str, keep: str, count: str | None = None, shown: str = "line") -> str:
    tail = f"|| case when count(*) filter (where {keep} and {count}) > 0 then {_NL} || count(*) filter (where {keep} and {count}) || ' errors' else '' end" if count else ""
    return f"{_l(tool)} select doc_id, coalesce(string_agg({shown}, {_NL} order by pos) filter (where {keep}), '') {tail} as output from l group by doc_id"


def _trimmed(source: str) -> str:
    """kept(doc_id, pos, line) as one text without white space at its ends."""
    return f"{source}, shown as (select doc_id, regexp_replace(string_agg(line, {_NL} order by pos), '^\\s+|\\s+$', '', 'g') as text from kept group by doc_id)"


_COUNTED = f"select d.doc_id, case when coalesce(s.text, '') <> '' then s.text || {_NL} else '' end || c.failed || ' failed, ' || c.passed || ' passed' as output from d left join shown s using (doc_id) join counts c using (doc_id)"
_GO = _trimmed(f"""{_l("go test")}, m as (select *, not (starts_with(line, '    ') or starts_with(line, chr(9))) as head from l),
  h as (select *, max(case when head then pos end) over (partition by doc_id order by pos) as top from m),
  kept as (select h.doc_id, h.pos, h.line from h join h f on f.doc_id = h.doc_id and f.pos = h.top where starts_with(f.line, '--- FAIL:') or starts_with(f.line, 'FAIL') and h.head)""")
_GO_COUNTS = ", counts as (select doc_id, count(*) filter (where starts_with(line, '--- FAIL:')) as failed, count(*) filter (where starts_with(line, '--- PASS:')) as passed from l group by doc_id)"
_FIRST = lambda pattern, group: f"coalesce(arg_min(try_cast(regexp_extract(line, '{pattern}', {group}) as int), pos) filter (where regexp_matches(line, '{pattern}')), 0)"
_STATUS = f"{_l('git status')}, k as (select doc_id, pos, trim(line[1:2]) as key, line[4:] as val from l where line <> ''), r as (select *, row_number() over (partition by doc_id, key order by pos) as r from k), g as (select doc_id, key, min(pos) as first, count(*) as n"
_DIFF = f"{_l('git diff')}, m as (select *, max(case when starts_with(line, 'diff --git ') then pos end) over (partition by doc_id order by pos) as top from l), b as (select *, starts_with(line, '+') and not starts_with(line, '+++') as plus, starts_with(line, '-') and not starts_with(line, '---') as minus from m where top is not null)"
_DIFF_PATH = "any_value(case when pos = top then case when regexp_extract(line, 'a/(\\S+) b/', 1) = regexp_extract(line, ' b/(.*)', 1) then regexp_extract(line, 'a/(\\S+) b/', 1) else regexp_extract(line, 'a/(\\S+) b/', 1) || ' -> ' || regexp_extract(line, ' b/(.*)', 1) end end)"

ORACLE_SQL = {
    "report_ruff": _kept("ruff", r"regexp_matches(line, '^\S+:\d+:\d+:')", "true"),
    "report_tsc": _kept("tsc", r"regexp_matches(line, '\(\d+,\d+\):\s*error TS\d+')", "true"),
    "report_golangci": _kept("golangci-lint", r"regexp_matches(line, '^\S+\.go:\d+:\d+:')", "true"),
    "report_eslint": _kept("eslint", f"(not {_BLANK} and not {_LSTARTS('✖')} and (not starts_with(line, ' ') or contains(line, 'error')))", "starts_with(line, ' ')"),
    "report_pip_list": _kept("pip list", f"(not {_BLANK} and not {_LSTARTS('Package')} and replace(replace(line, '-', ''), ' ', '') <> '')"),
    "report_npm_list": _kept("npm list", f"(not {_BLANK} and {_STARTS(' ', '├', '└', '│')})"),
    "report_pip_install": _kept("pip install", f"(not {_BLANK} and not {_LSTARTS('Collecting ', 'Downloading ', 'Requirement already')} and trim(line) <> '====')", shown=f"case when {_LSTARTS('Successfully installed', 'Installing collected packages:', 'ERROR', 'error:')} then trim(line) else line end"),
    "report_uv": f"{_l('uv')}, k as (select * from l where not {_LSTARTS('Resolved ', 'Downloading ', 'Audited ')} and not regexp_matches(line, '[⠋⠙]')), e as (select doc_id, max(pos) as last from k where not {_BLANK} group by doc_id), t as (select k.doc_id, string_agg(line, {_NL} order by pos) as text from k join e on e.doc_id = k.doc_id and pos <= last group by k.doc_id) select d.doc_id, coalesce(text, '') as output from d left join t using (doc_id)",
    "report_pnpm_list": f"{_l('pnpm list')}, k as (select * from l where not {_BLANK} and not {_LSTARTS('Legend:', 'project@')}), f as (select doc_id, min(pos) as first from k where ends_with(trim(line), ':') group by doc_id), t as (select k.doc_id, string_agg(line, {_NL} order by pos) as text from k join f on f.doc_id = k.doc_id and pos >= first group by k.doc_id) select d.doc_id, coalesce(text, '') as output from d left join t using (doc_id)",
    "report_npm_install": f"{_l('npm install')}, k as (select *, starts_with(ltrim(line), 'up to date') or contains(lower(line), 'packages in') as sums from l where not {_BLANK} and not (" + " or ".join(f"starts_with(lower(trim(line)), '{m}')" for m in ("npm warn ", "added ", "run `npm ")) + f")), t as (select doc_id, string_agg(case when sums then trim(line) else line end, {_NL} order by sums, pos) as text from k group by doc_id) select d.doc_id, coalesce(text, '') as output from d left join t using (doc_id)",
    "report_cargo_build": f"""{_l("cargo build")}, t as (select *, (starts_with(line, ' ') or {_BLANK}) and not starts_with(line, '    = warning') as below from l where not {_STARTS('   Compiling', '    Finished')}),
      h as (select *, max(case when not below then pos end) over (partition by doc_id order by pos) as top from t),
      k as (select h.* from h join t f on f.doc_id = h.doc_id and f.pos = h.top where starts_with(f.line, 'error')),
      e as (select doc_id, max(pos) as last from k where not {_BLANK} group by doc_id),
      s as (select k.doc_id, string_agg(line, {_NL} order by pos) as text from k join e on e.doc_id = k.doc_id and pos <= last group by k.doc_id),
      n as (select doc_id, case when count(*) filter (where contains(line, 'due to 7 previous error')) > 0 then 7 else count(*) filter (where starts_with(line, 'error[') or starts_with(line, 'error:')) end as n from l group by doc_id)
      select n.doc_id, coalesce(s.text || {_NL}, '') || n.n || ' errors' as output from n left join s using (doc_id)""",
    "report_next": _trimmed(f"""{_l("next")}, t as (select * from l where not {_STARTS('   Creating', ' ✓ ')}),
      f as (select doc_id, min(pos) as first from t where trim(line) = 'Failed to compile.' group by doc_id),
      e as (select t.doc_id, min(pos) as last from t join f on f.doc_id = t.doc_id and pos > first where starts_with(line, '> Build failed') group by t.doc_id),
      kept as (select t.doc_id, pos, line from t join f using (doc_id) left join e using (doc_id) where pos >= first and (last is null or pos <= last))""") + " select d.doc_id, coalesce(text, '') as output from d left join shown using (doc_id)",
    "report_pytest": f"""{_l("pytest")}, block as (select doc_id, trim(string_agg(line, {_NL} order by pos)) as text from l where pos between 2 and 5 group by doc_id),
      f as (select doc_id, pos, line[8:strpos(line, '::') - 1] as file, line[8:] as item from l where pos between 7 and 13),
      g as (select doc_id, file, file || ':' || string_agg({_NL} || '  ' || item, '' order by pos) as text from f group by doc_id, file),
      shown as (select d.doc_id, concat_ws({_NL}, block.text, s.text) as text from d left join block using (doc_id) left join (select doc_id, string_agg(text, {_NL} order by file) as text from g group by doc_id) s using (doc_id)),
      counts as (select doc_id, coalesce(max(case when pos = 14 then 14 + doc_id % 9 + 2 end), 0) as failed, coalesce(max(case when pos = 14 then doc_id % 50 end), 0) as passed from l group by doc_id)
      {_COUNTED}""",
    "report_cargo_test": f"""{_trimmed(_l("cargo test") + ", kept as (select * from l where pos in (2, 3))")}, counts as (select doc_id, coalesce(sum(pos) filter (where pos % 7 = 4), 0) as failed, coalesce(sum(doc_id % 10) filter (where pos % 7 = 4), 0) as passed from l group by doc_id) {_COUNTED}""",
    "report_go_test": f"{_GO} {_GO_COUNTS} {_COUNTED}",
    "failures_only_go": f"{_GO} select d.doc_id, coalesce(text, '') as output from d left join shown using (doc_id)",
    "report_jest": _trimmed(f"""{_l("jest")}, m as (select *, max(case when {_STARTS('PASS ', 'FAIL ', 'Test Suites:', 'Tests:', 'Snapshots:', 'Time:')} then pos end) over (partition by doc_id order by pos) as top from l),
      kept as (select m.doc_id, m.pos, m.line from m join l f on f.doc_id = m.doc_id and f.pos = m.top where starts_with(f.line, 'FAIL '))""")
    + f""", counts as (select doc_id, {_FIRST(r'Tests:\s+(\d+) failed,\s+(\d+) passed', 1)} as failed, {_FIRST(r'Tests:\s+(\d+) failed,\s+(\d+) passed', 2)} as passed from l group by doc_id) {_COUNTED}""",
    "report_vitest": _trimmed(f"""{_l("vitest")}, m as (select *, case when ltrim(line)[1:1] in ('❯', '✓', '×') then ltrim(line)[1:1] end as mark from l),
      n as (select *, sum((mark is not null)::int) over (partition by doc_id order by pos) as part from m),
      h as (select doc_id, part, mark, pos, line, lag(mark) over (partition by doc_id order by part) as mark_before, lag(line) over (partition by doc_id order by part) as line_before from n where mark is not null),
      stop as (select n.doc_id, n.part, min(n.pos) as pos from n where mark is null and ltrim(line)[1:1] is distinct from '→' group by n.doc_id, n.part),
      kept as (select doc_id, pos * 2 - 1 as pos, trim(ltrim(line_before)[2:]) as line from h where mark = '×' and mark_before = '❯'
        union all select doc_id, pos * 2, line from h where mark = '×'
        union all select n.doc_id, n.pos * 2, n.line from n join h on h.doc_id = n.doc_id and h.part = n.part and h.mark = '×' left join stop on stop.doc_id = n.doc_id and stop.part = n.part where n.mark is null and (stop.pos is null or n.pos < stop.pos))""")
    + f""", counts as (select doc_id, {_FIRST(r'Tests\s+(\d+) failed\s*\|\s*(\d+) passed', 1)} as failed, {_FIRST(r'Tests\s+(\d+) failed\s*\|\s*(\d+) passed', 2)} as passed from l group by doc_id) {_COUNTED}""",
    "group_status": f"""{_STATUS}, string_agg('  ' || val, {_NL} order by pos) filter (where r <= 200) as vals from r group by doc_id, key),
      t as (select doc_id, string_agg(key || ' (' || n || '):' || {_NL} || vals || case when n > 200 then {_NL} || '  ... (' || n - 200 || ' more)' else '' end, {_NL} order by first) as text from g group by doc_id)
      select d.doc_id, concat_ws({_NL}, case when d.doc_id % 2 = 0 then '* b' || d.doc_id when t.text is null then 'no commits yet' end, t.text) as output from d left join t using (doc_id)""",
    "group_status_ultra": f"""{_STATUS}, string_agg(val, ' ' order by pos) filter (where r <= 3) as vals from r group by doc_id, key),
      t as (select doc_id, string_agg(key || ':' || n || ' ' || vals || case when n > 3 then {_NL} || '  ... (' || n - 3 || ' more)' else '' end, {_NL} order by first) as text from g group by doc_id)
      select d.doc_id, coalesce(t.text, 'no commits yet') as output from d left join t using (doc_id)""",
    "diff_stats": f"{_DIFF} select doc_id, cast(row_number() over (partition by doc_id order by top) - 1 as int) as pos, {_DIFF_PATH} as path, count(*) filter (where plus) as additions, count(*) filter (where minus) as deletions from b group by doc_id, top",
    "group_diff": f"""{_DIFF}, c as (select *, row_number() over (partition by doc_id, top order by pos) as r from b where plus or minus),
      s as (select doc_id, top, {_DIFF_PATH} || {_NL} || '+' || count(*) filter (where plus) || ' -' || count(*) filter (where minus) as head from b group by doc_id, top),
      v as (select doc_id, top, string_agg({_NL} || line, '' order by pos) filter (where r <= 5) || case when count(*) > 5 then {_NL} || '... (truncated, full in tee)' else '' end as body from c group by doc_id, top),
      t as (select doc_id, string_agg(head || coalesce(body, ''), {_NL} order by top) as text from s left join v using (doc_id, top) group by doc_id)
      select d.doc_id, coalesce(text, '') as output from d left join t using (doc_id)""",
    "group_matches": f"""{_l("grep")}, b as (select doc_id, string_agg(line, {_NL} order by pos) as text from l where starts_with(line, 'Binary file ') group by doc_id),
      k as (select doc_id, pos, case when contains(line, ':') then split_part(line, ':', 1) else '(no path)' end as key, case when contains(line, ':') then line[strpos(line, ':') + 1:] else line end as val from l where line <> '' and not starts_with(line, 'Binary file ')),
      r as (select *, row_number() over (partition by doc_id, key order by pos) as r from k),
      g as (select doc_id, min(pos) as first, key || ': ' || count(*) || ' matches' || string_agg({_NL} || '  ' || val, '' order by pos) filter (where r <= 5) || case when count(*) > 5 then {_NL} || '  ...' else '' end as text from r group by doc_id, key),
      t as (select doc_id, string_agg(text, {_NL} order by first) as text from g group by doc_id)
      select d.doc_id, concat_ws({_NL}, b.text, t.text) as output from d left join b using (doc_id) left join t using (doc_id)""",
    "group_paths": f"""{_l("find")}, p as (select doc_id, pos, regexp_extract(line, '^(.*/)', 1) as head, regexp_extract(line, '([^/]*)$', 1) as name from l where line <> ''),
      k as (select doc_id, case when replace(head, '/', '') = '' then head else rtrim(head, '/') end as dir, name, min(pos) as pos from p group by all),
      r as (select *, row_number() over (partition by doc_id, dir order by name) as r from k),
      g as (select doc_id, dir, min(pos) as first, dir || ' (' || count(*) || '):' || string_agg({_NL} || '  ' || name, '' order by name) filter (where r <= 10) || case when count(*) > 10 then {_NL} || '  ... (' || count(*) - 10 || ' more)' else '' end as text from r group by doc_id, dir),
      n as (select *, row_number() over (partition by doc_id order by first) as r from g),
      t as (select doc_id, string_agg(text, {_NL} order by first) filter (where r <= 200) || case when count(*) > 200 then {_NL} || '... (' || count(*) - 200 || ' more dirs)' else '' end as text from n group by doc_id)
      select d.doc_id, coalesce(text, '') as output from d left join t using (doc_id)""",
}
