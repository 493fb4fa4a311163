import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import classify as C
from tallyloom.functions import groups as G
from tallyloom.functions import outline as O
from tallyloom.functions import redact as D
from tallyloom.functions import reports as R
from tallyloom.functions import rules as U
from tallyloom.functions import text as X


def run(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", f(F.col("t")).alias("r")).orderBy("i").collect()
    got = [r.r for r in rows]
    return got[0] if len(got) == 1 else got


def test_lossless(spark):
    assert run(spark, X.collapse, "a\na\na\n", "a\nb\na\n", "a\n\n\na\n", "", "\n", None) == ["a  [×3]\n", "a\nb\na\n", "a\n\n\na\n", "", "\n", None]
    assert run(spark, X.lossless, "\x1b[31mred\x1b[0m\nred") == "red  [×2]"
    ten = "".join(f"l{i}\n" for i in range(10))
    assert run(spark, lambda t: X.cap(t, 4, 300), ten) == "l0\nl1\n...[truncated: 6 lines omitted — сузьте команду]\nl8\nl9\n"
    assert run(spark, lambda t: X.cap(t, 4, 3), "abcd\nab") == "abc...(truncated)\nab"
    hundred = "\n".join(f"l{i}" for i in range(100))
    assert run(spark, lambda t: X.digest(t, 5), hundred, "a\nb\n") == ["l0\nl1\nl2\nl3\nl4\n... (90 lines skipped — сузьте команду)\nl95\nl96\nl97\nl98\nl99", "a\nb\n"]


def test_rules(spark):
    rule = [{"dedupe_lines": True, "strip_ansi": True, "max_lines": 2}]
    assert run(spark, lambda t: U.apply_rules(t, F.lit("x"), rule), "\x1b[1mred\x1b[0m\naa\nbb\naa\ncc") == "red\naa"
    swap = [{"replace": {"pattern": "foo", "replacement": "bar"}}]
    assert run(spark, lambda t: U.apply_rules(t, F.lit("x"), swap), "foo\nfood") == "bar\nbard"
    named = [{"replace": {"pattern": r"(?P<a>\w)(\w)", "replacement": r"\2\g<a>$"}}]
    assert run(spark, lambda t: U.apply_rules(t, F.lit("x"), named), "ab") == "ba$"
    other = [{"match_command": "git", "max_lines": 1}]
    assert run(spark, lambda t: U.apply_rules(t, F.lit("ls"), other), "a\nb") == "a\nb"
    for n, want in ((0, "a\nb\nc"), (2, "b\nc"), (-1, "b\nc"), (9, "a\nb\nc")):
        assert run(spark, lambda t, n=n: U.apply_rules(t, F.lit("x"), [{"tail_lines": n}]), "a\nb\nc") == want
    for n, want in ((0, ""), (2, "a\nb"), (-1, "a\nb"), (-9, "")):
        assert run(spark, lambda t, n=n: U.apply_rules(t, F.lit("x"), [{"max_lines": n}]), "a\nb\nc") == want
    assert run(spark, lambda t: U.apply_rules(t, F.lit("x"), [{"strip_lines_matching": "("}]), "a") == "a"
    assert U.parse_rules("{}") == U.parse_rules("no") == U.parse_rules(None) == [] and U.parse_rules('[1, {"max_lines": 2}]') == [{"max_lines": 2}]
    with pytest.raises(U.UnknownKey):
        U.parse_rules('[{"nope": 1}]')


def test_redaction(spark):
    assert run(spark, D.compact_infra, "a\nmy TOKEN x\na\n\n\nb") == "a (x2)\n (x2)\nb"
    assert run(spark, D.compact_cloud, '{"b": [{"SecretKey": 1, "y": 2}], "a": "é"}', "x\nx") == ['{\n  "a": "\\u00e9",\n  "b": [\n    {\n      "y": 2\n    }\n  ]\n}', "x (x2)"]


def test_groups(spark):
    status = " M a.txt\n?? b\n M c.txt\nA  d e\n"
    assert run(spark, lambda t: G.status_text(t, F.lit("main")), status) == "* main\nM (2):\n  a.txt\n  c.txt\n?? (1):\n  b\nA (1):\n  d e"
    assert run(spark, lambda t: G.status_text(t, F.lit(None).cast("string"), ultra=True), status, "") == ["M:2 a.txt c.txt\n??:1 b\nA:1 d e", "no commits yet"]
    many = "".join(f"?? f{i}\n" for i in range(203))
    assert run(spark, lambda t: G.status_text(t, F.lit("m")), many).endswith("\n  f199\n  ... (3 more)")
    diff = "junk\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@\n-one\n+two\n+three\n c\ndiff --git a/old b/new\n+a\n+b\n+c\n+d\n+e\n+f"
    assert run(spark, G.diff_text, diff) == "x\n+2 -1\n-one\n+two\n+three\nold -> new\n+6 -0\n+a\n+b\n+c\n+d\n+e\n... (truncated, full in tee)"
    found = "b:1\na:2:x\nBinary file z matches\nb:3\nplain\n" + "".join(f"a:{i}\n" for i in range(6))
    assert run(spark, G.match_text, found) == "Binary file z matches\nb: 2 matches\n  1\n  3\na: 7 matches\n  2:x\n  0\n  1\n  2\n  3\n  ...\n(no path): 1 matches\n  plain"
    assert run(spark, G.match_text, "m\n" * 100).startswith("(no path): 100 matches\n  m")
    paths = "./sub/b\n./sub/a\n./sub/a\nx\n/y\n" + "".join(f"d//f{i:02d}\n" for i in range(12))
    want = "./sub (2):\n  a\n  b\n (1):\n  x\n/ (1):\n  y\nd (12):\n" + "".join(f"  f{i:02d}\n" for i in range(10)) + "  ... (2 more)"
    assert run(spark, G.path_text, paths) == want
    assert run(spark, G.path_text, "".join(f"d{i}/x\n" for i in range(203))).endswith("d199 (1):\n  x\n... (3 more dirs)")
    names = F.array(*[F.lit(f"n{i:02d}") for i in range(31)])
    assert run(spark, lambda t: G.listing_text(t, F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"))), "p/") == "p/ (3)\n  a\n  b\n  c"
    assert run(spark, lambda t: G.listing_text(t, F.array().cast("array<string>"), names, ultra=True), "p").endswith(" n09\n... (21 more)")


PYTEST = """=== FAILURES ===
__ test_a __
boom

=== short test summary info ===
FAILED tests/b.py::test_x - AssertionError: no
FAILED tests/a.py::test_y[1] - ValueError
FAILED tests/b.py::test_z - KeyError: 1
3 failed, 23 passed, 1 error in 0.1s
"""


def test_test_reports(spark):
    got = run(spark, R.pytest_report, PYTEST)
    assert (got.failed, got.passed) == (4, 23)
    assert got.failures == "__ test_a __\nboom\ntests/a.py:\n  tests/a.py::test_y[1] - ValueError\ntests/b.py:\n  tests/b.py::test_x - AssertionError: no\n  tests/b.py::test_z - KeyError: 1"
    cargo = "running\nfailures:\n\n---- t stdout ----\nbad\n\ntest result: FAILED. 3 passed; 1 failed; 0 x\n\ntest result: ok. 1 passed; 0 failed; 0 x"
    got = run(spark, R.cargo_test_report, cargo)
    assert (got.failures, got.failed, got.passed) == ("---- t stdout ----\nbad", 1, 4)
    go = "--- PASS: A (0s)\n    note\n--- FAIL: B (0s)\n    b_test.go:1: bad\n\tmore\nother\n    lost\n--- PASS: C\nFAIL\nFAIL\tpkg\t0.1s\nok"
    got = run(spark, R.go_test_report, go)
    assert (got.failures, got.failed, got.passed) == ("--- FAIL: B (0s)\n    b_test.go:1: bad\n\tmore\nFAIL\nFAIL\tpkg\t0.1s", 1, 2)
    jest = "PASS a.js\n  fine\nFAIL b.js\n  ● x\n\n    bad\nFAIL c.js\n  y\nTest Suites: 2\nTests:       2 failed, 1 passed, 3 total\nTime: 1"
    got = run(spark, R.jest_report, jest)
    assert (got.failures, got.failed, got.passed) == ("FAIL b.js\n  ● x\n\n    bad\nFAIL c.js\n  y", 2, 1)
    vitest = " ✓ a.ts\n ❯ b.ts (2)\n   noise\n   × one\n     → bad\n     → worse\n   tail\n   → lost\n   × two\n ❯ c.ts\n ✓ d\n × three\n Tests  3 failed | 1 passed"
    got = run(spark, R.vitest_report, vitest)
    assert (got.failures, got.failed, got.passed) == ("b.ts (2)\n   × one\n     → bad\n     → worse\n   × two\n × three", 3, 1)
    assert run(spark, lambda t: R.test_text(R.jest_report(t)), "PASS a") == "0 failed, 0 passed"


def test_linters(spark):
    assert run(spark, R.ruff_text, "a.py:1:2: E1 x\nb.py:3:4: F2 y\nFound 2", "All good") == ["a.py:1:2: E1 x\nb.py:3:4: F2 y\n2 errors", ""]
    assert run(spark, R.tsc_text, "s.ts(1,2): error TS1: x\nok") == "s.ts(1,2): error TS1: x\n1 errors"
    assert run(spark, R.golangci_text, "m.go:1:2: bad\nm.py:1:2: no") == "m.go:1:2: bad\n1 errors"
    assert run(spark, R.eslint_text, "/a.js\n  1:1  error  x\n  2:1  warning  y\n\n✖ 2 problems") == "/a.js\n  1:1  error  x\n1 errors"
    build = "   Compiling a\nwarning: unused\n  --> w\nerror[E1]: bad\n  --> m.rs:1\n\n    = warning: w\n  lost\nerror: due to 1 previous error\n\n"
    assert run(spark, R.cargo_text, build, "    Finished dev") == ["error[E1]: bad\n  --> m.rs:1\n\nerror: due to 1 previous error\n1 errors", "0 errors"]
    assert run(spark, R.next_text, "   ▲ Next\n Failed to compile.\n\n./a.js\nx\n> Build failed because\nmore\n> Build failed again", "fine") == ["Failed to compile.\n\n./a.js\nx\n> Build failed because", ""]


def test_packages(spark):
    assert run(spark, R.pip_list_text, "Package Version\n------- ---\na 1\n\nb 2") == "a 1\nb 2"
    assert run(spark, R.uv_text, "Resolved 3\n⠋ x\nhi\n\n  \n") == "hi"
    assert run(spark, R.npm_list_text, "p@1\n├── a\n└── b\n\n") == "├── a\n└── b"
    assert run(spark, R.pnpm_list_text, "Legend: x\nproject@1\nskip\n\ndependencies:\na 1\n\ndevDependencies:\nb 2") == "dependencies:\na 1\ndevDependencies:\nb 2"
    assert run(spark, R.npm_install_text, "npm warn x\nadded 3 packages in 1s\nup to date, y\nkeep\nERR! z\n3 Packages in 2s") == "keep\nERR! z\nup to date, y\n3 Packages in 2s"
    assert run(spark, R.pip_install_text, "Collecting a\n  Downloading b\n----- ==\n  Successfully installed a\nnote") == "Successfully installed a\nnote"


PY = '#!/usr/bin/env python\n# c\nimport os\n"""doc\nmore\n"""\n@d\nclass A(B):\n    """x"""\n    y = 1\n    def f(self): return 1\n    async def g(self):\n        def h(): pass\n        return 2\nZ = 3\n\ndef k(a: int = 1) -> int:  # note\n    pass'


def test_outlines(spark):
    def both(ext):
        return lambda t: F.array(O.outline(t, F.lit(ext)), O.without_comments(t, F.lit(ext)), O.summary_text(t, F.lit(ext)))

    got = run(spark, both(".py"), PY)
    assert got[0] == "#!/usr/bin/env python\nimport os\n@d\nclass A(B):\n    def f(self):\n    async def g(self):\n        def h():\nZ = 3\ndef k(a: int = 1) -> int:  # note"
    assert got[1].startswith("#!/usr/bin/env python\nimport os") and "# c" not in got[1]
    assert got[2] == "language: python\nfunctions: 4, classes: 1\nimports: os"
    rust = 'use a::b;\npub(crate) async fn f() -> u8 { let s = "}"; 1 }\n/* x\n { */ struct S {\n  a: u8, // {\n}\n// gone\nimpl S {\n  pub unsafe fn g() {\n    1\n  }\n}\nextern "C" fn h() {}\ntrait T {}'
    got = run(spark, both(".rs"), rust)
    assert got[0] == 'use a::b;\npub(crate) async fn f() -> u8 {\n struct S {\nimpl S {\n  pub unsafe fn g() {\nextern "C" fn h() {}\ntrait T {'
    assert got[2] == "language: rust\nfunctions: 3, structs: 0, impls: 1, traits: 1\nimports: a::b"
    ts = "import { x } from 'y';\nimport './z';\nexport default async function f() {\n  return `}${1}`;\n}\nexport class A {\n  m() { return 1 }\n}\ninterface I { a: 1 }\nexport type T = 1;\nconst q = '{';"
    got = run(spark, both(".ts"), ts)
    assert got[0] == "import { x } from 'y';\nimport './z';\nexport default async function f() {\nexport class A {\ninterface I {\nexport type T = 1;\nconst q = '{';"
    assert got[2] == "language: typescript\nfunctions: 1, classes: 1, interfaces: 1, types: 1\nimports: y"
    assert run(spark, lambda t: O.summary_text(t, F.lit(".c")), "x") == "unknown language"
    assert run(spark, lambda t: O.outline(t, F.lit(".go")), 'func a() {\n  s := `{`\n}\ntype B struct {\n x int\n}\nvar c = "}"') == 'func a() {\ntype B struct {\nvar c = "}"'


YES = ["git status", "git push origin x", "git branch -a", "git branch", "git stash list", "ls", "ls -la src", "find . -name 'a b'", "tail -n 3 f", "sort -u f", "docker compose ps", "uv pip install x", "npm ci", "ruff check .", "next build", "cargo test", "go test ./...", "kubectl get pods", "gh pr list", "pytest -q", "grep -r 'x y' ."]
NO = ["", "tally git status", "git", "git diff --output=x", "git branch new", "git stash", "git rebase", "ls a b", "ls -Z", "ls ''", "find . -delete", "tail -f x", "tail --follow=name x", "sort -o x y", "sort --output=x", "docker run x", "uv sync", "npm run x", "ruff check --fix", "ruff format .", "eslint --fix-dry-run", "next lint --fix", "cargo run", "go build", "kubectl delete x", "gh api", "rm x", "git status; ls", "git status\n", "echo $(x)", "cat 'open", "cat # x", "cat " + "x" * 4096]


def test_classification(spark):
    got = run(spark, C.rewrite, *YES, *NO, None)
    assert got == ["tally " + c for c in YES] + [None] * (len(NO) + 1)
    ask = '{"tool_name": "Bash", "tool_input": {"command": "git status", "timeout": [1]}}'
    bad = ["{", "[]", '{"tool_name": "Edit", "tool_input": {"command": "ls"}}', '{"tool_name": "Bash", "tool_input": 1}', '{"tool_name": "Bash", "tool_input": {"command": 1}}', ask.replace("git status", "rm x")]
    got = run(spark, C.hook_answer, ask, *bad)
    assert got[1:] == [None] * len(bad) and re.search(r'"updatedInput": \{"command": "tally git status", "timeout": \[1\]\}', got[0])
    assert run(spark, lambda t: C.detect_runner(F.split(t, " ")), "/usr/bin/pytest -q", "cargo test", "cargo build", "go test", "jest", "ls") == ["pytest", "cargo", None, "go", "jest", None]
