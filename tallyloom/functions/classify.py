"""Which commands may be rewritten to run through compaction: an allow-list over tokens."""

from __future__ import annotations

import json
import re
import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.guard import or_null, readable
from tallyloom.functions.rowwise import bound_batches, row_udf

#: The allow-list.
PREFIX = "tally "
MOST_CHARS = 4096
FORBIDDEN = r"[\n\r\t\x00;&|<>$`(){}#]"
HOOK_TOOLS = ("Bash", "bash", "Shell")
HOOK_CONTEXT = "Command rewritten for output compression."
ALWAYS = ("grep", "rg", "cat", "tree", "pytest", "jest", "vitest", "tsc", "wc", "head", "uniq")
SECOND = {
    "gh": ("pr", "issue", "run"),
    "cargo": ("test", "build", "clippy"),
    "go": ("test",),
    "pip": ("list", "show", "freeze", "outdated", "install"),
    "npm": ("list", "install", "ci"),
    "pnpm": ("list", "install", "ci"),
    "kubectl": ("get", "logs"),
    "docker": ("ps", "images", "logs"),
    "uv": ("run",),
    "git": ("status", "diff", "log", "show", "blame", "rev-parse", "add", "commit", "push", "pull", "fetch"),
}
SECOND_AND_THIRD = {"docker": ("compose", "ps"), "uv": ("pip", "install"), "git": ("stash", "list")}
BRANCH_FLAGS = ("-a", "-r", "-l", "--list", "--show-current", "-v", "--verbose", "-vv", "--no-color")
LS_FLAGS = ("-l", "-a", "-la", "-al", "-lh", "-lah", "-ahl", "-hal", "-hla", "-alh", "-1", "-F")
FIND_ACTIONS = ("-delete", "-exec", "-execdir", "-ok", "-okdir", "-fprint", "-fprintf", "-fls")
WRITES = ("fix", "format")
CHECKERS = ("ruff", "eslint", "golangci-lint")


@row_udf(T.ArrayType(T.StringType()))
@or_null
def _tokens(command: str | None) -> list[str] | None:
    return None if command is None else shlex.split(command)


def may_rewrite(t: Column) -> Column:
    """Whether a command's tokens are on the list."""
    head, second, third = F.get(t, F.lit(0)), F.get(t, F.lit(1)), F.get(t, F.lit(2))
    rest = F.slice(t, 2, F.size(t))
    fixes = F.exists(rest, lambda x: x.startswith("--fix"))
    ok = head.isin(*ALWAYS)
    for tool, subs in SECOND.items():
        ok = ok | ((head == tool) & F.coalesce(second.isin(*subs), F.lit(False)))
    for tool, (a, b) in SECOND_AND_THIRD.items():
        ok = ok | ((head == tool) & F.coalesce((second == a) & (third == b), F.lit(False)))
    flags, paths = F.filter(rest, lambda x: x.startswith("-")), F.filter(rest, lambda x: ~x.startswith("-"))
    branch = (head == "git") & F.coalesce(second == "branch", F.lit(False)) & F.forall(F.slice(t, 3, F.size(t)), lambda x: x.isin(*BRANCH_FLAGS))
    ls = (head == "ls") & (F.size(paths) <= 1) & F.forall(paths, lambda x: x != "") & F.forall(flags, lambda x: x.isin(*LS_FLAGS))
    find = (head == "find") & ~F.exists(rest, lambda x: x.isin(*FIND_ACTIONS))
    tail = (head == "tail") & ~F.exists(rest, lambda x: x.isin("-f", "--follow") | x.startswith("--follow="))
    sort = (head == "sort") & ~F.exists(rest, lambda x: x.startswith("-o") | (x == "--output") | x.startswith("--output="))
    checks = head.isin(*CHECKERS) & ~fixes & ~F.exists(rest, lambda x: x.isin(*WRITES))
    build = (head == "next") & ~fixes
    writes_file = (head == "git") & F.exists(t, lambda x: x.startswith("--out"))
    return (ok | branch | ls | find | tail | sort | checks | build) & ~writes_file


def plain(command: str, prefix: str = PREFIX) -> bool:
    """The cheap tests of `candidate`, for commands that Python has read."""
    return 0 < len(command) <= MOST_CHARS and not command.startswith(prefix) and re.search(FORBIDDEN, command) is None


def candidate(command: Column, prefix: str = PREFIX) -> Column:
    """The command if it passes the cheap tests, else null; only these are tokenized."""
    plain = (F.length(command) > 0) & (F.length(command) <= MOST_CHARS) & ~command.startswith(prefix) & ~command.rlike(FORBIDDEN)
    return F.when(plain, readable(command))


def rewrite(command: Column, prefix: str = PREFIX) -> Column:
    """The command behind the prefix of the compacting tool, or null if it must run as it is.

    The tokenizer is an Arrow UDF that sees nulls for what the cheap tests reject.
    """
    tokens = _tokens(candidate(command, prefix))
    return F.when((F.size(tokens) > 0) & may_rewrite(tokens), F.concat(F.lit(prefix), command))


def _message(text: str | None) -> dict:
    """An agent's message if it asks for a command to be run, else nothing."""
    try:
        data = json.loads(text or "")
    except (ValueError, RecursionError):
        return {}
    asks = isinstance(data, dict) and data.get("tool_name") in HOOK_TOOLS and isinstance(data.get("tool_input"), dict)
    return data if asks and isinstance(data["tool_input"].get("command"), str) else {}


ASKED = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("answer", T.StringType())])


def _text(token: str) -> str:
    """The token without halves of code points, which JSON may name and Arrow refuses; no listed word has any."""
    return token.encode("utf-8", "replace").decode()


@row_udf(ASKED)
@or_null
def _asked(text: str | None, prefix: str, context: str) -> dict | None:
    """The tokens of the command that a message asks for, and the answer that puts it behind the prefix; null if the cheap tests reject it."""
    message = _message(text)
    if not message or not plain(message["tool_input"]["command"], prefix):
        return None
    command = message["tool_input"]["command"]
    output = {"hookEventName": "PreToolUse", "permissionDecision": "allow", "updatedInput": message["tool_input"] | {"command": prefix + command}, "additionalContext": context}
    return {"tokens": [_text(t) for t in shlex.split(command)], "answer": json.dumps({"hookSpecificOutput": output})}


def hook_answer(message: Column, prefix: str = PREFIX, context: str = HOOK_CONTEXT) -> Column:
    """The answer to an agent's JSON message, or null. Keys of the tool's input are open, so JSON is read and written in Python: all of it in one Arrow UDF, as each further one that needs another's result takes a worker more for every running task. To drop the nulls, explode (`answers`): a filter would be pushed below and hold a copy of the UDF."""
    asked = _asked(readable(message), F.lit(prefix), F.lit(context))
    return F.when((F.size(asked["tokens"]) > 0) & may_rewrite(asked["tokens"]), asked["answer"])


def answers(messages: DataFrame, message: Column, prefix: str = PREFIX, context: str = HOOK_CONTEXT, name: str = "answer") -> DataFrame:
    """The rows of messages that are answered, with their answers."""
    bound_batches(messages.sparkSession)
    answer = hook_answer(message, prefix, context)
    return messages.select("*", F.explode(F.when(answer.isNotNull(), F.array(answer))).alias(name))


def detect_runner(args: Column) -> Column:
    """The test runner that a command starts, or null."""
    name, sub = F.regexp_extract(F.get(args, F.lit(0)), r"([^/]*)\z", 1), F.get(args, F.lit(1))
    return F.when(name.isin("pytest", "jest", "vitest"), name).when(name.isin("cargo", "go") & (sub == "test"), name)
