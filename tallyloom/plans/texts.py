"""Queries over whole texts of the documents as what tools print or read: escape codes, comments, outlines, summaries, messages, JSON. And what they give in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import classify as C
from tallyloom.functions import outline as O
from tallyloom.functions import redact as D
from tallyloom.functions import text as X
from tallyloom.functions.rowwise import bound_batches
from tallyloom.sources import derived


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return derived.documents(spark, sf).where("text is not null")


def _digest(text, name: str = "digest"):
    return F.sha2(text, 256).alias(name)


def ansi_stripped(spark: SparkSession, sf: str) -> DataFrame:
    """Texts whose words are coloured, without their colours."""
    coloured = F.concat(F.lit("\x1b[1;31m"), F.regexp_replace("text", " ", " \x1b[0m\x1b[38;5;9m"), F.lit("\x1b[K"))
    return _docs(spark, sf).select("doc_id", _digest(X.strip_ansi(coloured)))


def _numbered(first: str, other: str):
    """The text's lines with one mark before every third line, another before the others."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 3 == 1, first).otherwise(other), x))
    return F.array_join(lines, "\n")


def comments_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as Python and as Go, every third line of which is a comment."""
    python = O.without_comments(_numbered("  # ", "x = "), F.lit(".py"))
    go = O.without_comments(_numbered("\t// ", "x = "), F.lit(".go"))
    return _docs(spark, sf).select("doc_id", _digest(python, "python"), _digest(go, "go"))


#: Source files around a text's lines: what stands before a line, by its place modulo 4.
PYTHON = ["def f{i}(a, b):  # ", "    return '", "@g('", "x{i} = '"]
RUST = ["pub fn f{i}() {{ // ", "    let y = \"", "}} // ", "use a::b{i}; // "]
#: The same with imports alone in their lines.
RUST_USES = [*RUST[:3], "use a::b{i};"]


def _as_source(text: str, parts: list[str]):
    place = lambda p, i: F.concat(*[x for k, piece in enumerate(p.format(i="\0").split("\0")) for x in ([i.cast("string")] if k else []) + [F.lit(piece)]])
    plain = F.regexp_replace(text, r"""["'`\\/*{}:]""", "_")
    full = lambda k, x, i: place(parts[k], i) if parts[k].endswith(";") else F.concat(place(parts[k], i), x)
    line = lambda x, i: F.when(i % 4 == 0, full(0, x, i)).when(i % 4 == 1, full(1, x, i)).when(i % 4 == 2, full(2, x, i)).otherwise(full(3, x, i))
    return F.array_join(F.transform(F.split(plain, "\n", -1), line), "\n")


def outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of texts as Python and as Rust files."""
    bound_batches(spark)
    python, rust = O.outline(_as_source("text", PYTHON), F.lit(".py")), O.outline(_as_source("text", RUST), F.lit(".rs"))
    return _docs(spark, sf).select("doc_id", _digest(python, "python"), _digest(rust, "rust"))


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    """What texts as Python and Rust files define."""
    return _docs(spark, sf).select("doc_id", O.summary_text(_as_source("text", PYTHON), F.lit(".py")).alias("python"), O.summary_text(_as_source("text", RUST_USES), F.lit(".rs")).alias("rust"))


def hook_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to agents' messages that ask for the calls' commands to be run; every fifth message isn't for a shell."""
    tool = F.when(F.col("event_id") % 5 == 0, "Read").otherwise("Bash")
    message = F.to_json(F.struct(tool.alias("tool_name"), F.struct(F.col("command_text").alias("command"), F.col("event_id").alias("n")).alias("tool_input")))
    return C.answers(derived.calls(spark, sf).where("command_text <> ''"), message).select("event_id", "answer")


def json_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """JSON with secret keys at two depths, from the columns of documents."""
    bound_batches(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null")
    inner = F.struct(F.col("doc_id").alias("id"), F.lit("x").alias("AccessKey"), F.col("lang").alias("lang"))
    value = F.to_json(F.struct(F.col("lang").alias("z"), F.lit("y").alias("my_password"), F.array(inner).alias("list"), inner.alias("Credentials")))
    return docs.select("doc_id", D.compact_cloud(value).alias("shown"))


QUERIES = {"ansi_stripped": ansi_stripped, "comments_dropped": comments_dropped, "outlines": outlines, "summaries": summaries, "hook_answers": hook_answers, "json_redacted": json_redacted}

_LINES = "l as (select doc_id, unnest(a) as x, unnest(generate_series(0, len(a) - 1)) as i from (select doc_id, string_split({text}, chr(10)) as a from documents where text is not null))"
_PLAIN = "regexp_replace(text, '[\"''`\\\\/*{}:]', '_', 'g')"


def _dropped(kept: str) -> str:
    return f"sha256(coalesce(string_agg({kept} || x, chr(10) order by i) filter (where i % 3 <> 1), ''))"


def _shown(marks: list[str], kept: dict[int, str]) -> str:
    """What is left of lines by their place: the text of a line, made of its number and its words."""
    cases = " ".join(f"when {k} then {v}" for k, v in kept.items())
    return f"sha256(coalesce(string_agg(case i % 4 {cases} end, chr(10) order by i) filter (where i % 4 in ({', '.join(map(str, kept))})), ''))"


ORACLE_SQL = {
    "ansi_stripped": "select doc_id, sha256(text) as digest from documents where text is not null",
    "comments_dropped": f"with {_LINES.format(text='text')} select doc_id, {_dropped("'x = '")} as python, {_dropped("'x = '")} as go from l group by doc_id",
    "outlines": f"""with {_LINES.format(text=_PLAIN)}
      select doc_id, {_shown(PYTHON, {0: "'def f' || i || '(a, b):  # ' || x", 2: "'@g(''' || x", 3: "'x' || i || ' = ''' || x"})} as python,
             {_shown(RUST, {0: "'pub fn f' || i || '() {'", 3: "'use a::b' || i || '; // ' || x"})} as rust
      from l group by doc_id""",
    "summaries": f"""with {_LINES.format(text=_PLAIN)}, n as (select doc_id, count(*) filter (where i % 4 = 0) as f, list('a::b' || i order by i) filter (where i % 4 = 3) as uses from l group by doc_id)
      select doc_id, 'language: python' || chr(10) || 'functions: ' || f || ', classes: 0' as python,
             'language: rust' || chr(10) || 'functions: ' || f || ', structs: 0, impls: 0, traits: 0' || coalesce(chr(10) || 'imports: ' || array_to_string(uses[1:5], ', '), '') as rust from n""",
    "hook_answers": f"""with calls as ({derived.CALLS_SQL})
      select event_id, '{{"hookSpecificOutput": {{"hookEventName": "PreToolUse", "permissionDecision": "allow", "updatedInput": {{"command": "{C.PREFIX}' || command_text || '", "n": ' || event_id || '}}, "additionalContext": "{C.HOOK_CONTEXT}"}}}}' as answer
      from calls where command_text <> '' and event_id % 5 <> 0""",
    "json_redacted": """select doc_id, '{' || chr(10) || '  "list": [' || chr(10) || '    {' || chr(10) || '      "id": ' || doc_id || ',' || chr(10) || '      "lang": "' || lang || '"' || chr(10) || '    }' || chr(10) || '  ],' || chr(10) || '  "z": "' || lang || '"' || chr(10) || '}' as shown
      from documents where lang is not null""",
}
