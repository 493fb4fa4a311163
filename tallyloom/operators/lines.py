"""Line relations: text rows to (id, pos, line) and back, with the line operators as rows instead of text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as X
from tallyloom.functions.arrays import runs
from tallyloom.functions.redact import names_secret, without_secret_lines


def explode_lines(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    return rows.select(id_col, F.posexplode(X.lines_of(text)).alias("pos", "line"))


def implode_lines(lines: DataFrame, id_col: str) -> DataFrame:
    """One text a row id again; an id's lines are bounded by what one text can hold."""
    return lines.groupBy(id_col).agg(X.join_lines(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("text"))


def run_rows(rows: DataFrame, id_col: str, text: Column, redacted: bool = False) -> DataFrame:
    """(id, pos, line, n) of each run of equal lines, pos counting runs. Runs are found within the row: nothing is shuffled."""
    lines = X.lines_of(text)
    cut = rows.select(id_col, F.posexplode(runs(without_secret_lines(lines) if redacted else lines)).alias("pos", "run"))
    return cut.select(id_col, "pos", F.col("run.item").alias("line"), F.col("run.n").cast("bigint").alias("n"))


def distinct_rows(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """First appearances of each line of a text, numbered in order."""
    return rows.select(id_col, F.posexplode(X.dedupe_lines(X.lines_of(text))).alias("pos", "line"))


def secret_rows(lines: DataFrame) -> DataFrame:
    return lines.where(names_secret(F.col("line")))


def first_k(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group as rank, and the group's size as n_group. Null keys are a group of their own. An input column of these names comes back as input_rank or input_n_group.

    Groups of any size: ranks beyond k are cut off before the shuffle (a window group limit), and sizes are counted before theirs, so only k rows a group and task travel.
    """
    rows, named = apart(rows, ("rank", "n_group"))
    by, order = [named.get(c, c) for c in by], [named.get(c, c) for c in order]
    few = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).alias("few")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_group")).alias("sizes")
    same = reduce(lambda a, b: a & b, [F.col(f"few.`{c}`").eqNullSafe(F.col(f"sizes.`{c}`")) for c in by])
    return few.join(sizes, same).select("few.*", "sizes.n_group")


def apart(rows: DataFrame, made: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """rows with `input_` before the names of columns that are about to be made, and the names that changed. A column that is so renamed already makes room again."""
    named: dict[str, str] = {}
    for c in rows.columns:
        if c in made:
            named[c] = f"input_{c}"
            while named[c] in rows.columns or named[c] in made:
                named[c] = f"input_{named[c]}"
    return rows.withColumnsRenamed(named), named


def path_rows(paths: DataFrame, path: Column, names: int = 10) -> DataFrame:
    """(dir, n, names) of a relation of paths: distinct names of each directory, the first few of them in order."""
    from tallyloom.functions.groups import base_name, dir_name

    distinct = paths.select(dir_name(path).alias("dir"), base_name(path).alias("name")).distinct()
    few = first_k(distinct, ["dir"], ["name"], names)
    return few.groupBy("dir").agg(F.max("n_group").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ",").alias("names"))


def tree_rows(files: DataFrame, id_col: str, path: Column, ignore_dirs: list[str] | None = None, ignore_globs: list[str] | None = None, most: int = 200, is_dir: Column | None = None) -> DataFrame:
    """(id, pos, line) of each root's tree: a directory's files, then its directories, both sorted, with a line that counts what is left out.

    files has one row a file with its path below the root. Directories are those that hold files, and the rows that `is_dir` holds for, such as empty ones.
    """
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    every = files.select(F.col(id_col), parts.alias("parts"), F.coalesce(is_dir if is_dir is not None else F.lit(False), F.lit(False)).alias("holds"))
    ignored = F.array(*[F.lit(d) for d in ignore_dirs or []]).cast("array<string>")
    holders = every.where(F.col("holds") & ~F.arrays_overlap("parts", ignored)).select(id_col, F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.slice("parts", F.lit(1), n))).alias("dir"))
    kept = every.where("not holds").select(id_col, "parts")
    kept = kept.where(F.size("parts") > 0).where(~F.arrays_overlap(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(0))), ignored))
    name = F.element_at("parts", -1)
    for glob in ignore_globs or []:
        hit = name.rlike(glob_pattern(glob))
        kept = kept.where(~hit)
    node = lambda is_dir, n: F.struct(is_dir.alias("is_dir"), n.alias("name"))
    as_key = lambda a, last_is_file: F.transform(a, lambda x, i: node(F.when((i == F.size(a) - 1) & last_is_file, F.lit(0)).otherwise(F.lit(1)), x))
    file_rows = kept.select(id_col, as_key(F.col("parts"), F.lit(True)).alias("key"), F.size("parts").alias("depth"), name.alias("name"), F.lit(0).alias("direct"))
    above = kept.select(id_col, F.explode(F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.struct(F.slice("parts", F.lit(1), n).alias("dir"), (n == F.size("parts") - 1).cast("int").alias("own")))).alias("d"))
    held = above.select(id_col, "d.dir", "d.own")
    if is_dir is not None:
        held = held.unionByName(holders.select(id_col, "dir", F.lit(0).alias("own")))
    dirs = held.groupBy(id_col, "dir").agg(F.sum("own").alias("direct"))
    dir_rows = dirs.select(id_col, as_key(F.col("dir"), F.lit(False)).alias("key"), F.size("dir").alias("depth"), F.coalesce(F.get("dir", F.size("dir") - 1), F.lit(".")).alias("name"), F.col("direct"))
    dir_rows = dir_rows.select(id_col, "key", "depth", F.format_string("%s (%d)", "name", "direct").alias("name"), "direct")
    rows = dir_rows.unionByName(file_rows)
    few = first_k(rows, [id_col], ["key"], most - 1)
    shown = few.select(id_col, F.col("rank").alias("pos"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("name")).alias("line"))
    more = few.where("rank = 1 and n_group > " + str(most - 1)).select(id_col, F.lit(most).alias("pos"), F.format_string("... (%d more)", F.col("n_group") - (most - 1)).alias("line"))
    return shown.unionByName(more)


def with_trees(captures: DataFrame, files: DataFrame, path: Column, is_dir: Column | None = None, **options) -> DataFrame:
    """captures with tree, the text of the tree below each one's directory, from files with a capture_id; null where files has none. The tree's first line names the directory as the command did. The router shows it for `tree`."""
    lines = tree_rows(files.select(F.col("capture_id").alias("tree_of"), path.alias("path"), *([is_dir.alias("is_dir")] if is_dir is not None else [])), "tree_of", F.col("path"), is_dir=None if is_dir is None else F.col("is_dir"), **options)
    texts = implode_lines(lines, "tree_of").withColumnRenamed("text", "tree")
    root = F.coalesce(F.get("args", F.lit(0)), F.lit("."))
    label = F.when(root == "/", root).when(F.rtrim(root, F.lit("/")) == "", ".").otherwise(F.rtrim(root, F.lit("/")))
    joined = captures.join(texts, captures.capture_id == texts.tree_of, "left").drop("tree_of")
    return joined.withColumn("tree", F.concat(label, F.substring("tree", 2, 1 << 30)))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a Java one for whole names."""
    import re

    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        close = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body = glob[k + 1 : close]
            negated, body = body[:1] == "!", body[1:] if body[:1] == "!" else body
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}\\z"
