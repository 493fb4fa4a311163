"""Filter interaction audit: what each filter of a set removes in every order that the filters can be applied in.

Duplicates come from partition refinement. Rows are split by their length in code points, then by the hash of one block of its bytes after another (the first 64 bytes with their number, then blocks that reach eight times as far); after every split, classes of one row are dropped. Rows of a class have equally many bytes after the first block, so a class runs out of blocks as a whole. What is left after the last block is compared as whole texts: the smallest and the largest text of each class, which pre-aggregates before the shuffle; should two different texts ever share all hashes, the class's rows are grouped by the text itself. Every row whose id isn't the smallest of its text is marked. Hashes of all blocks come from the one scan that also evaluates the other filters, so refinement shuffles some hundred bytes a row, less each round; texts are shuffled only if their class survives. Classes of any size are counted map-side and joined as they lie, so a hot class is split like any skewed join.

Filters are then bits of a mask. Rows are counted by part and mask, at most 2 ** filters a part; what a filter removes depends only on which filters came before it, so the counts are summed once for each filter and set of earlier filters and dealt out to the orders.

Defined results: a null text is empty, a null part is the empty string; empty texts are duplicates of each other; a row with a null id is nobody's duplicate and makes none; rows that repeat an id and a text are no duplicates of each other, and each counts; several labels of one id count as one, which is good or toxic if any of them is; unlabelled rows are neither; an empty table gives no rows; other columns are ignored, whatever their names; texts of any length are judged whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop, save, table, text_or_empty, workspace
from tallyloom.llm.runs import bits_for, filter_of, may_hold

#: Bytes of the first block; each other one ends GROWTH times as far in as the one before.
BLOCK, GROWTH = 64, 8
WORDS = "[ \\t\\n\\x0B\\f\\r]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.filter(F.split(text, WORDS), lambda w: w != "")


#: Letter -> failure condition over the text and its words. The last letter of an order's alphabet, E, is that of duplicates.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
DUPLICATE = "E"


def block_hashes(text: Column) -> Column:
    """Hashes of the blocks of a text's UTF-8 bytes, in order, the first with their number; an empty text has one."""
    raw, size = text.cast("binary"), F.octet_length(text)
    ends = F.filter(F.array(*[F.lit(BLOCK * GROWTH**k).cast("bigint") for k in range(11)]), lambda end: (end == BLOCK) | (end < GROWTH * size))
    later = lambda end: F.xxhash64(F.substring(raw, (end / GROWTH + 1).cast("int"), (end - end / GROWTH).cast("int")))
    return F.transform(ends, lambda end: F.when(end == BLOCK, F.xxhash64(F.substring(raw, 1, BLOCK), size)).otherwise(later(end)))


def chained(start: Column, hashes: Column) -> Column:
    """The class of a text once all its blocks have split it."""
    return F.aggregate(hashes, start, lambda acc, h: F.xxhash64(acc, h))


def refined(rows: DataFrame, root: str) -> DataFrame:
    """(chain, first): classes of more than one row that no block tells apart, with their smallest id. rows: id, points, hashes."""
    several = lambda df: save(df.join(df.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"), "class", "left_semi"), f"{root}/split{k}")
    k, done = 0, []
    left = several(rows.select(F.col("points").cast("bigint").alias("class"), "hashes", "id"))
    levels = left.agg(F.max(F.size("hashes"))).first()[0] or 0
    for k in range(1, levels + 1):
        left = several(left.select(F.xxhash64("class", F.get("hashes", F.lit(k - 1))).alias("class"), "hashes", "id"))
        done.append(left.where(F.size("hashes") == k).groupBy("class").agg(F.min("id").alias("first")))
        left = left.where(F.size("hashes") > k)
    out = save(_union(done), f"{root}/classes") if done else rows.where("false").select(F.col("points").cast("bigint").alias("class"), F.col("id").alias("first"))
    for j in range(k + 1):
        drop(rows.sparkSession, f"{root}/split{j}")
    return out.select(F.col("class").alias("chain"), "first")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mark_duplicates(texts: DataFrame, rows: DataFrame, root: str) -> DataFrame:
    """rows (with id, points, hashes, chain) with `later`: whether a row with a smaller id has the same text. texts: the same rows and their text."""
    classes = refined(rows, root)
    bits = bits_for(rows.count())
    asked = may_hold(texts, filter_of(classes, "chain", bits), "chain", bits).where("maybe").drop("maybe")
    ends = asked.groupBy("chain").agg(F.min("text").alias("low"), F.max("text").alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = save(ends.where("low <> high").select("chain").join(classes.select("chain"), "chain", "left_semi"), f"{root}/mixed")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("later")
    marked = rows.join(classes, "chain", "left").select(*[rows[c] for c in rows.columns], later)
    if mixed.isEmpty():
        return marked
    apart = texts.join(mixed, "chain", "left_semi")
    firsts = apart.groupBy(F.col("text").alias("same")).agg(F.min("id").alias("first"))
    told = apart.join(firsts, apart.text == firsts.same).select(*rows.columns, later)
    return marked.join(mixed, "chain", "left_anti").select(*rows.columns, "later").unionByName(told)


def filter_masks(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part and mask of each row: the bits of the filters that it fails, in the order of FILTERS, duplicates last."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_or_empty(text_col).alias("text"))
    bits = sum((F.when(fails(F.col("text"), F.col("words")), F.lit(1 << k)).otherwise(F.lit(0)) for k, fails in enumerate(FILTERS.values())), F.lit(0))
    scanned = base.withColumn("words", words_of(F.col("text"))).select("id", "part", bits.alias("mask"), F.length("text").alias("points"), block_hashes(F.col("text")).alias("hashes"), "text")
    texts = scanned.withColumn("chain", chained(F.col("points").cast("bigint"), F.col("hashes")))
    rows = save(texts.drop("text"), f"{root}/rows")
    later = F.when(F.col("later"), F.lit(1 << len(FILTERS))).otherwise(F.lit(0))
    return mark_duplicates(texts, rows, root).select("id", "part", (F.col("mask") + later).alias("mask"))


def audit(masks: DataFrame, labels: DataFrame, letters: str = "".join(FILTERS) + DUPLICATE) -> DataFrame:
    """A row per part, order and step: filter_order, step and the counts. masks: id, part, mask; labels: doc_id, quality, toxic."""
    spark = masks.sparkSession
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("of")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c) for c in ("quality", "toxic")])
    joined = masks.join(marks, masks.id == marks.of, "left")
    counted = joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"))

    # one row for each filter and set of filters before it
    every = range(len(letters))
    pairs = [(b, before) for b in every for before in range(1 << len(letters)) if not before >> b & 1]
    spread = counted.select("*", F.explode(F.array(*[F.struct(F.lit(1 << b).alias("bit"), F.lit(before).alias("before")) for b, before in pairs])).alias("at")).select("*", "at.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) > 0, F.col("mask").bitwiseAND(F.col("before")) > 0
    total = lambda when, of="n": F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0))
    share = F.when(fails, F.col("n") * F.element_at(F.array(*[F.lit(factorial(len(letters)) // k) for k in range(1, len(letters) + 1)]), F.bit_count("mask")))
    summed = spread.groupBy("part", "bit", "before").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "bad").alias("toxic_lost"),
        F.coalesce(F.sum(share), F.lit(0)).alias("shapley"),
    )
    steps = [("".join(order), s + 1, 1 << letters.index(order[s]), sum(1 << letters.index(x) for x in order[:s])) for order in permutations(letters) for s in every]
    orders = spark.createDataFrame(steps, "filter_order string, step int, bit int, before int")
    return summed.join(F.broadcast(orders), ["bit", "before"]).select("part", "filter_order", "step", *[F.col(c).cast("bigint").alias(c) for c in COUNTS])


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    masks = filter_masks(table(spark, sf_dir, "documents"), workspace(spark, "filter-audit"))
    return audit(masks, table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w, min(doc_id) over (partition by t) as first_id from d
), g as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as bad from labels group by doc_id
), f as (
  select w.doc_id, part, coalesce(good, false) as good, coalesce(bad, false) as bad,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first_id, false)] as fails
  from w left join g on g.doc_id = w.doc_id
), c as (
  select part, fails, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where bad) as n_bad from f group by part, fails
), o as (
  select '' as filter_order
  union all
  select filter_order || l from o, unnest(['A', 'B', 'C', 'D', 'E']) as x(l) where not contains(filter_order, l)
), s as (
  select filter_order, step, ascii(substring(filter_order, step, 1)) - 64 as own, list_transform(range(1, step), lambda k: ascii(substring(filter_order, k, 1)) - 64) as before
  from o, unnest([1, 2, 3, 4, 5]) as y(step) where length(filter_order) = 5
), e as (
  select part, filter_order, cast(step as integer) as step, own, fails, n, n_good, n_bad, fails[own] as now, len(list_filter(before, lambda k: fails[k])) > 0 as gone,
         len(list_filter(fails, lambda x: x)) as k from c, s
), r as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (where not now and not gone), 0) as kept, coalesce(sum(n) filter (where now and not gone), 0) as removed,
         coalesce(sum(n) filter (where now and gone), 0) as redundant, coalesce(sum(n) filter (where now and k = 1), 0) as unique_fails,
         coalesce(sum(n_good) filter (where now and not gone), 0) as good_lost, coalesce(sum(n_bad) filter (where now and not gone), 0) as toxic_lost
  from e group by all
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from r
"""
