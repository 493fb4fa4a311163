"""Benchmark decontamination by suffix arrays of the training text.

Test windows are hashed into a bitmap of bounded size, and one scan of the training documents tells which of them may hold a window; only these, few in clean text, are looked at further. They are dealt into shards (SLICE_BYTES of text each). A shard's suffix array holds the word suffixes that begin like some test suffix, sorted by their next words; every test suffix is binary-searched in every shard, which gives all places where at least a window of it stands word for word. Consecutive windows on one diagonal join to the longest verbatim matches with their places; hit words, listed items and removal all follow from these. Suffixes that begin like no test suffix can match none and are left out of the array before it is sorted.

Test items are dealt once into blocks of at most BLOCK_BYTES of text on average (one item is never split). Blocks are broadcast and searched for one after the other, each over the same stored candidates, and their matches are stored: driver and workers hold one block at a time however many there are, and the cost of another block is a pass over the candidates, not over the documents.

Words are runs of ASCII letters (A-Z lower-cased), digits and all characters beyond ASCII. A window is `window` consecutive words of an item, or the whole item where it has fewer.

Defined results: null and empty texts have no words; items without words match nothing; items that repeat an id count once; items with a null id mark words but are not listed; repeated rows are judged one by one; a text of any length is searched whole; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bound_batches, save, slices, table, text_or_empty, workspace
from tallyloom.llm.jaccard import Bitmap
from tallyloom.llm.rolling import folded_words, mix

BLOCK_BYTES = 8 << 20
WINDOW = 10
#: Words by which suffixes are looked up before they are sorted.
LEAD = 4
MULT = np.uint64(0x9E3779B97F4A7C15)
TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(TO_WORDS).split()


def _lead_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each position on; positions at the end are cut off."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    key = np.zeros(m, np.uint64)
    for k in range(n):
        key = (key ^ ids[k : m + k]) * MULT
        key ^= key >> np.uint64(29)
    return key


class Block:
    """Test suffixes of some items, as arrays that can be broadcast."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str | None] = []
        grams: dict[bytes, list[tuple[int, int]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if not ids:
                continue
            item, size = len(self.names), min(window, len(ids))
            self.names.append(name)
            row = np.array(ids, ">u4")
            for i in range(len(ids) - size + 1):
                grams.setdefault(row[i : i + size].tobytes(), []).append((item, i))
        keys = sorted(grams)
        self.sizes = np.array([len(k) // 4 for k in keys], np.int64)
        width = 4 * window
        self.low = np.array([k.ljust(width, b"\0") for k in keys], f"S{width}")
        self.high = np.array([k.ljust(width, b"\xff") for k in keys], f"S{width}")
        self.owner_from = np.cumsum([0] + [len(grams[k]) for k in keys])
        self.owners = np.array([x for k in keys for x, _ in grams[k]], np.int64)
        self.places = np.array([i for k in keys for _, i in grams[k]], np.int64)
        leads: dict[int, set[int]] = {}
        for k in keys:
            ids = np.frombuffer(k, ">u4").astype(np.uint64)
            n = min(LEAD, len(ids))
            leads.setdefault(n, set()).add(int(_lead_keys(ids[:n], n)[0]))
        self.leads = {n: np.array(sorted(x), np.uint64) for n, x in leads.items()}
        self.filters = {}
        for n, x in self.leads.items():
            bits = max(16, int(np.ceil(np.log2(len(x) + 1))) + 4)
            seen = np.zeros(1 << bits, bool)
            seen[(x >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.filters[n] = (bits, seen)

    def search(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one shard: starts and window numbers of all matches, and the shard's offsets of documents (one empty word apart)."""
        get = self.vocabulary.get
        sizes = np.array([len(d) for d in docs], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        ids = np.zeros(int((sizes + 1).sum()) + self.window, np.uint64)
        for begin, doc in zip(begins.tolist(), docs, strict=True):
            ids[begin : begin + len(doc)] = [get(w, 0) for w in doc]
        found = []
        for n, lead in self.leads.items():
            key, (bits, seen) = _lead_keys(ids, n), self.filters[n]
            at = np.nonzero(seen[(key >> np.uint64(64 - bits)).astype(np.int64)])[0]
            spot = np.minimum(np.searchsorted(lead, key[at]), len(lead) - 1)
            found.append(at[lead[spot] == key[at]])
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        at = at[at < len(ids) - self.window]
        if not len(at):
            return at, at, begins
        suffixes = np.ascontiguousarray(ids[at[:, None] + np.arange(self.window)].astype(">u4")).view(f"S{4 * self.window}").ravel()
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        hits = np.nonzero(last > first)[0]
        many = (last - first)[hits]
        which = np.repeat(hits, many)
        within = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        return at[order[np.repeat(first[hits], many) + within]], which, begins


def window_keys(texts: list[bytes], n: int, hashed: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a text, and the text's number. hashed: what `hashed_words` gives."""
    words_, first = hashed
    keys = mix(_lead_keys(words_, n) ^ np.uint64(n * int(MULT) % (1 << 64)))
    at = np.arange(len(keys))
    of = np.searchsorted(first, at, "right") - 1
    whole = at + n <= first[of + 1] if len(keys) else np.zeros(0, bool)
    return keys[whole], of[whole]


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of some texts laid end to end, and where each text's words begin (and end)."""
    plain = [t.lower().translate(TO_WORDS) for t in texts]
    begins, hashes = folded_words(np.frombuffer(b" ".join(plain) + b" ", np.uint8))
    return hashes, np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in plain]))


def _second(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ MULT)


class Windows:
    """Which windows a benchmark has, in a bitmap that misses none: lengths in words, and two bits a window."""

    def __init__(self, lengths: list[int], bitmap: Bitmap):
        self.lengths, self.bitmap = lengths, bitmap

    @staticmethod
    def of(benchmark: DataFrame, window: int, path: str) -> Windows:
        rows = benchmark.select(text_or_empty().cast("binary").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 0):
                texts = batch.column(0).to_pylist()
                hashed = hashed_words(texts)
                sizes = np.minimum(np.diff(hashed[1]), window)
                for n in np.unique(sizes[sizes > 0]).tolist():
                    keys, of = window_keys(texts, n, hashed)
                    keys = np.unique(keys[sizes[of] == n])
                    both = np.concatenate([keys, _second(keys)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), n), pa.int32()), pa.array(both.view(np.int64))], ["n", "key"])

        keys = save(rows.mapInArrow(run, "n int, key bigint"), path)
        return Windows(sorted(r.n for r in keys.select("n").distinct().collect()), Bitmap.of(keys.select("key")))

    def may_hit(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of words of each text, and whether it may hold a window."""
        hashed = hashed_words(texts)
        out = np.zeros(len(texts), bool)
        for n in self.lengths:
            keys, of = window_keys(texts, n, hashed)
            at = np.flatnonzero(self.bitmap.has(keys))
            out[of[at[self.bitmap.has(_second(keys[at]))]]] = True
        return np.diff(hashed[1]), out


def blocks_of(benchmark: DataFrame, window: int, path: str, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of a checked size, dealt out once below `path`; the driver holds one at a time."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    dealt.write.partitionBy("block").parquet(path)
    stored = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    for b in range(n):
        yield Block([(r.id, r.text.encode()) for r in stored.where(F.col("block") == b).collect()], window)


def matches_of(block: Block, docs: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches of at least a window between a shard's documents and a block's items: document, item, first word in either, number of words.

    Windows of one item that follow each other at the same distance in a document overlap or touch, and join.
    """
    at, which, begins = block.search(docs)
    many = block.owner_from[which + 1] - block.owner_from[which]
    owner = np.repeat(block.owner_from[which] - np.cumsum(many) + many, many) + np.arange(many.sum())
    at, size, item = np.repeat(at, many), np.repeat(block.sizes[which], many), block.owners[owner]
    doc = np.searchsorted(begins, at, "right") - 1
    at = at - begins[doc]
    diagonal = at - block.places[owner]
    order = np.lexsort((at, diagonal, item, doc))
    doc, item, diagonal, at, size = (x[order] for x in (doc, item, diagonal, at, size))
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] > at[:-1] + size[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return doc[first], item[first], at[first], at[first] - diagonal[first], at[last] + size[last] - at[first]


def judge(blocks: Iterable[Block], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Words, hit words and the listed items of each text, from its longest matches."""
    docs = [words(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    begins = np.cumsum(sizes) - sizes
    items: list[set[str]] = [set() for _ in docs]
    step = np.zeros(int(sizes.sum()) + 1, np.int64)
    for block in blocks:
        doc, item, first, _, n = matches_of(block, docs)
        np.add.at(step, begins[doc] + first, 1)
        np.add.at(step, begins[doc] + first + n, -1)
        for d, i in np.unique(np.stack([doc, item]), axis=1).T.tolist():
            if block.names[i] is not None:
                items[d].add(block.names[i])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return sizes, hit[begins + sizes] - hit[begins], items


MATCHES = "row bigint, item_id string, doc_word bigint, item_word bigint, n_words bigint"


def _matches(candidates: DataFrame, benchmark: DataFrame, window: int, root: str, block_bytes: int) -> DataFrame:
    """Longest matches of stored candidates (row, text), block by block."""
    spark = candidates.sparkSession
    paths = []
    for block in blocks_of(benchmark, window, f"{root}/items", block_bytes=block_bytes):
        cast = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], cast=cast) -> Iterator[pa.RecordBatch]:
            names = pa.array(cast.value.names, pa.string())
            for batch in slices(batches, 1):
                doc, item, first, item_word, n = matches_of(cast.value, [words(t) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), names.take(pa.array(item)), pa.array(first), pa.array(item_word), pa.array(n)], ["row", "item_id", "doc_word", "item_word", "n_words"])

        paths.append(f"{root}/matches{len(paths)}")
        save(candidates.mapInArrow(run, MATCHES), paths[-1])
        cast.destroy()
    return spark.read.schema(MATCHES).parquet(*paths)


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, root: str) -> DataFrame:
    """row, doc_id, n_words of all documents, with the texts of those that may hold a window."""
    bound_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(Windows.of(benchmark, window, f"{root}/windows"))
    source = docs.select(F.col("doc_id"), text_or_empty().cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            n, may = cast.value.may_hit(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([t if m else None for t, m in zip(texts, may.tolist(), strict=True)], pa.binary())], ["doc_id", "n_words", "text"])

    return save(source.mapInArrow(run, f"doc_id {kind}, n_words bigint, text binary").withColumn("row", F.monotonically_increasing_id()), f"{root}/scanned")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (listed ids, sorted), contaminated."""
    root = workspace(docs.sparkSession, "decontamination")
    scanned = _scanned(docs, benchmark, window, root)
    found = _matches(scanned.where("text is not null").select("row", "text"), benchmark, window, root, block_bytes)
    span = F.struct(F.col("doc_word").alias("first"), (F.col("doc_word") + F.col("n_words")).alias("last"))
    by_row = found.groupBy(F.col("row").alias("of")).agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a["last"], s["last"]).alias("last"), (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["last"], s["first"]))).alias("n")))["n"]
    told = by_row.select("of", covered.alias("n_hit"), "items")
    joined = scanned.drop("text").join(told, F.col("row") == F.col("of"), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), items.alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Maximal verbatim matches of at least a window: doc_id, item_id, doc_word, item_word, n_words."""
    root = workspace(docs.sparkSession, "matches")
    scanned = _scanned(docs, benchmark, window, root)
    found = _matches(scanned.where("text is not null").select("row", "text"), benchmark, window, root, block_bytes)
    return found.join(scanned.select("row", "doc_id"), "row").select("doc_id", "item_id", "doc_word", "item_word", "n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no window of any item, with all their columns. Only rows that may hold one are stored; the others are filtered as they are read."""
    spark = docs.sparkSession
    bound_batches(spark)
    root = workspace(spark, "decontaminate")
    cast = spark.sparkContext.broadcast(Windows.of(benchmark, window, f"{root}/windows"))
    at = docs.columns.index("text")

    def rows(wanted: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                may = cast.value.may_hit([t.encode() if t else b"" for t in batch.column(at).to_pylist()])[1]
                yield batch.filter(pa.array(may == wanted))

        return docs.mapInArrow(pick, docs.schema)

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    held = save(rows(True).select(whole, text_or_empty().cast("binary").alias("text")).withColumn("row", F.monotonically_increasing_id()), f"{root}/candidates")
    dirty = _matches(held.select("row", "text"), benchmark, window, root, block_bytes).select("row").distinct()
    clean = held.join(dirty, "row", "left_anti").select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
    return rows(False).unionByName(clean)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bw as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as k
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
), dw as (
  select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as p from d cross join (select distinct n from bw) where len(w) >= n)
), h as (
  select dw.doc_id, dw.p, dw.n, bw.item_id from dw join bw on dw.k = bw.k and dw.n = bw.n
), c as (
  select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(generate_series(p, p + n - 1)) as q from h) group by doc_id
), i as (
  select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from h) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(c.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items,
       sha256(coalesce(i.s, '')) as items_sha256, c.n_hit is not null as contaminated
from d left join c on c.doc_id = d.doc_id left join i on i.doc_id = d.doc_id
"""
