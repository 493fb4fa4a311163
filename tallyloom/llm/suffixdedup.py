"""Removal of every byte that a repeated string of `window` bytes covers, by blockwise suffix sorting with a difference cover.

Only the order of suffixes up to `window` bytes matters. Suffixes are dealt into buckets such that equal beginnings meet: a suffix belongs to the bucket of its minimizer, the least hashed stretch of CONTEXT bytes within its window. Neighbouring suffixes mostly share theirs, so a bucket gets short segments of text. Segments whose minimizer is found at one place only can't hold a repeat and are dropped first, by a bitmap of bounded size.

Buckets are sorted one at a time. Within one, a difference cover modulo COVER_PERIOD gives sample positions; these are sorted once by their next `window` bytes, which gives their ranks at every shorter length too. Suffixes are then sorted by their first COVER_PERIOD bytes alone; suffixes that tie go by the ranks of the samples that stand at the same small distance behind both, which the cover grants for any two suffixes. What a bucket needs in memory is a fixed multiple of its segments, however long the repeats.

Segments that stand at two places are repeats as they are. Of each distinct segment only the copy at its first place is sent to be sorted, so hot passages cost one row each. A minimizer with more than HOT_BYTES of distinct segments, such as that of the edge of a passage in very many documents, would make a bucket that grows with the corpus: its segments are cut into single suffixes of `window` bytes, of which two equal ones are a repeat as they are, so that nothing of it is sorted in one task.

Memory: workers hash STRETCH bytes at a time, of long texts overlapping pieces, and hold one text and one bucket (BUCKET_BYTES on average, HOT_BYTES more at most).

Defined results: null counts as empty; texts shorter than the window stay whole; identical rows are copies of each other and lose everything (if long enough); a text of any length is treated whole; a null id is kept as it is; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_rows, drop, save, slices, table, text_or_empty, workspace
from tallyloom.llm.jaccard import Bitmap
from tallyloom.llm.rolling import BASE, mix, stretch_hashes

WINDOW = 200
CONTEXT = 50
#: A perfect difference set; any two residues modulo 31 have one distance behind them at which both are in the set.
COVER_PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Bytes of text that are hashed in one go, of text a bucket, and of distinct segments of one minimizer that are sorted together.
STRETCH = 1 << 18
BUCKET_BYTES = 1 << 19
HOT_BYTES = 1 << 20
#: Rows of samples that are compared in one go.
COMPARED = 1 << 13
SALTS = 8


def stretches(texts: list[bytes], window: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text number, offset, piece) of some STRETCH bytes. Pieces of a long text overlap by window - 1 bytes, so that each window is in one of them."""
    held, total = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), STRETCH):
            piece = text[at : at + STRETCH + window - 1]
            if held and total + len(piece) > STRETCH:
                yield held
                held, total = [], 0
            held.append((number, at, piece))
            total += len(piece)
    if held:
        yield held


def segments(texts: list[bytes], window: int, context: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By stretches: text number, first start, number of starts, minimizer's place and its hash, of each segment. Starts are offsets in the text."""
    for group in stretches(texts, window):
        numbers, offsets, part = np.array([g[0] for g in group]), np.array([g[1] for g in group]), [g[2] for g in group]
        sizes = np.array([len(t) for t in part], np.int64)
        if sizes.max() < window:
            continue
        data = np.frombuffer(b"".join(part), np.uint8)
        hashes = stretch_hashes(data, context)
        w = window - context + 1
        n = len(data) - window + 1
        # least hash in each window, leftmost of equals: its high bits and its place in one word
        bits = np.uint64(31)
        packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        blocks = -(-len(packed) // w)
        grid = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
        grid[: len(packed)] = packed
        grid = grid.reshape(blocks, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
        place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        long = sizes >= window
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, begins[long], 1)
        np.add.at(step, np.minimum(ends[long] - window + 1, n), -1)
        valid = np.cumsum(step[:n]) > 0
        change = np.ones(n, bool)
        change[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        change[begins[long]] = True
        heads = np.nonzero(change)[0]
        sizes_ = np.diff(np.append(heads, n))
        keep = valid[heads]
        heads, sizes_ = heads[keep], sizes_[keep]
        piece = np.searchsorted(ends, heads, "right")
        shift = offsets[piece] - begins[piece]
        spots = place[heads]
        # least hashes are small numbers: mixed again, they spread over bitmaps and buckets
        yield numbers[piece], heads + shift, sizes_, spots + shift, mix(hashes[spots] ^ np.uint64(BASE))


def repeated_starts(parts: list[bytes], window: int) -> list[np.ndarray]:
    """Of each segment, which of its starts begin a string of `window` bytes that also begins elsewhere in these segments."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    n_starts = sizes - window + 1
    bounds = np.concatenate([[0], np.cumsum(n_starts)])
    starts = np.arange(bounds[-1]) + np.repeat(begins - bounds[:-1], n_starts)
    data = np.frombuffer(b"".join(parts) + bytes(window + 8), np.uint8)
    marked = np.zeros(len(starts), bool)

    # suffixes by their first COVER_PERIOD bytes: those that stand alone are done
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    head = [words[starts + d].copy().view(">u8").ravel() for d in (0, 8, 16, COVER_PERIOD - 8)]
    order = np.lexsort(head[::-1])
    same = np.ones(len(starts) - 1, bool) if len(starts) else np.zeros(0, bool)
    for h in head:
        same &= h[order[1:]] == h[order[:-1]]
    tied = np.zeros(len(starts), bool)
    tied[order[1:]] |= same
    tied[order[:-1]] |= same
    if tied.any():
        tie = np.empty(len(starts), np.int64)
        tie[order] = np.concatenate([[0], np.cumsum(~same)])
        left = np.nonzero(tied)[0]

        # ranks of the cover's samples behind them, at every length
        behind = {d: left[np.isin((starts[left] + d) % COVER_PERIOD, COVER)] for d in range(COVER_PERIOD)}
        samples = np.unique(np.concatenate([starts[x] + d for d, x in behind.items()]))
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, window)[samples])
        by = np.argsort(rows.view(f"S{window}").ravel(), kind="stable")
        common = np.empty(len(samples) - 1, np.int64)
        for k in range(0, len(common), COMPARED):
            differ = rows[by[k + 1 : k + 1 + COMPARED]] != rows[by[k : k + COMPARED][: len(common) - k]]
            common[k : k + COMPARED] = np.where(differ.any(axis=1), differ.argmax(axis=1), window)
        del rows
        at = np.empty(len(samples), np.int64)
        at[by] = np.arange(len(samples))
        for d, own in behind.items():
            rank = np.concatenate([[0], np.cumsum(common < window - d)])[at[np.searchsorted(samples, starts[own] + d)]]
            key = tie[own] * (len(samples) + 1) + rank
            sort = np.argsort(key, kind="stable")
            equal = key[sort[1:]] == key[sort[:-1]]
            marked[own[sort[1:][equal]]] = True
            marked[own[sort[:-1][equal]]] = True
    return [marked[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def runs_of(mask: np.ndarray) -> np.ndarray:
    """(first, end) of the runs of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def _minimizers(texts: DataFrame, window: int, context: int) -> DataFrame:
    """Minimizer hashes found at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for text, _, _, spot, key in segments(batch.column(0).to_pylist(), window, context):
                _, once = np.unique(np.stack([text, spot]), axis=1, return_index=True) if len(text) else (None, np.zeros(0, np.int64))
                keys, n = np.unique(key[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return texts.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def text_digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _place(digest: bytes, start: int) -> int:
    return xxhash.xxh3_64_intdigest(digest + start.to_bytes(8, "big")) - (1 << 63)


SEGMENT_SCHEMA = pa.schema([("digest", pa.binary()), ("start", pa.int64()), ("n", pa.int64()), ("segment", pa.binary()), ("place", pa.int64()), ("key", pa.int64()), ("part", pa.binary())])


def _suspects(batches: Iterator[pa.RecordBatch], window: int, context: int, shared: Bitmap, only: Bitmap | None = None, single: bool = False) -> Iterator[pa.RecordBatch]:
    """The segments whose minimizer is shared (and among `only`), as rows of SEGMENT_SCHEMA; cut into single starts if wanted."""
    for batch in slices(batches, 0):
        distinct = {text_digest(t): t for t in batch.column(0).to_pylist()}
        digests, texts = list(distinct), list(distinct.values())
        for text, first, size, _, key in segments(texts, window, context):
            hit = shared.has(key)
            take = np.flatnonzero(hit & only.has(key) if only else hit)
            text, first, size, key = text[take], first[take], size[take], key[take]
            if single:
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                text, key, first, size = np.repeat(text, size), np.repeat(key, size), np.repeat(first, size) + within, np.ones(int(size.sum()), np.int64)
            t, a, n = text.tolist(), first.tolist(), size.tolist()
            parts = [texts[i][b : b + m + window - 1] for i, b, m in zip(t, a, n, strict=True)]
            names = [hashlib.blake2b(x, digest_size=16).digest() for x in parts]
            own = [digests[i] for i in t]
            places = [_place(d, b) for d, b in zip(own, a, strict=True)]
            yield arrow_rows({"digest": own, "start": first, "n": size, "segment": names, "place": places, "key": key.view(np.int64), "part": parts}, SEGMENT_SCHEMA)


def _occurrences(texts: DataFrame, shared, window: int, context: int, only=None, single: bool = False) -> DataFrame:
    """Where suspect segments stand: text digest, start, number of starts, segment digest, a hash of the place and the minimizer's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _suspects(batches, window, context, shared.value, only.value if only else None, single):
            yield found.select(SEGMENT_SCHEMA.names[:-1])

    return texts.mapInArrow(run, "digest binary, start bigint, n bigint, segment binary, place bigint, key bigint")


def distinct_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[bytes, bytes]]:
    """Segment -> part of each bucket, from rows (bucket, segment, part) in order of buckets. Further copies of a segment go as they come, so what is held is a bucket's distinct text, however many copies were sent."""
    bucket, held = None, {}
    for batch in slices(batches, 2):
        for own, segment, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own != bucket:
                if held:
                    yield held
                bucket, held = own, {}
            held.setdefault(segment, part)
    if held:
        yield held


def _sorted_buckets(texts: DataFrame, shared, firsts, hot, buckets: int, window: int, context: int) -> DataFrame:
    """(segment, firsts, ends): the runs of repeated starts of each segment that has any. Segments of hot minimizers aren't sent; `firsts` only spares sending copies."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _suspects(batches, window, context, shared.value):
            names = np.array(found.column("segment").to_pylist(), object)
            wanted = firsts.value.has(found.column("place").to_numpy())
            if hot is not None:
                wanted &= ~hot.value.has(found.column("key").to_numpy())
            first = np.flatnonzero(wanted)
            _, once = np.unique(names[first], return_index=True)
            sent = found.take(pa.array(first[once]))
            yield pa.RecordBatch.from_arrays([pa.array(sent.column("key").to_numpy().view(np.uint64) % np.uint64(buckets)).cast(pa.int64()), sent.column("segment"), sent.column("part")], ["bucket", "segment", "part"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int64())
        for parts in distinct_parts(batches):
            out: dict = {"segment": [], "firsts": [], "ends": []}
            for s, mask in zip(parts, repeated_starts(list(parts.values()), window), strict=True):
                runs = runs_of(mask)
                if len(runs):
                    out["segment"].append(s)
                    out["firsts"].append(runs[:, 0])
                    out["ends"].append(runs[:, 1])
            yield arrow_rows(out, pa.schema([("segment", pa.binary()), ("firsts", ints), ("ends", ints)]))

    sent = texts.mapInArrow(send, "bucket bigint, segment binary, part binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(sort, "segment binary, firsts array<bigint>, ends array<bigint>")


def _without(rows: DataFrame, hot) -> DataFrame:
    """rows (with a key) whose minimizer isn't hot."""
    at = rows.columns.index("key")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~hot.value.has(batch.column(at).to_numpy())))

    return rows.mapInArrow(keep, rows.schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, context: int = CONTEXT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    spark = docs.sparkSession
    root = workspace(spark, "suffixes")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    texts = rows.where(F.octet_length("text") >= window).select("text")
    total = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0

    shared_keys = save(_minimizers(texts, window, context), f"{root}/minimizers")
    shared = spark.sparkContext.broadcast(Bitmap.of(shared_keys))
    drop(spark, f"{root}/minimizers")
    places = save(_occurrences(texts, shared, window, context), f"{root}/places")
    segment_of = lambda rows: rows.groupBy("segment").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.first("n").alias("n"), F.first("key").alias("key"))
    segment = save(segment_of(places), f"{root}/segments")
    heavy = save(segment.groupBy("key").agg(F.sum(F.col("n") + window).alias("bytes")).where(F.col("bytes") > hot_bytes).select("key"), f"{root}/hot")
    hot = None
    if not heavy.isEmpty():
        # hot is what this bitmap holds, here and wherever it is asked: a minimizer that only shares a bit is cut up as well, which is as right
        hot = spark.sparkContext.broadcast(Bitmap.of(heavy))
        cut_up = save(_occurrences(texts, shared, window, context, hot, single=True).select(places.columns), f"{root}/single")
        places = _without(places, hot).unionByName(cut_up)
        plain = save(_without(segment, hot), f"{root}/plain-segments")
        segment = plain.unionByName(save(segment_of(cut_up).select(segment.columns), f"{root}/single-segments"))
    else:
        plain = segment
    firsts = spark.sparkContext.broadcast(Bitmap.of(plain.select("low")))
    buckets = max(1, -(-total // BUCKET_BYTES))
    alone = _sorted_buckets(texts, shared, firsts, hot, buckets, window, context)
    whole = segment.where("low <> high").select("segment", F.array(F.lit(0).cast("bigint")).alias("firsts"), F.array("n").alias("ends"))
    repeats = save(alone.join(whole.select("segment"), "segment", "left_anti").unionByName(whole), f"{root}/repeats")

    dealt = repeats.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted_places = places.select("digest", "start", "segment").distinct().withColumn("salt", F.pmod(F.xxhash64("digest", "start"), F.lit(SALTS)).cast("int"))
    spans = salted_places.join(dealt, ["segment", "salt"]).select("digest", F.transform("firsts", lambda x: x + F.col("start")).alias("firsts"), F.transform("ends", lambda x: x + F.col("start") + (window - 1)).alias("ends"))
    by_text = spans.groupBy("digest").agg(F.flatten(F.collect_list("firsts")).alias("firsts"), F.flatten(F.collect_list("ends")).alias("ends"))

    named = rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    twice = named.where(F.octet_length("text") >= window).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.lit(True).alias("copied"))
    lost = by_text.join(twice, "digest", "full")
    lost = save(lost, f"{root}/lost").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(lost.hint("shuffle_hash"), ["digest", "salt"], "left").select("id", "text", "copied", "firsts", "ends")
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema_of = lambda t: pa.schema([(id_col, t), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        for batch in slices(batches, 1):
            cols: dict = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept")}
            for text, copied, firsts, ends in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                at, kept, spans_ = 0, [], 0
                if copied:
                    at, spans_ = len(text), 1
                elif firsts:
                    for a, b in sorted(zip(firsts, ends, strict=True)):
                        if a > at or not spans_:
                            kept.append(text[at:a])
                            spans_ += 1
                        at = max(at, b)
                kept.append(text[at:])
                left = b"".join(kept)
                for n, v in (("n_bytes", len(text)), ("n_removed", len(text) - len(left)), ("n_spans", spans_), ("kept", left)):
                    cols[n].append(v)
            yield arrow_rows(cols | {id_col: batch.column(0)}, schema_of(batch.schema.field(0).type))

    return joined.mapInArrow(cut, f"{id_col} {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
