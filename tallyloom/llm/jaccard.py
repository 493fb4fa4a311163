"""N-gram Jaccard join by PartEnum signatures, and the groups its links make.

Two sets with a Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) of their summed sizes. Sizes are cut into overlapping bands such that two sets that can be similar share one; within a band at most k elements differ. The domain of shingle hashes is cut into n = k + 1 + spare partitions: at least spare + 1 of them hold the same elements in both sets. A set's signatures are the hashes of its partitions that hold something. Should all equal partitions of two similar sets be empty, each set has more than `spare` empty ones, and each of its others holds an element that only one of the two has, of which there are at most (1 - t) / t of its own size. A set for which both hold also has the elements of its prefix as signatures, that is the smallest |set| - ceil(t |set|) + 1 hashes; similar sets always share an element of their prefixes. So two similar sets always share a signature, and no set has more of them than elements and partitions.

Equal sets are joined by digest first and stand for one class. Signatures that only one class has are dropped; a bitmap of bounded size spares most of them the second shuffle. Of the classes that share a signature each is compared with one leader, then those in groups that still hold several components with another leader, and at last whatever pairs of different components still share a signature. Every comparison is made on whole texts, with exact integer arithmetic. All pairs within a group are never made: within one component no further link can change the result.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer words than a shingle is one shingle; rows that repeat an id belong together; rows with a null id are linked with nothing and have no component; an empty table gives no rows; other columns are kept or ignored as each function says.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import arrow_rows, drop, save, slices, table, text_or_empty, workspace
from tallyloom.llm.components import components, one_round
from tallyloom.llm.rolling import folded_words, mix

#: Width of a size band, in steps of 1 / similarity.
BAND_STEPS = 3
#: The bitmap of shared signatures has at most 2 ** MAX_BITS bits (16 MB).
MAX_BITS = 27
SALTS = 16
#: Comparisons with one leader that stay in one share.
SHARE = 2_000
#: Elements of the sets of one block of the last step; their sketches take at most a byte each.
BLOCK = 1 << 20
#: Bytes of texts whose sets and signatures a worker makes at a time: they take some 15 times as much, and a worker keeps what it once took.
SLICE = 1 << 19
#: Rank limit of a set all of whose signatures count.
ALL = 1 << 30
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles, end to end, and where each text's begin."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    begins, words = folded_words(data)
    first = np.searchsorted(begins, np.cumsum([0] + [len(t) + 1 for t in texts]))
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(bounds[-1], np.uint64)
    factor = lambda k: ODD[k % 8] + np.uint64(2 * (k // 8))
    whole = np.ones(len(words), bool)
    for k in range(1, size):
        whole[(first[1:] - k)[n_words >= k]] = False
    joint = np.full(max(0, len(words) - size + 1), size, np.uint64)
    for k in range(size):
        joint += words[k : k + len(joint)] * factor(k)
    few = (n_words > 0) & (n_words < size)
    full = np.ones(len(out), bool)
    full[bounds[:-1][few]] = False
    out[full] = joint[whole[: len(joint)]]
    for d in np.flatnonzero(few).tolist():
        n = int(n_words[d])
        out[bounds[d]] = np.uint64(n) + np.sum(words[first[d] : first[d] + n] * np.array([factor(k) for k in range(n)]), dtype=np.uint64)
    out = mix(out)
    at = bounds.tolist()
    for a, b in zip(at, at[1:], strict=False):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are: 100 * intersection >= percent * union, in whole numbers."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
        return False
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


@lru_cache(maxsize=8)
def bands(most: int, percent: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, partitions) of the bands up to a size. Half as many partitions as may differ are added."""
    t = percent / 100
    out, low = [], 1.0
    while low <= most * (1 + 1e-9):
        high = floor(low / t**BAND_STEPS * (1 + 1e-9))
        differ = 2 * high * (100 - percent) // (100 + percent)
        out.append((ceil(low * (1 - 1e-9)), high, differ + 1 + ceil(differ / 2)))
        low /= t ** (BAND_STEPS - 1)
    return out


def signatures(elements: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many sorted sets laid end to end: signature, set number, band, and how many of a set's signatures in that band count, the rarest first."""
    sizes = np.diff(bounds)
    out: list[tuple[np.ndarray, ...]] = []
    for band, (low, high, n) in enumerate(bands(int(sizes.max(initial=0)), percent)):
        own = np.flatnonzero((sizes >= low) & (sizes <= high))
        if not len(own):
            continue
        count = sizes[own]
        row = np.repeat(np.arange(len(own)), count)
        values = elements[np.repeat(bounds[own] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        spot = row * n + (values % np.uint64(n)).astype(np.int64)
        total = np.zeros(len(own) * n, np.uint64)
        np.add.at(total, spot, mix(values ^ ODD[1]))
        held = np.zeros(len(own) * n, bool)
        held[spot] = True
        held_of = held.reshape(-1, n).sum(axis=1)
        tags = mix((np.arange(n, dtype=np.uint64) + np.uint64((band + 1) << 32)) * ODD[2])
        differ = (count + np.minimum(count * 100 // percent, high)) * (100 - percent) // (100 + percent)
        empty = held_of <= differ
        need = np.where(empty, ALL, differ + 1)
        at = np.flatnonzero(held)
        out.append((mix(total[at] ^ tags[at % n]), own[at // n], np.full(len(at), band), need[at // n]))
        if empty.any():
            prefix = count * (100 - percent) // 100 + 1
            among = empty[row] & (np.arange(len(row)) - (np.cumsum(count) - count)[row] < prefix[row])
            out.append((mix(values[among] ^ ODD[3] ^ tags[0]), own[row[among]], np.full(int(among.sum()), band), need[row[among]]))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def digest_of(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


class Bitmap:
    """Bits that are set for every value of a column of hashed longs; at most 2 ** MAX_BITS of them."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    @staticmethod
    def of(values: DataFrame) -> Bitmap:
        name = values.columns[0]
        n = values.count()
        bits = min(MAX_BITS, max(18, ceil(log2(n + 1)) + 4))
        bit = F.shiftrightunsigned(F.col(name), 64 - bits)
        rows = values.select(F.shiftright(bit, 15).alias("page"), bit.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
        packed = np.zeros(1 << (bits - 3), np.uint8)
        for r in rows:
            packed[r.page * 4096 : r.page * 4096 + len(r.map)] = np.frombuffer(bytes(r.map), np.uint8)
        return Bitmap(bits, packed)

    def has(self, values: np.ndarray) -> np.ndarray:
        bit = values.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.packed[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _sets(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[bytes]]]:
    for batch in slices(batches, column, SLICE):
        elements, bounds = shingle_sets(batch.column(column).to_pylist(), size)
        yield batch, elements, bounds, [digest_of(elements[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, bounds, digests in _sets(batches, 1, size):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(digests, pa.binary())], ["id", "n", "digest"])

    return rows.mapInArrow(run, f"id {kind}, n bigint, digest binary")


def _ends(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, low, high, n): the signatures of a slice of texts, with the ends of the short keys of the sets that have it, and how many have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, elements, bounds, digests in _sets(batches, 0, size):
            distinct, first = np.unique(np.array(digests), return_index=True)
            sigs, number, _, _ = signatures(elements, bounds, percent)
            keys = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
            once = np.isin(number, first)
            yield pa.RecordBatch.from_arrays([pa.array(sigs[once].view(np.int64)), pa.array(keys[number[once]])], ["sig", "key"])

    return texts.mapInArrow(run, "sig bigint, key bigint").groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("often"))


def _counting(texts: DataFrame, size: int, percent: int, shared) -> DataFrame:
    """(sig, digest, n, band, need) of signatures in the bitmap, of the sets whose rarest ones aren't all known to be theirs alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, elements, bounds, digests in _sets(batches, 0, size):
            sigs, number, band, need = signatures(elements, bounds, percent)
            hit = shared.value.has(sigs)
            group = number * 256 + band
            names, back = np.unique(group, return_inverse=True)
            need = need - np.bincount(back, ~hit, len(names)).astype(np.int64)[back]
            take = np.flatnonzero(hit & (need > 0))
            names = np.array(digests, object)[number[take]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(sigs[take].view(np.int64)), pa.array(names, pa.binary()), pa.array(np.diff(bounds)[number[take]]), pa.array(band[take], pa.int32()), pa.array(need[take])], ["sig", "digest", "n", "band", "need"])

    return texts.mapInArrow(run, "sig bigint, digest binary, n bigint, band int, need bigint").distinct()


def _sets_of(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(no, digest, id, n, elements, sketch) of wanted (digest, id, n). A bitmap of bounded size keeps most other texts from being looked at."""
    cast = rows.sparkSession.sparkContext.broadcast(Bitmap.of(wanted.select(F.xxhash64("id").alias("h"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            yield batch.filter(pa.array(cast.value.has(batch.column(2).to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, elements, bounds, digests in _sets(pick(batches), 1, size):
            sets = [elements[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([parity(x) if len(x) else b"" for x in sets], pa.binary())], ["own", "elements", "sketch"])

    found = rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, "own binary, elements binary, sketch binary")
    return found.join(wanted, F.col("own") == F.col("digest")).drop("own").dropDuplicates(["digest"]).withColumn("no", F.monotonically_increasing_id())


def _reach(sets: DataFrame, percent: int) -> DataFrame:
    """(no, reach): the greatest size that a set similar to this one can have, as the elements that no other of these sets holds are in no intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), "<i8")), pa.array(np.repeat(batch.column(0).to_numpy(), [len(r) // 8 for r in raw]))], ["element", "no"])

    held = sets.select("no", "elements").mapInArrow(run, "element bigint, no bigint")
    alone = held.groupBy("element").agg(F.count(F.lit(1)).alias("often"), F.min("no").alias("no")).where("often = 1").groupBy(F.col("no").alias("owner")).agg(F.count(F.lit(1)).alias("alone"))
    joined = sets.select("no", "n").join(alone, F.col("no") == F.col("owner"), "left")
    return joined.select("no", (F.expr(f"(n - coalesce(alone, 0)) * {100 + percent} div {percent}") - F.col("n")).alias("reach"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of set numbers with ids u and v, the links (u, v). A much wanted leader's comparisons are dealt over shares; in each its set comes first and the others stream by."""
    kind = pairs.schema["u"].dataType.simpleString()
    many = pairs.groupBy("a", "u").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    spread = many.select("a", "u", "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    leaders = spread.join(sets.select("no", "elements"), F.col("a") == F.col("no")).select("a", "share", F.lit(False).alias("other"), F.col("u").alias("id"), "elements")
    dealt = pairs.join(many.select("a", "shares"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b", "v")
    others = dealt.join(sets.select("no", "elements"), F.col("b") == F.col("no")).select("a", "share", F.lit(True).alias("other"), F.col("v").alias("id"), "elements")
    both = leaders.unionByName(others).repartition("a", "share").sortWithinPartitions("a", "share", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, u = np.zeros(0, np.uint64), None
        for batch in slices(batches, 4):
            found: dict = {"u": [], "v": []}
            for other, id_, raw in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if not other:
                    leader, u = own, id_
                elif similar(leader, own, percent):
                    found["u"].append(u)
                    found["v"].append(id_)
            t = batch.schema.field(3).type
            yield arrow_rows(found, pa.schema([("u", t), ("v", t)]))

    return both.mapInArrow(run, f"u {kind}, v {kind}")


def parity(elements: np.ndarray) -> bytes:
    """A sketch of at least four bits an element, each the parity of the elements that fall on it. Two sketches differ in no more bits than the sets do in elements."""
    size = 1 << max(6, ceil(log2(4 * len(elements))))
    odd = np.bincount((elements & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of several lengths, all brought down to the shortest one's, as rows of 64-bit words."""
    words = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in sketches])


def pairs_within(sketches: list[bytes], n: np.ndarray, reach: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs (r, s) of a left and a right set of different components, all similar ones among them: sets whose sketches differ in more bits than similar sets may in elements aren't."""
    rows = folded(sketches)
    out = []
    for r in np.flatnonzero(left).tolist():
        fit = np.flatnonzero(right & (n <= reach[r]) & (n[r] <= reach) & (component != component[r]))
        if len(fit):
            differ = np.bitwise_count(rows[fit] ^ rows[r]).sum(axis=1, dtype=np.int64)
            out += [(r, s) for s in fit[differ * (100 + percent) <= (100 - percent) * (n[r] + n[fit])].tolist()]
    return out


def _viable(rows: DataFrame) -> DataFrame:
    """Of the rows of each signature those that may be similar to one of another component: of the sets of other components the greatest reach and the smallest size allow it."""
    parts = rows.groupBy("sig", "component").agg(F.min("n").alias("least"), F.max("reach").alias("far"))
    ends = parts.groupBy("sig").agg(F.max(F.struct("far", "component")).alias("top"), F.min(F.struct("least", "component")).alias("low"))
    both = parts.join(ends, "sig").groupBy("sig").agg(F.first("top").alias("top"), F.first("low").alias("low"), F.max(F.when(F.col("component") != F.col("top.component"), F.col("far"))).alias("far2"), F.min(F.when(F.col("component") != F.col("low.component"), F.col("least"))).alias("least2"))
    far = F.when(F.col("component") == F.col("top.component"), F.col("far2")).otherwise(F.col("top.far"))
    least = F.when(F.col("component") == F.col("low.component"), F.col("least2")).otherwise(F.col("low.least"))
    return rows.join(both, "sig").where((far >= F.col("n")) & (least <= F.col("reach"))).select(*rows.columns)


def _in_blocks(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of set numbers, with ids u and v, among the rows of each signature that are of different components and that their sketches don't set apart. A signature's sets are dealt into blocks of bounded size, and the sketches of each two blocks meet in a task: rows grow with sets and blocks, not with pairs."""
    kind = rows.schema["id"].dataType.simpleString()
    blocks = rows.groupBy("sig").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int").alias("own")
    dealt = rows.join(blocks, "sig").select("sig", "no", "id", "n", "reach", "component", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    tiles = dealt.select("sig", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"), "own", "no", "id", "n", "reach", "component")
    both = tiles.join(sketches, "no").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch:
            own, no, ids, n, reach, component, sketch = zip(*held, strict=True)
            own, groups = np.array(own), {c: k for k, c in enumerate(dict.fromkeys(component))}
            pairs = pairs_within(list(sketch), np.array(n), np.array(reach), np.array([groups[c] for c in component]), own == key[1], own == key[2], percent) if len(groups) > 1 else []
            return arrow_rows({"a": [no[r] for r, _ in pairs], "b": [no[s] for _, s in pairs], "u": [ids[r] for r, _ in pairs], "v": [ids[s] for _, s in pairs]}, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("u", of), ("v", of)]))

        for batch in slices(batches, 9):
            of = batch.schema.field(5).type
            for sig, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (sig, i, j):
                    if held:
                        yield found()
                    key, held = (sig, i, j), []
                held.append(row)
        if held:
            yield found()

    return both.select("sig", "i", "j", "own", "no", "id", "n", "reach", "component", "sketch").mapInArrow(run, f"a bigint, b bigint, u {kind}, v {kind}")


def _repeated_ids(members: DataFrame, classes: DataFrame, path: str) -> DataFrame | None:
    """Links between the classes of rows that repeat an id; None without such rows."""
    own = members.where("n > 0 and id is not null").select("id", "digest").distinct()
    twice = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    of_class = classes.select("digest", F.col("id").alias("v"))
    links = save(own.join(twice, "id").join(of_class, "digest").select(F.col("id").alias("u"), "v"), path)
    return None if links.isEmpty() else links


def _labelled(rows: DataFrame, edges: DataFrame | None) -> DataFrame:
    """rows with the smallest id that each row's id is tied to directly, as component."""
    if edges is None:
        return rows.withColumn("component", F.col("id"))
    least = edges.groupBy(F.col("u").alias("tied")).agg(F.min("v").alias("least"))
    return rows.join(least, rows.id == least.tied, "left").withColumn("component", F.coalesce("least", "id")).drop("tied", "least")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    root = workspace(spark, "jaccard")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    known = rows.where(F.col("id").isNotNull())
    members = save(_sketches(rows, size), f"{root}/members")
    classes = members.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    classes = save(classes, f"{root}/classes")

    shared = save(_ends(known.select("text"), size, percent).where("low <> high").select("sig", "often"), f"{root}/shared")
    bitmap = spark.sparkContext.broadcast(Bitmap.of(shared.select("sig")))
    counting = _counting(known.select("text"), size, percent, bitmap).join(shared, "sig", "left")
    rank = F.row_number().over(Window.partitionBy("digest", "band").orderBy(F.coalesce("often", F.lit(0)), "sig"))
    counting = counting.withColumn("rank", rank).where("rank <= need and often is not null").select("sig", "digest", "n", "band")
    counting = save(counting, f"{root}/counting")
    drop(spark, f"{root}/shared")
    several = counting.groupBy("sig").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("sig")
    several = save(counting.join(several, "sig", "left_semi").select("sig", "digest"), f"{root}/several")
    drop(spark, f"{root}/counting")
    wanted = several.select("digest").distinct().join(classes.join(members.select("digest", "n").distinct(), "digest").select("digest", "id", "n"), "digest")
    sets = save(_sets_of(known, wanted, size), f"{root}/sets")
    reach = save(_reach(sets, percent), f"{root}/reach")
    nodes = sets.select("no", "digest", "id", "n").join(reach, "no")
    reached = several.join(nodes, "digest").drop("digest")
    least = reached.groupBy("sig").agg(F.min("n").alias("least"))
    reached = save(reached.join(least, "sig").where("reach >= least").drop("least"), f"{root}/reached")
    drop(spark, f"{root}/several")
    # similar sets share many signatures: of those that the same sets have, one is enough
    mark = [F.bit_xor(F.xxhash64("no", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    first = reached.groupBy("sig").agg(F.count(F.lit(1)).alias("sets"), *mark).where("sets > 1").groupBy("sets", "mark0", "mark1").agg(F.min("sig").alias("sig"))
    open_rows = save(reached.join(first.select("sig"), "sig", "left_semi"), f"{root}/open")
    drop(spark, f"{root}/reached")

    # edges are compressed to shallow trees after each step; labels read from them join what is known to be connected
    edges = _repeated_ids(members, classes, f"{root}/repeated")
    side = lambda row, end: [row(c).alias(f"{c}_{end}") for c in ("no", "id", "n", "reach", "component")]
    for step in ("first", "second", "blocks"):
        marked = _labelled(open_rows, edges)
        head = F.struct("id", "no", "n", "reach", "component")
        mixed = marked.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), (F.min if step == "first" else F.max)(head).alias("head")).where("c0 <> c1")
        if step == "blocks":
            apart = marked.join(mixed.select("sig"), "sig", "left_semi")
            for k in range(2):  # rows that go may have been another row's only hope
                apart = save(_viable(apart), f"{root}/apart{k}")
            pairs = _in_blocks(apart, sets.select("no", "sketch"), percent)
        else:
            found = marked.join(mixed.select("sig", "head"), "sig").select(*side(lambda c: F.col(f"head.{c}"), "a"), *side(F.col, "b"))
            fits = (F.col("n_b") <= F.col("reach_a")) & (F.col("n_a") <= F.col("reach_b")) & (F.col("component_a") != F.col("component_b"))
            pairs = found.where(fits).select(F.col("no_a").alias("a"), F.col("no_b").alias("b"), F.col("id_a").alias("u"), F.col("id_b").alias("v"))
        new = _verified(save(pairs.distinct(), f"{root}/pairs-{step}"), sets, percent)
        new = save(new, f"{root}/links-{step}")
        if not new.isEmpty():
            edges = save(one_round(new if edges is None else edges.unionByName(new)), f"{root}/edges-{step}")

    parts = None if edges is None else components(edges, f"{root}/parts")
    if parts is None:
        grouped = classes.where("rows > 1").select("digest", F.col("id").alias("component"))
    else:
        grouped = classes.join(parts, classes.id == parts.node, "left").where("rows > 1 or component is not null").select("digest", F.coalesce("component", "id").alias("component"))
    grouped = grouped.select("digest", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = members.select("id", "n", "digest").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(grouped, ["digest", "salt"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of its group (rows with a null id stay), with all their columns."""
    groups = similar_groups(docs, size, percent)
    gone = groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rest")
    kept = docs.select(rest, F.col("doc_id").alias("own_id")).join(gone.hint("shuffle_hash"), F.col("own_id") == F.col("gone_id"), "left_anti")
    return kept.select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


OP6_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') as g, least(4, len(w)) as k
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) as i from w where len(w) > 0)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), l as (
  select a.doc_id as u, b.doc_id as v
  from s a join s b on a.g = b.g and a.k = b.k and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  where 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r as (
  select doc_id as u, doc_id as c from w
  union
  select l.v as u, r.c from r join l on l.u = r.u where r.c < l.v
)
select w.doc_id, coalesce(n.n, 0) as n_shingles, r.c as component_id
from w left join n on n.doc_id = w.doc_id join (select u, min(c) as c from r group by u) r on r.u = w.doc_id
"""
