"""Levelled sorted runs in the shared folder: a log-structured index made of Parquet tables, with filters.

Each batch is first looked up (`split`): keys that the index's filter doesn't hold are new; the others are merge-joined with the runs, which tells the new ones from the known ones. New keys are flushed as one run of level 0, sorted by key within its files, and go into the filter. When a level holds `fanout` runs they are merged into one run of the next level. Entries of known keys stay beside the runs, which so hold each key once.

A filter is a bitmap of 2 ** bits bits in pages of 4 KB, at most 16 MB in all, so it may be broadcast. It never misses a key; with more keys than bits it only spares fewer joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import drop, save

MAX_BITS = 27
PAGE_BITS = 15


def bits_for(n_keys: int) -> int:
    return min(MAX_BITS, max(PAGE_BITS, ceil(log2(n_keys + 1)) + 4))


def _bit(key: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - bits)


def filter_of(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """(page, map) of the keys of rows."""
    bit = _bit(key, bits)
    spots = rows.select(F.shiftright(bit, PAGE_BITS).alias("page"), bit.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).alias("spot"))
    return spots.groupBy("page").agg(F.bitmap_construct_agg("spot").alias("map"))


def may_hold(rows: DataFrame, pages: DataFrame, key: str, bits: int) -> DataFrame:
    """rows with `maybe`: whether a filter may hold their key."""
    bit = _bit(key, bits)
    spot = bit.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("map"), F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("int")
    probed = rows.withColumn("page", F.shiftright(bit, PAGE_BITS)).join(F.broadcast(pages), "page", "left")
    return probed.withColumn("maybe", F.coalesce(F.getbit(byte, spot.bitwiseAND(F.lit(7))) == 1, F.lit(False))).drop("page", "map")


class SortedRuns:
    def __init__(self, spark: SparkSession, root: str, key: str, merge: Callable[[], list[Column]], fanout: int = 2, bits: int = 20):
        """merge() gives the aggregates that combine the entries of one key; they must be associative and keep the column names."""
        self.spark, self.root, self.key, self.merge, self.fanout, self.bits = spark, root, key, merge, fanout, bits
        self.levels: list[list[str]] = [[]]
        self.known: list[str] = []
        self.filters: list[str] = []
        self.written = 0

    def _path(self, kind: str) -> str:
        self.written += 1
        return f"{self.root}/{kind}{self.written}"

    def _flush(self, entries: DataFrame, level: int) -> str:
        path = self._path(f"level{level}-run")
        save(entries.sortWithinPartitions(self.key), path)
        return path

    def _merged(self, paths: list[str]) -> DataFrame:
        runs = [self.spark.read.parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, runs).groupBy(self.key).agg(*self.merge())

    def _runs(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def split(self, entries: DataFrame) -> DataFrame:
        """entries with `fresh`: whether no run holds the key yet. A merge anti-join of what the filter doesn't settle."""
        if not self._runs():
            return entries.withColumn("fresh", F.lit(True))
        pages = self.spark.read.parquet(*self.filters).groupBy("page").agg(F.bitmap_or_agg("map").alias("map"))
        asked = may_hold(entries, pages, self.key, self.bits)
        held = self.spark.read.parquet(*self._runs()).select(F.col(self.key).alias("held"))
        found = asked.where("maybe").join(held.hint("merge"), F.col(self.key) == F.col("held"), "left").withColumn("fresh", F.col("held").isNull())
        return found.select(*entries.columns, "fresh").unionByName(asked.where("not maybe").select(*entries.columns, F.lit(True).alias("fresh")))

    def add(self, entries: DataFrame) -> None:
        """Looks up one batch, one entry a key, and adds what is new to the runs and what is known beside them; then compacts the levels that are full."""
        batch = self._path("batch")
        whole = save(entries, f"{batch}/whole")
        split = save(self.split(whole), f"{batch}/split")
        drop(self.spark, f"{batch}/whole")
        self.levels[0].append(self._flush(split.where("fresh").drop("fresh"), 0))
        self.filters.append(self._path("filter"))
        save(filter_of(split.where("fresh"), self.key, self.bits), self.filters[-1])
        self.known.append(self._path("known"))
        save(split.where("not fresh").drop("fresh"), self.known[-1])
        drop(self.spark, batch)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._flush(self._merged(old), level + 1))
            for path in old:
                drop(self.spark, path)
            level += 1

    def entries(self) -> DataFrame:
        """One entry a key over all runs and what stands beside them."""
        return self._merged(self._runs() + self.known)
