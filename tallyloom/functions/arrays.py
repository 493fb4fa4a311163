"""Higher-order building blocks for ordered lines, all native and linear (or n log n) in an array's length.

`let` evaluates an expression once and hands it to a function by name, which keeps nested array expressions linear. A state machine in which the last marker decides becomes `segments`: the array cut before each marker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), use)[0]


def indices(size: Column) -> Column:
    """0 .. size - 1; empty for size 0."""
    return F.when(size > 0, F.sequence(F.lit(0), size.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def where_index(a: Column, test: Callable[[Column, Column], Column]) -> Column:
    """Positions i for which test(a, i) holds."""
    return F.filter(indices(F.size(a)), lambda i: test(a, i))


def segments(a: Column, starts: Callable[[Column, Column], Column]) -> Column:
    """a cut before each position where starts(a, i) holds; what stands before the first is left out."""
    return let(
        a,
        lambda b: let(
            where_index(b, starts),
            lambda s: F.transform(s, lambda at, k: F.slice(b, at + 1, F.coalesce(F.get(s, k + 1), F.size(b)) - at)),
        ),
    )


def cut_at_markers(a: Column, marker: Callable[[Column], Column]) -> Column:
    return segments(a, lambda b, i: marker(F.get(b, i)))


def runs(a: Column) -> Column:
    """Array of (item, n) for runs of equal neighbours."""
    cut = segments(a, lambda b, i: (i == 0) | ~F.get(b, i).eqNullSafe(F.get(b, i - 1)))
    return F.transform(cut, lambda r: F.struct(r[0].alias("item"), F.size(r).alias("n")))


def leading(a: Column, test: Callable[[Column], Column]) -> Column:
    """The items before the first one that fails the test."""
    return let(a, lambda b: let(F.array_position(F.transform(b, lambda x: F.coalesce(test(x), F.lit(False))), False), lambda p: F.when(p == 0, b).otherwise(F.slice(b, 1, p.cast("int") - 1))))


def without_trailing(a: Column, test: Callable[[Column], Column]) -> Column:
    return F.reverse(let(F.reverse(a), lambda r: let(leading(r, test), lambda t: F.slice(r, F.size(t) + 1, F.size(r)))))


def first_n(a: Column, n: int) -> Column:
    return F.slice(a, 1, n)


def last_n(a: Column, n: int) -> Column:
    return let(a, lambda b: F.slice(b, F.greatest(F.size(b) - n + 1, F.lit(1)), n))


def grouped(items: Column) -> Column:
    """Groups of an array of (key, pos, val), in order of first appearance: (first, key, vals)."""
    cut = segments(F.array_sort(items), lambda b, i: (i == 0) | (F.get(b, i)["key"] != F.get(b, i - 1)["key"]))
    return F.array_sort(F.transform(cut, lambda g: F.struct(g[0]["pos"].alias("first"), g[0]["key"].alias("key"), F.transform(g, lambda x: x["val"]).alias("vals"))))


def keyed(a: Column, key: Callable[[Column], Column], val: Callable[[Column], Column]) -> Column:
    return F.transform(a, lambda x, i: F.struct(key(x).alias("key"), i.alias("pos"), val(x).alias("val")))
