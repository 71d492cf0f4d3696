"""Array expressions that keep per-record work inside the record: no explode, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements per block of the two-level folds below.
BLOCK = 32


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body`` (a let-binding)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``bind`` for several values at once."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return bind(packed, lambda s: body(*[s[f"v{i}"] for i in range(len(values))]))


def _blocks(n: Column) -> Column:
    """0-based block numbers covering ``n`` elements (one empty block for n = 0)."""
    return F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / BLOCK), F.lit(0)).cast("int"))


def prefix_sums(lengths: Column) -> Column:
    """Exclusive running sums of an int array, same size as the input.

    Appending to an array in a fold copies it each time, which is quadratic for long texts.
    Folding inside blocks of 32 and once over the block totals keeps the copies per element
    near-constant for any realistic record.
    """

    def scan(arr: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            arr, start,
            lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"),
                                    F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"],
        )

    def body(arr: Column) -> Column:
        blocks = F.transform(_blocks(F.size(arr)),
                             lambda b: F.slice(arr, b * BLOCK + 1, F.lit(BLOCK)))

        def with_blocks(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
            return F.flatten(F.zip_with(parts, scan(totals, F.lit(0)), scan))

        return bind(blocks, with_blocks)

    return bind(lengths, body)


def block_heads(ordered: Column) -> Column:
    """First element of every block of an ascending array; the index for :func:`sorted_rank`."""
    return F.transform(_blocks(F.size(ordered)), lambda b: F.get(ordered, b * BLOCK))


def sorted_rank(ordered: Column, heads: Column, value: Column, inclusive: bool) -> Column:
    """How many elements of an ascending array are < ``value`` (<= when ``inclusive``).

    Looks at the block heads, then into one block: about n/32 + 32 comparisons instead of n.
    """

    def below(x: Column, v: Column) -> Column:
        return x <= v if inclusive else x < v

    def body(v: Column) -> Column:
        block = F.size(F.filter(heads, lambda h: below(h, v))) - 1
        inside = F.size(F.filter(F.slice(ordered, F.greatest(block, F.lit(0)) * BLOCK + 1, F.lit(BLOCK)),
                                 lambda x: below(x, v)))
        return F.when(block < 0, F.lit(0)).otherwise(block * BLOCK + inside)

    return bind(value, body)


def array_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def array_mean(arr: Column) -> Column:
    """Mean of a double array, NULL when empty."""
    return bind(arr, lambda v: F.when(F.size(v) > 0, array_sum(v) / F.size(v)))


def array_median(arr: Column) -> Column:
    """Median (mean of the middle two), NULL when empty."""

    def body(v: Column) -> Column:
        mid = F.floor((F.size(v) - 1) / 2).cast("int")
        high = F.floor(F.size(v) / 2).cast("int")
        return (F.get(v, mid) + F.get(v, high)) / 2

    return bind(F.sort_array(arr), body)


def array_p75(arr: Column) -> Column:
    """Element at position round-half-even((n-1) * 0.75) of the sorted array, NULL when empty."""
    return bind(F.sort_array(arr),
                lambda v: F.get(v, F.bround((F.size(v) - 1) * F.lit(0.75)).cast("int")))


def first_list(*candidates: Column) -> Column:
    """First non-NULL array; NULL when all are absent."""
    return F.coalesce(*candidates)


def dedupe_by(arr: Column, key: Callable[[Column], Column]) -> Column:
    """First element per key, kept in array order (``key`` must return a non-NULL value)."""

    def body(a: Column) -> Column:
        keyed = F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
        ordered = F.array_sort(keyed, lambda p, q: _compare(p, q))

        def keep(o: Column) -> Column:
            firsts = F.filter(o, lambda x, i: (i == 0) | (~F.get(o, i - 1)["k"].eqNullSafe(x["k"])))
            back = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["x"].alias("x"))),
                                lambda p, q: (p["i"] - q["i"]))
            return F.transform(back, lambda x: x["x"])

        return bind(ordered, keep)

    return bind(arr, body)


def _compare(p: Column, q: Column) -> Column:
    return (F.when(p["k"] < q["k"], F.lit(-1)).when(p["k"] > q["k"], F.lit(1))
            .otherwise(p["i"] - q["i"]))
