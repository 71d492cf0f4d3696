"""Join of two tables on overlapping intervals, by a plane sweep.

Both sides become one table of events, sorted once by (keys, cell, start).  An interval meets those of the other side that come after it and
start before its end, a run of that order, so no pair is looked at that isn't a result.  Long records are cut into
cells: an interval is carried into every cell that it reaches, and a pair belongs to the cell in which its
later interval starts, so it comes out once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.ordering import lookup_join
from spanlake.operators.staging import written
from spanlake.session import ship_package

#: Intervals of a record that a cell holds on average if no cell width is given; pairs of an output batch.
CELL_ROWS, PAIRS = 20_000, 65_536


def _number(df: DataFrame, bound: str | Column) -> Column:
    """A bound as a long: integers as they are, dates as days, timestamps as microseconds."""
    c = F.col(bound) if isinstance(bound, str) else bound
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"bounds must be integers, dates or timestamps, not {kind.simpleString()}")
    return c.cast("long")


def _events(df: DataFrame, keys: Sequence[str], bounds: tuple, side: int, closed: bool, payloads: list[T.StructType]) -> DataFrame:
    """(_k0.., _start, _end, _side, _l, _r): the rows that can overlap anything; ``_end`` is exclusive."""
    start, end = (_number(df, b) for b in bounds)
    row = F.struct(*[F.col(c) for c in payloads[side].fieldNames()])
    payload = [row if i == side else F.lit(None).cast(p) for i, p in enumerate(payloads)]
    out = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], start.alias("_start"), (end + 1 if closed else end).alias("_end"),
                    F.lit(side).alias("_side"), payload[0].alias("_l"), payload[1].alias("_r"))
    return out.filter(" and ".join([*[f"_k{i} is not null" for i in range(len(keys))], "_start < _end"]))


def _sweep(batches: Iterator, n_keys: int, names: tuple[list[str], list[str]]) -> Iterator:
    """Pairs of sorted events.  Of the other side an interval meets those that come later and start before its end: one run of positions, found
    for a whole batch at once.  The rows of both sides are taken from the Arrow columns by their positions.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    rows = [None, None]  # rows that are open at the end of a batch, of the left and of the right side
    until = [np.zeros(0, np.int64)] * 2  # their ends
    group = None

    def pairs(found: tuple):
        fields = [f for s in (0, 1) for f in rows[s].take(pa.array(found[s], pa.int64())).flatten()]
        return pa.RecordBatch.from_arrays(fields, names=[*names[0], *names[1]])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = [batch.column(i) for i in range(n_keys + 1)]  # keys and cell
        changed = np.zeros(n, bool)
        for k in keys:
            changed[1:] |= pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        g = changed.cumsum()
        if [k[0].as_py() for k in keys] != group:
            rows, until = [None, None], [until[0][:0], until[1][:0]]
        group = [k[n - 1].as_py() for k in keys]
        starts, ends, sides, carried = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_start", "_end", "_side", "_carried"))
        at = [len(u) for u in until]
        for s, side in enumerate("lr"):
            # The open rows come first, the batch follows.
            fields = [f"_{side}{i}" for i in range(len(names[s]))]
            new = pa.StructArray.from_arrays([batch.column(f) for f in fields], names=fields)
            rows[s] = pa.concat_arrays([rows[s], new]) if at[s] else new
        for s in (0, 1):
            own, later = np.flatnonzero(sides == s), np.flatnonzero((sides != s) & ~carried)
            end = np.concatenate((until[s], ends[own]))
            # Order by (group, start) as one number, with starts by rank.
            ranks = np.unique(starts[later])
            order = g[later] * (len(ranks) + 1) + np.searchsorted(ranks, starts[later])
            upto = np.concatenate((np.zeros(at[s], np.int64), g[own])) * (len(ranks) + 1) + np.searchsorted(ranks, end)
            first = np.concatenate((np.zeros(at[s], np.int64), np.searchsorted(later, own)))
            count = np.searchsorted(order, upto) - first
            meet = np.flatnonzero(count > 0)
            position = np.concatenate((np.arange(at[s]), at[s] + own))[meet]
            first, count = first[meet], count[meet]
            total = count.cumsum()
            for k in range(0, int(total[-1]) if len(total) else 0, PAIRS):
                pair = np.arange(k, min(k + PAIRS, total[-1]))
                x = np.searchsorted(total, pair, "right")
                y = at[1 - s] + later[first[x] + pair - (total[x] - count[x])]
                yield pairs((position[x], y) if s == 0 else (y, position[x]))
        for s in (0, 1):
            # Only the last record goes on, and what starts there next starts no earlier than the last interval.
            old = until[s] > starts[-1] if not g[-1] else np.zeros(at[s], bool)
            new = np.flatnonzero((g == g[-1]) & (sides == s) & (ends > starts[-1]))
            rows[s] = rows[s].take(pa.array(np.concatenate((np.flatnonzero(old), at[s] + new)), pa.int64()))
            until[s] = np.concatenate((until[s][old], ends[new]))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_bounds: tuple = ("start", "end"), right_bounds: tuple = ("start", "end"),
                 cell: int | None = None, closed: bool = False, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every pair of a ``left`` and a ``right`` row with equal ``keys`` whose intervals overlap, with all columns of both (the keys once).

    Intervals are half open, or with ``closed`` include their end; bounds are integers, dates or timestamps (columns or expressions).
    Other columns must have different names on the two sides.  Rows with a NULL key or bound, and empty intervals, overlap nothing;
    repeated rows give repeated pairs.

    ``cell`` is the width of a cell in units of the bounds (days, microseconds).  Without it every record gets cells of equal
    width for about ``cell_rows`` intervals each, from its count and range; a record up to that size is one cell.  A task holds the intervals that
    are open at one point and one batch of rows, never a record; an interval over many cells is repeated once a cell.
    """
    ship_package(left.sparkSession)
    rest = [[c for c in df.columns if c not in keys] for df in (left, right)]
    if not keys:
        raise ValueError("give at least one key; a constant column serves for one record")
    if clash := {c.lower() for c in rest[0]} & {c.lower() for c in rest[1]}:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    # The left row carries the keys of a pair.
    payloads = [T.StructType([left.schema[c] for c in [*keys, *rest[0]]]), T.StructType([right.schema[c] for c in [*rest[1], *([] if rest[1] else [keys[0]])]])]
    both = _events(left, keys, left_bounds, 0, closed, payloads).unionByName(_events(right, keys, right_bounds, 1, closed, payloads))
    packed = [f"_k{i}" for i in range(len(keys))]
    if cell is None:
        # Written once: the records' sizes and the sweep read the same rows, and Spark knows how large they are.
        both = written(both, "overlap-events")
        wide = F.greatest(F.lit(1), F.ceil((F.max("_end") - F.min("_start")) / F.ceil(F.count("*") / cell_rows))).cast("long")
        many = both.groupBy(*packed).agg(F.count("*").alias("_n"), wide.alias("_width")).filter(F.col("_n") > cell_rows).drop("_n")
        both = lookup_join(both, written(many, "overlap-cells"), packed, "left")
    else:
        both = both.withColumn("_width", F.lit(int(cell)).cast("long"))
    whole = lambda c: F.expr(f"({c} - pmod({c}, _width)) div _width")  # floor for any sign, exact for any long
    cells = F.when(F.col("_width").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(whole("_start"), whole("(_end - 1)")))
    cut = both.select(*packed, F.explode(cells).alias("_cell"), "_start", "_end", "_side", "_l", "_r", "_width")
    cut = cut.withColumn("_carried", F.col("_width").isNotNull() & (F.col("_cell") > whole("_start"))).drop("_width")
    # Keys that workers can't compare as they are become text.
    plain = (T.IntegralType, T.StringType, T.DateType)
    cut = cut.withColumns({k: F.col(k).cast("string") for k in packed if not isinstance(cut.schema[k].dataType, plain)})
    order = [*packed, "_cell", "_start", "_side"]
    # The rows' fields as columns of their own: Spark measures its Arrow batch after every row, and walks a struct's vectors each time.
    fields = [F.col(f"_{x}.`{f}`").alias(f"_{x}{i}") for x, p in zip("lr", payloads) for i, f in enumerate(p.fieldNames())]
    ready = cut.repartition(*packed, "_cell").sortWithinPartitions(*order).select(*packed, "_cell", "_start", "_end", "_side", "_carried", *fields)
    names = tuple([f.name for f in p] for p in payloads)
    out = T.StructType([*payloads[0], *[f if rest[1] else T.StructField("_again", f.dataType) for f in payloads[1]]])
    swept = ready.mapInArrow(lambda batches: _sweep(batches, len(keys), (names[0], names[1] if rest[1] else ["_again"])), out)
    return swept.select(*keys, *rest[0], *rest[1])
