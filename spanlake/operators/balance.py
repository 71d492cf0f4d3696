"""Folds balanced by their cost: a distributed local search over moves and swaps of groups.

The totals of the folds are a small table (folds times labels).  A round lets every group meet groups of the other folds in random
buckets of a bounded mean size, scores each move and swap by what it changes of the cost, and brings the best ones to the driver, which takes those
that still pay after the ones before.  The cost never rises; the search ends when rounds find nothing any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators.staging import written
from spanlake.session import ship_package

#: Rounds at most; rounds without a gain after which the search ends if not all pairs were seen; candidates that come back in a round.
ROUNDS, PATIENCE, TAKE = 30, 3, 512
#: Groups of a fold that share a bucket, on average; up to this many, all pairs of groups meet.
BUCKET, ALL_PAIRS = 8, 256
#: Pairs of groups that a task scores at once.
PAIRS = 1 << 17
#: Weights of the cost by what is out of balance (see ``fold_cost``); a gain has to be larger than ``LEAST``.
GROUP, EXAMPLE, PRESENCE, SPAN, MISSING, LEAST = 1.0, 1.0, 3.0, 2.0, 10.0, 1e-12


class FoldTotals:
    """Totals of each fold as vectors (groups, examples, groups by label, spans by label), and their cost."""

    def __init__(self, totals: list[list[float]], labels: int):
        self.totals, self.labels = totals, labels
        goals = [sum(x) / len(totals) for x in zip(*totals)]
        scale = lambda w, g, least: w / max(least, g) ** 2 if g > 0 or least else 0.0
        share = max(1, labels)
        self.goals = goals
        self.weights = [scale(GROUP, goals[0], 1.0), scale(EXAMPLE, goals[1], 1.0),
                        *[scale(PRESENCE / share, g, 0.0) for g in goals[2:2 + labels]], *[scale(SPAN / share, g, 0.0) for g in goals[2 + labels:]]]

    def _of(self, row: Sequence[float]) -> float:
        off = sum(w * (x - g) ** 2 for w, x, g in zip(self.weights, row, self.goals))
        return off + MISSING * sum(x <= 0 for x in row[2:2 + self.labels])

    def cost(self) -> float:
        return sum(map(self._of, self.totals))

    def gain(self, source: int, target: int, moved: Sequence[float]) -> float:
        """Change of the cost if ``moved`` leaves one fold for another."""
        a, b = self.totals[source], self.totals[target]
        return self._of([x - m for x, m in zip(a, moved)]) - self._of(a) + self._of([x + m for x, m in zip(b, moved)]) - self._of(b)

    def move(self, source: int, target: int, moved: Sequence[float]) -> None:
        self.totals[source] = [x - m for x, m in zip(self.totals[source], moved)]
        self.totals[target] = [x + m for x, m in zip(self.totals[target], moved)]


def _best_changes(batches: Iterator, totals: FoldTotals, take: int) -> Iterator:
    """The ``take`` best swaps and moves of the buckets of a task, whose rows (f, v, h, b) come sorted by bucket; gains as ``FoldTotals.gain`` without
    its common terms.  Pairs exist ``PAIRS`` at a time.
    """
    import numpy as np
    table, weights, width, labels, k = np.array(totals.totals), totals.weights, len(totals.weights), totals.labels, len(totals.totals)
    gone = lambda x: np.where(x <= 0, MISSING, 0.0)
    # Of the best so far: gain, h, i (0 for a move), target, source, whether it is a move, the vector that moves.
    best = [np.zeros(0), *[np.zeros(0, np.int64)] * 4, np.zeros(0, bool), np.zeros((0, width))]

    def gains(moved, source, target):
        out = np.zeros(len(source))
        for i in range(width):
            m = moved(i)
            out += weights[i] * m * 2 * (m - table[source, i] + table[target, i])
        for i in range(2, 2 + labels):
            m, a, b = moved(i), table[source, i], table[target, i]
            out += gone(a - m) - gone(a) + gone(b + m) - gone(b)
        return out

    def offer(gain, h, i, target, source, alone, moved):
        nonlocal best
        good = gain < -LEAST
        if len(best[0]) >= take:
            good &= gain <= best[0][-1]
        at = np.flatnonzero(good)
        if len(at) > take:
            at = at[gain[at] <= np.partition(gain[at], take - 1)[take - 1]]
        if len(at):
            new = [gain[at], h[at], i[at], target[at], source[at], np.full(len(at), alone), np.stack([moved(c)[at] for c in range(width)], 1)]
            both = [np.concatenate(x) for x in zip(best, new)]
            first = np.lexsort(both[3::-1])[:take]
            best = [x[first] for x in both]

    def score(f, v, h, b):
        order = np.lexsort((f, b))
        f, v, h, b = f[order], v[order].T.copy(), h[order], b[order]
        place = np.concatenate(([0], (b[1:] != b[:-1]).cumsum())) * k
        later = np.searchsorted(place + f, place + f, "right")  # of the same bucket, in later folds
        count = np.searchsorted(place + f, place + k) - later
        total = count.cumsum()
        for start in range(0, int(total[-1]), PAIRS):
            pair = np.arange(start, min(start + PAIRS, total[-1]))
            x = np.searchsorted(total, pair, "right")
            y = later[x] + pair - (total[x] - count[x])
            moved = lambda c: v[c][x] - v[c][y]
            offer(gains(moved, f[x], f[y]), h[x], h[y], f[y], f[x], False, moved)
        for target in range(k):
            x = np.flatnonzero((f != target) & (table[f, 0] > table[target, 0]))
            moved, to = (lambda c: v[c][x]), np.full(len(x), target)
            offer(gains(moved, f[x], to), h[x], np.zeros(len(x), np.int64), to, f[x], True, moved)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column("f").to_numpy().astype(np.int64), batch.column("v").flatten().to_numpy().reshape(-1, width), batch.column("h").to_numpy(), batch.column("b").to_numpy()]
        rows = [np.concatenate(x) for x in zip(rest, rows)] if rest else rows
        whole = np.searchsorted(rows[3], rows[3][-1])  # the last bucket may go on
        if whole:
            score(*[x[:whole] for x in rows])
        rest = [x[whole:] for x in rows]
    if rest:
        score(*rest)
    gain, h, i, target, source, alone, moved = best
    yield pa.RecordBatch.from_arrays([pa.array(gain), pa.array(source, pa.int32()), pa.array(target, pa.int32()), pa.array(h), pa.array(i, mask=alone), pa.array(moved.tolist(), pa.list_(pa.float64()))],
                                     names=["gain", "source", "target", "h", "i", "moved"])


def balance_folds(folds: DataFrame, group: str, k: int, seed: int = 42, rounds: int = ROUNDS, take: int = TAKE, bucket: int = BUCKET, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """``folds`` (group, fold 1..k, examples, spans, counts) with a cost that is no higher, mostly far lower.

    Groups keep their profiles and only change folds; group counts still differ by at most one if they did before, as a group moves alone only
    from a larger fold to a smaller one and all else are swaps.  The same input and seed give the same folds.  A round takes ``take`` changes at
    most; groups of all folds meet pair by pair up to ``all_pairs`` groups a fold, so that the result is a local optimum there, and
    in buckets of ``bucket`` groups a fold above.  What comes back to the driver is folds times labels, and the candidates.
    """
    ship_package(folds.sparkSession)
    base = written(folds, "fold-profiles")
    names = [r["label"] for r in base.select(F.explode(F.map_keys("counts")).alias("label")).distinct().orderBy("label").collect()]  # the label inventory
    known = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    spans = F.transform(known, lambda x: F.coalesce(F.try_element_at("counts", x), F.lit(0)).cast("double"))
    vector = F.concat(F.array(F.lit(1.0), F.col("examples").cast("double")), F.transform(spans, lambda x: F.when(x > 0, 1.0).otherwise(0.0)), spans)
    slim = written(base.select(F.col(group).alias("g"), (F.col("fold") - 1).cast("int").alias("f"), vector.alias("v"), F.xxhash64(F.lit(seed), F.col(group), F.col(group).isNull()).alias("h")), "fold-vectors")
    width = 2 + 2 * len(names)
    sums = {r["f"]: list(r)[1:] for r in slim.groupBy("f").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()}
    totals = FoldTotals([sums.get(f, [0.0] * width) for f in range(k)], len(names))
    most = max(t[0] for t in totals.totals)
    buckets = 1 if most <= all_pairs else int(-(-most // bucket))
    # An Arrow table goes to the JVM as it is, without Python workers.
    changes = lambda of: folds.sparkSession.createDataFrame(pa.table({"_h": pa.array(of.keys(), pa.int64()), "_f": pa.array(of.values(), pa.int32())}))
    changed: dict[int, int] = {}
    idle = 0
    for turn in range(rounds):
        now = slim
        if changed:  # rounds times twice ``take`` rows at most
            moved = F.broadcast(changes(changed))
            now = slim.join(moved, F.col("h") == F.col("_h"), "left").select("g", F.coalesce("_f", "f").alias("f"), "v", "h")
        dealt = now.select("f", "v", "h", F.pmod(F.xxhash64(F.lit(turn), F.col("h")), F.lit(buckets)).alias("b"))
        found = dealt.repartition("b").sortWithinPartitions("b").mapInArrow(
            lambda batches: _best_changes(batches, totals, take), "gain double, source int, target int, h long, i long, moved array<double>")
        best = found.orderBy("gain", "h", F.coalesce("i", F.lit(0)), "target").limit(take).collect()
        used: set[int] = set()
        for r in best:
            touched = {r["h"], r["i"]} - {None}
            a, b = r["source"], r["target"]
            if touched & used or (r["i"] is None and totals.totals[a][0] <= totals.totals[b][0]) or totals.gain(a, b, r["moved"]) >= -LEAST:
                continue
            totals.move(a, b, r["moved"])
            used |= touched
            changed[r["h"]] = b
            if r["i"] is not None:
                changed[r["i"]] = a
        idle = 0 if used else idle + 1
        if idle and (buckets == 1 or idle == PATIENCE):
            break
    if not changed:
        return base.select(*folds.columns)
    moved = F.broadcast(changes(changed))
    h = F.xxhash64(F.lit(seed), F.col(group), F.col(group).isNull())
    out = base.join(moved, h == F.col("_h"), "left").withColumn("fold", F.coalesce(F.col("_f") + 1, F.col("fold")).cast(folds.schema["fold"].dataType))
    return out.select(*folds.columns)
