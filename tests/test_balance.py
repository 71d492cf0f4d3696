import random
from itertools import combinations

import pytest

from spanlake.operators import balance
from spanlake.operators.balance import FoldTotals, balance_folds
from spanlake.operators.splits import fold_cost, group_folds

LABELS = ["A", "B", "C", "D"]


def records(spark, seed, n, groups, names=LABELS):
    rng = random.Random(seed)
    shares = [rng.paretovariate(1.2) for _ in range(groups)]
    rows = []
    for i in range(n):
        g = i if i < groups else rng.choices(range(groups), shares)[0]
        rows.append((i, None if g == 0 else f"g{g}", [x for j, x in enumerate(names) for _ in range(rng.choice((0, 0, j % 3)))]))
    return spark.createDataFrame(rows, "row_idx long, g string, labels array<string>")


def profiles(folds):
    names = sorted({x for r in folds for x in r["counts"]})
    return {r["g"]: [1.0, r["examples"], *[float(x in r["counts"]) for x in names], *[float(r["counts"].get(x, 0)) for x in names]] for r in folds}, len(names)


def plain_search(vectors, n_labels, k):
    """Put the largest groups first where they cost least, then take the best of all moves and swaps until none pays."""
    place, limit = {}, -(-len(vectors) // k)
    zero = [0.0] * (2 + 2 * n_labels)
    whole = FoldTotals([[x / k for x in map(sum, zip(*vectors.values()))] for _ in range(k)], n_labels)
    whole.totals = [list(zero) for _ in range(k)]
    cost_with = lambda f, v: whole._of([a + b for a, b in zip(whole.totals[f], v)]) - whole._of(whole.totals[f])
    for g, v in sorted(vectors.items(), key=lambda kv: (-kv[1][1], repr(kv[0]))):
        f = min((f for f in range(k) if whole.totals[f][0] < limit), key=lambda f: (cost_with(f, v), whole.totals[f][0]))
        place[g] = f
        whole.totals[f] = [a + b for a, b in zip(whole.totals[f], v)]
    for _ in range(300):
        options = [(whole.gain(place[a], place[b], [x - y for x, y in zip(vectors[a], vectors[b])]), a, b) for a, b in combinations(vectors, 2) if place[a] != place[b]]
        options += [(whole.gain(place[a], f, vectors[a]), a, f) for a in vectors for f in range(k) if whole.totals[place[a]][0] > whole.totals[f][0]]
        gain, a, b = min(options, key=lambda o: o[0])
        if gain >= -1e-12:
            break
        if b in vectors:
            whole.move(place[a], place[b], [x - y for x, y in zip(vectors[a], vectors[b])])
            place[a], place[b] = place[b], place[a]
        else:
            whole.move(place[a], b, vectors[a])
            place[a] = b
    return whole.cost()


@pytest.mark.parametrize("seed, n, groups, k", [(1, 200, 24, 4), (2, 150, 40, 5), (3, 60, 7, 3)])
def test_no_worse_than_a_plain_search(spark, seed, n, groups, k):
    dealt = group_folds(records(spark, seed, n, groups), "g", k)
    better = balance_folds(dealt, "g", k)
    before, after = (df.collect() for df in (dealt, better))
    assert better.dtypes == dealt.dtypes
    key = lambda r: (r["g"] or "", r["examples"], r["spans"])
    assert sorted(map(key, before)) == sorted(map(key, after))
    sizes = [sum(r["fold"] == f for r in after) for f in range(1, k + 1)]
    assert max(sizes) - min(sizes) <= 1 and min(sizes) > 0
    costs = [fold_cost(df, k).first()["cost"] for df in (dealt, better)]
    vectors, n_labels = profiles(after)
    assert costs[1] <= costs[0] and costs[1] <= 1.05 * plain_search(vectors, n_labels, k) + 1e-9


def test_buckets_and_repeats(spark):
    """Above the bound groups meet in buckets only; the cost still falls, and the same seed gives the same folds."""
    dealt = group_folds(records(spark, 5, 3000, 400), "g", 4)
    runs = [balance_folds(dealt, "g", 4, all_pairs=20, bucket=6, rounds=8) for _ in range(2)]
    costs = [fold_cost(df, 4).first()["cost"] for df in (dealt, *runs)]
    assert costs[1] < costs[0] / 2
    a, b = ({(r["g"], r["fold"]) for r in df.collect()} for df in runs)
    assert a == b


def test_cost_of_totals_is_the_fold_cost(spark):
    folds = group_folds(records(spark, 7, 90, 12), "g", 3)
    vectors, n_labels = profiles(folds.collect())
    totals = [[sum(x) for x in zip(*[vectors[r["g"]] for r in folds.collect() if r["fold"] == f])] for f in (1, 2, 3)]
    assert FoldTotals(totals, n_labels).cost() == pytest.approx(fold_cost(folds, 3).first()["cost"])


def test_groups_without_labels(spark):
    folds = group_folds(records(spark, 2, 30, 8, []), "g", 2)
    out = balance_folds(folds, "g", 2)
    assert out.count() == 8 and fold_cost(out, 2).first()["cost"] <= fold_cost(folds, 2).first()["cost"]


def test_folds_read_the_records_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = records(spark, 4, 90, 12)
    out = group_folds(df.mapInArrow(count, df.schema), "g", 3)
    assert seen.value == 90
    want = {}
    for r in df.collect():
        n, found = want.get(r.g, (0, {}))
        want[r.g] = n + 1, {x: found.get(x, 0) + r.labels.count(x) for x in {*found, *r.labels}}
    assert {r.g: (r.examples, r.counts) for r in out.collect()} == want


@pytest.mark.parametrize("take, names", [(3, 2), (1000, 2), (7, 0)])
def test_best_changes_of_buckets(monkeypatch, take, names):
    """All pairs of a bucket and all moves to smaller folds, a few pairs at a time, whatever the batches."""
    import pyarrow as pa
    monkeypatch.setattr(balance, "PAIRS", 11)
    rng = random.Random(take + names)
    rows = sorted([(rng.randrange(3), [1.0, float(rng.randint(1, 9)), *[float(rng.random() < 0.3) for _ in range(2 * names)]], rng.getrandbits(40), b) for b in (0, 0, 3, 7) for _ in range(9)], key=lambda r: r[3])
    totals = FoldTotals([[sum(r[1][i] for r in rows if r[0] == f) for i in range(2 + 2 * names)] for f in range(3)], names)
    options = [(totals.gain(a[0], b[0], [x - y for x, y in zip(a[1], b[1])]), a[0], b[0], a[2], b[2]) for a in rows for b in rows if a[3] == b[3] and a[0] < b[0]]
    options += [(totals.gain(r[0], f, r[1]), r[0], f, r[2], None) for r in rows for f in range(3) if totals.totals[r[0]][0] > totals.totals[f][0]]
    want = sorted((o for o in options if o[0] < -balance.LEAST), key=lambda o: (o[0], o[3], o[4] or 0, o[2]))[:take]
    kind = pa.schema([("f", pa.int32()), ("v", pa.list_(pa.float64())), ("h", pa.int64()), ("b", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip("fvhb", r)) for r in rows[i:i + 5]], kind) for i in range(0, len(rows), 5)]
    (got,) = balance._best_changes(iter(batches), totals, take)
    vectors = {r[2]: r[1] for r in rows}
    found = got.to_pylist()
    assert len(found) == len(want) > 0
    assert sorted(r["gain"] for r in found) == pytest.approx([o[0] for o in want], abs=1e-9)
    for r in found:
        assert r["moved"] == [x - y for x, y in zip(vectors[r["h"]], vectors[r["i"]] if r["i"] is not None else [0.0] * 9)]
        assert totals.gain(r["source"], r["target"], r["moved"]) == pytest.approx(r["gain"], abs=1e-9)
    assert list(balance._best_changes(iter([]), totals, take))[0].num_rows == 0
