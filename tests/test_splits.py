import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlake.operators import merge as mg
from spanlake.operators import ordering as od
from spanlake.operators import splits as sp


def ids(spark, n, extra=""):
    return spark.range(n).withColumnRenamed("id", "row_idx")


def test_hash_positions_are_dense_and_seeded(spark):
    df = ids(spark, 500).withColumn("g", F.when(F.col("row_idx") < 400, "hot").otherwise("cold"))
    pos = od.with_hash_position(df, ["row_idx"], 1, ["g"], total="n").collect()
    for g, n in (("hot", 400), ("cold", 100)):
        mine = [r for r in pos if r.g == g]
        assert sorted(r.pos for r in mine) == list(range(n)) and {r.n for r in mine} == {n}
    a = [r.row_idx for r in od.with_hash_position(df, ["row_idx"], 1).orderBy("pos").collect()]
    b = [r.row_idx for r in od.with_hash_position(df.repartition(7), ["row_idx"], 1).orderBy("pos").collect()]
    c = [r.row_idx for r in od.with_hash_position(df, ["row_idx"], 2).orderBy("pos").collect()]
    assert a == b and a != c and a != sorted(a)


def test_threshold_selects_the_first_in_hash_order(spark):
    df = ids(spark, 300)
    order = [r.row_idx for r in od.with_hash_position(df, ["row_idx"], 5).orderBy("pos").collect()]
    for n in (1, 37, 299, 300):
        got = {r.row_idx for r in sp.sample_rows(df, n, 5).collect()}
        assert got == set(order[:n])
    with pytest.raises(Exception, match="exceeds"):
        sp.sample_rows(df, 301).collect()
    with pytest.raises(ValueError):
        sp.sample_rows(df, 0)


def test_positions_and_running_totals(spark):
    df = ids(spark, 200).withColumn("v", F.col("row_idx") % 7)
    got = od.with_position(df, [F.desc("v"), F.col("row_idx")]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(200)) and [(r.v, r.row_idx) for r in got] == sorted(((r.v, r.row_idx) for r in got), key=lambda x: (-x[0], x[1]))
    counts = df.groupBy((F.col("row_idx") % 2).alias("g"), "v").agg(F.count(F.lit(1)).alias("c"))
    rows = od.running_totals(counts, ["g"], "v", ["c"]).collect()
    for r in rows:
        assert r.c_before == sum(x.c for x in rows if x.g == r.g and x.v < r.v) and r.c_total == 100


def test_keep_first_with_a_hot_key(spark):
    df = ids(spark, 300).withColumn("k", F.when(F.col("row_idx") % 3 == 0, F.lit(None)).otherwise((F.col("row_idx") % 50).cast("string")))
    rows = {r.row_idx for r in od.keep_first(df, ["k"]).collect()}
    seen, want = set(), set()
    for r in df.orderBy("row_idx").collect():
        if r.k not in seen:
            seen.add(r.k)
            want.add(r.row_idx)
    assert rows == want
    free = od.keep_first(df, ["k"], passthrough=F.col("k").isNull())
    assert free.filter("k is null").count() == 100


def test_lookup_join_beyond_the_broadcast_bound(spark):
    big = ids(spark, 400).withColumn("k", F.when(F.col("row_idx") < 300, 0).otherwise(F.col("row_idx") % 20))
    small = spark.range(15).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        a = sorted((r.row_idx, r.v) for r in od.lookup_join(big, small, ["k"], how).fillna(-1).collect())
        b = sorted((r.row_idx, r.v) for r in od.lookup_join(big, small, ["k"], how, salts=3).fillna(-1).collect())
        assert a == b and len(a) == (400 if how == "left" else sum(1 for r in big.collect() if r.k < 15))


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "row_idx long, text string")


def test_merge_keeps_supervised(spark):
    sup, pseudo = texts(spark, "same report", "", "Única"), texts(spark, "Same   REPORT", "", "new", "new ")
    out = mg.merge_training(sup, pseudo)
    assert Counter(r.training_source for r in out.collect()) == {"supervised": 3, "pseudolabel": 2}
    assert {r.training_source: (r.kept, r.dropped_duplicate) for r in mg.merge_counts([("supervised", sup), ("pseudolabel", pseudo)], out).collect()} == {
        "supervised": (3, 0), "pseudolabel": (2, 2)}
    assert mg.merge_training(sup, pseudo, dedupe=False).count() == 7
    assert [n for n, _ in mg.select_sources("pseudolabel_only", sup, pseudo)] == ["pseudolabel"]
    with pytest.raises(ValueError):
        mg.select_sources("x", sup, pseudo)
    acc = mg.accumulate([pseudo, sup]).filter("iteration = 2")
    assert sorted(r.text for r in acc.collect()) == ["", "Única"]


def test_dedupe_per_file(spark):
    df = spark.createDataFrame([(0, "a", "f1"), (1, "a", "f1"), (2, "a", "f2"), (3, None, "f2")], "row_idx long, text string, file string")
    assert mg.dedupe_exact(df, ["text"]).count() == 2 and mg.dedupe_exact(df, ["text"], per_file="file").count() == 3


def test_cross_set_leakage(spark):
    s = "row_idx long, text string, spans array<struct<start:int,label:string>>"
    train = spark.createDataFrame([(0, "a", [(1, "X")]), (1, "b", [])], s)
    test = spark.createDataFrame([(0, "a", [(1, "X")]), (1, "a", [(2, "X")]), (2, "a", [(1, "X")])], s)
    swapped = test.select("row_idx", F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"))).alias("spans"), "text")
    assert [r.row_idx for r in mg.drop_seen_in(swapped, train).collect()] == [1]
    assert mg.common_rows(test, train).head().common_rows == 1


def test_train_val(spark):
    df = ids(spark, 10)
    roles = {r.row_idx: r.role for r in sp.split_train_val(df, 0.25).collect()}
    assert Counter(roles.values()) == {"validation": 2, "train": 8}  # 2.5 rounds to even
    assert Counter(r.role for r in sp.split_train_val(ids(spark, 1), 0.2).collect()) == {"train": 1}
    assert sp.split_train_val(df.limit(0), 0.2).count() == 0


def test_refit_splits(spark):
    sup, pseudo = texts(spark, *[f"s{i}" for i in range(10)]), texts(spark, "p0", "p1", "s3")
    both = sp.refit_splits(sup, pseudo).collect()
    only = sp.refit_splits(sup, None, "supervised_only").collect()
    val = lambda rows: {r.text for r in rows if r.role == "validation"}
    assert val(both) == val(only) and len(val(both)) == 2 and all(r.training_source == "supervised" for r in both if r.role == "validation")
    assert sum(r.training_source == "pseudolabel" for r in both) == (3 if "s3" in val(both) else 2)
    p = sp.refit_splits(sup, pseudo, "pseudolabel_only").collect()
    assert Counter(r.role for r in p) == {"train": 2, "validation": 1}


def test_sampling(spark):
    df = ids(spark, 10)
    a = sorted(r.row_idx for r in sp.sample_pseudolabels(df, 0.5, seed=7).collect())
    assert len(a) == 5 and a == sorted(r.row_idx for r in sp.sample_pseudolabels(df, 0.5, seed=7).collect())
    capped = [r.row_idx for r in sp.sample_pseudolabels(df, 0.5, 2, seed=7).collect()]
    assert len(capped) == 2 and set(capped) <= set(a)
    assert sp.sample_pseudolabels(df, 0.01).count() == 1


def test_chunks(spark):
    df = ids(spark, 25)
    plain = sp.assign_chunks(df, 10).orderBy("row_idx").collect()
    assert [r.chunk_id for r in plain] == [1] * 10 + [2] * 10 + [3] * 5 and plain[0].chunk_name == "chunk_01"
    assert [r.chunk_id for r in sp.assign_chunks(df, 10, dense=True).orderBy("row_idx").collect()] == [r.chunk_id for r in plain]
    mixed = sp.assign_chunks(df, 10, shuffle=True, seed=3).collect()
    assert Counter(r.chunk_id for r in mixed) == {1: 10, 2: 10, 3: 5}
    assert {r.row_idx for r in mixed if r.chunk_id == 1} != set(range(10))
    assert sp.assign_chunks(ids(spark, 205), 2).agg(F.max("chunk_name")).head()[0] == "chunk_103"


def test_group_split_is_leak_free(spark):
    df = ids(spark, 100).withColumn("g", F.when(F.col("row_idx") < 40, 0).otherwise(F.col("row_idx") % 9))
    rows = sp.group_split(df, "g", 0.3).collect()
    roles = {}
    for r in rows:
        roles.setdefault(r.g, set()).add(r.role)
    assert all(len(v) == 1 for v in roles.values()) and sum("validation" in v for v in roles.values()) == math.ceil(9 * .3)
    single = sp.group_split(df.withColumn("g", F.lit(1)), "g", 0.25).collect()
    assert {r.row_idx for r in single if r.role == "validation"} == set(range(25))


def test_reshuffle(spark):
    tr, te = texts(spark, *"abcdefgh"), texts(spark, *"wxyz")
    a, b = sp.reshuffle_split(tr, te, 1).collect(), sp.reshuffle_split(tr, te, 1).collect()
    assert Counter(r.role for r in a) == {"train": 8, "test": 4} and sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert any(r.role != r.origin for r in a)


def test_calibration_split(spark):
    rows = [(i, [(0, 1, "A")] if i % 4 else [(0, 1, "A"), (0, 1, "B")] if i % 8 else []) for i in range(90)]
    df = spark.createDataFrame(rows, "row_idx long, spans array<struct<start:int,end:int,label:string>>")
    for mode in ("random", "heuristic"):
        c = Counter(r.role for r in sp.calibration_split(df, 0.25, mode=mode).collect())
        assert c["calibration"] == round(90 * .25)
    out = sp.calibration_split(df, 0.25, mode="heuristic").collect()
    for want in ({"A"}, {"A", "B"}, set()):
        mine = [r for r in out if {s.label for s in r.spans} == want]
        assert abs(sum(r.role == "calibration" for r in mine) - len(mine) * 22 / 90) < 1
    with pytest.raises(ValueError):
        sp.calibration_split(df, 1.0)


def groups(spark, spec):
    return spark.createDataFrame([(g, ls) for g, ls in spec], "sample_id string, labels array<string>")


def test_folds_balance(spark):
    df = groups(spark, [(f"g{i}", ["A"]) for i in (1, 2, 3)] + [(f"g{i}", ["B"]) for i in (4, 5, 6)] + [(f"g{i}", ["A", "B"]) for i in (7, 8, 9)])
    folds = sp.group_folds(df, "sample_id", 3)
    rep = sp.fold_report(folds).collect()
    assert {r.groups for r in rep} == {3} and all(r.groups_with_label >= 1 for r in rep)
    placed = sp.assign_folds(df, folds, "sample_id")
    pairs = sp.fold_pairs(placed, 3, ["sample_id"])
    assert pairs.count() == 27 and pairs.filter("role = 'test'").count() == 9
    assert sp.fold_cost(folds, 3).head().cost < 3


def test_folds_never_empty_and_rare_labels_spread(spark):
    uneven = groups(spark, [("g1", ["Location"] * 10), ("g2", ["Location"] * 8), ("g3", ["Location"] * 6), ("g4", ["Organization"] * 4), ("g5", ["Organization"] * 2), ("g6", ["Person"])])
    rep = sp.fold_report(sp.group_folds(uneven, "sample_id", 3)).select("fold", "groups").distinct().collect()
    assert len(rep) == 3 and max(r.groups for r in rep) - min(r.groups for r in rep) <= 1
    rare = groups(spark, [(f"g{i}", ["A"]) for i in range(6)] + [(f"r{i}", ["B"] * 5) for i in range(3)])
    assert all(r.label_spans >= 5 for r in sp.fold_report(sp.group_folds(rare, "sample_id", 3)).filter("label = 'B'").collect())
    with pytest.raises(ValueError):
        sp.group_folds(rare.limit(2), "sample_id", 3)
    assert sp.fold_count(rare.limit(2), "sample_id", 5) == 2
    with pytest.raises(ValueError):
        sp.fold_count(rare.limit(1), "sample_id", 5)


def test_fold_cost_beats_plain_hashing(spark):
    rng = __import__("random").Random(1)
    spec = [(f"g{i}", [rng.choice("AAAAAABBBC") for _ in range(rng.randint(0, 6))]) for i in range(60)]
    df = groups(spark, spec)
    ours = sp.group_folds(df, "sample_id", 5)
    hashed = sp.group_profiles(df, "sample_id").withColumn("fold", F.expr("int(pmod(xxhash64(sample_id), 5)) + 1"))
    assert sp.fold_cost(ours, 5).head().cost < sp.fold_cost(hashed, 5).head().cost


def test_weights_and_resample(spark):
    df = spark.createDataFrame([(0, ["A", "A"]), (1, ["A", "B"]), (2, [])], "row_idx long, labels array<string>")
    w = {r.row_idx: r.weight for r in sp.sampling_weights(df).collect()}
    assert w == pytest.approx({0: 1 / 3, 1: 1 / 3 + 1, 2: 1.0})
    many = ids(spark, 50).withColumn("weight", F.when(F.col("row_idx") == 7, 50.0).otherwise(1.0))
    draws = sp.weighted_resample(many, 4000, seed=3, buckets=16).collect()
    c = Counter(r.row_idx for r in draws)
    assert len({r.draw for r in draws}) == 4000 and None not in c and 1800 < c[7] < 2250 and len(c) > 45
    # against the plain definition
    order = od.with_hash_position(many, ["row_idx"], 3).orderBy("pos").collect()
    edges, at = [], 0.0
    for r in order:
        edges.append((at / 99.0, r.row_idx))
        at += r.weight
    shots = {r.id: r.u for r in spark.range(4000).select("id", sp.hashed_uniform(F.col("id"), 3).alias("u")).collect()}
    import bisect
    keys = [e[0] for e in edges]
    assert all(r.row_idx == edges[bisect.bisect_right(keys, shots[r.draw]) - 1][1] for r in draws)
    assert sp.weighted_resample(many, None, buckets=3).count() == 50


def test_batches(spark):
    ts = "array<struct<start_tok:int,end_tok:int,label:string>>"
    mk = lambda pos, neg: spark.createDataFrame([(i, [(0, 0, "P")] if i < pos else []) for i in range(pos + neg)], f"row_idx long, ner {ts}")
    out = sp.assign_batches(mk(2, 3), 2).collect()
    by = {}
    for r in out:
        by.setdefault(r.batch, []).append(bool(r.ner))
    assert len(by) == 2 and all(any(v) and len(v) <= 2 for v in by.values())
    one = sp.assign_batches(mk(1, 10), 2).collect()
    assert Counter(r.batch for r in one) == {0: 2}
    big = sp.assign_batches(mk(37, 90), 8).collect()
    sizes = Counter(r.batch for r in big)
    assert len(big) == 127 and max(sizes.values()) <= 8 and all(any(r.ner for r in big if r.batch == b) for b in sizes)
    with pytest.raises(Exception, match="at least one record"):
        sp.assign_batches(mk(0, 3), 2).collect()


def test_missing_groups_and_labels_stay(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 5}", [None, "A"] if i % 3 else ["B"]) for i in range(40)]
    df = spark.createDataFrame(rows, "row_idx long, g string, labels array<string>")
    folds = sp.group_folds(df, "g", 3)
    placed = sp.assign_folds(df, folds, "g").collect()
    assert len(placed) == 40 and len({r.fold for r in placed if r.g is None}) == 1
    assert sum(r.examples for r in folds.collect()) == 40
    with pytest.raises(Exception, match="no fold for group"):
        sp.assign_folds(df, folds.filter("g is not null"), "g").collect()
    weights = {r.row_idx: r.weight for r in sp.sampling_weights(df).collect()}
    n_a = sum(1 for r in rows if "A" in r[2])
    assert weights[1] == pytest.approx(2 / n_a) and weights[0] == pytest.approx(1 / (40 - n_a))
    numbered = od.with_hash_position(df, ["row_idx"], groups=["g"], name="p").collect()
    for g in {r.g for r in numbered}:
        assert sorted(r.p for r in numbered if r.g == g) == list(range(sum(r.g == g for r in numbered)))
    totals = od.running_totals(df.groupBy("g", "row_idx").count(), ["g"], "row_idx", ["count"]).collect()
    assert len(totals) == 40 and {r.count_total for r in totals if r.g is None} == {10}
