import json

import numpy as np
import pytest
from conftest import ENT, ent
from pyspark.sql import functions as F

from spanlake.operators import calibrate as c
from spanlake.operators.ordering import group_quantiles


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(0.02, 0.98, 600), 3)
    y = (rng.uniform(size=600) < p ** 1.7).astype(int)
    label = np.where(np.arange(600) % 3 == 0, "Person", "Location")
    rows = [(i, float(a), int(b), str(l)) for i, (a, b, l) in enumerate(zip(p, y, label))] + [(600, 0.4, 1, "Organization"), (601, 0.6, 1, "Organization")]
    return spark.createDataFrame(rows, "row_idx long, score double, target int, label string").cache(), rows


def np_fit(rows):
    p, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    p = np.clip(p, 1e-6, 1 - 1e-6)
    z = np.log(p / (1 - p))
    best = None
    for t in np.linspace(0.5, 5, 181):
        q = np.clip(1 / (1 + np.exp(-z / t)), 1e-6, 1 - 1e-6)
        loss = -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))
        if best is None or loss < best[1]:
            best = (t, loss)
    return best


def test_temperature_matches_numpy(data):
    df, rows = data
    got, want = c.fit_temperature(df).head(), np_fit(rows)
    assert got.temperature == pytest.approx(want[0]) and got.fit_loss == pytest.approx(want[1]) and got.support == 602
    assert c.fit_temperature(df.filter("target = 1")).count() == 0


def test_per_class_and_fallback(data):
    df, rows = data
    got = {r.label: r for r in c.fit_temperature_per_class(df).collect()}
    for label in ("Person", "Location"):
        assert got[label].temperature == pytest.approx(np_fit([r for r in rows if r[3] == label])[0]) and got[label].source == "per-class"
    assert got["Organization"].source == "global-fallback" and got["Organization"].temperature == pytest.approx(np_fit(rows)[0])
    assert got["Organization"].fit_loss is None and got["Organization"].support == 2
    plain = {r.label: r for r in c.fit_temperature_per_class(df, fallback=False).collect()}
    assert plain["Organization"].source == "identity" and plain["Organization"].temperature is None


def pav(rows):
    xs = sorted({r[1] for r in rows})
    blocks = []
    for x in xs:
        ys = [r[2] for r in rows if r[1] == x]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, m = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][2] += m
    return {x: s / n for s, n, m in blocks for x in m}


def test_isotonic_matches_brute_force(spark, data):
    df, rows = data
    cal = c.fit_calibrator(df, "isotonic")
    want = pav(rows)
    got = df.select("score", cal.column(F.col("score"), F.lit("")).alias("v")).collect()
    assert max(abs(want[r.score] - r.v) for r in got) < 1e-9
    probe = spark.createDataFrame([(0.0001,), (0.5005,), (0.99999,), (None,)], "s double").select(c.interpolate(F.col("s"), *cal.knots).alias("v")).collect()
    assert [p.v for p in probe[:3]] == pytest.approx([float(np.interp(x, *cal.knots)) for x in (0.0001, 0.5005, 0.99999)]) and probe[3].v is None
    xs = list(np.linspace(0, 1, 4101))
    wide = spark.createDataFrame([(0.123456,)], "s double").select(c.interpolate(F.col("s"), xs, [x * x for x in xs]).alias("v")).head().v
    assert wide == pytest.approx(0.123456 ** 2, abs=1e-6)
    with pytest.raises(ValueError):
        c.fit_isotonic(df.filter("target = 1"))


def test_calibrator_json_and_apply(spark):
    cal = c.Calibrator("temperature-per-class", per_class={"Person": {"temperature": 2.0}, "Location": {"temperature": None}}, fallback=None)
    again = c.Calibrator.from_json(cal.to_json())
    assert json.loads(again.to_json())["parameters"]["per_class_temperature"]["Person"]["temperature"] == 2.0
    df = spark.createDataFrame([([ent("Person", score=.9), ent("Location", score=1.0), ent("Person"), ent("X", score=.3, original=.1)],)], f"entities {ENT}")
    e = c.apply_calibrator(df, again).head().entities
    assert [round(x.score_calibrated, 6) if x.score_calibrated is not None else None for x in e] == [0.75, 0.999999, None, 0.3]
    assert [x.score_original for x in e] == [0.9, 1.0, None, 0.1]
    for method in ("temperature", "isotonic"):
        assert c.Calibrator.from_json(c.Calibrator(method, temperature=1.5, knots=((0.0, 1.0), (0.2, 0.8))).to_json()).method == method


def test_bins_ece_brier_nll_auc(spark):
    rows = [(0.1, 0), (0.1, 1), (0.3, 0), (0.30000000000000004, 1), (0.95, 1), (0.0, 0), (1.0, 1)]
    df = spark.createDataFrame(rows, "score double, target int")
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    ids = np.digitize(s, np.linspace(0, 1, 11)[1:-1], right=True)
    got = {r.bin: r for r in c.reliability_bins(df).collect()}
    assert len(got) == 10
    for b in range(10):
        assert got[b]["count"] == int((ids == b).sum())
        assert (got[b].conf_mean is None) == (got[b]["count"] == 0)
    gaps = [(abs(y[ids == b].mean() - s[ids == b].mean()), (ids == b).sum()) for b in set(ids)]
    m = c.ece_mce(c.reliability_bins(df)).head()
    assert m.ece == pytest.approx(sum(g * n for g, n in gaps) / len(rows)) and m.mce == pytest.approx(max(g for g, _ in gaps))
    a = df.agg(c.brier(F.col("score"), F.col("target")).alias("b"), c.nll(F.col("score"), F.col("target")).alias("n")).head()
    q = np.clip(s, 1e-12, 1 - 1e-12)
    assert a.b == pytest.approx(np.mean((s - y) ** 2)) and a.n == pytest.approx(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
    pairs = [(p > n) + (p == n) / 2 for p in s[y == 1] for n in s[y == 0]]
    assert c.auc(df).head().auc == pytest.approx(np.mean(pairs))
    assert c.auc(df.filter("target = 1")).head().auc is None


def test_quantiles_exact_with_hot_values(spark):
    rng = np.random.default_rng(2)
    vals = {"a": list(rng.uniform(size=101)) + [0.5] * 200, "b": [1.0], "c": [0.0, 1.0]}
    df = spark.createDataFrame([(g, float(v)) for g, vs in vals.items() for v in vs], "g string, v double")
    got = {(r.g, r.prob): r.quantile for r in group_quantiles(df, ["g"], "v", [0.0, 0.25, 0.3, 0.5, 1.0]).collect()}
    assert got == pytest.approx({(g, p): float(np.percentile(vs, 100 * p)) for g, vs in vals.items() for p in (0.0, 0.25, 0.3, 0.5, 1.0)})


def test_pseudo_targets(data):
    df, rows = data
    assert c.pseudo_targets(df, threshold=0.9).filter("target = 1").count() == sum(r[1] >= 0.9 for r in rows)
    lo, hi = np.percentile([r[1] for r in rows], [30, 70])
    got = c.pseudo_targets(df.drop("target"), "quantile-bands").collect()
    assert len(got) == sum(r[1] <= lo or r[1] >= hi for r in rows) and sum(g.target for g in got) == sum(r[1] >= hi for r in rows)


def test_pairs(spark):
    pred = spark.createDataFrame([(0, 0, 4, "P", "John", .9), (0, 8, 11, "L", "Rio", .5)], "row_idx long, start int, end int, label string, text string, score double")
    gold = spark.createDataFrame([(0, 0, 4, "P", "John"), (0, 0, 4, "P", "John")], "row_idx long, start int, end int, label string, text string")
    rows = c.calibration_pairs(pred, gold).orderBy("Start").collect()
    assert [(r.RowId, r.Validacao, r.Entidade_Referencia, r.Entidade_Predita) for r in rows] == [(1, 1, "John", "John"), (1, 0, "", "Rio")]


def test_evaluate_and_audit(spark):
    df = spark.createDataFrame([("Organization", 0, .9), ("Organization", 0, .95), ("Person", 1, .8), ("Person", 0, .1)], "label string, target int, score double")
    cal = c.Calibrator("temperature", temperature=4.0)
    rows = {(r.scope, r.label, r.scores): r for r in c.evaluate_calibrator(df, cal).collect()}
    assert len(rows) == 6 and rows["overall", "*", "raw"].rows == 4 and rows["label", "Person", "raw"].brier == pytest.approx((.04 + .01) / 2)
    audit = {(r.label, r.scores, r.target): r for r in c.audit_by_label(df, 0.8, cal).collect()}
    assert audit["Organization", "raw", 0].share_ge_threshold == 1.0 and audit["Organization", "calibrated", 0].share_ge_threshold == 0.0
    assert audit["Organization", "raw", 0].p50 == pytest.approx(0.925) and audit["*", "raw", 1]["count"] == 1


def test_cross_validation(spark, data):
    df, rows = data
    scored = c.cv_scores(df, "row_idx", k=4).cache()
    assert scored.groupBy("method").count().collect()[0]["count"] == 602
    sizes = [r["count"] for r in scored.filter("method = 'raw'").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 4
    summary = {(r.method, r.metric): r for r in c.cv_summary(scored).collect()}
    assert len(summary) == 15 and all(r.n_folds == 4 for r in summary.values())
    assert summary["isotonic", "auc"].mean > 0.7 and summary["raw", "auc"].mean == summary["temperature", "auc"].mean
    assert sum(r["count"] for r in c.cv_reliability(scored).filter("method = 'raw'").collect()) == 602
    # the temperature of a fold is the one fitted on the other folds
    from spanlake.operators.ordering import with_hash_position
    folded = with_hash_position(df, ["row_idx"], 42, name="p").withColumn("fold", F.expr("int(p % 4)")).collect()
    want = np_fit([(r.row_idx, r.score, r.target, r.label) for r in folded if r.fold != 2])[0]
    some = [r for r in folded if r.fold == 2][:3]
    expected = sorted(1 / (1 + np.exp(-np.log(r.score / (1 - r.score)) / want)) for r in folded if r.fold == 2)
    got = sorted(r.score for r in scored.filter("method = 'temperature' and fold = 2").collect())
    assert some and got == pytest.approx(expected)


def test_calibrate_corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [ent("Person" if j else "Location", score=float(rng.uniform())) for j in range(2)]) for i in range(100)]
    df = spark.createDataFrame(rows, f"row_idx long, entities {ENT}")
    out, stats, cal = c.calibrate_corpus(df, "temperature-per-class", threshold=0.6)
    s = stats.head()
    assert s.fit_rows == 200 and s.brier_after < s.brier_before and set(cal.per_class) == {"Person", "Location"}
    assert out.filter(F.exists("entities", lambda e: e["score_calibrated"].isNull())).count() == 0


def test_missing_labels_are_measured(spark):
    rows = [(i, (i * 37 % 100) / 100 + 0.003, int(i * 37 % 100 > 40 + i % 30), [None, "Person"][i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "row_idx long, score double, target int, label string")
    cal = c.Calibrator("temperature", temperature=1.5)
    measured = c.evaluate_calibrator(df, cal).filter("scope = 'label'").collect()
    assert {(r.label, r.scores, r.rows) for r in measured} == {(x, s, 100) for x in (None, "Person") for s in ("raw", "calibrated")}
    mine = [(s, t) for _, s, t, x in rows if x is None]
    raw = next(r for r in measured if r.label is None and r.scores == "raw")
    assert raw.brier == pytest.approx(sum((s - t) ** 2 for s, t in mine) / 100)
    audit = c.audit_by_label(df, 0.8).filter("scope = 'label'").collect()
    assert sum(r["count"] for r in audit) == 200 and {r.label for r in audit} == {None, "Person"}
    aucs = {r.label: r.auc for r in c.auc(df, ["label"]).collect()}
    wins = [(a > b) + (a == b) / 2 for a, t in mine if t for b, u in mine if not u]
    assert aucs[None] == pytest.approx(sum(wins) / len(wins))
    fitted = {r.label: r for r in c.fit_temperature_per_class(df).collect()}
    assert set(fitted) == {None, "Person"} and fitted[None].support == 100


def test_pairs_inside_a_record_equal_joined_pairs(spark, make_ent):
    span = "array<struct<start:int,end:int,label:string,text:string,score:double>>"
    gold = [(0, 3, "A", "abc", None), (0, 3, "A", "abb", None), (4, 5, "B", "x", None)]
    pred = [(0, 3, "A", "p1", 0.5), (0, 3, "A", "p2", None), (4, 5, "A", "p3", 0.1), (7, 9, "B", "p4", 0.2)]
    df = spark.createDataFrame([(0, gold, pred), (1, [], pred), (2, gold, []), (3, None, pred[:1]), (4, gold, None)], f"row_idx long, gold {span}, pred {span}")
    long = lambda c_: df.select("row_idx", F.explode(c_).alias("e")).select("row_idx", "e.*")
    inside = sorted(map(tuple, c.calibration_pairs_in_records(df).collect()))
    assert inside == sorted(map(tuple, c.calibration_pairs(long("pred"), long("gold")).collect())) and len(inside) == 9
    assert ("abb", 1) in {(r[2], r[7]) for r in inside}


def test_isotonic_stacks_merge_in_rounds(spark):
    """Many range partitions, merged two by two: the knots of one stack over all scores."""
    import random
    rng = random.Random(6)
    rows = [(round(rng.random(), 4), int(rng.random() < 0.4 + 0.2 * rng.random()), rng.randrange(3)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "score double, target int, fold int")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = c.isotonic_blocks(df, 3, fan=2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for f in range(3):
        sums = {}
        for s, t, fold in rows:
            if fold != f:
                y, w = sums.get(s, (0, 0))
                sums[s] = (y + t, w + 1)
        stack = []
        for s in sorted(sums):
            c._pool(stack, s, s, *sums[s])
        assert sorted([r.lo, r.hi, r.y, r.w] for r in got if r.fold == f) == stack
