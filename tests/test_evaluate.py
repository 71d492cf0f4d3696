import pytest
from pyspark.sql import functions as F

from spanlake.operators import evaluate as ev

LONG = "row_idx long, start int, end int, label string"


def spans(spark, *rows, score=False):
    return spark.createDataFrame(list(rows), LONG + (", score double" if score else ""))


def table(df):
    return {r.label: r for r in df.collect()}


def test_equal_and_disjoint(spark):
    g = spans(spark, (0, 0, 4, "Person"), (0, 0, 4, "Person"), (1, 8, 11, "Location"))
    m = table(ev.span_metrics(g, g, ["Person", "Location"]))
    assert m["micro"].f1 == m["macro"].f1 == 1.0 and m["Person"].support == 1
    other = spans(spark, (0, 1, 4, "Person"))
    m = table(ev.span_metrics(g.limit(1), other, ["Person"]))
    assert (m["micro"].f1, m["Person"].fp, m["Person"].fn) == (0.0, 1, 1)


def test_macro_counts_requested_labels_without_spans(spark):
    g = spans(spark, (0, 0, 4, "Person"))
    m = table(ev.span_metrics(g, g, ["Person", "Organization"]))
    assert m["macro"].f1 == 0.5 and m["Organization"].f1 == 0.0 and m["Organization"].support == 0
    assert ev.macro_f1(g, g, ["Person", "Organization"]).head().macro_f1 == 0.5


def test_micro_and_membership(spark):
    empty = spans(spark, (0, 0, 1, "P")).limit(0)
    one, two = spans(spark, (0, 0, 1, "P")), spans(spark, (0, 0, 1, "P"), (0, 5, 6, "P"))
    assert ev.micro_f1(empty, empty).head().micro_f1 == 1.0 and ev.micro_f1(one, empty).head().micro_f1 == 0.0
    assert ev.micro_f1(one, two).head().micro_f1 == pytest.approx(2 / 3)
    assert ev.membership_f1(one, one).head().membership_f1 == 1.0 and ev.membership_f1(empty, empty).head().membership_f1 == 1.0
    assert ev.membership_f1(one, two).head().membership_f1 == pytest.approx((2 / 3) / 2)


def brute_sweep(gold, pred, labels, grid):
    out = {}
    for label in labels:
        best_t, best = 0.5, 0.0
        for t in grid:
            g = {x for x in gold if x[3] == label}
            p = {x[:4] for x in pred if x[3] == label and (x[4] is None or x[4] >= t)}
            tp, fp, fn = len(g & p), len(p - g), len(g - p)
            pr, rc = (tp / (tp + fp) if tp + fp else 0.0), (tp / (tp + fn) if tp + fn else 0.0)
            f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
            if f1 > best:
                best_t, best = t, f1
        out[label] = (best_t, best)
    return out


def test_threshold_sweep_against_loop(spark):
    rng = __import__("random").Random(9)
    gold = [(r, s, s + 3, rng.choice("AB")) for r in range(20) for s in range(0, 30, 5)]
    pred = [(*g, round(rng.random(), 2)) if rng.random() < .7 else (g[0], g[1] + 1, g[2], g[3], round(rng.random(), 2)) for g in gold]
    pred += [(*pred[0][:4], 0.99), (*gold[3], None)]
    grid = [round(i * 0.05, 2) for i in range(21)]
    got = {r.label: (r.best_threshold, r.best_f1) for r in ev.threshold_sweep(spans(spark, *gold), spans(spark, *pred, score=True), ["A", "B", "C"]).collect()}
    want = brute_sweep(gold, pred, "ABC", grid)
    for label in "ABC":
        assert got[label] == pytest.approx(want[label])


def test_outcomes_with_thresholds(spark):
    g = spans(spark, (0, 0, 4, "A"), (0, 5, 6, "B"))
    p = spans(spark, (0, 0, 4, "A", .4), (0, 5, 6, "B", .4), (0, 9, 10, "B", None), score=True)
    t = table(ev.count_outcomes(g, p, {"A": 0.3}))
    assert (t["A"].tp, t["B"].tp, t["B"].fp, t["B"].fn) == (1, 0, 1, 1)
    s = ev.outcome_summary(ev.count_outcomes(g, p, {"A": 0.3}), ["A", "B", "C"]).head()
    assert s.accuracy == pytest.approx(1 / 3) and s.macro_f1 == 0.5
    assert table(ev.count_outcomes(g, p, 0.4))["B"].tp == 1


def test_seen_unseen(spark):
    train = spark.createDataFrame([(["Rio", "de", "Janeiro"], [(0, 2, "L"), (0, 9, "L")])], "tokenized_text array<string>, ner array<struct<start_tok:int,end_tok:int,label:string>>")
    keys = ev.training_surfaces(train)
    assert [tuple(r) for r in keys.collect()] == [("L", "rio de janeiro")]
    sp = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([(0, "RIO  de Janeiro e Ana", [(0, 15, "L"), (18, 21, "P"), (18, 99, "P")], [(0, 15, "L"), (0, 3, "L")])], f"row_idx long, text string, gold {sp}, pred {sp}")
    g, p = ev.span_surfaces(df, "gold"), ev.span_surfaces(df, "pred")
    assert ev.mark_seen(g, keys).filter("seen").count() == 1
    parts = {r.part: r for r in ev.seen_unseen_f1(g, p, keys).collect()}
    assert parts["seen"].f1 == 1.0 and parts["seen"].gold_support == 1
    assert parts["unseen"].f1 == 0.0 and parts["unseen"].gold_support == 2
    none = ev.seen_unseen_f1(g.limit(0), p.limit(0), keys).collect()
    assert all(r.f1 is None and r.gold_support == 0 for r in none)


def test_review_worst_first(spark):
    g = spans(spark, (0, 0, 4, "A"), (1, 0, 4, "A"), (2, 0, 1, "A"))
    p = spans(spark, (0, 0, 4, "A"), (1, 1, 4, "A"))
    records = spark.createDataFrame([(i,) for i in range(4)], "row_idx long")
    rows = ev.review_rows(g, p, records=records).collect()
    assert [(r.row_idx, r.error_count) for r in rows] == [(1, 2), (2, 1), (0, 0), (3, 0)]
    s = ev.review_summary(ev.review_rows(g, p, records=records)).head()
    assert (s.records, s.avg_errors_per_record, s.max_errors_in_record) == (4, 0.75, 2)


def test_compare_metrics_and_fold_summary(spark):
    cols = "label string, precision double, recall double, f1 double, support long"
    a = spark.createDataFrame([("A", .5, .5, .5, 4), ("micro", None, None, .40, None)], cols)
    b = spark.createDataFrame([("B", .2, .2, .2, 3), ("micro", None, None, .45, None)], cols)
    rows = {(r.label, r.metric): r for r in ev.compare_metrics(a, b).collect()}
    assert rows["micro", "f1"].delta == pytest.approx(.05) and rows["A", "f1"].delta == -.5 and rows["B", "recall"].base is None
    assert rows["A", "support"].delta is None and ("micro", "precision") not in rows
    f = spark.createDataFrame([(.2, .1, None), (.4, None, None), (None, .3, None)], "test_f1 double, seen_f1 double, unseen_f1 double")
    s = ev.fold_summary(f).head()
    assert (s.mean_test_f1, s.std_test_f1, s.mean_seen_entity_test_f1, s.mean_unseen_entity_test_f1) == (pytest.approx(.3), pytest.approx(.1), .2, None)
    t = spark.createDataFrame([(.3, .5), (.3, .7), (.5, .6), (.7, .1)], "threshold double, f1 double")
    assert tuple(ev.best_threshold(t).head()) == (.3, .6)


def test_match_in_records_equals_match_spans(spark):
    rng = __import__("random").Random(21)
    mk = lambda: [(a, a + rng.randint(1, 2), rng.choice("AB")) for a in (rng.randint(0, 8) for _ in range(rng.randint(0, 12)))]
    rows = [(i, mk(), [(*s, round(rng.random(), 2) if rng.random() < .9 else None) for s in mk()]) for i in range(40)] + [(40, None, None)]
    df = spark.createDataFrame(rows, "row_idx long, gold array<struct<start:int,end:int,label:string>>, pred array<struct<start:int,end:int,label:string,score:double>>")
    inside = sorted(tuple(r) for r in ev.match_in_records(df, "gold", "pred").collect())
    long = sorted(tuple(r) for r in ev.match_spans(ev.long_spans(df, "gold"), ev.long_spans(df, "pred")).collect())
    assert inside == long
    best = {tuple(r)[:4]: r.score for r in ev.match_in_records(df, "gold", "pred", score=True).collect()}
    for i, _, pred in rows[:-1]:
        for key in {p[:3] for p in pred}:
            known = [p[3] for p in pred if p[:3] == key]
            assert best[(i, *key)] == (None if None in known else max(known))


def test_different_records_are_an_error(spark):
    one = spark.createDataFrame([(0,), (1,), (None,)], "row_idx long")
    ev.require_same_records(one, one)
    with pytest.raises(ValueError, match="row_idx=1 .gold only., row_idx=2 .predictions only."):
        ev.require_same_records(one, spark.createDataFrame([(0,), (2,), (None,)], "row_idx long"))
