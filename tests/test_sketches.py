import random

import pytest
from conftest import ENT, ent
from pyspark.sql import functions as F

from spanlake.operators import calibrate as c
from spanlake.operators import sketches as sk


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        ents = [ent(rng.choice(["Person", "Person", "Location", None]), "x", score=rng.choice([rng.random(), rng.random(), None])) for _ in range(rng.randint(0, 3))]
        rows.append((i, rng.choice([f"text {rng.randrange(900)}", f"text {rng.randrange(900)}", "  ", None]), rng.choice(["a", "b", None]), ents))
    return spark.createDataFrame(rows, f"row_idx long, text string, source string, entities {ENT}")


def exact(df):
    rows = df.collect()
    scores = sorted(e.score for r in rows for e in r.entities if e.score is not None)
    labels = [e.label or "UNKNOWN" for r in rows for e in r.entities]
    top = min(set(labels), key=lambda x: (-labels.count(x), x))
    texts = [r.text for r in rows if (r.text or "").strip()]
    return len(rows), len(set(texts)), len(texts), scores, top, labels.count(top)


def check(report, df):
    rows, unique, texts, scores, top, n = exact(df)
    assert (report["rows"], report["scored"], report["top_label"], report["top_label_count"]) == (rows, len(scores), top, n)
    assert abs(report["unique_texts"] - unique) <= 0.03 * unique and report["unique_texts"] + report["duplicate_text_rows"] == texts
    for p in (25, 50, 75):
        rank = sum(s <= report[f"p{p}"] for s in scores) / len(scores)
        assert abs(rank - p / 100) < 0.01


def test_runs_merge_without_their_records(spark, records, tmp_path):
    """Four runs stored one after the other, one of them twice: the merged report is that of all records together."""
    folder = str(tmp_path / "runs")
    for i in (0, 1, 2, 3, 1):
        sk.store_run(sk.sketch_run(records.filter(F.col("row_idx") % 4 == i)), folder, f"r{i}")
    runs = sk.stored_runs(spark, folder)
    assert runs.count() == 4
    check(sk.sketch_report(sk.merge_runs(runs)).first(), records)
    for row in sk.sketch_report(sk.merge_runs(runs, ["run"]), groups=["run"]).collect():
        check(row, records.filter(F.col("row_idx") % 4 == int(row["run"][1])))


def test_groups_with_null_and_without_entities(spark, records):
    got = {r["source"]: r for r in sk.sketch_report(sk.sketch_run(records, ["source"]), groups=["source"]).collect()}
    assert set(got) == {"a", "b", None}
    for source, row in got.items():
        check(row, records.filter(F.col("source").eqNullSafe(source)))
    bare = sk.sketch_run(records.withColumn("entities", F.expr("filter(entities, e -> false)")))
    report = sk.sketch_report(sk.merge_runs(bare.unionByName(bare))).first()
    assert (report["rows"], report["scored"], report["p50"], report["top_label"]) == (6000, 0, None, None)
    nothing = sk.sketch_report(sk.merge_runs(sk.sketch_run(records.limit(0), ["source"]), ["source"]), groups=["source"])
    assert nothing.count() == 0


def test_audit_from_sketches(spark):
    rng = random.Random(9)
    rows = [(rng.random(), int(rng.random() < 0.5), rng.choice(["A", "B", None])) for _ in range(4000)] + [(0.5, 1, "C")]
    df = spark.createDataFrame(rows, "score double, target int, label string")
    keys = ["scope", "label", "scores", "target"]
    full, near = ({tuple(r[k] for k in keys): r for r in c.audit_by_label(df, 0.8, approximate=a).collect()} for a in (False, True))
    assert set(full) == set(near)
    for key, row in near.items():
        assert [row[x] for x in ("count", "mean", "min", "max", "share_ge_threshold", "threshold")] == [full[key][x] for x in ("count", "mean", "min", "max", "share_ge_threshold", "threshold")]
        mine = sorted(s for s, t, x in rows if t == key[3] and (key[0] == "overall" or x == key[1]))
        for p, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
            if not mine:
                assert row[name] is None
            elif len(mine) > 10:
                assert abs(sum(s <= row[name] for s in mine) / len(mine) - p) < 0.012
