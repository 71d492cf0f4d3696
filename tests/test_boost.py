import pytest
from conftest import ENT, ent
from pyspark.sql import functions as F

from spanlake.operators import boost as b


def boosted(spark, scope, entities, **fields):
    names = list(fields)
    df = spark.createDataFrame([(0, *fields.values(), entities)], "row_idx long, " + ", ".join(f"{n} string" for n in names) + f", entities {ENT}")
    return b.context_boost(df, b.BoostConfig(scope=scope))


def scores(df):
    return [round(e.score_context_boosted, 6) for e in df.head().entities]


def test_all_entities(spark):
    df = boosted(spark, "all-entities", [ent("Person", "Jose Marques", score=.5), ent("Location", "Centro", score=.6)],
                 relato="Tráfico na rua Jose Marques, no bairro Centro.", bairroLocal="Centro", logradouroLocal="Rua José Marques")
    assert scores(df) == [0.6, 0.72]
    r = df.head()
    assert r._context_boost_trace.boosted_entities == 2 and r.record_score_context_boosted == pytest.approx(0.66)
    assert r._context_boost_trace.match_count == 2


def test_scopes(spark):
    two = [ent("Location", "Centro", score=.5), ent("Person", "Joao", score=.5)]
    assert scores(boosted(spark, "location-only", two, relato="Acontece em Centro", bairroLocal="Centro")) == [0.6, 0.5]
    places = [ent("Location", "Centro", score=.5), ent("Location", "Tijuca", score=.5)]
    assert scores(boosted(spark, "matched-only", places, relato="Acontece em Centro e Tijuca", bairroLocal="Centro")) == [0.6, 0.5]
    mixed = [ent("Location", "Centro", score=.5), ent("Organization", "Guarda Centro", score=.5)]
    df = boosted(spark, "location-matched-only", mixed, relato="Acontece em Centro com apoio da Guarda Centro", bairroLocal="Centro")
    assert scores(df) == [0.6, 0.5]
    assert [e._context_boost_reason for e in df.head().entities] == ["location-entity-overlaps-metadata", "no-boost"]


def test_only_metadata_found_in_text_counts(spark):
    df = boosted(spark, "location-matched-only", [ent("Location", "Rua Faia", calibrated=.9), ent("Location", "Rio de Janeiro", calibrated=.9)],
                 relato="Ocorrencia na Rua Faia.", logradouroLocal="Rua Faia", cidadeLocal="Rio de Janeiro")
    assert scores(df) == [1.0, 0.9]
    assert [e._context_boost_applied for e in df.head().entities] == [True, False]
    assert df.head().entities[0]._context_boost_score_source == "score_calibrated"


@pytest.mark.parametrize("text,score,meta,want", [
    ("de", .9, "Rio de Janeiro", False), (".", .9, "Centro", False), ("Galeao", .9, "Estrada do Galeao", False),
    ("Ilha do Governador", .9, "Ilha do Governador", True), ("Estrada Galeao", .9, "Estrada do Galeao", True),
    ("Rua Faia", .2, "Rua Faia", False), ("Rua Faia", .8, "Rua Faia", True), ("Rua", .9, "Rua Faia", False), ("Rua Faia", None, "Rua Faia", False)])
def test_entity_matches_metadata(spark, text, score, meta, want):
    df = spark.createDataFrame([(0, meta, meta, [ent("Location", text, calibrated=score)])], f"row_idx long, relato string, bairroLocal string, entities {ENT}")
    row = b.record_context_match(df, ["relato"], ["bairroLocal"]).select(F.transform(
        "entities", lambda e: b.entity_matches_metadata(e, F.col("_match.matched"), ["text", "score_calibrated"])).alias("m")).head()
    assert row.m == [want]


def test_unscored_entities_and_config_errors(spark):
    df = boosted(spark, "all-entities", [ent("Person", "x")], relato="Centro", bairroLocal="Centro")
    assert df.head().entities[0].score_context_boosted is None and df.head().record_score_context_boosted == 0.0
    for bad in ({"factor": 0.0}, {"scope": "x"}, {"match_policy": "x"}):
        with pytest.raises(ValueError):
            b.BoostConfig(**bad)


def test_per_match_stats_and_audit(spark):
    df = spark.createDataFrame([
        (0, "Rua Faia no Centro", "Rua Faia", "Centro", [ent("Location", "Centro", score=.5), ent("Person", "Ana", score=.2)]),
        (1, "nada", "Rua Faia", "Centro", [ent("Location", "Centro", score=.5)]), (2, "Centro", None, "Centro", [])],
        f"row_idx long, relato string, logradouroLocal string, bairroLocal string, entities {ENT}")
    out = b.context_boost(df, b.BoostConfig(scope="all-entities", per_match=True))
    first = out.orderBy("row_idx").head()
    assert [round(e.score_context_boosted, 4) for e in first.entities] == [0.72, 0.288]
    s = b.context_boost_stats(out).head()
    assert (s.records_total, s.entities_total, s.entities_boosted, s.records_with_context_match) == (3, 3, 2, 2)
    d = b.context_boost_details(out)
    assert b.boost_audit_summary(d).head().asDict() == {"records_total": 3, "records_with_context_match": 2, "records_with_boosted_entities": 1,
                                                        "entity_candidates_total": 3, "entity_boosts_total": 2}
    counts = {(r.kind, r.key): r.n for r in b.boost_audit_counts(d).collect()}
    assert counts == {("boost_reason", "record-context-match"): 2, ("boosted_label", "Location"): 1, ("boosted_label", "Person"): 1,
                      ("matched_field", "bairroLocal"): 2, ("matched_field", "logradouroLocal"): 1}
    assert b.boosted_rows(d).count() == 2
    top = b.top_boosted_records(d, 1).collect()
    assert [(t.row_index, t.boosted_entities) for t in top] == [(1, 2)]
