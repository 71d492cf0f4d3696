import sys

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanlake.functions import text as tx
from spanlake.functions.arrays import block_heads, dedupe_by, prefix_sums, sorted_rank
from spanlake.functions.udfs import normalize_text_exact


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).head().x


@pytest.mark.parametrize("raw,norm", [("TijucÁ", "tijuca"), ("  Rua   José  ", "rua jose"), ("Straße", "strasse"), (None, ""),
                                      ("ÇÃO\n x", "cao x")])
def test_normalize(spark, raw, norm):
    assert one(spark, raw, tx.normalize_text(F.col("v"))) == norm


def test_native_and_exact_normalisers_agree_on_whole_blocks(spark):
    chars = [(chr(c),) for c in range(1, 0x250)] + [(chr(c),) for c in range(0x370, 0x530)] + [(chr(c),) for c in range(0x1E00, 0x2000)]
    rows = spark.createDataFrame([(f"a{c}b",) for (c,) in chars], "v string").select(
        "v", tx.normalize_text(F.col("v")).alias("n"), normalize_text_exact(F.col("v")).alias("e")).collect()
    assert [(r.v, r.n, r.e) for r in rows if r.n != r.e] == []


def test_regex_tokens(spark):
    toks = one(spark, "Ivete Sangalo, Xuxa.", tx.tokenize_with_spans(F.col("v"), "regex"))
    assert [t.token for t in toks] == ["Ivete", "Sangalo", ",", "Xuxa", "."]
    assert (toks[1].start, toks[1].end) == (6, 13) and (toks[2].start, toks[2].end) == (13, 14)
    with pytest.raises(ValueError):
        tx.tokenize_with_spans(F.col("v"), "wordpiece")


def test_tokens_match_python_on_many_texts(spark):
    import re
    alphabet = "aZé ß_9.,-\n\t ²́漢ｆ"
    rng = __import__("random").Random(7)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (0, 1, 2, 5, 31, 32, 33, 64, 65, 100, 700, 3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    rows = df.select("i", tx.tokenize_with_spans(F.col("v")).alias("w"), tx.tokenize_with_spans(F.col("v"), "regex").alias("r")).collect()
    for r in rows:
        t = texts[r.i]
        assert [(x.token, x.start, x.end) for x in r.w] == [(m.group(), *m.span()) for m in re.finditer(r"\S+", t)]
        assert [(x.token, x.start, x.end) for x in r.r] == [(m.group(), *m.span()) for m in re.finditer(r"\w+|[^\w\s]", t)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200))
def test_prefix_sums_and_rank(spark, xs):
    row = spark.createDataFrame([(xs,)], "v array<int>").select(
        prefix_sums(F.col("v")).alias("p"),
        sorted_rank(F.sort_array("v"), block_heads(F.sort_array("v")), F.lit(25), True).alias("le"),
        sorted_rank(F.sort_array("v"), block_heads(F.sort_array("v")), F.lit(25), False).alias("lt")).head()
    assert row.p == [sum(xs[:i]) for i in range(len(xs))]
    assert (row.le, row.lt) == (sum(x <= 25 for x in xs), sum(x < 25 for x in xs))


def test_dedupe_keeps_first_in_order(spark):
    assert one(spark, [3, 1, 3, 2, 1], dedupe_by(F.col("v"), lambda x: x), "array<int>") == [3, 1, 2]


def test_fields_and_scores(spark):
    df = spark.createDataFrame([("  ", " b ", "x")], "relato string, text string, bairroLocal string")
    t, f = tx.primary_text(["relato", "text"])
    r = df.select(t.alias("t"), f.alias("f"), tx.inference_text(["relato", "text", "bairroLocal"]).alias("i"),
                  tx.metadata_values(["relato", "bairroLocal"]).alias("m")).head()
    assert (r.t, r.f, r.i) == ("b", "text", "b. x") and [(p.field, p.value) for p in r.m] == [("bairroLocal", "x")]
    vals = spark.createDataFrame([(v,) for v in (" 1.5 ", "nan", "x", None, "inf")], "v string").select(tx.safe_double(F.col("v")).alias("d")).collect()
    assert [v.d for v in vals] == [1.5, None, None, None, float("inf")]


def test_informative_tokens_and_mentions(spark):
    assert one(spark, "rua de faia um galeao 12 123", tx.informative_tokens(F.col("v"))) == ["rua", "faia", "galeao", "123"]
    m = lambda s, e: one(spark, "John in Rio", tx.mention_text(F.col("v"), F.lit(s), F.lit(e), F.lit("own")))
    assert [m(0, 4), m(4, 4), m(8, 12), m(-1, 2)] == ["John", "own", "own", "own"]


def test_regex_matches_offsets(spark):
    found = one(spark, "é Ana, Rui e Zé", tx.regex_matches(F.col("v"), "[A-Z][a-zé]+"))
    assert [(x.text, x.start, x.end) for x in found] == [("Ana", 2, 5), ("Rui", 7, 10), ("Zé", 13, 15)]


def test_sql_functions(spark):
    from spanlake.functions.registry import register_functions
    assert "normalize_text" in register_functions(spark)
    r = spark.sql("select normalize_text('Ação  Straße') a, apply_temperature(0.9D, 2D) b, safe_double('x') c, "
                  "informative_tokens('rua da faia') d, mention_text('John in Rio', 8, 11) e, safe_double('nan') f").head()
    assert r.a == "acao strasse" and abs(r.b - 0.75) < 1e-12 and r.c is None and r.d == ["rua", "faia"] and r.e == "Rio" and r.f is None


def test_normalizers_agree_on_every_character(spark):
    """Native, SQL and exact form, each code point between two letters."""
    import unicodedata
    from spanlake.functions.registry import register_functions
    from spanlake.functions.text import fold_exact, normalize_text
    register_functions(spark)
    codes = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) not in ("Cs", "Cn", "Co")]
    texts = ["".join(f"a{chr(i)}b " for i in codes[at:at + 40]) for at in range(0, len(codes), 40)] + ["STRAẞE 각 힣 ᾀ և", "가나다 " * 50, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    df.createOrReplaceTempView("odd_texts")
    native = {r.i: r.n for r in df.select("i", normalize_text(F.col("t")).alias("n")).collect()}
    by_sql = {r.i: r.n for r in spark.sql("SELECT i, normalize_text(t) AS n FROM odd_texts").collect()}
    generic = {r.i: r.n for r in df.select("i", normalize_text(F.col("t"), "NFKD").alias("n")).collect()}
    for i, t in enumerate(texts):
        assert native[i] == by_sql[i] == fold_exact(t, "NFD"), t
        assert generic[i] == fold_exact(t, "NFKD"), t
