import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators.extract import dictionary_tagger, prefix_bits


def plain(texts, terms, max_words, fold=str):
    out = []
    for i, text in texts:
        words, at = [], 0
        for w in (text or "").split(" "):
            if w:
                words.append((w, at, at + len(w)))
            at += len(w) + 1
        for a in range(len(words)):
            for k in range(1, max_words + 1):
                if a + k <= len(words):
                    for label in terms.get(fold(" ".join(w for w, *_ in words[a:a + k])), ()):
                        out.append((i, words[a][1], words[a + k - 1][2], label, text[words[a][1]:words[a + k - 1][2]]))
    return sorted(out)


@pytest.mark.parametrize("fold", [False, True])
def test_phrases_against_all_runs(spark, fold):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "D", "é", "New", "york"]
    run = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    terms = {}
    for _ in range(120):
        terms.setdefault(run(rng.randint(1, 6)), set()).add(rng.choice("XY"))
    texts = [(i, rng.choice((" ", "  ")).join(run(rng.randint(0, 40)).split(" "))) for i in range(60)] + [(90, None), (91, ""), (92, "  ")]
    df = spark.createDataFrame(texts, "row_idx long, text string")
    table = spark.createDataFrame([(t, x) for t, xs in terms.items() for x in xs], "term string, label string")
    folded = {}
    for t, xs in terms.items():
        folded.setdefault(t.lower() if fold else t, set()).update(xs)
    for max_words in (2, 6, 8):
        short = {t: xs for t, xs in folded.items() if t.count(" ") < max_words}
        got = dictionary_tagger(df, table, max_words=max_words, ignore_case=fold, strategy="whitespace").collect()
        want = plain(texts, short, max_words, str.lower if fold else str)
        assert sorted((r.row_idx, r.start, r.end, r.label, r.text) for r in got) == want and len(want) > 100


def test_a_full_table_loses_no_term(spark):
    """With far too few bits nearly every run gets through, and the join still decides."""
    terms = spark.range(3000).select(F.concat(F.lit("w"), "id", F.lit(" x"), F.col("id") % 7).alias("term"), F.lit("T").alias("label"))
    small = prefix_bits(terms, most=64)
    assert small.bits == 64
    df = spark.range(200).select(F.col("id").alias("row_idx"), F.concat(F.lit("say w"), F.col("id") * 20, F.lit(" x"), F.col("id") * 20 % 7, F.lit(" now")).alias("text"))
    assert dictionary_tagger(df, terms, max_words=3).count() == 150


def test_the_prefix_table_keeps_other_places_from_the_join(spark):
    terms = spark.range(2000).select(F.concat(F.lit("w"), "id", F.lit(" y"), "id").alias("term"))
    bits = prefix_bits(terms)
    rows = spark.range(20000).select(F.xxhash64(F.lit(0).cast("long"), F.concat(F.lit("w"), "id")).alias("k"), "id")
    counts = rows.groupBy((F.col("id") < 2000).alias("term")).agg(F.count_if(bits.has(F.col("k"))).alias("n")).collect()
    n = {r.term: r.n for r in counts}
    assert n[True] == 2000 and n[False] < 0.15 * 18000


def test_empty_dictionary(spark):
    df = spark.createDataFrame([(1, "some text")], "row_idx long, text string")
    assert dictionary_tagger(df, spark.createDataFrame([], "term string, label string"), max_words=4).count() == 0
