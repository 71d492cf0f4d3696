import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import pytest

import __spark_entry__ as entry
from spanlake.llm import variants

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def plain_counts(rows, min_letters=6, min_count=5, spoil=199):
    met = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_letters:
                met[run] += 1
    return {w: n for w, n in met.items() if n >= min_count}


def plain_variants(counts, ratio=5):
    """Every word with its near words by deletion and wildcard patterns."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1:]].add(w)
            if (short := w[:i] + w[i + 1:]) in counts:
                near[w].add(short)
                near[short].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return out


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op12_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_counts(docs))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5000
    assert any(form and root != form for _, form, root, *_ in want)


@pytest.mark.parametrize("chunk", [3, 50, variants.CHUNK])
def test_all_near_words_are_found(spark, chunk):
    """Few letters, many near words, groups cut into several indexes, words of two letters on, and letters beyond ASCII."""
    rng = random.Random(chunk)
    counts = {"".join(rng.choice("abé") for _ in range(rng.randint(2, 7))): rng.choice((1, 2, 5, 5, 30, 200, 2000)) for _ in range(1500)}
    counts |= {"日本語テスト": 3, "日本語テス": 90, "a" * 200: 1, "a" * 199 + "b": 7, "a" * 201: 6, "🎉🎉": 1, "🎉🎉🎉": 9}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert {tuple(r) for r in variants.spelling_variants(frame, chunk=chunk).collect()} == plain_variants(counts)


def test_long_paths(spark):
    counts = {"a" * i: 5 ** i for i in range(2, 20)}
    got = {r["word"]: r["root"] for r in variants.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == {w: "a" * 19 for w in counts}


def test_hard_rows(spark):
    docs = corpus.frame(spark)
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, 2, 2).collect()} == plain_counts([(i, t) for i, t, *_ in corpus.rows()], 2, 2)
    assert {r["word"]: r["n"] for r in variants.word_counts(docs, 3, 1, spoil=3).collect()} == plain_counts([(i, t) for i, t, *_ in corpus.rows()], 3, 1, 3)
    assert variants.variants_of(corpus.empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, 5, 1), ("x", 5, 2), ("word", None, 3), ("word", 2, 4), ("word", 3, 4), ("words", 30, 5)], "word string, n long, m int")
    assert sorted(tuple(r) for r in variants.spelling_variants(odd).collect()) == [("word", "words", "words", 5, 1, 30), ("words", None, "words", 30, 1, None)]
    with pytest.raises(ValueError):
        variants.spelling_variants(odd, ratio=1)
