"""License scan and quality rules against plain Python."""

from __future__ import annotations

import random
import re
import textwrap
from collections import Counter
from hashlib import sha256
from math import log

import public_tokenizers
import xxhash
from corpus import empty, frame, rows

from spanlake.llm import licenses as li
from spanlake.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_canonical(text):
    text = (text or "").lower()
    text = re.sub(r"^[ \t#*/;-]*(copyright|\(c\)|©)[^\n]*(\n|\Z)", "", text, flags=re.M)
    words = [w for w in re.split(r"(?:[^\w©]|_)+", text) if w]
    return " ".join(dict(li.SPELLINGS).get(w, w) for w in words)


def test_canonical_form(spark):
    texts = ["  MIT   LICENCE!\n(c) Ann 2020\n", "licence licence Licences", "Copyright me\nall", "", None, "HTTPS://x.y v2", "a\rcopyright b"]
    got = [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(li.canonical(li.F.col("t")).alias("c")).collect()]
    assert got == [plain_canonical(t) for t in texts]
    assert got[0] == "mit license"


def test_license_scan(spark):
    known = {}
    for name, free, text in li.KNOWN:
        key = sha256(plain_canonical(text).encode()).hexdigest()
        known[key] = min(known.get(key, (name, free)), (name, free))
    want = []
    for i, text, *_ in rows():
        form = plain_canonical(text)
        lines = [f for f in map(plain_canonical, (text or "").split("\n")) if f]
        digest = lambda f: sha256(f.encode()).hexdigest()
        hits = [known[digest(f)] for f in lines if digest(f) in known]
        whole = known.get(digest(form)) if form else None
        both = hits + ([whole] if whole else [])
        want.append((i, digest(form), whole and whole[0], len(lines), len(hits), ",".join(sorted({h[0] for h in both})), min((h[1] for h in both), default=None)))
    got = [tuple(r) for r in li.scan_licenses(frame(spark), li.known_digests(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert any(w[2] == "MIT" for w in want) and any(w[5] == "MIT" and w[2] is None for w in want)
    assert li.scan_licenses(empty(spark), li.known_digests(spark)).count() == 0


def test_whole_license_files(spark):
    files, want = [], []
    for x in li.json.loads(li.Path(li.__file__).with_name("license_texts.json").read_text(encoding="utf-8")):
        for title in ["", *x["titles"]]:
            for i, tail in enumerate(x["tails"]):
                whole = "\n".join(filter(None, (title, "\nCopyright (c) 2019-2021 Ann Lee\n", x["texts"][-1], tail)))
                files.append("\n".join(textwrap.fill(line, 100) for line in whole.split("\n")))
                want.append(x["license"])
    parts = dict(re.findall(r"(?ms)^(\S+_bpe_\S+):\n(.*?)(?=^\S+_bpe_\S+:\n|\Z)", open(public_tokenizers.path("LICENSES.txt"), encoding="utf-8").read()))
    files.append(parts["byte_bpe_*"])
    want.append("MIT")
    docs = spark.createDataFrame([*enumerate(files)], "doc_id long, text string")
    got = {r.doc_id: r for r in li.scan_licenses(docs, li.known_digests(spark)).collect()}
    assert [got[i].text_license for i in range(len(files))] == want
    assert {"MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(want)


def test_copyright_statements_end_with_their_sentence(spark):
    want = {"Copyright (c) 2021 Acme Inc. All rights reserved.": "all rights reserved", "(c) 2020 Jane Doe. Licensed under CC BY-NC 4.0.": "licensed under cc by nc 4 0",
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY": "copyright holders be liable for any", "copyright notice": "copyright notice", "(c) You must retain": "c you must retain",
            "copyright treaty adopted on 20 December 1996, and": "copyright treaty adopted on 20 december 1996 and", "# Copyright 2020 J. R. Smith": "",
            "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>": "", "© Meta Platforms, Inc. and affiliates.": "", "Copyright [yyyy] [name of copyright owner]": "",
            "(c) 2020 a" + " b" * 20_000: ""}
    rows_ = spark.createDataFrame([*enumerate(want)], "doc_id int, text string")
    assert [r.c for r in rows_.orderBy("doc_id").select(li.canonical(li.F.col("text")).alias("c")).collect()] == [*want.values()]
    found = {r.doc_id: r for r in li.scan_licenses(rows_, li.known_digests(spark)).collect()}
    assert [(found[i].licenses, found[i].permissive, found[i].n_lines) for i in (0, 1)] == [("proprietary", False, 1), ("CC-BY-NC-4.0", False, 1)]
    # Whole texts, wrapped so that lines begin with 'copyright' here and there.
    mit = next(text for name, _, text in li.KNOWN if name == "MIT" and "AUTHORS OR COPYRIGHT" in text)
    files = ["Copyright (c) 2020 Ann Lee\n\n" + textwrap.fill(mit, n) for n in range(20, 100)]
    assert any("\nCOPYRIGHT" in f for f in files)
    wrapped = li.scan_licenses(spark.createDataFrame([*enumerate(files)], "doc_id int, text string"), li.known_digests(spark))
    assert wrapped.filter("text_license = 'MIT'").count() == len(files)


def plain_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n)


def plain_buckets(text, buckets=qr.BUCKETS):
    """Spark's xxhash64: seed 42, a long's eight bytes hashed with the hash before as seed."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    return [signed(h) % buckets for h in hashes] + [signed(pair(a, b)) % buckets for a, b in zip(hashes, hashes[1:])]


def test_quality_rules(spark):
    docs, trusted = frame(spark), spark.createDataFrame([(i,) for i in (5, 6, 7, 7, None, 60, 99)], "doc_id long")
    ratios = qr.fit_ratios(docs, trusted)
    corpus, target = Counter(), Counter()
    for i, text, *_ in rows():
        corpus.update(plain_buckets(text))
        target.update(plain_buckets(text) if i in (5, 6, 7, 60) else [])
    times = sum(corpus.values()) / sum(target.values())
    share = lambda c, extra: [(c[b] + extra) / (sum(c.values()) + extra * qr.BUCKETS) for b in range(qr.BUCKETS)]
    for ratio, t, c in zip(ratios, share(target, qr.SMOOTHING), share(corpus, qr.SMOOTHING * times)):
        assert abs(ratio - log(t / c)) < 1e-12
    want = []
    for i, text, *_ in rows():
        base, grams = plain_base(text), plain_buckets(text)
        score = sum(ratios[g] for g in grams) / len(grams) if grams else None
        want.append((i, *base, score is not None and round(score, 6), not base[-1] and score >= qr.MIN_SCORE))
    got = [(*r[:7], r.score is not None and round(r.score, 6), r.kept) for r in qr.quality_rules(docs, ratios).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert qr.fit_ratios(empty(spark), trusted) == [0.0] * qr.BUCKETS
    assert qr.quality_rules(empty(spark), ratios).count() == 0


def test_rules_tell_junk_from_clean(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = qr.quality_rules(docs, qr.fit_ratios(docs, labels.filter("quality = 1 and doc_id % 2 = 0")))
    held = fitted.filter("n_words >= 10").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").toPandas()
    assert held[held.quality == 1].kept.mean() > 0.97 and held[held.quality == 0].kept.mean() < 0.55


def test_rules_with_a_written_model(spark):
    docs, trusted = frame(spark), spark.createDataFrame([(i,) for i in (5, 6, 7, 7, None, 60, 99)], "doc_id long")
    model, small = qr.fit_table(docs, trusted), qr.fit_ratios(docs, trusted)
    assert model.buckets == qr.BUCKETS  # the least
    for row in model.table.collect():
        assert abs(row["units"] / qr.UNITS - small[row["bucket"]]) < 1e-12
    got, want = (sorted(((*r[:7], r.score is not None and round(r.score, 6), r.kept) for r in qr.quality_rules(docs, m).collect()), key=repr) for m in (model, small))
    assert got == want and len(got) == len(rows())
    assert qr.quality_rules(docs, qr.fit_table(empty(spark), trusted)).filter("score <> 0").count() == 0
    assert qr.quality_rules(empty(spark), model).count() == 0


def test_buckets_grow_with_the_corpus(spark):
    assert [qr.bucket_number(n) for n in (0, 32 * qr.BUCKETS, 32 * qr.BUCKETS + 1, 8_000_000, 15_600_000_000)] == [qr.BUCKETS, qr.BUCKETS, 2 * qr.BUCKETS, 1 << 18, 1 << 29]
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = qr.fit_table(docs, labels.filter("quality = 1 and doc_id % 2 = 0"))
    assert model.buckets == 1 << 18
    held = qr.quality_rules(docs, model).filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").toPandas()
    assert held[held.quality == 1].kept.mean() > 0.99 and held[held.quality == 0].kept.mean() < 0.05


def plain_scores(data, trusted, buckets):
    """Mean log ratios by plain counting in ``buckets``."""
    corpus, target = Counter(), Counter()
    for i, text in data:
        corpus.update(plain_buckets(text, buckets))
        target.update(plain_buckets(text, buckets) if i in trusted else [])
    times = sum(corpus.values()) / sum(target.values()) if target else 1
    ratio = lambda b: log((target[b] + qr.SMOOTHING) * times / (corpus[b] + qr.SMOOTHING * times)) if target else 0.0
    out = []
    for i, text in data:
        grams = plain_buckets(text, buckets)
        out.append((repr(i), sum(map(ratio, grams)) / len(grams) if grams else None))
    return sorted(out, key=repr)


def check_scores(spark, docs, data, trusted, buckets):
    known = spark.createDataFrame([(i,) for i in trusted], f"doc_id {dict(docs.dtypes)['doc_id']}")
    got = qr.quality_rules(docs, qr.fit_scores(docs, known)).collect()
    want = plain_scores(data, set(trusted) - {None}, buckets)
    order = lambda x: (x[0], x[1] is not None, x[1] or 0.0)
    want, found = sorted(want, key=order), sorted(((repr(r.doc_id), r.score) for r in got), key=order)
    assert [(i, s is None) for i, s in want] == [(i, s is None) for i, s in found]
    assert all(s is None or abs(s - x) < 2e-9 for (_, s), (_, x) in zip(want, found))
    assert all(r.kept == (not r.base_failed and r.score >= qr.MIN_SCORE) for r in got)


def test_scores_of_one_shuffle(spark, monkeypatch):
    """Hard rows, texts that repeat an n-gram far more often than one packed n-gram can say, negative ids; ids as bitmaps and joined."""
    data = [(i, t) for i, t, *_ in rows()] + [(-5, "no no " * 400 + "yes"), (1 << 40, "far away " * 40), (70, "a b c d e f g h i j k")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    trusted = [5, 6, 7, 7, None, 60, 99, -5, 1 << 40]
    check_scores(spark, docs, data, trusted, qr.BUCKETS)
    monkeypatch.setattr(qr, "MOST_MARKS", 0)
    check_scores(spark, docs, data, trusted, qr.BUCKETS)
    check_scores(spark, docs.selectExpr("concat('x', doc_id) as doc_id", "text"), [(None if i is None else f"x{i}", t) for i, t in data], ["x5", "x60", None], qr.BUCKETS)
    none = spark.createDataFrame([], "doc_id long")
    assert qr.quality_rules(docs, qr.fit_scores(docs, none)).filter("score <> 0").count() == 0
    assert qr.quality_rules(empty(spark), qr.fit_scores(empty(spark), none)).count() == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_scores_in_more_buckets(spark, monkeypatch):
    """A corpus that calls for 2^15 buckets and more, and places of few bits, so that there are many ranges."""
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    grams = sum(max(0, 2 * len(WORD.findall(t or "")) - 1) for _, t in data)
    buckets = qr.bucket_number(grams)
    assert buckets >= 1 << 15
    docs = spark.createDataFrame(data, "doc_id long, text string")
    check_scores(spark, docs, data, [i for i, _ in data if i % 3 == 0], buckets)
    monkeypatch.setattr(qr, "BUCKET_GRAMS", 1)
    check_scores(spark, docs, data, [i for i, _ in data if i % 3 == 0], qr.bucket_number(grams))
    assert qr.bucket_number(grams) >= 1 << 19


def test_held_out_junk_by_one_shuffle(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = qr.quality_rules(docs, qr.fit_scores(docs, labels.filter("quality = 1 and doc_id % 2 = 0")))
    held = fitted.filter("not base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "kept").toPandas()
    assert held[held.quality == 1].kept.mean() > 0.99 and held[held.quality == 0].kept.mean() < 0.05


def test_rules_split_a_text_twice(spark, monkeypatch):
    """Once for the statistics, which say how many n-grams there are, and once for the n-grams themselves."""
    calls, split = [], qr.F.split
    monkeypatch.setattr(qr.F, "split", lambda text, by, *a: calls.extend([by] if by == qr.SPACE_RUN else []) or split(text, by, *a))
    docs, trusted = frame(spark), spark.createDataFrame([(i,) for i in (5, 6, 7)], "doc_id long")
    scores = qr.fit_scores(docs, trusted)
    assert qr.quality_rules(docs, scores).count() == len(rows()) and len(calls) == 2
    # Other rows than those of the fit get statistics of their own.
    assert [r.n_words for r in qr.quality_rules(docs.filter("doc_id = 63"), scores).collect()] == [53] and len(calls) == 3


def test_repeated_windows(spark, monkeypatch):
    """Texts around the counts that rule repeats out; also when every hash of neighbours is the same."""
    rng = random.Random(11)
    texts = [None, "", " ", " \n a b c d e a b c d e\t ", "a", "a b c d e", "a a a a a", "a a a a a a", "a b c d e a b c d e", "a b c d a b c d", "a b c d e x a b c d f", "a b c d e f a b c d e f g",
             "x a b c d e a b c d", "n a b c d e m a b c d e o a b c d e", "a b a b a b a b", "a b c a b c a b c"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(5, 40))) for _ in range(60)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20, 120))) for _ in range(40)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = [plain_base(t)[4] for t in texts]
    assert {0} < set(want)
    found = lambda: [r.n_repeat_words for r in qr.quality_rules(docs, [0.0] * 8).orderBy("doc_id").collect()]
    assert found() == want
    monkeypatch.setattr(qr, "_mixed", lambda a, b: qr.F.lit(7).cast("long"))
    assert found() == want
