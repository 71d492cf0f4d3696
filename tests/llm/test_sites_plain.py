"""Quality classifier, languages and shards, row by row against plain versions; the first two pipeline stages too."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from math import exp, floor, log
from struct import pack, unpack
from zlib import crc32

import corpus_pipeline as cp
import pytest
import xxhash
from corpus import SF, frame, rows

from spanlake.llm import language as lg
from spanlake.llm import quality_classifier as qc
from spanlake.llm import sharding as sh

MASK = (1 << 64) - 1
WORD = re.compile("[^ \t\n\x0b\x0c\r]+")


def words(text):
    return WORD.findall(text or "")


# --------------------------------------------------------------------------- quality
def features(word):
    shape, last = "", ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "L" if c.isalpha() else c
        if not (kind == last and kind in "aA0L"):
            shape += kind
        last = kind
    return [1 + crc32(x.encode()) % (qc.BUCKETS - 1) for x in ("w" + word, "s" + shape[:32])]


def plain_quality(docs, labels):
    """(id, text, lang, source) and {id: good} -> rows (n_words, evidence, host rate, path rate, quality, kept), in order."""
    counts = [defaultdict(int), defaultdict(int)]
    for i, text, *_ in docs:
        if i in labels:
            w = words(text)
            for x in w:
                for b in features(x):
                    counts[labels[i]][b] += 1
            counts[labels[i]][0] += sum(a == b for a, b in zip(w, w[1:]))
    totals = [sum(c.values()) + 0.5 * qc.BUCKETS for c in counts]
    both = all(sum(c.values()) for c in counts)
    odds = lambda b: log((counts[1][b] + 0.5) / totals[1]) - log((counts[0][b] + 0.5) / totals[0]) if both else 0.0
    evidence = []
    for _, text, *_ in docs:
        w = words(text)
        total = sum(odds(b) for x in w for b in features(x)) + odds(0) * sum(a == b for a, b in zip(w, w[1:]))
        evidence.append(total / len(w) * min(len(w), qc.EVIDENCE_WORDS) if w else 0.0)
    known = list(labels.values())
    rate = min(0.99, max(0.01, sum(known) / len(known) if known else 0.5))
    good = [1 / (1 + exp(-(e + log(rate / (1 - rate))))) for e in evidence]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, _, lang, source), g in zip(docs, good):
        hosts[source].append(g)
        paths[source, lang].append(g)
    host_rate = {h: (sum(g) + rate * qc.HOST_STRENGTH) / (len(g) + qc.HOST_STRENGTH) for h, g in hosts.items()}
    path_rate = {p: (sum(g) + host_rate[p[0]] * qc.PATH_STRENGTH) / (len(g) + qc.PATH_STRENGTH) for p, g in paths.items()}
    out = []
    for (_, text, lang, source), e in zip(docs, evidence):
        p = path_rate[source, lang]
        q = 1 / (1 + exp(-(e + log(p / (1 - p)))))
        out.append((len(words(text)), e, host_rate[source], p, q, bool(words(text)) and round(q, 9) >= qc.MIN_GOOD))
    return out


def check_quality(spark, docs, data, labels):
    known = spark.createDataFrame([(i, g) for i, g in labels.items()], "doc_id long, quality int")
    got = sorted((repr(r.doc_id), r.n_words, r.evidence, r.host_rate, r.path_rate, r.quality, r.kept) for r in qc.classify_quality(docs, known).collect())
    want = sorted((repr(d[0]), *w) for d, w in zip(data, plain_quality(data, labels)))
    assert [(g[0], g[1], g[6]) for g in got] == [(w[0], w[1], w[6]) for w in want]
    assert all(g[2:6] == pytest.approx(w[2:6], abs=2e-9) for g, w in zip(got, want))


def test_quality_row_by_row(spark):
    check_quality(spark, frame(spark), rows(), {5: 1, 6: 1, 7: 1, 61: 0, 63: 0, 66: 0})
    check_quality(spark, frame(spark), rows(), {5: 1})
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null").collect()}
    check_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), data, labels)


def test_quality_stage_row_by_row(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null").collect()}
    want = sorted(d[0] for d, w in zip(data, plain_quality(data, labels)) if w[-1])
    got = cp.good_documents(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()
    assert sorted(r.doc_id for r in got) == want


# --------------------------------------------------------------------------- languages
def trigrams(text):
    out = []
    for w in words((text or "").lower()):
        w = f" {w} "
        for a, b, c in zip(w, w[1:], w[2:]):
            m = (ord(a) * 0x9E3779B97F4A7C15 + ord(b) * 0xC2B2AE3D27D4EB4F + ord(c) * 0x165667B19E3779F9) & MASK
            m = ((m ^ (m >> 29)) * 0xD6E8FEB86659FD93) & MASK
            out.append((m >> 32) % lg.BUCKETS)
    return out


def single(x):
    return unpack("f", pack("f", x))[0]


def domain(host):
    parts = (host or "").split(".")
    return ".".join(parts[-2:]) if host and len(parts) > 1 and all(parts[-2:]) else host


def share(weights):
    most = max(weights)
    e = [exp(w - most) for w in weights]
    return [x / sum(e) for x in e]


def plain_languages(docs):
    """(id, text, declared code or None, host) -> rows (n_words, text language, language, confidence, kept), in order; declarations are plain codes."""
    declared = defaultdict(int)
    for _, text, lang, _ in docs:
        if lang and words(text):
            declared[lang] += 1
    langs = [x for x, n in sorted(declared.items(), key=lambda kv: (-kv[1], kv[0])) if n >= lg.MIN_TEXTS] or list(lg.LANGUAGES)
    counts = {x: defaultdict(int) for x in langs}
    for _, text, lang, _ in docs:
        if lang in counts:
            for b in trigrams(text):
                counts[lang][b] += 1
    size = {x: sum(c.values()) + lg.SMOOTHING * lg.BUCKETS for x, c in counts.items()}
    likelihood = []
    for _, text, *_ in docs:
        t = trigrams(text)
        scale = min(len(t), lg.EVIDENCE_GRAMS) / len(t) if t else 0
        likelihood.append([scale * sum(single(log((counts[x][b] + lg.SMOOTHING) / size[x])) for b in t) for x in langs] + [-log(lg.BUCKETS) * min(len(t), lg.EVIDENCE_GRAMS)])
    hosts, domains, corpus = (defaultdict(lambda: [0.0] * len(langs)) for _ in range(3))
    for (_, text, _, host), li in zip(docs, likelihood):
        if words(text):
            for i, p in enumerate(share(li)[:-1]):
                for table, key in ((hosts, host), (domains, domain(host)), (corpus, 0)):
                    table[key][i] += p
    all_ = [x + 1 for x in corpus[0]]
    shrink = lambda own, above, strength: [(x + strength * g) / (sum(own) + strength) for x, g in zip(own, above)]
    whole = [x / sum(all_) for x in all_]
    out = []
    for (_, text, lang, host), li in zip(docs, likelihood):
        if not words(text):
            out.append((0, None, None, None, False))
            continue
        prior = shrink(hosts[host], shrink(domains[domain(host)], whole, lg.DOMAIN_STRENGTH), lg.HOST_STRENGTH)
        points = lg.SUFFIX_LANGUAGE.get((host or "").split(".")[-1]) if "." in (host or "") else None
        w = []
        for i, x in enumerate([*langs, lg.NONE]):
            v = li[i] + log(prior[i] * (1 - lg.NONE_PRIOR) if x != lg.NONE else lg.NONE_PRIOR)
            for says, trust in ((lang, lg.DECLARED_TRUST), (points, lg.SUFFIX_TRUST)):
                if says in langs:
                    v += log(trust if says == x else 1 / len(langs) if x == lg.NONE else (1 - trust) / max(1, len(langs) - 1))
            w.append(v)
        p = share(w)
        best = max(range(len(p)), key=lambda i: (p[i], -i))
        text_best = max(range(len(li)), key=lambda i: (li[i], -i))
        names = [*langs, lg.NONE]
        out.append((len(words(text)), names[text_best], names[best], p[best], p[best] >= lg.MIN_CONFIDENCE and names[best] != lg.NONE))
    return out


def check_languages(spark, docs, data):
    got = sorted(((repr(r.doc_id), r.n_words, r.text_language or "", r.language or "", r.kept, r.confidence or 0.0) for r in lg.identify_languages(docs).collect()))
    want = sorted((repr(d[0]), n, t or "", x or "", k, c or 0.0) for d, (n, t, x, c, k) in zip(data, plain_languages(data)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], abs=1e-5)


def test_languages_row_by_row(spark):
    check_languages(spark, frame(spark), rows())
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    check_languages(spark, spark.read.parquet(f"{SF}/documents.parquet"), data)


def test_suffixes_domains_and_many_languages(spark):
    """Sites with dots, languages by their own letters, wrong and rare declarations, texts too short to tell."""
    rng = random.Random(8)
    langs = ["de", "fr", "pl", "it", "sv", "tr", "qq"]
    alphabet = {x: rng.sample("abcdefghijklmnopqrstuvwxyz", 9) for x in langs}
    data = []
    for i in range(260):
        x = rng.choice(langs[:6])
        text = " ".join("".join(rng.choice(alphabet[x]) for _ in range(rng.randint(2, 6))) for _ in range(rng.choice((1, 2, 12, 30))))
        host = rng.choice([f"a.site.{x}", f"b.site.{x}", "news.big.com", "plain", None, "x.de", ".", "a."])
        data.append((i, text, rng.choice([x, x, rng.choice(langs), None]), host))
    data += [(900, "zz zz", "qq", "x.de"), (901, None, "de", "only.empty.fr")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert len({w[2] for w in plain_languages(data)}) > 5
    check_languages(spark, docs, data)


def test_language_stage_row_by_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    data = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    want = sorted(d[0] for d, w in zip(data, plain_languages(data)) if w[-1])
    assert sorted(r.doc_id for r in cp.known_languages(spark, docs, SF).collect()) == want


def test_the_plan_does_not_grow_with_the_languages(spark):
    """184 languages, each declared by a few texts."""
    codes = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "jkqvwxz"]
    codes = [c for c in codes if c not in lg.SUBTAGS and c not in lg.NO_LANGUAGE][:180]
    data = [(i * 10 + k, f"{c * 3}lo {c}ma wo{c} ti{c}na {c}{c} ro{c}m " * 4, c, f"src{i % 7}") for i, c in enumerate(codes) for k in range(4)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    got = lg.identify_languages(docs).collect()
    assert len(got) == len(data) and sum(r.language == r.declared for r in got) > 0.9 * len(data)


# --------------------------------------------------------------------------- shards
def plain_leaves(points, dims, leaves):
    """The tree by sorting: {key: leaf}; ``points`` are (key, weight, coordinates)."""
    wide = [max(p[2][d] for p in points) - min(p[2][d] for p in points) or 1.0 for d in range(dims)]
    signed = lambda key: xxhash.xxh64_intdigest(key.encode(), seed=42) & ((1 << sh.TIE_BITS) - 1)
    out = {}

    def split(part, first, n):
        if n == 1 or not part:
            out.update({p[0]: first for p in part})
            return
        lo, hi = ([f(p[2][d] for p in part) for d in range(dims)] for f in (min, max))
        d = max(range(dims), key=lambda d: ((hi[d] - lo[d]) / wide[d], -d))
        half, total = n // 2, sum(p[1] for p in part)

        def place(p):
            share = (p[2][d] - lo[d]) / (hi[d] - lo[d]) if hi[d] > lo[d] else 0.0
            return floor(share * ((1 << sh.SCALE_BITS) - 1)) << sh.TIE_BITS | signed(p[0])

        bits = (sh.SCALE_BITS + sh.TIE_BITS) - sh.ROUND_BITS * ((sh.SCALE_BITS + sh.TIE_BITS) // sh.ROUND_BITS - 1)
        cells = defaultdict(list)
        for p in part:
            cells[place(p) >> bits].append(p)
        goal, before, left, right, cut = total * half / n, 0, [], [], False
        for cell in sorted(cells):
            w = sum(p[1] for p in cells[cell])
            stays = not cut and (before + w < goal - 0.5 or (goal - before) * 2 >= w)
            cut = cut or before + w >= goal - 0.5
            (left if stays else right).extend(cells[cell])
            before += w
        split(left, first, half)
        split(right, first + half, n - half)

    split(points, 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [2, 5, 8])
def test_tree_by_sorting(spark, leaves):
    rng = random.Random(leaves)
    points = [(f"k{i}", rng.randint(1, 50), (rng.random() * 10, float(rng.randint(0, 6)), rng.gauss(0, 1))) for i in range(500)]
    frame_ = spark.createDataFrame([(k, w, *x) for k, w, x in points], "key string, weight long, a double, b double, c double")
    got = {r.key: r.leaf for r in sh.kd_leaves(frame_, ["a", "b", "c"], leaves).collect()}
    assert got == plain_leaves(points, 3, leaves)
