import re

import pytest
from pyspark.sql import functions as F

from spanlake.operators import extract as ex
from spanlake.operators.filters import clean_entities, sanitize_spans

SP = "array<struct<start:int,end:int,label:string>>"
TS = "array<struct<start_tok:int,end_tok:int,label:string>>"


def test_align_regex_keeps_entity_boundary(spark):
    df = spark.createDataFrame([("Ivete Sangalo, Xuxa", [(0, 13, "Person")], "s1")], f"text string, spans {SP}, sample_id string")
    r = ex.tokenized_samples(df, strategy="regex").head()
    assert r.tokenized_text == ["Ivete", "Sangalo", ",", "Xuxa"] and [tuple(x) for x in r.ner] == [(0, 1, "Person")]


def test_alignment_against_brute_force(spark):
    rng = __import__("random").Random(3)
    rows = []
    for i in range(30):
        text = " ".join("w" * rng.randint(1, 6) for _ in range(rng.randint(1, 150))) + " " * rng.randint(0, 2)
        spans = [(a, a + rng.randint(0, 25), "L") for a in (rng.randint(0, len(text)) for _ in range(12))]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, f"row_idx int, text string, spans {SP}")
    for r in ex.tokenized_samples(df).collect():
        import re
        toks = [m.span() for m in re.finditer(r"\S+", r.text)]
        want = []
        for s in r.spans:
            hit = [i for i, (a, b) in enumerate(toks) if (a >= s.start and b <= s.end) or (a < s.end and b > s.start)]
            if hit:
                want.append((hit[0], hit[-1], s.label))
        assert [tuple(x) for x in r.ner] == want


def test_clamped_alignment(spark):
    df = spark.createDataFrame([("ab cd", [(3, 99, "X"), (-1, 2, "X"), (9, 10, "X"), (0, 1, "")])], f"text string, spans {SP}")
    assert [tuple(x) for x in ex.tokenized_samples(df, clamp=True).head().ner] == [(1, 1, "X")]


def test_windows_empty_kept_or_dropped(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [(0, 0, "Person")], "s1")], f"tokenized_text array<string>, ner {TS}, sample_id string")
    kept = ex.sliding_token_windows(df, 2, 0, keep_empty=True).orderBy("window").collect()
    assert [[tuple(x) for x in r.ner] for r in kept] == [[(0, 0, "Person")], []] and kept[1].tokenized_text == ["c", "d"]
    assert ex.sliding_token_windows(df, 2, 0).count() == 1


def brute_windows(lengths, budget, overlap, max_words):
    out, start = [], 0
    while start < len(lengths):
        used, end = 0, start
        while end < len(lengths) and end - start < max_words:
            if used and used + lengths[end] > budget:
                break
            used += lengths[end]
            end += 1
            if used > budget:
                break
        out.append((start, end))
        if end >= len(lengths):
            break
        start = max(start + 1, end - overlap)
    return out


def test_variable_length_windows_against_brute_force(spark):
    rng = __import__("random").Random(5)
    rows = []
    for i in range(25):
        n = rng.randint(1, 120)
        rows.append((i, [f"w{j}" for j in range(n)], [], [rng.choice([1, 1, 2, 3, 9]) for _ in range(n)]))
    df = spark.createDataFrame(rows, f"row_idx int, tokenized_text array<string>, ner {TS}, len array<int>")
    for budget, overlap in ((8, 3), (5, 0), (20, 7)):
        got = ex.sliding_token_windows(df, budget, overlap, keep_empty=True, lengths="len").orderBy("row_idx", "window").collect()
        by = {}
        for r in got:
            by.setdefault(r.row_idx, []).append((int(r.tokenized_text[0][1:]), int(r.tokenized_text[0][1:]) + len(r.tokenized_text)))
        for i, words, _, lens in rows:
            want = brute_windows(lens, budget, overlap, budget) if sum(lens) > budget else [(0, len(words))]
            assert by[i] == want


def test_unit_windows_against_brute_force(spark):
    rows = [(n, [f"w{j}" for j in range(n)], []) for n in (1, 2, 5, 6, 7, 11, 30)]
    df = spark.createDataFrame(rows, f"row_idx int, tokenized_text array<string>, ner {TS}")
    for budget, overlap in ((5, 2), (3, 0), (4, 9)):
        got = ex.sliding_token_windows(df, budget, overlap, keep_empty=True).orderBy("row_idx", "window").collect()
        by = {}
        for r in got:
            a = int(r.tokenized_text[0][1:])
            by.setdefault(r.row_idx, []).append((a, a + len(r.tokenized_text)))
        for n, words, _ in rows:
            assert by[n] == (brute_windows([1] * n, budget, overlap, budget) if n > budget else [(0, n)])


def test_chunks_and_location(spark):
    df = spark.createDataFrame([("a b  c d e", ["a b", "zz", "c", "a"])], "text string, parts array<string>")
    r = df.select(ex.chunk_text(F.col("text"), 2).alias("c"), ex.locate_chunks(F.col("text"), F.col("parts")).alias("l")).head()
    assert [(x.text, x.start) for x in r.c] == [("a b", 0), ("c d", 5), ("e", 9)]
    assert [(x.text, x.start) for x in r.l] == [("a b", 0), ("c", 5), ("a", 0)]
    assert (ex.chunk_budget(384, 256, reserved=2), ex.chunk_budget(1, reserved=5), ex.chunk_budget(384, 0, 10 ** 6)) == (254, 1, 384)
    p = ex.chunk_profile(df, "text", 2).head()
    assert (p.rows, p.total_chunks, p.max_chunks_per_row, p.max_chunk_length) == (1, 3, 3, 3)


def capital_tagger():
    import re

    def tag(texts, labels, threshold):
        if any("BOOM" in t for t in texts) and len(texts) > 1:
            raise RuntimeError("batch")
        if any("NEVER" in t for t in texts):
            raise RuntimeError("record")
        return [[{"start": m.start(), "end": m.end(), "text": m.group(), "label": "Person", "score": 0.9 if len(m.group()) > 2 else 0.1}
                 for m in re.finditer(r"[A-Z][a-z]+", t)] + [{"start": 0, "end": 999, "text": "bad", "label": "Person"},
                                                              {"start": 0, "end": 1, "text": " [", "label": "Person"}] for t in texts]
    return tag


def test_tagger_chunks_batches_and_retries(spark):
    df = spark.createDataFrame([(0, "Ana saw Rui and Al"), (1, "BOOM Bia"), (2, "NEVER Cid"), (3, None), (4, "Eva Eva")], "row_idx int, text string")
    rows = {r.row_idx: r for r in ex.extract_entities(df, capital_tagger, threshold=0.5, max_tokens=2).collect()}
    assert [(e.start, e.end, e.text) for e in rows[0].entities] == [(0, 3, "Ana"), (8, 11, "Rui")]
    assert rows[1].tagger_ok and [e.text for e in rows[1].entities] == ["Bia"]
    assert not rows[2].tagger_ok and rows[2].entities == []
    assert rows[3].entities == [] and [(e.start, e.end) for e in rows[4].entities] == [(0, 3), (4, 7)]


def test_native_taggers(spark):
    df = spark.createDataFrame([(0, "rio de janeiro, Rio"), (1, "nada")], "row_idx int, text string")
    found = df.select(ex.regex_tagger(F.col("text"), {"Location": "[Rr]io", "Number": "[0-9]+"}).alias("e")).head().e
    assert [(x.start, x.end, x.label, x.text) for x in found] == [(0, 3, "Location", "rio"), (16, 19, "Location", "Rio")]
    terms = spark.createDataFrame([("rio de janeiro", "Location"), ("RIO", "Location")], "term string, label string")
    ents = ex.dictionary_tagger(df, terms, max_words=3, ignore_case=True)
    assert sorted((e.row_idx, e.start, e.end, e.text) for e in ents.collect()) == [(0, 0, 3, "rio"), (0, 0, 14, "rio de janeiro"), (0, 16, 19, "Rio")]
    back = ex.collect_entities(df, ents).orderBy("row_idx").collect()
    assert len(back[0].entities) == 3 and back[1].entities == []


def test_dedupe_entities(spark):
    kind = "array<struct<start:int,end:int,label:string,text:string,score:double>>"
    df = spark.createDataFrame([([(5, 6, "A", "x", .1), (0, 1, "A", "x", .2), (5, 6, "A", "x", .9), (5, 6, "B", "x", .3)],)], f"e {kind}")
    assert [x.score for x in df.select(ex.dedupe_entities(F.col("e")).alias("e")).head().e] == [.1, .2, .3]


def test_bio_tags_first_span_wins(spark):
    df = spark.createDataFrame([(0, "Ana Maria mora aqui", [(0, 9, "Person"), (4, 9, "Location"), (15, 17, "X")]), (1, "so texto", [])],
                               f"row_idx int, text string, spans {SP}")
    rows = ex.bio_tags(df).orderBy("row_idx", "tok_idx").collect()
    assert [(r.token, r.tag) for r in rows] == [("Ana", "B-PER"), ("Maria", "I-PER"), ("mora", "O"), ("aqui", "O"), ("so", "O"), ("texto", "O")]


def test_bio_against_brute_force(spark):
    import re
    rng = __import__("random").Random(11)
    rows = []
    for i in range(20):
        text = " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(1, 90)))
        rows.append((i, text, [(a, a + rng.randint(1, 30), rng.choice(["Person", "Org"])) for a in (rng.randint(0, len(text)) for _ in range(8))]))
    df = spark.createDataFrame(rows, f"row_idx int, text string, spans {SP}")
    got = {(r.row_idx, r.tok_idx): r.tag for r in ex.bio_tags(df).collect()}
    for i, text, spans in rows:
        for j, m in enumerate(re.finditer(r"\w+|[^\w\s]", text)):
            want = "O"
            for a, b, label in spans:
                if m.start() >= a and m.end() <= b:
                    want = ("B-" if m.start() == a else "I-") + label.upper()[:3]
                    break
            assert got[(i, j)] == want


def test_char_offsets_mentions_segments(spark):
    df = spark.createDataFrame([(["John", "in", "Rio"], [(0, 0, "P"), (2, 2, "L"), (2, 7, "L")])], f"t array<string>, n {TS}")
    assert [tuple(x) for x in df.select(ex.tokens_to_char_offsets(F.col("t"), F.col("n")).alias("s")).head().s] == [(0, 4, "P"), (8, 11, "L")]
    txt = spark.createDataFrame([("Rio e Rio e Ana", [(0, 3, "Location"), (6, 9, "Location"), (12, 15, "Person"), (1, 4, "Z")])], f"text string, spans {SP}")
    ments = ex.to_mention_lists(txt, {"Location": "place"}).head().output.entities
    assert ments == {"place": ["Rio"], "person": ["Ana"], "z": ["io"]}
    seg = txt.select(ex.segment_text(F.col("text"), F.col("spans")).alias("s")).head().s
    assert [(x.text, x.label) for x in seg] == [("Rio", "Location"), (" e ", None), ("Rio", "Location"), (" e ", None), ("Ana", "Person")]


def test_clean_and_sanitize(spark):
    kind = "array<struct<start:int,end:int,label:string,text:string>>"
    df = spark.createDataFrame([("abc def", [(0, 3, "A", "abc"), (0, 3, "A", " CLS "), (-1, 2, "A", "x"), (0, 99, "A", "x"), (0, 3, "A", "a@b"), (4, 7, "A", "dé-f o'x.")])], f"t string, e {kind}")
    r = df.select(clean_entities(F.col("e"), F.length("t")).alias("a"), clean_entities(F.col("e"), F.length("t"), False).alias("b")).head()
    assert [x.text for x in r.a] == ["abc", "dé-f o'x."] and [x.text for x in r.b] == ["abc", "a@b", "dé-f o'x."]
    s = spark.createDataFrame([("abcd", [(2, 4, " B "), (0, 9, "A"), (0, 2, "A"), (3, 3, "A"), (0, 1, " ")])], f"t string, s {SP}")
    assert [tuple(x) for x in s.select(sanitize_spans(F.col("s"), F.col("t")).alias("s")).head().s] == [(0, 2, "A"), (2, 4, "B")]


def test_dictionary_words_in_one_pass(spark):
    """A token is its own text (no walk through the record for each), and a small dictionary is broadcast whatever it was made of."""
    texts = ["Zoë ißt das  Brot, das Brot", " das", "", None, "x　das é" + " wort" * 500 + " das"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_idx int, text string")
    out = ex.dictionary_tagger(df, spark.createDataFrame([("das", "A"), ("Brot", "B")], "term string, label string"), strategy="whitespace")
    want = [(i, m.start(), m.end(), {"das": "A"}.get(m.group(), "B"), m.group()) for i, t in enumerate(texts) for m in re.finditer(r"\S+", t or "") if m.group() in ("das", "Brot")]
    assert sorted(tuple(r)[:5] for r in out.collect()) == sorted(want) and len(want) == 6
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "substring" not in plan and "BroadcastHashJoin" in plan
