"""Encoding, counting and packing against the tokenizer libraries."""

from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import sentencepiece
from corpus import SF, empty, frame, rows
from tokenizers import Tokenizer, models

from spanlake.llm import packing as pk
from spanlake.llm import pieces as pc
from spanlake.llm import token_counts as tc
from spanlake.llm.queries import PIECE_MODEL, WORD_MODEL

DATA = open(PIECE_MODEL, "rb").read()


def odd_texts(n, seed):
    rng = random.Random(seed)
    signs = list("ab cthe. \n\t▁é日本語🎉 ing&&& 0123²½\x00'sΣς\x85\xa0\x1cİßſ") + ["the", "'re", "  "]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [" " * k + "a" * (k % 3) for k in range(70)]


def test_encoder_equals_the_library():
    encoder, library = pc.MergeEncoder(DATA), sentencepiece.SentencePieceProcessor(model_proto=DATA)
    rng = random.Random(1)
    texts = odd_texts(1500, 2) + ["".join(rng.choice(encoder.model.pieces[300:20000]) for _ in range(8)) for _ in range(1500)] + ["x" * 5000, "ab" * 3000, " " * 4000]
    for text in texts:
        ids = library.encode(text)
        assert encoder.encode(text) == ids and encoder.decode(ids) == library.decode(ids)


def test_decoding_of_any_ids():
    encoder, library = pc.MergeEncoder(DATA), sentencepiece.SentencePieceProcessor(model_proto=DATA)
    rng = random.Random(4)
    for _ in range(500):
        ids = [rng.randrange(259, 32000) for _ in range(rng.randint(0, 9))]
        assert encoder.decode(ids) == library.decode(ids)


def test_piece_digests(spark):
    library = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    digest = lambda s: sha256(s.encode()).hexdigest()
    want = []
    for i, text, *_ in rows():
        ids = library.encode(text or "")
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    got = [tuple(r) for r in pc.piece_digests(frame(spark), PIECE_MODEL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    full = pc.encode_pieces(frame(spark), PIECE_MODEL).collect()
    assert sorted(((r.doc_id, len(r.ids), digest(",".join(map(str, r.ids))), digest(r.decoded)) for r in full), key=repr) == sorted(want, key=repr)
    assert pc.piece_digests(empty(spark), PIECE_MODEL).count() == 0


def test_counts_equal_the_unigram_tokenizer(spark):
    counter = tc.UnigramCounter(DATA)
    model = counter.model
    library = Tokenizer(models.Unigram(list(zip(model.pieces, model.scores)), unk_id=0, byte_fallback=True))
    want = lambda t: len(library.encode(pc.SPACE + t.replace(" ", pc.SPACE), add_special_tokens=False).ids) if t else 0
    for text in odd_texts(1500, 3):
        assert counter.count(text) == want(text)
    got = [(r.doc_id, r.n_tokens) for r in tc.count_tokens(frame(spark), PIECE_MODEL).collect()]
    assert sorted(got, key=repr) == sorted(((i, want(t or "")) for i, t, *_ in rows()), key=repr)
    assert tc.count_tokens(empty(spark), PIECE_MODEL).count() == 0


def test_word_ids_equal_the_library():
    own, library = pk.WordIds(open(WORD_MODEL, "rb").read()), Tokenizer.from_file(WORD_MODEL)
    for text in odd_texts(3000, 6):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memo_stays_bounded():
    memo = pc.Memo(len, size=10)
    assert [memo["x" * (k % 35)] for k in range(200)] == [k % 35 for k in range(200)]
    assert len(memo) <= 10 and len(memo.old) <= 10 and memo["y" * 100] == 100 and "y" * 100 not in memo


def best_sum(counts, capacity):
    reach = {0}
    for length, n in counts.items():
        for _ in range(n):
            reach |= {x + length for x in reach if x + length <= capacity}
    return max(reach)


def test_fill_is_closest_to_the_capacity():
    rng = random.Random(8)
    for _ in range(200):
        counts = {rng.randint(1, 60): rng.randint(1, 4) for _ in range(rng.randint(0, 6))}
        capacity = rng.randint(0, 90)
        taken = pk.fill(counts, capacity)
        assert all(0 < n <= counts[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == best_sum(counts, capacity)


def check_packed(docs, got, window):
    library, pieces, sequences = Tokenizer.from_file(WORD_MODEL), {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    left = sorted((i if i is not None else -1, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in docs)
    assert sorted((i if i is not None else -1, r.doc_tokens) for i, rs in pieces.items() for r in rs if r.start == 0) == left
    for i, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = {r.start: r for r in pieces[i] if r.doc_tokens == len(ids)}
        at = 0
        while at < len(ids):
            r = mine[at]
            assert r.ids_crc32 == crc32(ids[at:at + r.length].tobytes())
            at += r.length
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def test_packing(spark):
    docs = [(i, t) for i, t, *_ in rows() if i is not None]
    got = pk.pack_documents(frame(spark, [r for r in rows() if r[0] is not None]), WORD_MODEL, window=256, group_tokens=6000).collect()
    check_packed(docs, got, 256)
    assert pk.pack_documents(frame(spark), WORD_MODEL, window=256).select("sequence_id", "offset").distinct().count() == pk.token_pieces(frame(spark), WORD_MODEL, 256).count()
    assert pk.pack_documents(empty(spark), WORD_MODEL).count() == 0
    withids = pk.pack_documents(frame(spark), WORD_MODEL, window=256, with_ids=True).collect()
    assert all(len(r.ids) == r.length and crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in withids)


def test_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pk.pack_documents(docs, WORD_MODEL).collect()
    check_packed([tuple(r) for r in docs.select("doc_id", "text").collect()], got, 4096)
    tokens, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert sequences <= tokens / 4096 + 2
