"""Packing of token sequences by minimum bin slack.

Documents become token ids once; a document longer than the window is cut into whole windows and a rest.  Pieces are
dealt into groups of about equal token counts, and every group fills its windows one after the other: the longest piece
left is set, then subset sums of the lengths left, kept as the bits of one integer, show which multiset of pieces comes
closest to the capacity; the counts behind the best sum are traced back and taken out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from struct import pack as packed

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import model_bytes, python_ready, stored
from spanlake.llm.pieces import CACHE, Memo

#: Tokens of a window, the id after each document, tokens of a packing group (a few thousand rows).
WINDOW, END_ID, GROUP_TOKENS = 4096, 2, 4_000_000
WORD = r"[^ \t\n\r]+"

# The pieces into which the tokenizer cuts lower-case text, for characters below U+0180, where
# normalisation changes nothing but case.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼-¾", r" \t-\r\x85\xa0"
LATIN_PIECE = f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
NOT_LATIN = "[^\x00-\u012f\u0131-\u017f]"


class WordIds:
    """Little-endian 32-bit ids of texts by a lower-case word tokenizer, which never crosses white space.

    Every part of a text that the tokenizer treats by itself is looked up in a bounded cache: the pieces between
    letters, numbers and signs in Latin texts, whole words in others.
    """

    def __init__(self, data: bytes):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.words, self.pieces, self.other = re.compile(WORD), re.compile(LATIN_PIECE), re.compile(NOT_LATIN)
        self.known = Memo(self.word, 2 * CACHE)

    def word(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return packed(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> bytes:
        found = self.words.findall(text) if self.other.search(text) else self.pieces.findall(text.lower())
        return b"".join(map(self.known.__getitem__, found))


_TOKENIZERS: dict[int, WordIds] = {}


def _tokenizer(model) -> WordIds:
    key = hash(model.value)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordIds(model.value)
    return _TOKENIZERS[key]


def token_pieces(docs: DataFrame, model_path: str, window: int = WINDOW, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document's ids, ``end_id`` included: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``.

    Whole windows first, then the rest.  A NULL text counts as empty: its one piece is the end id.  ``with_ids`` adds the ids
    themselves.
    """
    python_ready(docs.sparkSession)
    model = model_bytes(docs.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import numpy as np
        import pyarrow as pa
        tokenizer, end = _tokenizer(model), int(end_id).to_bytes(4, "little")
        for batch in batches:
            owners, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for owner, text in zip(owners, texts):
                ids = tokenizer.ids(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start:4 * (start + window)]
                    row = owner, start, len(part) // 4, crc32(part), n, np.frombuffer(part, "<u4") if with_ids else None
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)][:5 + with_ids], names=names[:5 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (length -> number) within ``counts`` whose sum comes closest to ``capacity`` from below.

    Longer lengths are tried first, and the search stops once the capacity itself is met.
    """
    full, mask, reach = 1 << capacity, (1 << capacity + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, take = min(counts[length], capacity // length), 1
        while left > 0:  # 1, 2, 4, .. copies and the rest: every number of copies is a sum of these
            n = min(take, left)
            steps.append((length, n, reach))
            reach = (reach | reach << length * n) & mask
            left, take = left - n, take * 2
        if reach & full:
            break
    best, taken = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + n
            best -= length * n
    return taken


def minimum_slack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``lengths`` for each window; every position is in exactly one.  No length exceeds the capacity."""
    stacks: dict[int, list[int]] = {}
    for at in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[at], []).append(at)
    counts = {length: len(x) for length, x in stacks.items()}
    order, windows = sorted(counts), []

    def take(length: int, n: int) -> list[int]:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
        return [stacks[length].pop() for _ in range(n)]

    while counts:
        while order[-1] not in counts:
            order.pop()
        window = take(order[-1], 1)
        if order[-1] < capacity:
            for length, n in fill(counts, capacity - order[-1]).items():
                window += take(length, n)
        windows.append(window)
    return windows


def pack(pieces: DataFrame, window: int = WINDOW, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    The number of groups follows from the token total; a group is one task's work and holds a few thousand rows.
    """
    pieces = stored(pieces, "token-pieces")
    # Rows of one id, however many, are told apart by their start and digest.
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    keyed = pieces.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(groups)))
    columns = pieces.columns

    def run(key, group):
        group = group.sort_values([id_col, "start", "ids_crc32"], kind="stable", ignore_index=True)
        sequence, offset, lengths = [0] * len(group), [0] * len(group), group["length"].tolist()
        for number, members in enumerate(minimum_slack(lengths, window)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (int(key[0]) << 32) + number, at
                at += lengths[i]
        return group[columns].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return keyed.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, model_path: str, window: int = WINDOW, end_id: int = END_ID, group_tokens: int = GROUP_TOKENS,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of all documents packed into windows; see ``token_pieces`` and ``pack``.  An empty table gives no rows."""
    return pack(token_pieces(docs, model_path, window, end_id, id_col, text_col, with_ids), window, group_tokens, id_col)
