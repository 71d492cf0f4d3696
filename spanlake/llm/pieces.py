"""SentencePiece encoding and decoding of merge-type (BPE) models with a table of prefixes.

For a merge-type vocabulary every prefix of a text has one last token, whatever follows the prefix.  Reading the text
once, an automaton lists the pieces that end at each character; the last token there is the one piece that is
compatible with the last token of the prefix before it, where two tokens are compatible if the merges
leave them apart.  The ids of the whole text are then read backwards through the table.  The time is linear in the text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import model_bytes, python_ready

SPACE = "▁"
#: Entries of a worker's caches, and the longest part of a text that they keep.
CACHE, CACHED_CHARS = 300_000, 40


class Memo(dict):
    """A function's results for the keys it met lately: at most twice ``size`` entries, old ones go first."""

    def __init__(self, make, size: int = CACHE):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class PieceModel:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, data: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.scores = [sp.get_score(i) for i in range(len(self.pieces))]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and i not in self.bytes_of}
        self.unknown = sp.unk_id()
        if any(SPACE in p.strip(SPACE) or p.endswith(SPACE) and p.strip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses the start of a word")
        # Letters and other characters are apart where no piece holds both; else words stay whole.
        signs = re.escape("".join(sorted(c for c in {c for p in self.ids for c in p} if c.isalnum() and not c.isalpha() and not c.isdecimal())))
        letters, others = rf"[^\W\d_{signs}]+", rf"(?:[\d_{signs}]|[^\w{SPACE}])+"
        apart = all(re.fullmatch(f"{letters}|{others}|", p.lstrip(SPACE)) for p in self.ids)
        self.parts = re.compile(f"{SPACE}*(?:{letters}|{others})|{SPACE}+" if apart else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def split(self, text: str) -> list[str]:
        """Parts that no piece crosses; together the text with its leading space, spaces shown as pieces show them."""
        return self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def fallback(self, char: str) -> list[int]:
        """The ids of a character without a piece."""
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]


class MergeEncoder:
    """Encoder and decoder of a merge-type model."""

    def __init__(self, data: bytes):
        import ahocorasick
        self.model = PieceModel(data)
        self.score = {p: self.model.scores[i] for p, i in self.model.ids.items()}
        # Pieces that the merges never make from their own characters can't stand in a result.
        self.automaton = ahocorasick.Automaton()
        for p in self.model.ids:
            if SPACE * 2 not in p and self.merged(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[str]] = {}
        self.known = Memo(self.part)

    def merged(self, text: str) -> list[str]:
        """The merges by their definition: best score first, leftmost first among equals."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str, int]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j], j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[j] is None or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """The merges keep ``a`` and ``b`` apart when they stand side by side."""
        pair = a, b
        if (ok := self.pairs.get(pair)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[pair] = self.merged(a + b) == [a, b]
        return ok

    def tokens(self, word: str) -> list[str]:
        """Pieces of a word; a character without a piece stands for itself."""
        last: list[str] = [""] * (len(word) + 1)
        for end, piece in self.automaton.iter(word):
            end += 1
            if last[end]:
                continue
            start = end - len(piece)
            before = last[start]
            if not start or not before or self.compatible(before, piece):
                last[end] = piece
        out, at = [], len(word)
        while at:
            out.append(last[at] or word[at - 1])
            at -= len(out[-1])
        out.reverse()
        return out

    def run(self, n: int) -> list[str]:
        """Pieces of ``n`` spaces; all these pieces have one score, so their merges are followed as they are defined."""
        if n not in self.runs:
            if len(self.runs) >= 1000:
                self.runs.clear()
            self.runs[n] = self.merged(SPACE * n)
        return self.runs[n]

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part: spaces, then a word that takes the last of them with it if its pieces do."""
        word = part.lstrip(SPACE)
        spaces = len(part) - len(word)
        tokens = self.tokens(SPACE + word) if spaces and word else self.tokens(word)
        if spaces and word:
            alone = tokens[0] == SPACE
            tokens = self.run(spaces if alone else spaces - 1) + tokens[alone:]
        elif spaces:
            tokens = self.run(spaces)
        ids = self.model.ids
        return [x for t in tokens for x in ([ids[t]] if t in ids else self.model.fallback(t))]

    def part(self, part: str) -> tuple[str, int, bytes]:
        """(ids joined by commas, their number, the text they decode to) of one part."""
        ids = self.part_ids(part)
        return ",".join(map(str, ids)), len(ids), self.decode_bytes(ids)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces and bytes behind ``ids``, with the leading space that encoding adds."""
        pieces, raw = self.model.pieces, self.model.bytes_of
        return b"".join(bytes([raw[i]]) if i in raw else pieces[i].replace(SPACE, " ").encode() for i in ids)

    def encode(self, text: str) -> list[int]:
        return [x for p in self.model.split(text) for x in self.part_ids(p)]

    def decode(self, ids: list[int]) -> str:
        """The text behind ``ids``: without the leading space that encoding adds; bytes that aren't UTF-8 show as U+FFFD."""
        data = self.decode_bytes(ids)
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


_ENCODERS: dict[int, MergeEncoder] = {}


def _encoder(model) -> MergeEncoder:
    """One encoder per worker process and model."""
    key = hash(model.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = MergeEncoder(model.value)
    return _ENCODERS[key]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and the text decoded from them: id, ``ids`` (list of int), ``decoded``.

    NULL counts as empty and has no ids; other columns play no part; every row comes back once.
    """
    python_ready(docs.sparkSession)
    model = model_bytes(docs.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        encoder = _encoder(model)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "ids": ids, "decoded": [encoder.decode(x) for x in ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` (of the ids joined by commas), ``decoded_sha256``; like ``encode_pieces``, but only digests
    leave the workers, and parts of texts that were seen before come from a bounded cache."""
    python_ready(docs.sparkSession)
    model = model_bytes(docs.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator:
        from hashlib import sha256

        import pyarrow as pa
        encoder = _encoder(model)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                parts = list(map(encoder.known.__getitem__, encoder.model.split(text or "")))
                n.append(sum(p[1] for p in parts))
                ids.append(sha256(",".join([p[0] for p in parts]).encode()).hexdigest())
                # Checked for UTF-8 as a whole: the bytes of one character may come from several pieces.
                data = b"".join([p[2] for p in parts])
                decoded.append(sha256((data[1:] if data[:1] == b" " else data).decode(errors="replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
                                             names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
