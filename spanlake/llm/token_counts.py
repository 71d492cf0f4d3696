"""Token counts of a unigram vocabulary without making the tokens.

An automaton lists the pieces that end at each character; going through the text once, the best score of every prefix and
the number of its pieces are all that is kept.  Of paths with equal scores the one whose last piece is the longest
wins, as in the tokenizer, which tries starts from left to right and keeps a path unless a later one is
strictly better.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import model_bytes, python_ready
from spanlake.llm.pieces import Memo, PieceModel

#: How far a character without a piece scores below the worst piece (a fixed value of unigram tokenizers).
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts of the best segmentation over the pieces and scores of a model file."""

    def __init__(self, data: bytes):
        import ahocorasick
        self.model = PieceModel(data)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.model.ids.items():
            self.automaton.add_word(p, (len(p), self.model.scores[i]))
        self.automaton.make_automaton()
        self.unknown = min(self.model.scores) - UNKNOWN_PENALTY
        self.known = Memo(self.viterbi)

    def viterbi(self, part: str) -> int:
        best: list[float | None] = [0.0] + [None] * len(part)
        count, done = [0] * (len(part) + 1), 0
        for end, (length, score) in self.automaton.iter(part):
            end += 1
            if end > done + 1:
                self._unknown(part, best, count, done, end - 1)
            done = end
            before = best[end - length]
            if best[end] is None or before + score > best[end]:
                best[end], count[end] = before + score, count[end - length] + 1
        self._unknown(part, best, count, done, len(part))
        return count[-1]

    def _unknown(self, part: str, best: list, count: list, start: int, end: int) -> None:
        """Characters from ``start`` to ``end`` belong to no piece: each stands for its bytes, or for one unknown id."""
        for i in range(start, end):
            best[i + 1] = best[i] + self.unknown
            count[i + 1] = count[i] + (len(part[i].encode()) if self.model.byte_ids else 1)

    def count(self, text: str) -> int:
        """Number of tokens of a whole text: the sum over parts that no piece crosses."""
        return sum(map(self.known.__getitem__, self.model.split(text)))


_COUNTERS: dict[int, UnigramCounter] = {}


def _counter(model) -> UnigramCounter:
    key = hash(model.value)
    if key not in _COUNTERS:
        _COUNTERS[key] = UnigramCounter(model.value)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_chars``, ``n_tokens`` of every whole text.  NULL and empty texts have no tokens; every row comes back
    once; other columns play no part."""
    python_ready(docs.sparkSession)
    model = model_bytes(docs.sparkSession, model_path)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        counter = _counter(model)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([counter.count(t or "") for t in texts], pa.int64())],
                names=["id", "n_chars", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_chars long, n_tokens long").withColumnRenamed("id", id_col)
