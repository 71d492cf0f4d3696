"""Spelling variants: words one letter apart, each pointed at the most frequent of its near words.

Words one insertion, deletion or replacement apart agree in a half: of two words whose shorter one has ``m`` letters, either
the first ``m // 2`` letters are equal or the last ``m - m // 2``.  So words meet only in groups of one half, and a
pair is counted in the group of its first half if that is equal, else in that of its last half.  Inside a group lies a bit-sliced
position index: for every position and letter a bitset over the group's words.  A query word walks its letters once, with
one set of words met without an error and three met with one error (replaced, one letter more, one letter less, the
last two at positions shifted by one); every step is a handful of word-parallel bit operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import python_ready, stored

#: Least letters and least occurrences of a word; how many times as frequent its form must be.
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter, drawn by the checksum of its document and itself.
SPOIL = 199
#: Words of a group in one index; larger groups get several, and every word of the group is looked up in each.
CHUNK = 8192
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_ascii(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def word_counts(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, spoil: int | None = SPOIL,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, counted; runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case.

    With ``spoil`` = k, a run loses the letter ``h % length`` if k divides h, the CRC-32 of ``<id>:<run>`` (a NULL id is written as
    nothing).  NULL and empty texts have no words; repeated rows count as often as they are there.  Counts are added up before the shuffle.
    """
    # A shorter run can't become a word, so it isn't taken out of the text at all.
    runs = docs.select(F.col(id_col).cast("string").alias("_id"), F.explode(F.regexp_extract_all(
        F.col(text_col), F.lit(f"[A-Za-zÀ-ÿ]{{{min_letters},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_id", _lower_ascii(F.col("_run")).alias("run"))
    word = F.col("run")
    if spoil:
        h, run = F.crc32(F.concat(F.coalesce("_id", F.lit("")), F.lit(":"), "run").cast("binary")), F.col("run")
        at = (h % F.length(run)).cast("int")
        word = F.when(h % spoil == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    counted = runs.select(word.alias("word")).filter(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_count)


class PositionIndex:
    """Bitsets over a list of letter strings of length ``short`` or one more, by position and letter."""

    def __init__(self, words: list[str], short: int):
        self.short = short
        self.all = (1 << len(words)) - 1
        at: list[dict[str, bytearray]] = [{} for _ in range(short + 3)]  # one position beyond either end stays empty
        size = len(words) // 8 + 1
        long = bytearray(size)
        for i, word in enumerate(words):
            byte, bit = i >> 3, 1 << (i & 7)
            if len(word) > short:
                long[byte] |= bit
            for p, letter in enumerate(word):
                row = at[p + 1].get(letter)
                if row is None:
                    row = at[p + 1][letter] = bytearray(size)
                row[byte] |= bit
        self.at = [{c: int.from_bytes(row, "little") for c, row in d.items()} for d in at]
        self.long = int.from_bytes(long, "little")

    def near(self, word: str, same_start: int) -> int:
        """The indexed words one error from ``word``, without pairs of two long ones and, if ``same_start``, without those with its first letters.

        ``zero`` are the words met without an error so far; ``other``, ``more`` and ``less`` those met with one:
        a replaced letter, a letter more than ``word``, a letter less.
        """
        at, short, zero, other, more, less, started = self.at, self.short, self.all, 0, 0, 0, 0
        if len(word) > short:  # only shorter words are looked for
            for p, letter in enumerate(word):
                if p == same_start:
                    started = zero
                less = less & at[p].get(letter, 0) | zero
                zero &= at[p + 1].get(letter, 0)
            found = less & ~self.long
        else:
            for p, letter in enumerate(word):
                if p == same_start:
                    started = zero
                here = at[p + 1].get(letter, 0)
                more = (more | zero) & at[p + 2].get(letter, 0)
                other = other & here | zero & ~here
                zero &= here
            found = other & ~self.long | (more | zero) & self.long
        if same_start == len(word):
            started = zero
        return found & ~started if same_start else found


def halves(word: Column) -> Column:
    """The groups a word belongs to: (m, side, half) for ``m`` its length and one less; ``m`` is the length of a pair's shorter word."""
    n = F.length(word)
    both = []
    for m in (n, n - 1):
        h = F.floor(m / 2).cast("int")
        both += [F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring(word, F.lit(1), h).alias("half")),
                 F.struct(m.alias("m"), F.lit(1).alias("side"), F.substring(word, n - m + h + 1, m).alias("half"))]
    return F.array(*both)


def _rest(word: str, m: int, side: int) -> str:
    """What two words of a group may differ in."""
    return word[m // 2:] if side == 0 else word[:len(word) - (m - m // 2)]


def _look_up(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(word, near words, n of the most frequent, that word) of rows (m, side, half, chunk, indexed, n, word), sorted so that a group's indexed words come first, frequent ones before rare ones."""
    group, members, index, single = None, [], None, 0
    waiting: list[str] = []

    def found(word: str) -> tuple | None:
        m, side = group[0], group[1]
        hits = index.near(_rest(word, m, side), m // 2 if side else 0)
        if hits:
            best = members[(hits & -hits).bit_length() - 1]
            return word, hits.bit_count(), best[0], best[1]
        return None

    def flush() -> Iterator[tuple]:
        nonlocal index
        if group is not None and index is None:
            m, side = group[0], group[1]
            index = PositionIndex([_rest(w, m, side) for _, w in members], m - m // 2 if side == 0 else m // 2)
            for word in waiting:
                if hit := found(word):
                    yield hit
            waiting.clear()

    for m, side, half, chunk, indexed, n, word in rows:
        key = (m, side, half, chunk)
        if key != group:
            yield from flush()
            group, members, index = key, [], None
        if indexed:
            members.append((n, word))
            waiting.append(word)
        else:
            yield from flush()
            if hit := found(word):
                yield hit
    yield from flush()


def near_words(vocabulary: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of a written ``vocabulary`` (word, n) that have near words.

    ``best`` is the near word of largest n, of equal ones the first in code-point order.  All near words are found: a group larger than
    ``chunk`` is indexed in several parts, each looked up by the whole group.
    """
    python_ready(vocabulary.sparkSession)
    rows = stored(vocabulary.select("word", "n", F.explode(halves(F.col("word"))).alias("g")).select("word", "n", "g.*"), "word-halves")
    key = ["m", "side", "half"]
    # A group without both a short word and another word has no pair.
    sizes = rows.groupBy(*key).agg(F.count("*").alias("members"), F.min(F.length("word")).alias("least"))
    sizes = stored(sizes.filter((F.col("members") > 1) & (F.col("least") == F.col("m"))).select(*[F.col(c).alias(f"_{c}") for c in key], F.ceil(F.col("members") / chunk).cast("int").alias("parts")), "half-sizes")
    met = rows.join(sizes, (F.col("m") == F.col("_m")) & (F.col("side") == F.col("_side")) & (F.col("half") == F.col("_half")))
    met = met.select(*key, "word", "n", F.pmod(F.xxhash64("word"), "parts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = met.select(*key, "part", (F.col("own") == F.col("part")).alias("indexed"), "n", "word")
    met = met.repartition(*key, "part").sortWithinPartitions(*key, "part", F.desc("indexed"), F.desc("n"), "word")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        names, kinds = ["word", "n_near", "best_n", "best"], [pa.string(), pa.int64(), pa.int64(), pa.string()]

        def pack(out: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

        out: list[tuple] = []
        for hit in _look_up(row for b in batches for row in zip(*[b.column(i).to_pylist() for i in range(7)])):
            out.append(hit)
            if len(out) == 10_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    hits = met.mapInArrow(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return hits.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def last_forms(edges: DataFrame) -> DataFrame:
    """(word, to): the end of the path from each word of ``edges`` (word, to), by doubling; paths must end.

    A path whose counts grow by a factor has few steps, so a handful of rounds is enough; each is one join of written tables.
    """
    while True:
        ahead = edges.select(F.col("word").alias("_word"), F.col("to").alias("_to"))
        jumped = stored(edges.join(ahead, F.col("to") == F.col("_word"), "left").select("word", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")), "roots")
        moved = jumped.filter("moved").limit(1).count()
        edges = jumped.select("word", "to")
        if not moved:
            return edges


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every word of ``vocabulary`` (word, n; other columns play no part).

    Two words are near if they differ by one inserted, deleted or replaced code point.  ``form`` is the near word of largest n (ties: the
    first in code-point order) if that is at least ``ratio`` (2 or more) times the word's own n, else NULL; ``root`` is the last form on the way from the
    word, itself without one.  Rows without a word or n, and words of fewer than two letters, are left out; of repeated words the
    counts are added up.  An empty vocabulary gives no rows; words may be of any length.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms have to grow")
    words = stored(vocabulary.filter((F.length("word") > 1) & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "vocabulary")
    near = stored(near_words(words, chunk).withColumnRenamed("word", "_word"), "near-words")
    good = F.col("best_n") >= ratio * F.col("n")
    joined = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n"))
    formed = stored(joined, "forms")
    roots = last_forms(formed.filter("form is not null").select("word", F.col("form").alias("to"))).select(F.col("word").alias("_word"), "to")
    return formed.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def variants_of(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, spoil: int | None = SPOIL,
                chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_variants`` of the words of all texts (``word_counts``)."""
    return spelling_variants(word_counts(docs, min_letters, min_count, spoil, id_col, text_col), ratio, chunk)
