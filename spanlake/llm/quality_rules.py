"""Quality rules: plain text statistics and a hashed n-gram likelihood ratio.

Word unigrams and bigrams of the trusted texts and of the whole corpus are counted in hash buckets; the two
multinomials give every bucket a log ratio, and a document's score is the mean of the log ratios of its n-grams.
There are as many buckets as the corpus's n-grams call for.  A text's n-grams are sorted, counted and packed by ranges of buckets; one shuffle
brings every range together, where its n-grams are counted, get their ratios and are summed by text again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind
from spanlake.llm.common import SPACE_RUN, SPACES, row_key, stored, words_of
from spanlake.operators.staging import once

#: Hash buckets of the n-grams: those of a model held in memory, and the least of a written one.
BUCKETS = 16384
#: N-grams of the corpus to a bucket of a written model: few enough that rare n-grams don't drown in ordinary text.
BUCKET_GRAMS = 32
#: A written model's log ratios are whole multiples of 1 / ``UNITS``: their sums don't depend on the order.
UNITS = 1 << 40
#: Trusted n-grams added to each bucket, and as many times the corpus is larger, corpus n-grams: a bucket with few n-grams says little.
SMOOTHING = 20.0
#: Mean log ratio under which a document is not like the trusted texts.
MIN_SCORE = -0.1
#: Ranges that the buckets are cut into at least; bits of a bucket's place in its range, and times that one packed n-gram counts at most.
RANGES, PLACE_BITS, MOST_TIMES = 8, 21, 7
#: Bytes of trusted ids, as bitmaps, that are broadcast at most (half a billion ids without gaps); more are joined by a shuffle.
MOST_MARKS = 64 << 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _rest(values: str, skip: int) -> Column:
    return F.slice(values, F.lit(skip + 1), F.greatest(F.size(values) - skip, F.lit(0)))


def _mixed(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _joined(rows: DataFrame, name: str, values: str, others: str, skip: int, when: Column | None = None) -> DataFrame:
    """``rows`` with hashes of each of ``values`` and the one ``skip`` later in ``others``; an empty list where ``when`` is false.

    List functions that Spark compiles stand in steps of their own: in one step with a lambda function they would be interpreted.
    """
    hashes = F.zip_with(values, "_later", _mixed)
    rows = rows.withColumn("_later", _rest(others, skip))
    rows = once(rows, _joined=hashes if when is None else F.when(when, hashes).otherwise(F.array().cast("array<bigint>")))
    return rows.withColumn(name, F.slice("_joined", F.lit(1), F.size("_later"))).drop("_joined", "_later")


def _with_words(rows: DataFrame) -> DataFrame:
    """``rows`` (_text, ..) with their ``words_of``: between runs of white space only the first and the last piece can be empty."""
    rows = once(rows, words=F.split(F.coalesce(F.col("_text"), F.lit("")), SPACE_RUN, -1))
    first, last = ((F.element_at("words", k) == "").cast("int") for k in (1, -1))
    return rows.withColumn("words", F.slice("words", first + 1, F.greatest(F.size("words") - first - last, F.lit(0))))


def _with_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` (words, ..) with the hashes of the words and those of neighbouring ``pairs``."""
    return _joined(once(rows, hashes=_word_hashes(F.col("words"))), "pairs", "hashes", "hashes", 1)


def _with_repeated(rows: DataFrame) -> DataFrame:
    """``rows`` (words, hashes, pairs, ..) with ``n_repeat_words``: words inside windows of five words that occur twice or more.

    A window that comes again brings four pairs of words, two runs of four words and one of five that were there before: the counts of
    different hashes rule out texts without a repeat, the cheapest first. The others are decided on the words themselves.
    """
    none = F.lit(0).cast("long")
    again = lambda a: F.size(a) - F.size(F.array_distinct(a))
    word = lambda i: F.get(F.col("words"), i)
    starts = F.sequence(F.lit(0), F.size("fives") - 1)

    def covered(found: Column) -> Column:
        at = F.sort_array(F.transform(found, lambda x: x["at"]))
        gaps = lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(WINDOW))))
        return bind(at, lambda p: F.when(F.size(p) == 0, none).otherwise(F.aggregate(gaps(p), none, lambda a, x: a + x)))

    def decided(found: Column) -> Column:
        """Neighbours of one hash are compared; should they ever differ, the text's windows are sorted by their words."""
        differ = lambda x, y: ~reduce(and_, [word(x["at"] + j) == word(y["at"] + j) for j in range(WINDOW)])
        clash = F.filter(found, lambda x, i: (x["k"] == F.get(found, i - 1)["k"]) & differ(x, F.get(found, i - 1)))
        spelled = F.sort_array(F.zip_with("fives", starts, lambda _, i: F.struct(F.array(*[word(i + j) for j in range(WINDOW)]).alias("k"), i.alias("at"))))
        return F.when(F.size(clash) == 0, covered(found)).otherwise(bind(spelled, lambda s: covered(twice(s))))

    # (hash, start) sorted: equal windows are neighbours.
    windows = F.sort_array(F.zip_with("fives", starts, lambda h, i: F.struct(h.alias("k"), i.alias("at"))))
    twice = lambda s: F.filter(s, lambda x, i: (x["k"] == F.get(s, i - 1)["k"]) | (x["k"] == F.get(s, i + 1)["k"]))
    rows = _joined(rows.withColumn("_again", again("pairs")), "fours", "pairs", "pairs", 2, F.col("_again") >= 4)
    rows = _joined(rows.withColumn("_again", again("fours")), "fives", "fours", "hashes", 4, F.col("_again") >= 2)
    repeated = bind(windows, lambda s: bind(twice(s), decided))
    return once(rows.withColumn("_again", again("fives")), n_repeat_words=F.when(F.col("_again") == 0, none).otherwise(repeated)).drop("fours", "fives", "_again")


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all unigrams, then of all bigrams, from the hashes of a text's words."""
    m, kind = F.lit(buckets).cast("long"), "int" if buckets <= 1 << 31 else "long"
    one = F.transform(hashes, lambda h: F.pmod(h, m).cast(kind))
    two = F.zip_with(hashes, F.slice(hashes, F.lit(2), F.greatest(F.size(hashes) - 1, F.lit(0))),
                     lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), m).cast(kind)))
    return F.concat(one, F.slice(two, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))))


def _bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """(bucket, corpus, target): n-grams of all texts and of those whose id is in ``trusted``; added up before the shuffle."""
    marks = trusted.select(F.col(id_col).alias("_trusted")).filter("_trusted is not null").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    # Trusted ids grow with the corpus: the texts are shuffled to them at any size.
    marked = texts.join(marks.hint("merge"), F.col("_id") == F.col("_trusted"), "left")
    hashes = once(marked.select(F.col("_trusted").isNotNull().alias("in_target"), "_text"), hashes=_word_hashes(words_of(F.col("_text"))))
    grams = hashes.select("in_target", F.explode(ngram_buckets(F.col("hashes"), buckets)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.count(F.when(F.col("in_target"), 1)).alias("target"))


@dataclass(frozen=True)
class RatioTable:
    """A written model: (bucket, units) of every bucket met, its log ratio in ``UNITS``; a bucket never met has ratio 0."""

    table: DataFrame
    buckets: int


def bucket_number(grams: int) -> int:
    """Buckets for a corpus of so many n-grams: the power of two that puts ``BUCKET_GRAMS`` or fewer in one."""
    return max(BUCKETS, 1 << max(0, -(-grams // BUCKET_GRAMS) - 1).bit_length())


def fit_table(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RatioTable:
    """``fit_ratios`` with as many buckets as the n-grams of ``docs`` call for, as a written table; three numbers come back to the driver."""
    n_words = F.size(words_of(F.col(text_col)))
    grams = docs.agg(F.sum(F.greatest(2 * n_words - 1, F.lit(0)).cast("long"))).first()[0] or 0
    buckets = bucket_number(grams)
    counts = stored(_bucket_counts(docs, trusted, id_col, text_col, buckets), "ngram-counts")
    corpus, target = counts.agg(F.sum("corpus"), F.sum("target")).first()
    if not target:  # nothing to compare with: no n-gram speaks for or against a text
        return RatioTable(counts.select("bucket", F.lit(0).cast("long").alias("units")), buckets)
    times = corpus / target
    ratio = F.log((F.col("target") + SMOOTHING) * times / (F.col("corpus") + SMOOTHING * times))
    return RatioTable(counts.select("bucket", F.round(ratio * UNITS).cast("long").alias("units")), buckets)


def fit_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> list[float]:
    """Log ratio trusted / corpus of every bucket, from all texts of ``docs``; ``trusted`` holds ids.

    For small corpora: ``buckets`` numbers come back to the driver.  ``fit_table`` grows with the corpus.
    """
    counts = _bucket_counts(docs, trusted, id_col, text_col, buckets)
    corpus, target = [0] * buckets, [0] * buckets
    for row in counts.collect():  # at most ``buckets`` rows
        corpus[row["bucket"]], target[row["bucket"]] = row["corpus"], row["target"]
    return log_ratios(corpus, target)


def log_ratios(corpus: list[int], target: list[int], smoothing: float = SMOOTHING) -> list[float]:
    """log of the smoothed target share over the smoothed corpus share, bucket by bucket.

    Both counts are smoothed in proportion to their totals, so that an n-gram seen only outside the trusted texts
    counts against a text as far as the trusted texts are large enough to expect it there.
    """
    from math import log
    if not sum(target):  # nothing to compare with: no n-gram speaks for or against a text
        return [0.0] * len(corpus)
    times = sum(corpus) / sum(target)
    wide = smoothing * times
    return [log((t + smoothing) * times / (c + wide)) for c, t in zip(corpus, target)]


def joined_scores(docs: DataFrame, model: RatioTable, id_col: str, text_col: str) -> DataFrame:
    """(_scored, score): the mean log ratio of every row with words, by its key; every n-gram is joined with the written table."""
    rows = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("_scored"), F.col(text_col).alias("_text"))
    hashes = once(rows, hashes=_word_hashes(words_of(F.col("_text")))).select("_scored", "hashes")
    grams = hashes.select("_scored", F.explode(ngram_buckets(F.col("hashes"), model.buckets)).alias("bucket"))
    # Frequent n-grams fill partitions, which Spark splits; a partition of the model has few rows.
    met = grams.join(model.table.hint("shuffle_hash"), "bucket", "left")
    # Repeated rows add n-grams and sums alike.
    return met.groupBy("_scored").agg((F.sum(F.coalesce("units", F.lit(0).cast("long"))) / F.count("*") / UNITS).alias("score"))


@dataclass(frozen=True)
class TextScores:
    """(_scored, score): the mean log ratio of every text with words, by the key of its row; the statistics of the rows of ``docs`` (``_numbers``)."""

    table: DataFrame
    numbers: DataFrame
    docs: DataFrame
    columns: tuple[str, str]


def _packed(texts: DataFrame, buckets: int, ranges: int) -> DataFrame:
    """(range, row, low, high) of rows (row, words): a text's different n-grams by ranges of buckets, three bytes each.

    ``low`` has the last 16 bits of an n-gram's place in its range, ``high`` the five before and how often it is there, both less half their range.
    ``buckets`` and ``ranges`` are powers of two.  What Spark compiles is kept apart from the lambda functions, see ``_joined``.
    """
    width, kind = buckets // ranges, "int" if buckets <= 1 << 31 else "long"
    grams = _with_hashes(texts).select("row", F.concat("hashes", "pairs").alias("g"))
    grams = once(grams, g=F.transform("g", lambda h: h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast(kind)))
    sorted_ = once(grams, g=F.sort_array("g")).filter(F.size("g") > 0)
    at = lambda a, i: F.get(F.col(a), i)
    spots = lambda a: F.sequence(F.lit(0), F.size(a) - 1)
    # A run also ends at every so many n-grams, so that its length fits; there is no n-gram before the first.
    runs = once(sorted_.withColumn("_spots", spots("g")), s=F.filter("_spots", lambda i: (at("g", i) != at("g", i - 1)) | (i % MOST_TIMES == 0)))
    runs = runs.withColumn("e", F.concat(_rest("s", 1), F.array(F.size("g"))))
    five = ((width - 1) >> 16) * (MOST_TIMES + 1)
    times = lambda i, e: e - i - 128
    high = lambda i, e: (F.shiftright(at("g", i), 13).bitwiseAND(F.lit(five)) + times(i, e) if five else times(i, e)).cast("tinyint")
    runs = once(runs, v=F.transform("s", lambda i: at("g", i)), high=F.zip_with("s", "e", high)).select("row", "v", "high")
    low = F.transform("v", lambda x: (x.bitwiseAND(F.lit(min(width, 1 << 16) - 1)) - (1 << 15)).cast("smallint"))
    # Sorted numbers that differ in the bits of their range: there the next range begins.
    cuts = once(runs.withColumn("_spots", F.sequence(F.lit(1), F.size("v"))), low=low, c=F.filter("_spots", lambda j: at("v", j).bitwiseXOR(at("v", j - 1)) >= width))
    pieces = cuts.withColumn("c", F.concat(F.array(F.lit(0)), "c")).select("row", "v", "low", "high", "c", F.posexplode("c").alias("k", "i"))
    size = F.coalesce(at("c", F.col("k") + 1), F.size("v")) - F.col("i")
    range_ = F.shiftright(at("v", F.col("i")), width.bit_length() - 1).cast("int")
    return pieces.select(F.coalesce(range_, F.lit(0)).alias("range"), "row", F.slice("low", F.col("i") + 1, size).alias("low"), F.slice("high", F.col("i") + 1, size).alias("high"))


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` (_id, ..) with ``_in``: is the id among the written, distinct ``ids`` (_trusted)?

    Whole-number ids become bitmaps of 32,768 each, which are broadcast after a look at their size, so that no text moves; else, and for ids of other
    types, both sides are joined as Spark plans it.
    """
    if dict(ids.dtypes)["_trusted"] in ("bigint", "int", "smallint", "tinyint"):
        number = lambda c: F.bitmap_bucket_number(F.col(c).cast("long"))
        maps = ids.groupBy(number("_trusted").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_trusted").cast("long"))).alias("_map"))
        if (ids.agg(F.count_distinct(number("_trusted"))).first()[0] or 0) * 4096 <= MOST_MARKS:
            found = rows.join(F.broadcast(stored(maps, "trusted-maps")), number("_id") == F.col("_block"), "left")
            place = F.bitmap_bit_position(F.col("_id").cast("long"))
            byte = F.conv(F.hex(F.substring("_map", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1
            return found.withColumn("_in", F.coalesce(bit, F.lit(False))).drop("_block", "_map")
    return rows.join(ids, F.col("_id") == F.col("_trusted"), "left").withColumn("_in", F.col("_trusted").isNotNull()).drop("_trusted")


def fit_scores(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> TextScores:
    """Fit the ratios on all texts (``trusted`` holds ids) and score the same texts; only totals come back to the driver.

    The n-grams move once, packed; a bucket's count, the lookup of its ratio and the sums by text happen where its range is.
    """
    marks = stored(trusted.select(F.col(id_col).alias("_trusted")).filter("_trusted is not null").distinct(), "trusted-ids")
    numbers = stored(_numbers(docs, id_col, text_col), "rules")
    sizes = _marked(numbers.select("_id", F.greatest(2 * F.col("n_words") - 1, F.lit(0)).alias("_n")), marks)
    corpus, target = (x or 0 for x in sizes.agg(F.sum("_n"), F.sum(F.when(F.col("_in"), F.col("_n")))).first())
    buckets = bucket_number(corpus)
    ranges = max(RANGES, buckets >> PLACE_BITS)
    texts = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull())
    # The row's lowest bit says whether the text is trusted: counting and scoring read the very same columns and share one shuffle.
    row = F.col("_key").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("_in").cast("long"))
    words = _with_words(_marked(texts, marks).select(row.alias("row"), "_text")).select("row", "words")
    moved = _packed(words, buckets, ranges).repartition("range")
    grams = moved.select("range", "row", "high", F.posexplode("low").alias("i", "low"))
    low, high = F.col("low").cast("int") + (1 << 15), F.get("high", F.col("i")).cast("int") + 128
    grams = grams.select("range", "row", (F.shiftright(high, 3) * (1 << 16) + low).alias("place"), high.bitwiseAND(F.lit(MOST_TIMES)).alias("times"))
    counts = grams.groupBy("range", "place").agg(F.sum("times").alias("corpus"), F.sum(F.col("times") * F.col("row").bitwiseAND(F.lit(1))).alias("target"))
    if target:
        ratio = F.round(F.log((F.col("target") + SMOOTHING) * (corpus / target) / (F.col("corpus") + SMOOTHING * (corpus / target))) * UNITS).cast("long")
    else:  # nothing to compare with: no n-gram speaks for or against a text
        ratio = F.lit(0).cast("long")
    model = counts.select(F.col("range").alias("_range"), F.col("place").alias("_place"), ratio.alias("units"))
    met = grams.join(model.hint("shuffle_hash"), (F.col("range") == F.col("_range")) & (F.col("place") == F.col("_place")))
    sums = met.groupBy("row").agg(F.sum(F.col("units") * F.col("times")).alias("units"), F.sum("times").alias("n"))
    scores = sums.select(F.col("row").bitwiseAND(F.lit(-2)).alias("_scored"), (F.col("units") / F.col("n") / UNITS).alias("score"))
    # Both sides of the join lie by range already; Spark need not deal them again by place.
    conf, name = docs.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return TextScores(stored(scores, "scores"), numbers, docs, (id_col, text_col))
    finally:
        conf.set(name, before)


def _numbers(docs: DataFrame, id_col: str, text_col: str, ratios: list[float] | None = None) -> DataFrame:
    """_id, _key and the text statistics of every row, from its words, split and hashed once; with the score if the model is a list."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), row_key(F.col(id_col), F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    rows = _with_words(rows).select(
        "_id", "_key", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"), F.split(text, "\n", -1).alias("lines"))
    rows = once(rows, lines=F.filter("lines", lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0))
    rows = rows.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    rows = _with_repeated(_with_hashes(rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    if ratios is not None:
        # One literal for the whole model, folded when the query is planned.
        model = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
        grams = ngram_buckets(F.col("hashes"), len(ratios))
        total = bind(grams, lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(model, b)) / F.size(g))
        rows, names = once(rows, score=F.when(F.size("words") > 0, F.round(total, 9))), [*names, "score"]
    return rows.select("_id", "_key", *names)


def quality_rules(docs: DataFrame, ratios: list[float] | RatioTable | TextScores, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text statistics, score and verdict of every row; without a shuffle if ``ratios`` is a list, with the scores of ``fit_scores`` by one small join.

    id, ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word, equal to an
    earlier line), ``n_repeat_words`` (words in 5-word windows found twice or more), ``base_failed``, ``score`` (mean log ratio,
    rounded to 9 digits; NULL without words), ``kept``.  NULL and blank texts have no words and fail; repeated rows
    come back as often as they are there, and an empty table gives no rows; very long texts are read whole, as one array of words; a score equal
    to ``min_score`` keeps a text; other columns play no part.
    """
    if isinstance(ratios, RatioTable):
        found, key = stored(joined_scores(docs, ratios, id_col, text_col), "scores"), F.col("_key")
        numbers = stored(_numbers(docs, id_col, text_col), "rules")
    elif isinstance(ratios, TextScores):
        found, key = ratios.table, F.col("_key").bitwiseAND(F.lit(-2))
        same = ratios.docs is docs and ratios.columns == (id_col, text_col)
        numbers = ratios.numbers if same else stored(_numbers(docs, id_col, text_col), "rules")
    if isinstance(ratios, RatioTable | TextScores):
        stats = numbers.join(found, key == F.col("_scored"), "left").withColumn("score", F.round("score", 9))
    else:
        stats = _numbers(docs, id_col, text_col, ratios)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), "score", (~failed & (F.col("score") >= min_score)).alias("kept"))
