"""Chunking, tagging and span geometry.

Everything that returns to its record is an array expression: no explode, no shuffle.  Work per token is
left to native string functions; interpreted array steps grow with the spans, chunks or windows of a record.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind, bind_all, block_heads, dedupe_by, prefix_sums, sorted_rank
from spanlake.functions.text import (
    _SPACE, MATCHES, cut_text, inside_token, mention_in, regex_matches, strip, text_blocks, token_starts_before, tokenize_with_spans,
    tokens_of,
)
from spanlake.functions.udfs import Tagger, tagger_udf
from spanlake.operators.fields import struct_fields
from spanlake.operators.filters import clean_entities, sanitize_spans
from spanlake.operators.ordering import lookup_join
from spanlake.operators.staging import once, written
from spanlake.schema import LABELS


# --------------------------------------------------------------------------- chunks
def chunk_budget(max_tokens: int, *limits: int, reserved: int = 0) -> int:
    """Smallest positive limit minus the reserved special tokens, at least 1."""
    usable = [max_tokens, *[n for n in limits if 0 < n < 100_000]]
    return max(1, min(usable) - reserved)


def chunk_text(text: Column, max_tokens: int, reserved: int = 0) -> Column:
    """array<struct<text, start>>: consecutive chunks of at most the budget in white-space tokens.

    A chunk is one match of "token, then up to budget - 1 times space and token", so the work per token is native.  All
    quantifiers are possessive: the matcher counts the repetitions in a loop, whatever the budget, and never goes back.
    """
    budget = chunk_budget(max_tokens, reserved=reserved)
    pattern = rf"[^{_SPACE}]++(?:[{_SPACE}]++[^{_SPACE}]++){{0,{budget - 1}}}+"
    found = F.when(text.isNotNull(), regex_matches(text, pattern)).otherwise(F.array().cast(MATCHES))
    return F.transform(found, lambda m: F.struct(m["text"].alias("text"), m["start"].alias("start")))


def locate_chunks(text: Column, parts: Column) -> Column:
    """array<struct<text, start>> for chunk texts that came from elsewhere.

    Each chunk is searched from the end of the one before, else from the start of the text; chunks
    that do not occur are left out.
    """
    start = F.struct(F.lit(1).alias("cursor"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        here = F.position(part, text, acc["cursor"])

        def place(at: Column) -> Column:
            hit = F.struct((at + F.length(part)).cast("int").alias("cursor"), F.array_append(
                acc["out"], F.struct(part.alias("text"), (at - 1).cast("int").alias("start"))).alias("out"))
            return F.when(at > 0, hit).otherwise(acc)

        return bind(F.when(here > 0, here).otherwise(F.position(part, text, F.lit(1))), place)

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def chunk_profile(df: DataFrame, text: str, max_tokens: int, reserved: int = 0) -> DataFrame:
    """One row: records, chunk counts and text and chunk lengths."""
    staged = once(df.select(text), _c=chunk_text(F.col(text), max_tokens, reserved)).withColumn("_len", F.length(text))
    per = staged.select(
        "_len", F.size("_c").alias("_n"),
        F.coalesce(F.array_max(F.transform("_c", lambda c: F.length(c["text"]))), F.lit(0)).alias("_longest"))
    return per.agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("total_chunks"),
                   F.avg("_n").alias("avg_chunks_per_row"), F.max("_n").alias("max_chunks_per_row"),
                   F.max("_len").alias("max_text_length"), F.max("_longest").alias("max_chunk_length"))


# --------------------------------------------------------------------------- taggers
def dedupe_entities(entities: Column) -> Column:
    """Unique by (start, end, label, text); the first one stays, order kept."""
    return dedupe_by(entities, lambda e: F.struct(
        F.coalesce(e["start"], F.lit(-1)).alias("s"), F.coalesce(e["end"], F.lit(-1)).alias("e"),
        F.coalesce(e["label"], F.lit("")).alias("l"), F.coalesce(e["text"], F.lit("")).alias("t")))


def extract_entities(df: DataFrame, load: Callable[[], Tagger], labels: Sequence[str] = LABELS, text: str = "text",
                     threshold: float = 0.0, batch_size: int = 4, max_tokens: int = 384, reserved: int = 0,
                     check_text: bool = True) -> DataFrame:
    """Run a tagger over the chunks of every record; adds ``entities``, ``tagger_ok`` and ``tagger_error`` (its text, or NULL).

    Only the chunk texts go through Arrow.  Cleaning, thresholding, shifting to record offsets and
    deduplication are native.
    """
    tag = tagger_udf(load, labels, threshold, batch_size)
    staged = once(df, _chunks=chunk_text(F.coalesce(F.col(text), F.lit("")), max_tokens, reserved))
    staged = staged.withColumn("_texts", F.transform("_chunks", lambda c: c["text"]))
    staged = once(staged.withColumn("_tagged", tag("_texts")), _t=F.col("_tagged")).drop("_texts", "_tagged")
    chunk_of = lambda e: F.get(F.col("_chunks"), e["chunk"])
    numbered = F.transform("_t.found", lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["text"].alias("text"),
        e["score"].alias("score"), chunk_of(e)["start"].alias("shift"), F.length(chunk_of(e)["text"]).alias("room")))
    bounded = F.filter(numbered, lambda e: (e["score"] >= threshold) & (e["end"] <= e["room"]))
    cleaned = clean_entities(bounded, F.lit(2**31 - 1), check_text)
    shifted = F.transform(cleaned, lambda e: F.struct(
        (e["start"] + e["shift"]).alias("start"), (e["end"] + e["shift"]).alias("end"), e["label"].alias("label"),
        e["text"].alias("text"), e["score"].alias("score")))
    return (once(staged, entities=dedupe_entities(shifted))
            .withColumns({"tagger_ok": F.col("_t.ok"), "tagger_error": F.col("_t.error")}).drop("_chunks", "_t"))


def tagging_stats(df: DataFrame) -> DataFrame:
    """One row: records seen, tagged and failed, records with an entity, entities, and the most frequent error."""
    errors = df.filter(~F.col("tagger_ok")).groupBy("tagger_error").agg(F.count(F.lit(1)).alias("n"))
    common = errors.agg(F.max_by("tagger_error", F.struct("n", "tagger_error"))).scalar()
    ok = F.coalesce(F.col("tagger_ok"), F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"),
        F.count_if(F.size("entities") > 0).alias("with_entities"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities")
    ).withColumn("common_error", common)


def regex_tagger(text: Column, patterns: Mapping[str, str], score: float = 1.0) -> Column:
    """Entity array of all matches of label -> pattern, sorted by offsets."""

    def found(label: str, pattern: str) -> Column:
        return F.transform(regex_matches(text, pattern), lambda m: F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label"),
            m["text"].alias("text"), F.lit(float(score)).alias("score")))

    return F.array_sort(F.concat(*[found(label, p) for label, p in patterns.items()]))


def dictionary_tagger(df: DataFrame, terms: DataFrame, text: str = "text", id_col: str = "row_idx",
                      max_words: int = 1, ignore_case: bool = False, strategy: str = "regex") -> DataFrame:
    """Long entity rows (id, start, end, label, text, score 1.0) for dictionary terms in the text.

    ``terms``: one row per (term, label), words separated by single spaces; terms of more than ``max_words`` words play no part.
    Tokens are joined with the terms; Spark broadcasts the dictionary by its size or splits the partitions of frequent words.  For terms of
    several words the places where one may stand are found in the text first (``phrase_places``), so that only those are joined.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    # Written: Spark knows its size, so a small one is broadcast whatever it was made of.
    lexicon = written(terms.select(fold(F.col("term")).alias("term"), "label").distinct(), "lexicon")
    staged = once(df.select(id_col, text), _tok=tokenize_with_spans(F.col(text), strategy))
    if max_words == 1:
        # A token is its own text: ``substring`` would walk the record from its start for every token.
        pieces = staged.select(id_col, F.explode("_tok").alias("g"))
        words = pieces.select(id_col, fold(F.col("g.token")).alias("term"), F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("g.token").alias("text"))
    else:
        lexicon = lexicon.filter(F.size(F.split("term", " ")) <= max_words)
        places = phrase_places(F.col("_tok"), F.col(text), prefix_bits(lexicon.select("term")), max_words, fold)
        words = once(staged, _p=places).select(id_col, F.explode("_p").alias("p")).select(id_col, "p.*")
    return lookup_join(words, lexicon, ["term"], "inner").select(
        id_col, "start", "end", "label", "text", F.lit(1.0).alias("score"))


#: Bits of the prefix table for each beginning of a term, and bits at most (4 MB); a fuller table lets more places through, no term is lost.
PREFIX_BITS, MOST_BITS = 16, 1 << 25


def _step(before: Column, word: Column) -> Column:
    """Key of a beginning from the key of the beginning one word shorter."""
    return F.xxhash64(before, word)


def _whole(key: Column) -> Column:
    """Key of a beginning that is a whole term."""
    return F.xxhash64(key, F.lit(1))


class PrefixBits(NamedTuple):
    """A table of bits: is the key of a term's beginning, or of a whole term, perhaps in the dictionary?"""

    words: Column
    bits: int

    def has(self, key: Column) -> Column:
        at = F.pmod(key, F.lit(self.bits))
        return F.get(self.words, F.shiftright(at, 6).cast("int")).bitwiseAND(_bit(at)) != 0


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def prefix_bits(terms: DataFrame, per_prefix: int = PREFIX_BITS, most: int = MOST_BITS) -> PrefixBits:
    """The prefix table of a dictionary (term): for every beginning of a term a bit that a term goes on there, for every term one that it ends.

    Bits are set in an aggregation by 64-bit word; the words, ``most`` / 8 bytes at most, come back to the driver and are one value of the plan.
    """
    words = F.split("term", " ")
    keys = F.aggregate(words, F.struct(F.lit(0).cast("long").alias("k"), F.array().cast("array<bigint>").alias("all")),
                       lambda a, w: F.struct(_step(a["k"], w).alias("k"), F.array_append(a["all"], _step(a["k"], w)).alias("all")))
    each = terms.select(keys.alias("t")).select(F.explode(F.concat("t.all", F.array(_whole(F.col("t.k"))))).alias("key"))
    prefixes = each.agg(F.approx_count_distinct("key")).first()[0] or 0
    bits = min(most, max(1024, 1 << (per_prefix * prefixes).bit_length()))
    at = F.pmod("key", F.lit(bits))
    filled = each.select(F.shiftright(at, 6).cast("long").alias("i"), _bit(at).alias("bit")).groupBy("i").agg(F.bit_or("bit").alias("w")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[filled["i"].to_numpy()] = filled["w"].to_numpy()
    return PrefixBits(F.split(F.lit(",".join(map(str, table.tolist()))), ",").cast("array<bigint>"), bits)


def phrase_places(tokens: Column, text: Column, table: PrefixBits, max_words: int, fold=lambda c: c) -> Column:
    """array<struct<term, start, end, text>>: runs of tokens that may be terms, by walking the prefix table word by word from every token."""
    folded = F.transform(tokens, lambda t: fold(t["token"]))

    def ends(words: Column) -> Column:
        """Lengths of the runs from the first of ``words`` on that may be terms; a run ends where no term goes on."""
        start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(True).alias("on"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("found"))

        def go(a: Column, w: Column) -> Column:
            key = _step(a["k"], w)
            on = a["on"] & table.has(key)
            return F.struct(key.alias("k"), on.alias("on"), (a["n"] + 1).alias("n"), F.when(on & table.has(_whole(key)), F.array_append(a["found"], a["n"] + 1)).otherwise(a["found"]).alias("found"))

        return F.aggregate(words, start, go, lambda a: a["found"])

    def at(words: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: table.has(_step(F.lit(0).cast("long"), F.get(words, i))))
        return F.flatten(F.transform(starts, lambda i: F.transform(ends(F.slice(words, i + 1, F.lit(max_words))), lambda n: F.struct(
            F.array_join(F.slice(words, i + 1, n), " ").alias("term"), F.get(tokens, i)["start"].alias("start"), F.get(tokens, i + n - 1)["end"].alias("end"),
            F.substring(text, F.get(tokens, i)["start"] + 1, F.get(tokens, i + n - 1)["end"] - F.get(tokens, i)["start"]).alias("text")))))

    return F.when(F.size(tokens) > 0, bind(folded, at))


def collect_entities(df: DataFrame, ents: DataFrame, id_col: str = "row_idx", name: str = "entities") -> DataFrame:
    """Attach long entity rows to their records as a sorted array (one group per record)."""
    fields = [c for c in ents.columns if c != id_col]
    lists = ents.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    out = df.join(lists, id_col, "left")
    kind = lists.schema[name].dataType.simpleString()
    return out.withColumn(name, F.coalesce(name, F.array().cast(kind)))


# --------------------------------------------------------------------------- tokens and spans
def _token_counts(text: Column, spans: Column, strategy: str, body, heads: bool = True) -> Column:
    """Call ``body`` with "number of tokens that start before position p" and "is p inside a token" (0 or 1).

    p is a span's start or end, or with ``heads`` the place after its first character.
    """
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"]),
                    *[F.transform(spans, lambda s: s["start"] + 1)] * heads)

    def with_points(n: Column) -> Column:
        inside = F.array_sort(F.array_distinct(F.transform(ends, lambda p: F.greatest(F.lit(0), F.least(p, n)).cast("int"))))
        return bind_all([inside, text_blocks(text)], lambda points, blocks: bind_all(
            [token_starts_before(blocks, points, strategy), block_heads(points)],
            lambda counts, heads: body(
                lambda p: F.get(counts, sorted_rank(points, heads, F.greatest(F.lit(0), F.least(p, n)), inclusive=True) - 1),
                lambda p: inside_token(blocks, p, strategy).cast("int"))))

    return bind(F.length(text), with_points)


def align_spans_to_tokens(text: Column, spans: Column, strategy: str = "whitespace") -> Column:
    """Character spans -> inclusive token spans of the tokens they overlap; spans over no token drop."""

    def body(before, split) -> Column:
        ranges = F.transform(spans, lambda s: F.struct(
            (before(s["start"]) - split(s["start"])).alias("start_tok"),
            (before(s["end"]) - 1).alias("end_tok"), s["label"].alias("label")))
        return F.filter(ranges, lambda r: r["start_tok"] <= r["end_tok"])

    return _token_counts(text, spans, strategy, body, heads=False)


def clamp_spans(spans: Column, text: Column) -> Column:
    """Refit variant: valid ints, labelled, start inside the text; the end is clamped to the text."""
    n = F.length(text)
    kept = F.filter(spans, lambda s: F.coalesce(
        (s["start"] >= 0) & (s["end"] > s["start"]) & (s["start"] < n) & (s["label"] != ""), F.lit(False)))
    return F.transform(kept, lambda s: F.struct(
        s["start"].alias("start"), F.least(s["end"], n).alias("end"), s["label"].alias("label")))


def tokenized_samples(df: DataFrame, text: str = "text", spans: str = "spans", strategy: str = "whitespace",
                      clamp: bool = False) -> DataFrame:
    """Adds ``tokenized_text`` and ``ner`` (inclusive token spans) to every record."""
    given = clamp_spans(F.col(spans), F.col(text)) if clamp else F.col(spans)
    staged = once(df, _given=given) if clamp else df.withColumn("_given", given)
    return once(staged, tokenized_text=tokens_of(F.col(text), strategy),
                ner=align_spans_to_tokens(F.col(text), F.col("_given"), strategy)).drop("_given")


def tokens_to_char_offsets(tokens: Column, ner: Column) -> Column:
    """Token spans -> character spans over the tokens joined by single spaces.

    The token list is cut at the span boundaries and each piece measured natively.
    """

    def body(n: Column) -> Column:
        inside = F.filter(ner, lambda s: (s["start_tok"] < n) & (s["end_tok"] < n))
        marks = F.concat(F.array(F.lit(0)), F.transform(inside, lambda s: s["start_tok"]), F.transform(inside, lambda s: s["end_tok"] + 1))

        def measured(points: Column) -> Column:
            size = lambda p, i: F.when(i > 0, F.length(F.array_join(F.slice(
                tokens, F.get(points, i - 1) + 1, p - F.get(points, i - 1)), " ")) + 1).otherwise(F.lit(0))
            sums = bind(prefix_sums(F.concat(F.transform(points, size), F.array(F.lit(0)))), lambda a: F.slice(a, 2, F.size(a) - 1))
            return bind_all([sums, block_heads(points)], lambda at, heads: F.transform(inside, lambda s: F.struct(
                F.get(at, sorted_rank(points, heads, s["start_tok"], True) - 1).alias("start"),
                (F.get(at, sorted_rank(points, heads, s["end_tok"] + 1, True) - 1) - 1).alias("end"), s["label"].alias("label"))))

        return bind(F.array_sort(F.array_distinct(marks)), measured)

    return bind(F.size(tokens), body)


# --------------------------------------------------------------------------- windows
def _window_starts(n: Column, budget: int, overlap: int) -> Column:
    """array<struct<from, to>> for words of length 1: a closed form."""
    step = max(1, budget - overlap)
    last = F.greatest(F.ceil((n - budget) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        (i * step).alias("from"), F.least(i * step + budget, n).alias("to")))


def _fitted_windows(lengths: Column, budget: int, overlap: int, max_words: int) -> Column:
    """array<struct<from, to>> for words of any length: the longest run that fits, at least one word.

    One fold over the candidate starts; only real window starts look up their end in the prefix sums.
    """

    def body(ends: Column, heads: Column) -> Column:
        n = F.size(lengths)

        def end_of(at: Column) -> Column:
            used = F.when(at > 0, F.get(ends, at - 1)).otherwise(0)
            fit = sorted_rank(ends, heads, used + budget, inclusive=True)
            return F.least(F.greatest(fit, at + 1), at + max_words, n).cast("int")

        start = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))

        def step(acc: Column, at: Column) -> Column:
            emit = bind(end_of(at), lambda to: F.struct(
                F.when(to >= n, F.lit(-1)).otherwise(F.greatest(at + 1, to - overlap)).cast("int").alias("next"),
                F.array_append(acc["out"], F.struct(at.alias("from"), to.alias("to"))).alias("out")))
            return F.when(acc["next"] == at, emit).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: acc["out"])

    inclusive = F.zip_with(prefix_sums(lengths), lengths, lambda p, x: p + x)
    return bind(inclusive, lambda ends: bind(block_heads(ends), lambda heads: body(ends, heads)))


def sliding_token_windows(df: DataFrame, max_length: int = 384, overlap: int = 50, keep_empty: bool = False,
                          reserved: int = 0, lengths: str | None = None) -> DataFrame:
    """Long tokenized samples -> overlapping windows with clipped, re-based spans.

    Input columns ``tokenized_text`` and ``ner``; ``lengths`` names an ``array<int>`` of model lengths per
    word (all 1 when absent).  A sample that fits stays whole.  Adds ``window``; windows without spans
    are dropped unless ``keep_empty``.
    """
    budget, words = max(1, max_length - reserved), max(1, max_length)
    rows = df.filter(F.size("tokenized_text") > 0)
    n = F.size("tokenized_text")
    if lengths is None:
        cuts = F.when(n > budget, _window_starts(n, budget, overlap)).otherwise(
            F.array(F.struct(F.lit(0).alias("from"), n.alias("to"))))
    else:
        total = F.aggregate(F.col(lengths), F.lit(0), lambda a, x: a + x)
        cuts = F.when(total > budget, _fitted_windows(F.col(lengths), budget, overlap, words)).otherwise(
            F.array(F.struct(F.lit(0).alias("from"), n.alias("to"))))
    keep = [c for c in df.columns if c not in ("tokenized_text", "ner", lengths)]
    rows = once(rows, _cuts=cuts).select(*keep, "tokenized_text", "ner", F.posexplode("_cuts").alias("window", "w"))
    lo, hi = F.col("w.from"), F.col("w.to") - 1
    inside = F.filter("ner", lambda s: F.greatest(s["start_tok"], lo) <= F.least(s["end_tok"], hi))
    moved = F.transform(inside, lambda s: F.struct(
        (F.greatest(s["start_tok"], lo) - lo).alias("start_tok"), (F.least(s["end_tok"], hi) - lo).alias("end_tok"),
        s["label"].alias("label")))
    out = once(rows, ner=moved).select(*keep, "window", F.slice("tokenized_text", lo + 1, hi - lo + 1).alias("tokenized_text"), "ner")
    return out if keep_empty else out.filter(F.size("ner") > 0)


# --------------------------------------------------------------------------- BIO, mentions, segments
def bio_tags(df: DataFrame, text: str = "text", spans: str = "spans", id_col: str = "row_idx",
             strategy: str = "regex") -> DataFrame:
    """Long rows (id, tok_idx, token, tag).  A token fully inside a span is B-XXX when the starts are
    equal, else I-XXX; the first span in list order wins."""
    none = F.array().cast("array<struct<t:int,i:int,tag:string>>")

    def tags(body: Column, given: Column, tokens: Column) -> Column:
        def hits(before, split) -> Column:
            def one(s: Column, i: Column) -> Column:
                first = before(s["start"])
                last = before(s["end"]) - split(s["end"]) - 1
                head = before(s["start"] + 1) > first  # does a token start right at the span?
                code = F.upper(F.substring(s["label"], 1, 3))
                return bind(F.struct(first.alias("a"), last.alias("b"), head.alias("h")), lambda r: F.when(
                    r["a"] <= r["b"], F.transform(F.sequence(r["a"], r["b"]), lambda t: F.struct(
                        t.alias("t"), i.alias("i"), F.concat(F.when((t == r["a"]) & r["h"], "B-").otherwise("I-"), code).alias("tag"))))
                    .otherwise(none))
            return F.array_sort(F.flatten(F.transform(given, one)))

        def fill(found: Column) -> Column:
            firsts = F.filter(found, lambda h, i: (i == 0) | (F.get(found, i - 1)["t"] != h["t"]))

            def gaps(f: Column) -> Column:
                before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(f, i - 1)["t"])
                parts = F.transform(f, lambda h, i: F.concat(
                    F.array_repeat(F.lit("O"), h["t"] - before(i) - 1), F.array(h["tag"])))
                tail = F.size(tokens) - 1 - F.when(F.size(f) > 0, F.element_at(f, -1)["t"]).otherwise(-1)
                return F.concat(F.flatten(parts), F.array_repeat(F.lit("O"), tail))

            return bind(firsts, gaps)

        return bind(_token_counts(body, given, strategy, hits), fill)

    staged = df.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(spans).alias("_s"))
    staged = once(staged, _tok=tokens_of(F.col("_t"), strategy))
    staged = once(staged, _tags=tags(F.col("_t"), F.col("_s"), F.col("_tok")))
    rows = once(staged, _rows=F.arrays_zip(F.col("_tok").alias("token"), F.col("_tags").alias("tag")))
    return rows.select(id_col, F.posexplode("_rows").alias("tok_idx", "x")).select(
        id_col, "tok_idx", "x.token", "x.tag")


def to_mention_lists(df: DataFrame, label_map: Mapping[str, str] | None = None, text: str = "text",
                     spans: str = "spans") -> DataFrame:
    """``input`` and ``output.entities``: label -> distinct mentions in order of appearance."""
    table = F.create_map(*[F.lit(x) for kv in (label_map or {"": ""}).items() for x in kv])
    t = F.col(text)
    named = bind_all([text_blocks(t), F.length(t)], lambda blocks, n: F.transform(spans, lambda s: F.struct(
        F.coalesce(F.try_element_at(table, s["label"]), F.lower(s["label"])).alias("label"),
        strip(mention_in(blocks, n, s["start"], s["end"], F.lit(""))).alias("mention"))))

    def lists(pairs: Column) -> Column:
        labels = F.array_distinct(F.transform(pairs, lambda p: p["label"]))
        return F.map_from_entries(F.transform(labels, lambda k: F.struct(k.alias("key"), F.array_distinct(
            F.transform(F.filter(pairs, lambda p: p["label"] == k), lambda p: p["mention"])).alias("value"))))

    entities = bind(F.filter(named, lambda p: p["mention"] != ""), lists)
    extra = [c for c in df.columns if c not in (text, spans)]
    return df.select(*extra, t.alias("input"), F.struct(entities.alias("entities")).alias("output"))


def segment_text(text: Column, spans: Column) -> Column:
    """array<struct<text, label>>: the text cut at its valid spans; a span overlapping an earlier one is
    skipped, plain text has a NULL label."""
    piece = "array<struct<text:string,label:string>>"

    def body(blocks: Column, n: Column) -> Column:
        cut = lambda a, b, label: F.struct(cut_text(blocks, a, b - a).alias("text"), label.alias("label"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(piece).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            with_gap = F.when(acc["at"] < s["start"], F.array_append(
                acc["out"], cut(acc["at"], s["start"], F.lit(None).cast("string")))).otherwise(acc["out"])
            taken = F.struct(s["end"].alias("at"), F.array_append(
                with_gap, cut(s["start"], s["end"], s["label"])).alias("out"))
            return F.when(s["start"] < acc["at"], acc).otherwise(taken)

        finish = lambda acc: F.when(acc["at"] < n, F.array_append(
            acc["out"], cut(acc["at"], n, F.lit(None).cast("string")))).otherwise(acc["out"])
        return F.aggregate(sanitize_spans(spans, text), start, step, finish)

    return bind_all([text_blocks(text), F.length(text)], body)
