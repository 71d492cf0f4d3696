"""Text, token and score expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.arrays import bind, bind_all, prefix_sums
from spanlake.schema import STOPWORDS

# Character classes that mean in Java what they mean in Python's `re` on str.  Single Latin-1 characters are one table
# look-up in Java; the rare spaces sit behind one range test, so ordinary characters cost two steps.
_SPACE = (r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
          r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]")
_ODD_SPACE = rf"[{_SPACE}]{{2,}}|[{_SPACE}&&[^ ]]"
#: Every character that ``str.isspace`` accepts.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_WORD = r"\p{L}\p{N}_"
#: Token patterns, and for each the first characters of tokens and the places inside a token.
TOKEN = {"whitespace": rf"[^{_SPACE}]+", "regex": rf"[{_WORD}]+|[^{_WORD}{_SPACE}]"}
TOKEN_START = {"whitespace": rf"(?<![^{_SPACE}])[^{_SPACE}]", "regex": rf"(?<![{_WORD}])[{_WORD}]|[^{_WORD}{_SPACE}]"}
TOKEN_INSIDE = {"whitespace": rf"^[^{_SPACE}]{{2}}", "regex": rf"^[{_WORD}]{{2}}"}


# --------------------------------------------------------------------------- blank handling
def strip(col: Column) -> Column:
    """Trim any Unicode white space at both ends."""
    return F.btrim(col, F.lit(SPACES))


def collapse_spaces(col: Column) -> Column:
    """White-space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, _ODD_SPACE, " "))  # single spaces stay untouched, which is most of them


def not_blank(col: Column) -> Column:
    """True for a string with at least one non-space character; false for NULL."""
    return F.coalesce(col.rlike(rf"[^{_SPACE}]"), F.lit(False))


def primary_text(fields: Sequence[str], stripped: bool = True) -> tuple[Column, Column]:
    """(text, name of the field used): first non-blank field, ``""`` for both when there is none."""
    text = F.coalesce(*[F.when(not_blank(F.col(f)), strip(F.col(f)) if stripped else F.col(f))
                        for f in fields], F.lit(""))
    name = F.coalesce(*[F.when(not_blank(F.col(f)), F.lit(f)) for f in fields], F.lit(""))
    return text, name


def inference_text(fields: Sequence[str], sep: str = ". ") -> Column:
    """Strip the fields, drop blank and NULL ones, join the rest."""
    parts = F.filter(F.array(*[strip(F.col(f).cast("string")) for f in fields]), lambda x: x != "")
    return strip(F.array_join(parts, sep))


def metadata_values(fields: Sequence[str]) -> Column:
    """Ordered (field, value) pairs of the non-blank metadata columns."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), strip(F.col(f)).alias("value")) for f in fields])
    return F.filter(pairs, lambda p: F.coalesce(p["value"] != "", F.lit(False)))


def mention_text(text: Column, start: Column, end: Column, fallback: Column) -> Column:
    """Covered substring when the offsets are valid, else the span's own text, else ``""``."""
    valid = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.when(valid, F.substring(text, start + 1, end - start)).otherwise(F.coalesce(fallback, F.lit("")))


def text_blocks(text: Column) -> Column:
    """The text as 256-character blocks.

    ``substring`` walks a UTF-8 string from its start, so cutting many pieces out of a long text is quadratic;
    :func:`cut_text` on blocks walks one block.
    """
    return F.regexp_extract_all(text, F.lit("(?s).{1,256}"), F.lit(0))


def cut_text(blocks: Column, start: Column, size: Column) -> Column:
    """``size`` characters from 0-based ``start`` of a text held as blocks; ``""`` for size <= 0."""
    first = F.shiftright(start, 8)
    last = F.shiftright(start + size - 1, 8)
    piece = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when((size > 0) & (start >= 0), F.substring(piece, start - F.shiftleft(first, 8) + 1, size)).otherwise(F.lit(""))


def mention_in(blocks: Column, n: Column, start: Column, end: Column, fallback: Column) -> Column:
    """:func:`mention_text` for the spans of an array: ``blocks`` and length ``n`` of the record's text."""
    valid = (start >= 0) & (start < end) & (end <= n)
    return F.when(valid, cut_text(blocks, start, end - start)).otherwise(F.coalesce(fallback, F.lit("")))


def preview(col: Column, size: int = 160) -> Column:
    return F.substring(F.replace(col, F.lit("\n"), F.lit(" ")), 1, size)


# --------------------------------------------------------------------------- numbers
def safe_double(col: Column) -> Column:
    """Parsed number or NULL.  NaN counts as invalid: it would win every max and comparison."""
    v = col.try_cast("double")
    return F.when(~F.isnan(v), v)


def pick_score(entity: Column, fields: Sequence[str]) -> Column:
    """struct(score, source) of the first field that parses; (NULL, "") when none does."""
    empty = F.struct(F.lit(None).cast("double").alias("score"), F.lit("").alias("source"))

    def attempt(name: str) -> Column:
        return bind(safe_double(entity[name]), lambda v: F.when(
            v.isNotNull(), F.struct(v.alias("score"), F.lit(name).alias("source"))))

    return F.coalesce(*[attempt(f) for f in fields], empty)


def clip01(col: Column, eps: float) -> Column:
    return F.greatest(F.least(col, F.lit(1.0 - eps)), F.lit(eps))


# --------------------------------------------------------------------------- normalisation
HANGUL = ("\uac00", "\ud7a3")


@lru_cache(maxsize=None)
def _fold_tables(form: str) -> tuple[str, str, str, tuple[tuple[str, str], ...]]:
    """Rule-generated folding tables: (from, to, deleted characters, long expansions).

    Characters whose folding is a single character go into one ``translate`` call, vanishing ones
    are deleted by it, and those with longer results are looked up letter by letter.  Hangul syllables are left out:
    their letters follow from their number.
    """
    src, dst, gone, longer = [], [], [], []
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if HANGUL[0] <= ch <= HANGUL[1] or 0xD800 <= code <= 0xDFFF:
            continue
        out = fold_exact(ch, form, squeeze=False)
        if out == ch:
            continue
        if len(out) == 1:
            src.append(ch)
            dst.append(out)
        elif not out:
            gone.append(ch)
        else:
            longer.append((ch, out))
    return "".join(src), "".join(dst), "".join(gone), tuple(longer)


@lru_cache(maxsize=None)
def hangul_letters() -> tuple[str, str, str]:
    """Leading, middle and trailing letters of the syllables, in the order of their numbers."""
    parts = lambda n: unicodedata.normalize("NFD", chr(ord(HANGUL[0]) + n))
    return "".join(parts(588 * i)[0] for i in range(19)), "".join(parts(28 * i)[1] for i in range(21)), "".join(parts(i)[2] for i in range(1, 28))


def rare_class(form: str) -> str:
    """Regex class of the characters that need a look-up, Hangul syllables included."""
    return "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch, _ in _fold_tables(form)[3]) + "".join(HANGUL[:1]) + "-" + HANGUL[1] + "]"


def expand_rare(text: Column, form: str) -> Column:
    """Replace the characters with longer foldings, letter by letter."""
    longer = _fold_tables(form)[3]
    lead, middle, tail = (F.lit(x) for x in hangul_letters())
    table = F.map_from_arrays(*[F.split(F.lit("\x01".join(pair[k] for pair in longer)), "\x01") for k in (0, 1)])
    pick = lambda letters, at: F.substring(letters, at.cast("int"), F.lit(1))

    def letter(c: Column) -> Column:
        n = F.ascii(c) - ord(HANGUL[0])
        syllable = F.concat(pick(lead, F.floor(n / 588) + 1), pick(middle, F.floor(n % 588 / 28) + 1), F.when(n % 28 > 0, pick(tail, n % 28)).otherwise(F.lit("")))
        return F.when((c >= HANGUL[0]) & (c <= HANGUL[1]), syllable).otherwise(F.when(c.rlike(rare_class(form)), F.element_at(table, c)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), letter), "")


def fold_exact(value: str, form: str = "NFD", squeeze: bool = True) -> str:
    """The exact folding of one string (small helper shared by the tables and the Arrow UDF).

    ``NFD``: casefold, decompose, drop non-spacing marks.  ``NFKD``: lower, compatibility
    decomposition, drop combining characters (the rule for generic terms).
    """
    if form == "NFD":
        kept = [c for c in unicodedata.normalize("NFD", value.casefold()) if unicodedata.category(c) != "Mn"]
    else:
        kept = [c for c in unicodedata.normalize("NFKD", value.lower()) if not unicodedata.combining(c)]
    return " ".join("".join(kept).split()) if squeeze else "".join(kept)


def normalize_text(col: Column, form: str = "NFD") -> Column:
    """Casefold, strip accents, collapse white space.  NULL becomes ``""``.

    ASCII texts take the cheap ``lower`` branch, Latin-1 texts one ``replace`` (the sharp s) and one
    ``translate`` pass; only texts with characters that fold to several are walked letter by letter.
    """
    src, dst, gone, longer = _fold_tables(form)

    def body(v: Column) -> Column:
        # Foldings are final: characters with longer ones are replaced last.
        far = F.translate(v, src + gone, dst)
        near = far
        for ch, out in longer:
            if ord(ch) < 0x100:
                near = F.replace(near, F.lit(ch), F.lit(out))
        return collapse_spaces(
            F.when(~v.rlike(r"[^\x00-\x7f]"), F.lower(v))
            .when(~v.rlike(r"[^\x00-\xff]"), near)
            .when(~v.rlike(rare_class(form)), far).otherwise(expand_rare(far, form)))

    return bind(F.coalesce(col.cast("string"), F.lit("")), body)


def dedupe_key(col: Column) -> Column:
    """White space collapsed and case folded, accents kept; the key for equal training texts."""
    return F.replace(F.lower(collapse_spaces(F.coalesce(col, F.lit("")))), F.lit("ß"), F.lit("ss"))


def surface_key(col: Column) -> Column:
    """White space collapsed and lower-cased; the key for seen and unseen entity surfaces."""
    return F.lower(collapse_spaces(F.coalesce(col, F.lit(""))))


def informative_tokens(normalized: Column) -> Column:
    """Distinct ``[0-9a-z]`` tokens of three or more characters that are not stopwords."""
    words = F.filter(F.regexp_extract_all(normalized, F.lit("[0-9a-z]+"), F.lit(0)),
                     lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


# --------------------------------------------------------------------------- tokens
def _known(strategy: str) -> str:
    if strategy not in TOKEN:
        raise ValueError(f"unknown tokenization strategy: {strategy}")
    return strategy


def tokens_of(text: Column, strategy: str = "whitespace") -> Column:
    """array<string> of the tokens: one native regular expression pass."""
    return F.regexp_extract_all(text, F.lit(TOKEN[_known(strategy)]), F.lit(0))


def tokenize_with_spans(text: Column, strategy: str = "whitespace") -> Column:
    """array<struct<token, start, end>> with code-point offsets.

    For offsets of every token; where only a few positions matter use :func:`token_starts_before`.
    """
    found = regex_matches(text, TOKEN[_known(strategy)])
    return F.transform(F.when(text.isNotNull(), found).otherwise(F.array().cast(MATCHES)), lambda m: F.struct(
        m["text"].alias("token"), m["start"].alias("start"), m["end"].alias("end")))


def token_starts_before(blocks: Column, points: Column, strategy: str = "whitespace") -> Column:
    """For ascending distinct positions beginning with 0: how many tokens start before each.

    The text (as :func:`text_blocks`) is cut at the positions and the native ``regexp_count`` counts token starts in each
    piece, with the character before it so that a cut inside a token starts no new one.  Linear in the
    text, and only as many interpreted steps as there are positions.
    """
    pattern = F.lit(TOKEN_START[_known(strategy)])

    def piece(p: Column, i: Column) -> Column:
        before = F.get(points, i - 1)
        lead = F.when(before > 0, cut_text(blocks, before - 1, F.lit(1))).otherwise(F.lit(" "))
        # The lead character may itself look like a token start; it is not counted.
        counted = bind(lead, lambda c: F.regexp_count(F.concat(c, cut_text(blocks, before, p - before)), pattern) - F.regexp_count(c, pattern))
        return F.when(i > 0, counted).otherwise(F.lit(0))

    counts = F.transform(points, piece)
    return bind(prefix_sums(F.concat(counts, F.array(F.lit(0)))), lambda sums: F.slice(sums, 2, F.size(sums) - 1))


def inside_token(blocks: Column, point: Column, strategy: str = "whitespace") -> Column:
    """Does the position fall between two characters of one token?"""
    pair = cut_text(blocks, point - 1, F.lit(2))
    return F.when(point > 0, F.coalesce(pair.rlike(TOKEN_INSIDE[_known(strategy)]), F.lit(False))).otherwise(F.lit(False))


MATCHES = "array<struct<text:string,start:int,end:int>>"


def regex_matches(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of all non-empty matches, in order.

    Gaps (``split``) and matches (``regexp_extract_all``) alternate, so offsets are again sums.
    """

    def body(gaps: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))
        # The sum after match i is its end: what precedes it plus its own gap and length.
        ends = bind(prefix_sums(F.concat(steps, F.array(F.lit(0)))), lambda sums: F.slice(sums, 2, F.size(sums) - 1))
        return F.zip_with(found, ends, lambda m, e: F.struct(
            m.alias("text"), (e - F.length(m)).alias("start"), e.alias("end")))

    return bind_all([F.split(text, pattern, -1),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0))], body)


# --------------------------------------------------------------------------- keys
def digest(seed: int | str, *cols: Column) -> Column:
    """Reproducible 128-bit order key of a row: the hex md5 of ``seed:col:col``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def digest_fraction(hex_digest: Column) -> Column:
    """First six hex digits of a digest as a number in [0, 1)."""
    return F.conv(F.substring(hex_digest, 1, 6), 16, 10).cast("bigint") / F.lit(16777216.0)
