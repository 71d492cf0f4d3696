"""The scalar functions as SQL functions, so ``spark.sql`` users get them without Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanlake.functions.text import _SPACE, HANGUL, _fold_tables, hangul_letters, rare_class
from spanlake.schema import SCORE_EPS, STOPWORDS


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _expanded(text: str, longer: tuple[tuple[str, str], ...]) -> str:
    """The letter-by-letter replacement of ``text.expand_rare`` as SQL, from the same tables."""
    lead, middle, tail = map(_literal, hangul_letters())
    n, rare = f"(ascii(c) - {ord(HANGUL[0])})", _literal(rare_class("NFD"))
    syllable = (f"concat(substring({lead}, CAST(floor({n} / 588) AS INT) + 1, 1), substring({middle}, CAST(floor({n} % 588 / 28) AS INT) + 1, 1), "
                f"if({n} % 28 > 0, substring({tail}, {n} % 28, 1), ''))")
    cut = _literal("\\x01")
    parts = [f"split({_literal(chr(1).join(pair[k] for pair in longer))}, {cut})" for k in (0, 1)]
    table = f"map_from_arrays({', '.join(parts)})"
    letter = (f"CASE WHEN c >= {_literal(HANGUL[0])} AND c <= {_literal(HANGUL[1])} THEN {syllable} "
              f"WHEN c RLIKE {rare} THEN element_at({table}, c) ELSE c END")
    return f"if({text} RLIKE {rare}, array_join(transform(split({text}, ''), c -> {letter}), ''), {text})"


def sql_functions() -> dict[str, str]:
    """name -> CREATE statement body after ``CREATE OR REPLACE TEMPORARY FUNCTION``."""
    src, dst, gone, longer = _fold_tables("NFD")
    folded = _expanded(f"translate(coalesce(v, ''), {_literal(src + gone)}, {_literal(dst)})", longer)
    space = _literal(f"[{_SPACE}]+")
    stop = ", ".join(_literal(w) for w in STOPWORDS)
    eps = f"{SCORE_EPS}D"
    clip = f"greatest(least(p, 1 - {eps}), {eps})"
    return {
        "normalize_text": f"normalize_text(v STRING) RETURNS STRING RETURN trim(regexp_replace({folded}, {space}, ' '))",
        "collapse_spaces": f"collapse_spaces(v STRING) RETURNS STRING RETURN trim(regexp_replace(v, {space}, ' '))",
        "informative_tokens": "informative_tokens(n STRING) RETURNS ARRAY<STRING> RETURN array_except("
                              f"filter(regexp_extract_all(n, '[0-9a-z]+', 0), w -> length(w) >= 3), array({stop}))",
        "safe_double": "safe_double(v STRING) RETURNS DOUBLE RETURN nullif(try_cast(v AS DOUBLE), double('NaN'))",
        "clip_score": f"clip_score(p DOUBLE) RETURNS DOUBLE RETURN {clip}",
        "logit": f"logit(p DOUBLE) RETURNS DOUBLE RETURN ln({clip} / (1 - {clip}))",
        "sigmoid": "sigmoid(z DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-z))",
        "apply_temperature": f"apply_temperature(p DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + exp(-ln({clip} / (1 - {clip})) / t))",
        "mention_text": "mention_text(v STRING, s INT, e INT) RETURNS STRING RETURN "
                        "if(s >= 0 AND s < e AND e <= length(v), substring(v, s + 1, e - s), '')",
    }


def register_functions(spark: SparkSession) -> list[str]:
    """Create all functions in the session; returns their names."""
    bodies = sql_functions()
    for body in bodies.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return list(bodies)
