"""Small tables with the hard cases: NULLs, blanks, long texts, copies, near copies, repeated rows, clashing columns."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, id string, own long, words string, "
          "weight long, shard int, digest string, host string, node long, label string, kept boolean, n long, pos int, value string, _id string, _key string, _sha string, _n string, "
          "_vertex string, _own string, _kept string, _kept_id string, _KEPT_SHA string, _kept_key string, _text string, row string, _row string, _scored string")


def rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "of", "naïve", "straße", "日本語", "x&&&", "!!"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = [text(n) for n in (1, 2, 3, 5, 12, 40, 80, 200)]
    out = [(i, t, "en", "src0") for i, t in enumerate(base)]
    out += [(20 + i, t, "en", "src0") for i, t in enumerate(base[:6])]  # copies
    for i in range(6):  # near copies of one text
        w = base[7].split(" ")
        w[10 + 25 * i] = "changed"
        out.append((30 + i, " ".join(w), "en", "src0"))
    out += [(40, None, None, None), (41, "", "en", "src1"), (42, " \t\n\x0b\x0c\r ", "de", "src1"), (43, None, "fr", "src0")]
    out += [(50, "tie a\nb", "en", "src2"), (50, "tie a\nb", "en", "src2"), (50, "tie a\nb", "en", "src3")]  # repeated rows
    out += [(None, "no id at all here", "en", "src0"), (None, "no id at all here", "en", "src0"), (None, None, None, None)]
    out += [(60, text(6000), "es", "src4"), (61, "x" * 30000, "en", "src4"), (62, " " * 500 + "a", "en", "src4"), (63, "same\nsame\nsame\n\n" + "go " * 50, "en", "src5")]
    out += [(64, "copyright 2020 Ann\n  MIT   LICENCE!\n", "en", "src5"), (65, "Intro.\nReleased under the MIT Licence.\nmore", "en", "src5"), (66, "A\rB\x1cC D 🎉 é", "en", "src5")]
    return out


def frame(spark, data=None):
    """The rows with clashing extra columns."""
    data = rows() if data is None else data
    extra = ("k", "i", 7, "w", 3, 9, "d", "h", 1, "l", True, 2, 4, "v", *[f"own {i}" for i in range(14)])
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *extra) for i, t, lang, source in data], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
