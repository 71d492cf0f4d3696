"""Main text of web pages: boosted trees over the features of DOM nodes, decoded along the tree.

Every element and every block of text gets log odds of holding main text, from the size and link density of its subtree, the tokens
of its attributes, its depth, its siblings and its place.  The kept nodes are the set of largest total log odds in which nothing is kept
below a dropped element.  The model is fitted on made-up pages (``page_templates``), the same at every run.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.boosted import Trees, fit_trees
from spanlake.llm.common import python_ready
from spanlake.llm.dom import Forest, parse
from spanlake.llm.page_templates import MARK, pages as template_pages

#: Made-up pages that the model is fitted on, and their seed.
TRAIN_PAGES, SEED = 700, 11
#: Pseudo-count of an attribute token or tag; log odds that a node brings into the decoding at most; pages of a block.
SMOOTHING, MOST, BLOCK = 2.0, 6.0, 256


@dataclass(frozen=True)
class PageModel:
    """Log odds of attribute tokens and tags, and the trees."""

    tokens: dict[str, float]
    tags: dict[str, float]
    trees: Trees


def _labelled(number: int, seed: int):
    """Nodes of made-up pages without their marks, and for each node whether it holds main text."""
    import numpy as np
    htmls = list(template_pages(number, seed))
    marked, plain = (Forest([parse(x) for x in xs]) for xs in (htmls, [h.replace(MARK, "") for h in htmls]))
    main = np.array([MARK in t for t in marked.text], float)
    for level in marked.levels[:0:-1]:
        np.maximum.at(main, marked.parent[level], main[level])
    return plain, main


def fit_page_model(number: int = TRAIN_PAGES, seed: int = SEED) -> PageModel:
    """The model of ``number`` made-up pages; on the driver, in seconds, whatever the tables."""
    import numpy as np
    forest, main = _labelled(number, seed)

    def scores(names: list[tuple[str, ...]], rows) -> dict[str, float]:
        met = Counter((name, main[i] > 0) for i in rows for name in names[i])
        return {name: log((met[name, True] + SMOOTHING) / (met[name, False] + SMOOTHING)) for name in {name for name, _ in met}}

    tags = [(t,) for t in forest.tag]
    halves = [np.flatnonzero(forest.page % 2 == k) for k in (0, 1)]
    x = np.zeros((len(main), 0))
    for rows, others in (halves, halves[::-1]):  # the trees see scores that come from the other half of the pages
        seen = forest.features(scores(forest.tokens, others), scores(tags, others))
        x = x if x.size else np.zeros_like(seen)
        x[rows] = seen[rows]
    weight = 1 / np.sqrt(np.bincount(forest.page))[forest.page]
    everything = range(len(main))
    return PageModel(scores(forest.tokens, everything), scores(tags, everything), fit_trees(x, main, weight * len(weight) / weight.sum()))


def main_texts(htmls: list[str | None], model: PageModel) -> list[str]:
    """Main text of each page: kept blocks in page order, joined by blank lines; empty if there is none."""
    import numpy as np
    if not htmls:
        return []
    forest = Forest([parse(h) for h in htmls])
    odds = model.trees.log_odds(forest.features(model.tokens, model.tags))
    found: list[list[str]] = [[] for _ in htmls]
    for i in np.flatnonzero(forest.decode(np.clip(odds, -MOST, MOST))):
        if forest.text[i]:
            found[forest.page[i]].append(forest.text[i])
    return ["\n\n".join(f) for f in found]


def extract_main_text(pages: DataFrame, model: PageModel | None = None, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Main text of every page: id, the columns ``keep``, ``text``, ``n_chars`` (code points).

    The whole page is read; NULL and empty pages, and pages without a block that is kept, have an empty text.  White space (Unicode's, no-break spaces
    included) becomes one space inside a block, blocks are joined by two line feeds.  Every row comes back once, equal pages give equal texts; a very long page is
    one value of its row and takes memory in proportion; other columns play no part.  There are no ties: a node is kept if its log odds are above 0.
    """
    spark = pages.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(model or fit_page_model())  # trees and names: well below 1 MB
    columns = [id_col, *keep]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                texts = main_texts(part.column("_html").to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 names=[*columns, "text", "n_chars"])

    rows = pages.select(*columns, F.col(html_col).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_html")
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
