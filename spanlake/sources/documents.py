"""Items of very large JSON documents, read by many tasks.

A file that holds one array (or one object) is read in byte ranges whose rows end at closing braces.  Whether such a brace ends an item depends
on what stands before it: is the place inside a string, and how deep.  Every range therefore yields the map from the state at its start
(inside a string or not, depth) to the state at its end and to the number of items that end in it: quotes decide the string state by
parity, brackets outside strings the depth.  The maps of a file are composed in order, which gives every range its start state;
a second pass then cuts the items.  Only the pieces of items that reach over two ranges are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanlake.operators.staging import written

_SPACE = r"[ \t\r\n]"


def _pieces(spark: SparkSession, paths: str | Sequence[str], files: DataFrame | None) -> DataFrame:
    """Texts between closing braces, with their quotes and their change of depth from outside (``d0``) and from inside a string (``d1``)."""
    rows = spark.read.option("lineSep", "}").text(paths if isinstance(paths, str) else list(paths))
    rows = rows.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"))
    if files is not None:
        rows = rows.join(files.select(F.col("file").alias("_file")), "_file", "left_semi")
    count = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    plain = F.when(F.instr("value", "\\") > 0, F.regexp_replace("value", r"\\(?s:.)", "")).otherwise(F.col("value"))
    outside = lambda c: F.regexp_replace(c, r'"[^"]*+(?:"|\z)', "")
    depth = lambda c: (count(c, "[{") - count(c, "]")).cast("int")
    rows = rows.withColumn("_plain", plain)
    return rows.select("_file", "_block", "_size", "value", count(F.col("_plain"), '"').cast("int").alias("quotes"), depth(outside("_plain")).alias("d0"),
                       depth(outside(F.regexp_replace("_plain", r'^[^"]*+(?:"|\z)', ""))).alias("d1"))


def _runs(batch, columns: list[str]) -> Iterator[tuple]:
    """Slices of a batch that belong to one range: (file, block, slices of the columns)."""
    import numpy as np
    files, blocks = batch.column("_file").dictionary_encode(), batch.column("_block").to_numpy()
    codes = files.indices.to_numpy()
    cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(blocks)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield files.dictionary[int(codes[a])].as_py(), int(blocks[a]), [batch.column(c).slice(a, b - a) for c in columns]


def _ranges(batches: Iterator, columns: list[str]) -> Iterator[tuple]:
    """(file, block, columns, last) for the pieces of each range in order; its last piece comes alone, with ``last``.

    Rows of a range follow each other in a partition.
    """
    import pyarrow as pa
    open_, held = None, None
    for batch in batches:
        for file, block, found in _runs(batch, columns):
            if (file, block) == open_:
                found = [pa.concat_arrays([h, f]) for h, f in zip(held, found)]
            elif open_ is not None:
                yield *open_, held, True
            n = len(found[0]) - 1
            if n:
                yield file, block, [f.slice(0, n) for f in found], False
            open_, held = (file, block), [f.slice(n) for f in found]
    if open_ is not None:
        yield *open_, held, True


def _walk(quotes, d0, d1, inside: int, depth: int):
    """State after every piece, before its brace counts, from the state at the start: (inside a string, depth), and the end of both with all braces."""
    import numpy as np
    total = np.cumsum(quotes)
    before = (inside + total - quotes) & 1
    after = (inside + total) & 1
    closes = (after == 0).astype(np.int64)
    change = np.where(before == 1, d1, d0)
    deep = depth + np.cumsum(change) - (np.cumsum(closes) - closes)
    return after, deep, closes


def _range_maps(batches: Iterator) -> Iterator:
    """One row a range: for both string states at its start the end state and the closing braces outside strings by relative depth.

    The brace after the last piece stands apart (``last_*``): at the end of a file there may be none.
    """
    from collections import Counter

    import numpy as np
    import pyarrow as pa
    names = ["_file", "_block", "_size", "bytes", "lead", "quotes", "depth", "ends", "last_outside", "last_depth"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.bool_()), pa.list_(pa.int64())]
    state: dict = {}
    for file, block, columns, last in _ranges(batches, ["quotes", "d0", "d1", "bytes", "lead", "_size"]):
        quotes, d0, d1, bytes_ = (c.to_numpy().astype(np.int64) for c in columns[:4])
        if not state:
            state = {"lead": columns[4][0].as_py(), "size": columns[5][0].as_py(), "quotes": 0, "bytes": 0, "depth": [0, 0], "ends": [Counter(), Counter()]}
        state["bytes"] += int(bytes_.sum()) + len(bytes_)
        outside, at = [False, False], [0, 0]
        for q in (0, 1):
            after, deep, closes = _walk(quotes, d0, d1, (q + state["quotes"]) & 1, state["depth"][q])
            if last:
                outside[q], at[q] = bool(closes[-1]), int(deep[-1]) - 1
                state["depth"][q] = int(deep[-1])
            else:
                state["ends"][q].update((deep - 1)[closes == 1].tolist())
                state["depth"][q] = int(deep[-1] - closes[-1])
        state["quotes"] += int(quotes.sum())
        if last:
            row = [file, block, state["size"], state["bytes"], state["lead"], state["quotes"], state["depth"], [[x for kv in e.items() for x in kv] for e in state["ends"]], outside, at]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)
            state = {}


def document_ranges(pieces: DataFrame) -> DataFrame:
    """(_file, _block, level, inside, depth, before, closed, items): the start state of every range, the items that end before it,
    whether a brace follows its last piece, and the items of its file.  A file that is no single array or object raises."""
    lead = F.substring(F.regexp_replace("value", f"^{_SPACE}+", ""), 1, 1)
    slim = pieces.select("_file", "_block", "_size", F.octet_length("value").cast("long").alias("bytes"), lead.alias("lead"), "quotes", "d0", "d1")
    maps = slim.mapInArrow(_range_maps, "_file string, _block long, _size long, bytes long, lead string, quotes long, depth array<long>, ends array<array<long>>, last_outside array<boolean>, last_depth array<long>")
    by_file = W.partitionBy("_file")  # one row a range
    before = by_file.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    ranges = maps.withColumns({
        "inside": (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"),
        "level": F.when(F.first("lead").over(by_file.orderBy("_block")) == "[", 1).otherwise(0),
        "opener": F.first("lead").over(by_file.orderBy("_block")),
        # A byte order mark is not among the pieces.
        "gap": F.col("_size") - F.sum("bytes").over(by_file), "final": F.max("_block").over(by_file) == F.col("_block")})
    ranges = ranges.withColumn("closed", ~F.col("final") | F.col("gap").isin(0, 3))
    mine = lambda c: F.get(F.col(c), F.col("inside"))
    ranges = ranges.withColumn("change", mine("depth") - F.when(F.col("closed") & mine("last_outside"), 1).otherwise(0))
    ranges = ranges.withColumn("depth_in", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("int"))
    level = F.col("level") - F.col("depth_in")  # of an item's end, seen from the start of the range
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(mine("ends")) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.get(mine("ends"), 2 * i) == level)
    ended = F.coalesce(F.get(mine("ends"), 2 * F.get(pairs, F.lit(0)) + 1), F.lit(0)) + (F.col("closed") & mine("last_outside") & (mine("last_depth") == level)).cast("int")
    ranges = ranges.withColumn("ended", ended.cast("long"))
    ranges = ranges.withColumns({
        "before": F.coalesce(F.sum("ended").over(before), F.lit(0)), "items": F.sum("ended").over(by_file),
        "wrong": (F.sum("change").over(by_file) != 0) | (F.sum("quotes").over(by_file) % 2 != 0) | ~F.col("opener").isin("[", "{", "") | ((F.col("level") == 0) & (F.sum("ended").over(by_file) > 1))})
    problem = F.concat(F.lit("not one JSON array or object of records: "), F.col("_file"), F.lit(" ("), F.col("items").cast("string"), F.lit(" items found)"))
    return ranges.select("_file", "_block", F.when(F.col("wrong"), F.raise_error(problem).cast("int")).otherwise(F.col("level")).alias("level"), "inside",
                         F.col("depth_in").alias("depth"), "before", "closed", "items")


def _cut(batches: Iterator) -> Iterator:
    """(_file, _block, item, whole, text): items that lie in one range, and what is left at both ends of the range."""
    import numpy as np
    import pyarrow as pa
    names, kinds = ["_file", "_block", "item", "whole", "text"], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    state: dict = {}
    out: list[tuple] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    for file, block, columns, last in _ranges(batches, ["quotes", "d0", "d1", "value", "level", "inside", "depth", "before", "closed"]):
        quotes, d0, d1 = (c.to_numpy().astype(np.int64) for c in columns[:3])
        texts = columns[3].to_pylist()
        if not state:
            level, inside, depth, before, closed = (c[0].as_py() for c in columns[4:])
            state = {"level": level, "inside": inside, "depth": depth, "item": before, "first": True, "open": []}
        after, deep, closes = _walk(quotes, d0, d1, state["inside"], state["depth"])
        ends = np.flatnonzero((closes == 1) & (deep - 1 == state["level"])).tolist()
        if last and not closed:
            ends = []
        at = 0
        for e in ends:
            text = "}".join([*state["open"], *texts[at:e + 1], ""])
            out.append((file, block, state["item"], not state["first"], text))
            state["open"], state["first"], at = [], False, e + 1
            state["item"] += 1
            size += len(text)
        state["open"] += texts[at:]
        if last:
            text = "}".join(state["open"]) + ("}" if closed and state["open"] else "")
            if text:
                out.append((file, block, state["item"], False, text))
            state = {}
        else:
            state["inside"], state["depth"] = int(after[-1]), int(deep[-1] - closes[-1])
        if size > 1 << 22 or len(out) > 10_000:
            yield flush()
            out, size = [], 0
    if out:
        yield flush()


def document_items(spark: SparkSession, paths: str | Sequence[str], files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Items of files that hold one JSON array or object: ((_file, item, value), (_file, items)).

    ``files`` (file) restricts the paths to some of their files.  ``item`` counts from 0 in a file, in its order.  Blank files have no items.  Anything
    before, between or after the items is an error that names the file and the item; whether an item itself is valid is left to who parses it.
    An item may be as large as a row; a file of any size is read by as many tasks as it has splits (a compressed one by one).
    """
    pieces = _pieces(spark, paths, files)
    ranges = written(document_ranges(pieces), "document-ranges")
    # One row a range of the input: fewer than the file listing that Spark keeps on the driver.
    placed = pieces.join(F.broadcast(ranges), ["_file", "_block"]).select("_file", "_block", "quotes", "d0", "d1", "value", "level", "inside", "depth", "before", "closed")
    cut = placed.mapInArrow(_cut, "_file string, _block long, item long, whole boolean, text string")
    counts = ranges.groupBy("_file").agg(F.max("level").alias("level"), F.max("items").alias("items"))
    whole = cut.filter("whole").select("_file", "item", _value(F.col("item"), F.lit(1), F.col("text"), F.col("_file")).alias("value"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "text"))), lambda x: x["text"])  # two pieces a range at most
    joined = cut.filter("not whole").groupBy("_file", "item").agg(F.array_join(parts, "").alias("text")).join(F.broadcast(counts), "_file")
    rest = F.col("item") == F.col("items")  # what follows the last item
    text = F.col("text")
    ended = F.when(F.col("level") == 0, text.rlike(rf"^{_SPACE}*\z")).when(F.col("items") == 0, text.rlike(rf"^{_SPACE}*(\[{_SPACE}*\]{_SPACE}*)?\z")).otherwise(text.rlike(rf"^{_SPACE}*\]{_SPACE}*\z"))
    checked = F.when(rest, F.when(ended, F.lit(None).cast("string")).otherwise(_refuse(F.col("item"), F.col("_file")))).otherwise(
        _value(F.col("item"), F.col("level"), F.col("text"), F.col("_file")))
    edges = joined.select("_file", "item", checked.alias("value"))
    # A tail that is as it should be has no value and is no item.
    return whole.unionByName(edges.filter(F.col("value").isNotNull())), counts.select("_file", "items")


def _refuse(item: Column, file: Column) -> Column:
    return F.raise_error(F.concat(F.lit("not one JSON array or object of records: "), file, F.lit(" around item "), (item + 1).cast("string"))).cast("string")


def _value(item: Column, level: Column, text: Column, file: Column) -> Column:
    """The item without what belongs before it: the bracket, a comma, or nothing."""
    cases = [(level == 0, f"^{_SPACE}*(?=\\{{)"), (item == 0, rf"^{_SPACE}*\[{_SPACE}*(?=\{{)"), (F.lit(True), f"^{_SPACE}*,{_SPACE}*(?=\\{{)")]
    return F.coalesce(*[F.when(_first(cases, k) & text.rlike(before), F.regexp_replace(text, before, "")) for k, (_, before) in enumerate(cases)], _refuse(item, file))


def _first(cases: list[tuple[Column, str]], k: int) -> Column:
    """Does case ``k`` hold and none before it?"""
    out = cases[k][0]
    for condition, _ in cases[:k]:
        out = out & ~condition
    return out
