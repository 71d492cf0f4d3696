"""Near duplicates by MinHash with tensored banding, every link confirmed on the full sets.

Two small collections of band hashes are computed per document, and every pair of a left and a right band makes one
table key: ``bands`` squared tables cost 2 x ``bands`` x ``rows`` minima instead of 2 x ``bands`` squared x ``rows``.

Documents with the same set are one class.  In every bucket one class, drawn by hash, is compared with all others; the confirmed links
give components.  Buckets that are not inside one component are finished: the pairs of a small one that are still apart are compared,
and in the large ones the members outside the largest component meet all others block by block.  No bucket,
however large, is cut, and no pair of a bucket is left open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bounded, fresh, python_ready, stored

#: Words of a shingle, least similarity in percent, bands per collection, minima per band.
WORDS, PERCENT, BANDS, ROWS = 3, 85, 8, 2
#: Members of a bucket up to which the rest is compared pair by pair; members of a block in larger ones.
DIRECT, BLOCK = 32, 256
#: Fixed odd multipliers of the integer mixing.
_MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Stand-ins for missing ids lie below this.
_NO_ID = -(1 << 62)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; ``bytes`` splits at exactly the six ASCII spaces."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, size: int = WORDS) -> set[tuple[bytes, ...]]:
    """Distinct word shingles; a shorter text is one shingle, a text without words has none."""
    w = words(text)
    return set(zip(*[w[i:] for i in range(size)])) if len(w) >= size else {tuple(w)} if w else set()


class Signer:
    """Set size, set digest and the two collections of band hashes of a text."""

    def __init__(self, size: int, bands: int, rows: int):
        import numpy as np
        import xxhash
        self.size, self.bands, self.rows, self.np = size, bands, rows, np
        draw = np.random.default_rng(20)
        n = 2 * bands * rows
        self.factor = draw.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
        self.term = draw.integers(0, 1 << 63, n, dtype=np.uint64)
        self.mix = [np.uint64(x) for x in _MIX]

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) >= 500_000:
                    self.clear()
                value = self[word] = xxhash.xxh64_intdigest(word)
                return value

        self.hashes = Hashes()

    def shingles(self, text: str | None):
        """Sorted distinct 64-bit hashes of the shingles."""
        np, w = self.np, words(text)
        x = np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))
        if not len(w):
            return x
        if len(w) < self.size:
            x = np.append(x, np.uint64(len(w)))
        n = len(x) if len(w) < self.size else self.size
        v = np.zeros(len(x) - n + 1, np.uint64)
        for i in range(n):
            v = (v ^ (v >> np.uint64(29))) * self.mix[0] + x[i:len(x) - n + 1 + i]
        v ^= v >> np.uint64(32)
        v *= self.mix[1]
        return np.unique(v ^ (v >> np.uint64(29)))

    def bands_of(self, shingles) -> list[int]:
        """Band hashes: the left collection, then the right one."""
        np, out = self.np, []
        for band in range(2 * self.bands):
            value = np.uint64(band)
            for k in range(band * self.rows, (band + 1) * self.rows):
                z = shingles * self.factor[k] + self.term[k]
                z ^= z >> np.uint64(31)
                value = (value ^ (value >> np.uint64(29))) * self.mix[1] ^ (z * self.mix[2]).min()
            out.append(int(value.view(np.int64)))
        return out


def vertex(id_: Column, text: Column) -> Column:
    """The id, or for a row without one a stand-in that equal texts share."""
    return F.coalesce(id_.cast("long"), F.lit(_NO_ID) - F.abs(F.shiftright(F.xxhash64(F.coalesce(text, F.lit(""))), 2)) - 1)


def signatures(docs: DataFrame, size: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, digest, n, left, right) of every row, ``own`` its vertex; without words n is 0 and the bands are empty."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa
        signer = Signer(size, bands, rows)
        with np.errstate(over="ignore"):
            for batch in batches:
                digest, n, left, right = [], [], [], []
                for text in batch.column("text").to_pylist():
                    s = signer.shingles(text)
                    digest.append(blake2b(s.tobytes(), digest_size=16).digest())
                    n.append(len(s))
                    both = signer.bands_of(s) if len(s) else []
                    left.append(both[:bands])
                    right.append(both[bands:])
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(left, longs), pa.array(right, longs)],
                                                 names=["id", "own", "digest", "n", "left", "right"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), vertex(F.col(id_col), F.col(text_col)).alias("own"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, own long, digest binary, n long, left array<long>, right array<long>")


def table_keys(left: Column, right: Column) -> Column:
    """One key per table: every left band with every right band."""
    return F.flatten(F.transform(left, lambda a, i: F.transform(right, lambda b, j: F.xxhash64(i, j, a, b))))


def _verify(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(lo, hi, shared, total) of pairs of nodes: sizes of the intersection and of the union of their full sets."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"))
    both = bounded(pairs.select("lo", "hi")).join(side("lo"), "lo").join(side("hi"), "hi")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        recent: dict[str, set] = {}

        def of(text: str) -> set:
            if (found := recent.get(text)) is None:
                if len(recent) >= 64:
                    recent.clear()
                found = recent[text] = shingle_set(text, size)
            return found

        for batch in batches:
            shared, total = [], []
            for a, b in zip(batch.column("lo_text").to_pylist(), batch.column("hi_text").to_pylist()):
                x, y = of(a), of(b)
                shared.append(len(x & y))
                total.append(len(x) + len(y) - shared[-1])
            yield pa.RecordBatch.from_arrays([batch.column("lo"), batch.column("hi"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
                                             names=["lo", "hi", "shared", "total"])

    return both.mapInArrow(run, "lo long, hi long, shared long, total long")


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("lo").alias("src"), F.col("hi").alias("dst")).unionByName(links.select(F.col("hi").alias("src"), F.col("lo").alias("dst")))


def _hop(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Each node's smallest label among its own and its neighbours'."""
    near = edges.join(bounded(labels.select(F.col("node").alias("dst"), "label")), "dst").select(F.col("src").alias("node"), "label")
    return near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in ``links`` (lo, hi): label is the smallest node that can be reached.

    Labels move along the links and jump to their label's label, until nothing changes; every round is kept in the
    shared folder.
    """
    edges = stored(_both_ways(links).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("label")).withColumn("label", F.least("node", "label")), "labels")
    while True:
        spread = stored(_hop(edges, labels), "spread")
        jump = spread.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(spread.join(bounded(jump), "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        changed = new.join(bounded(labels.withColumnRenamed("label", "was")), "node").filter("label <> was")
        if changed.isEmpty():
            return new
        labels = new


def find_links(members: DataFrame, texts: DataFrame, size: int = WORDS, percent: int = PERCENT, direct: int = DIRECT) -> DataFrame:
    """(lo, hi): edges that connect the nodes of ``members`` (key, node) as the confirmed links of their buckets do.

    Any two members of a bucket are compared, unless they are already in one component.  The links of the first round come
    back as their components: each node with its component's smallest.
    """
    near = F.col("shared") * 100 >= F.col("total") * percent
    # Every bucket's centre against all its members.  Drawn in one of four orders, so that the many buckets of one group share
    # a few centres.
    draw = F.xxhash64("node", F.pmod("key", F.lit(4)))
    centres = members.groupBy("key").agg(F.count("*").alias("n"), F.min(draw).alias("first"))
    starred = stored(members.join(bounded(stored(centres, "centres")), "key").withColumn("centre", draw == F.col("first")), "starred")
    centre = starred.filter("centre").select("key", F.col("node").alias("other"))
    stars = starred.join(bounded(centre), "key").filter("node <> other")
    pairs = stars.select(F.least("node", "other").alias("lo"), F.greatest("node", "other").alias("hi")).distinct()
    tested = stored(_verify(stored(pairs, "pairs"), texts, size), "tested")
    links = tested.filter(near).select("lo", "hi").distinct()
    # What is still apart in a bucket.
    label = components(links)
    joined = label.filter("label < node").select(F.col("label").alias("lo"), F.col("node").alias("hi"))
    labelled = starred.select("key", "node", "n").join(bounded(label), "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = stored(labelled, "labelled")
    apart = stored(labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key"), "apart")
    rest = stored(labelled.join(bounded(apart), "key", "left_semi"), "rest")
    small, large = rest.filter(F.col("n") <= direct), rest.filter(F.col("n") > direct)
    other = small.select("key", F.col("node").alias("hi"), F.col("label").alias("hi_label"))
    pairs = small.select("key", F.col("node").alias("lo"), "label").join(bounded(other), "key").filter("lo < hi and label <> hi_label")
    pairs = pairs.select("lo", "hi").distinct().join(bounded(tested.select("lo", "hi")), ["lo", "hi"], "left_anti")
    more = _verify(stored(pairs, "pairs"), texts, size).filter(near).select("lo", "hi")
    return stored(joined.unionByName(more).unionByName(_links_in_clusters(large, texts, size, percent)), "links")


def _links_in_clusters(large: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(lo, hi) of links in large buckets (key, node, label), at least one for any two components that have one.

    Buckets that share members are one cluster, so that no pair is compared bucket by bucket.  In a cluster the members outside its
    largest component are compared with all others, block against block: a task sees two blocks of texts, and pairs
    exist inside it only.
    """
    first = large.groupBy("key").agg(F.min("node").alias("lo"))
    edges = large.select("key", F.col("node").alias("hi")).join(bounded(stored(first, "heads")), "key").select("lo", "hi").distinct()
    cluster = components(edges).withColumnRenamed("label", "cluster")
    nodes = stored(large.select("node", "label").distinct().join(bounded(cluster), "node"), "clusters")
    sizes = nodes.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(
        F.max(F.struct("n", "label"))["label"].alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    sizes = stored(sizes.filter("n > most"), "cluster-sizes")
    blocks = lambda c: F.ceil(c / F.lit(BLOCK)).cast("int")
    placed = nodes.join(bounded(sizes), "cluster").withColumn("outside", F.col("label") != F.col("main"))
    placed = placed.withColumns({"rows": blocks(F.col("n") - F.col("most")), "columns": blocks(F.col("n"))})
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    upto = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = placed.filter("outside").select("cluster", block("rows").alias("i"), upto("columns").alias("j"), F.lit(True).alias("asks"), "node", "label")
    right = placed.select("cluster", upto("rows").alias("i"), block("columns").alias("j"), F.lit(False).alias("asks"), "node", "label")
    sides = bounded(stored(left.unionByName(right), "blocks")).join(texts, "node")

    def compare(group):
        import numpy as np
        import pandas as pd
        ids: dict[tuple, int] = {}
        sets = [np.array([ids.setdefault(s, len(ids)) for s in shingle_set(t, size)], np.int64) for t in group["text"]]
        node, label, asks = group["node"].to_numpy(), group["label"].to_numpy(), group["asks"].to_numpy()
        answers = [k for k in range(len(sets)) if not asks[k] and len(sets[k])]
        found: list[tuple[int, int]] = []
        if answers:
            flat, lengths = np.concatenate([sets[k] for k in answers]), np.array([len(sets[k]) for k in answers])
            starts, mark = np.concatenate(([0], lengths.cumsum()[:-1])), np.zeros(len(ids), np.int64)
            for k in np.flatnonzero(asks):
                if not len(sets[k]):
                    continue
                mark[sets[k]] = 1
                shared = np.add.reduceat(mark[flat], starts)
                mark[sets[k]] = 0
                linked: dict[int, int] = {}
                for at in np.flatnonzero(shared * 100 >= percent * (lengths + len(sets[k]) - shared)):
                    x = answers[at]
                    if label[x] != label[k]:  # one link to a component is enough
                        linked[label[x]] = min(linked.get(label[x], node[x]), node[x])
                found += [(min(node[k], x), max(node[k], x)) for x in linked.values()]
        return pd.DataFrame(found, columns=["lo", "hi"]).astype("int64")

    return sides.groupBy("cluster", "i", "j").applyInPandas(compare, "lo long, hi long")


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link texts whose shingle sets have at least ``percent`` similarity; one row per input row.

    id, ``n_shingles``, ``component_id`` (smallest id that can be reached), ``kept`` (the row with that id stays).  A text without
    words is linked with nothing.  Ids are the vertices: rows repeated with one id belong together, and of rows without
    an id those with equal texts; such rows have the smallest id of their component, or NULL if there is none.  Of
    a component without ids the rows of one text stay.  Ids are above -2^62.  Other columns play no part; an empty
    table gives no rows.
    """
    return _judged(docs, size, percent, bands, rows, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, size: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(id, own, n_shingles, component_id, kept) of every row."""
    signed = stored(signatures(docs, size, bands, rows, id_col, text_col), "signatures")
    filled = signed.filter("n > 0")
    first = F.min(F.struct(F.col("own").alias("node"), "left", "right")).alias("first")
    classes = stored(filled.groupBy("digest").agg(first).select("digest", "first.*"), "classes")
    # Rows and their class: both are plain tables, so Spark splits a class that holds much of the corpus.
    copies = filled.select("own", "digest").join(bounded(classes.select("digest", "node")), "digest").filter("own <> node")
    copies = stored(copies.select(F.col("node").alias("lo"), F.col("own").alias("hi")).distinct(), "copies")
    members = classes.select("node", F.explode(table_keys(F.col("left"), F.col("right"))).alias("key")).select("key", "node")
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    members = stored(members.join(bounded(shared), "key", "left_semi"), "candidates")
    wanted = stored(members.select("node").distinct(), "wanted")
    texts = docs.select(vertex(F.col(id_col), F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    texts = stored(texts.join(bounded(wanted), "node", "left_semi"), "texts")
    parts = components(find_links(members, texts, size, percent).unionByName(copies))
    real = F.when(F.col("node") >= F.lit(_NO_ID), F.col("node"))
    smallest = stored(parts.groupBy("label").agg(F.min(real).alias("component")), "components")
    membership = stored(parts.join(bounded(smallest), "label").select(F.col("node").alias("own"), "label", "component"), "membership")
    out = signed.select("id", "own", "n").join(bounded(membership), "own", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("component"))
    stays = F.when(component.isNull(), F.coalesce(F.col("label"), F.col("own")) == F.col("own")).otherwise(F.col("id").eqNullSafe(component))
    return out.select("id", "own", F.col("n").alias("n_shingles"), component.alias("component_id"), stays.alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all their columns as they are.

    Of rows repeated with one id or of one text without an id the smallest by all columns stays.
    """
    found = _judged(docs, size, percent, bands, rows, id_col, text_col).filter("kept")
    own, stays, n = fresh(docs, "_vertex", "_own", "_n")
    stay = stored(found.groupBy(F.col("own").alias(stays)).agg(F.count("*").alias(n)), "stay")
    keyed, same = docs.withColumn(own, vertex(F.col(id_col), F.col(text_col))), F.col(own) == F.col(stays)
    single = keyed.join(bounded(stay.filter(F.col(n) == 1)), same, "left_semi").drop(own)
    again = keyed.join(bounded(stay.filter(F.col(n) > 1)), same, "left_semi")
    first = again.groupBy(own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return single.unionByName(first)
