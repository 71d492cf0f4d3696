"""Exact and near duplicates against brute force."""

from __future__ import annotations

from hashlib import sha256

from corpus import empty, frame, rows
from pyspark.sql import functions as F

from spanlake.llm import exact_dedup as ed
from spanlake.llm import near_dedup as nd


def by_text(data):
    groups = {}
    for i, text, *_ in data:
        groups.setdefault(text or "", []).append(i)
    return groups


def test_exact_duplicates(spark):
    for block in (ed.BLOCK, 64, 3):  # one, several and very many levels
        data = rows() if block > 3 else [r for r in rows() if len(r[1] or "") < 2000]
        groups, want, seen = by_text(data), [], set()
        for i, text, *_ in data:
            ids = groups[text or ""]
            keep = max((x for x in ids if x is not None), default=None)
            first = (i, text or "") not in seen
            seen.add((i, text or ""))
            want.append((i, keep, len(ids), i == keep and first, sha256((text or "").encode()).hexdigest()))
        got = [tuple(r) for r in ed.exact_duplicates(frame(spark, data), block=block).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ed.exact_duplicates(empty(spark)).count() == 0


def test_blocks_that_share_a_key_get_different_names(spark):
    values = [(1, b"a"), (1, b"b"), (1, b"b"), (2, b"a"), (1, b"c"), (None, b"z")]
    items = spark.createDataFrame([(n, k, bytearray(v)) for n, (k, v) in enumerate(values)], "row long, key long, value binary")
    names = {r.row: (r.key, r["rank"]) for r in ed.name_values(items, "test").collect()}
    assert len({names[i] for i in range(5)}) == 4 and names[1] == names[2] and len(names) == 6


def test_rows_that_stay(spark):
    data = rows()
    stay = ed.drop_duplicates(frame(spark, data))
    assert stay.columns == frame(spark, data).columns
    got = [(r.doc_id, r.text) for r in stay.collect()]
    assert len(got) == len(by_text(data)) == len({t or "" for _, t in got})
    assert all(i == max((x for x in by_text(data)[t or ""] if x is not None), default=None) for i, t in got)
    assert ed.drop_duplicates(empty(spark)).count() == 0


def plain_components(data, size, percent):
    """vertex -> smallest vertex; vertices are ids, or texts for rows without one."""
    sets, parent = {}, {}
    for i, text, *_ in data:
        v = ("id", i) if i is not None else ("text", text or "")
        sets.setdefault(v, []).append(nd.shingle_set(text, size))
        parent[v] = v

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    vertices = sorted(sets)
    linked = lambda a, b: any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])
    for n, a in enumerate(vertices):
        for b in vertices[:n]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in vertices}


def check(spark, data, size, percent):
    parts = plain_components(data, size, percent)
    want = []
    for i, text, *_ in data:
        root = parts[("id", i) if i is not None else ("text", text or "")]
        component = root[1] if root[0] == "id" else None
        want.append((i, len(nd.shingle_set(text, size)), component, component is None or i == component))
    got = [tuple(r) for r in nd.near_duplicates(frame(spark, data), size, percent).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_duplicates(spark):
    check(spark, rows(), 3, 85)
    assert nd.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_by_five_words(spark):
    check(spark, rows(), 5, 80)


def test_a_chain_through_large_buckets(spark, monkeypatch):
    """Copies of copies, first and last far apart: pair by pair and block by block."""
    words = [f"v{i}" for i in range(120)]
    data = []
    for i in range(24):
        data.append((i, " ".join(words), "en", "s"))
        words[(7 * i) % 120] = f"u{i}"
    docs = frame(spark, data)
    parts = plain_components(data, 3, 85)
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    for direct, block in ((2, 256), (2, 5), (64, 256)):
        monkeypatch.setattr(nd, "BLOCK", block)
        members = texts.select(F.lit(1).cast("long").alias("key"), "node")
        links = nd.find_links(members, texts, direct=direct)
        found = {r.node: r.label for r in nd.components(links).collect()}
        assert {("id", k): ("id", found.get(k, k)) for k, *_ in data} == parts


def test_rows_left_of_near_copies(spark):
    data = rows()
    stay = nd.drop_near_duplicates(frame(spark, data))
    parts = plain_components(data, 5, 80)
    assert stay.columns == frame(spark, data).columns
    assert stay.count() == len({*parts.values()})
    assert nd.drop_near_duplicates(empty(spark)).count() == 0


def test_no_large_broadcast(spark, monkeypatch):
    """Ids compress well: their files stay below Spark's own limit, their rows on the driver don't."""
    plans, keep = [], nd.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, name)

    links = keep(spark.range(200_000).selectExpr("id * 2 as lo", "id * 2 + 1 as hi"), "test-links")
    monkeypatch.setattr(nd, "stored", watched)
    found = nd.components(links)
    assert found.count() == 400_000 and found.filter("label <> node - node % 2").count() == 0
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
