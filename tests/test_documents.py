import json
import random

import pytest
from pyspark.sql import functions as F

from spanlake.sources.documents import _pieces, document_items
from spanlake.sources.records import read_records

SCHEMA = "a long, s string, o struct<x:string,l:array<struct<y:long>>>"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}

    def use(size, rows=10_000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def some_items(rng, n):
    strings = ['}', '{', '"', '\\', '}"', '\\"}', '[{"', "plain", "", "é日🎉}", '\\\\"', "a,b]", "]}"]
    text = lambda: "".join(rng.choice(strings) for _ in range(rng.randint(0, 6)))
    return [{"a": i, "s": text(), "o": {"x": text(), "l": [{"y": k} for k in range(rng.randint(0, 3))]}} for i in range(n)]


def found(spark, path):
    rows = read_records(spark, path, spark.createDataFrame([], SCHEMA).schema, layout="document").orderBy("row_idx").collect()
    return [(r.row_idx, json.loads(json.dumps(r.asDict(True)))) for r in rows]


@pytest.mark.parametrize("seed, size, rows, indent", [(1, 64, 10_000, None), (2, 200, 3, None), (3, 1000, 7, 1), (4, 100_000, 10_000, None), (5, 37, 2, 2)])
def test_any_split_gives_the_items_of_the_whole_text(spark, tmp_path, small_splits, seed, size, rows, indent):
    items = some_items(random.Random(seed), 60)
    path = write(tmp_path / "a.json", json.dumps(items, indent=indent, ensure_ascii=bool(seed % 2)))
    small_splits(size, rows)
    got = found(spark, path)
    assert [i for i, _ in got] == list(range(60))
    assert [{k: r[k] for k in ("a", "s", "o")} for _, r in got] == items


def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_splits):
    items = [{"a": i, "s": "x}" * 50} for i in range(20_000)]
    path = write(tmp_path / "a.json", json.dumps(items))
    small_splits(100_000)
    assert _pieces(spark, path, None).rdd.getNumPartitions() > 15
    rows = read_records(spark, path, spark.createDataFrame([], "a long, s string").schema)
    assert rows.agg(F.count("*"), F.sum((F.col("a") == F.col("row_idx")).cast("int")), F.sum(F.length("s"))).first()[:] == (20_000, 20_000, 2_000_000)


@pytest.mark.parametrize("text, items", [
    ("[]", []), (" [ \n ] \n", []), ("\n \t", []), ("[{}]", ["{}"]), ('{"a":1}', ['{"a":1}']), (' {"a":{"b":[{}]}}\n', ['{"a":{"b":[{}]}}']),
    ("[{},\n{ }\n,{}]", ["{}", "{ }", "{}"]), (b"\xef\xbb\xbf[{}]", ["{}"]), ('[{"a":"\\\\"},{"b":"\\"}"}]', ['{"a":"\\\\"}', '{"b":"\\"}"}']), (b"\xef\xbb\xbf{}", ["{}"]),
])
def test_documents(spark, tmp_path, small_splits, text, items):
    path = write(tmp_path / "a.json", text)
    small_splits(3)
    rows, counts = document_items(spark, path)
    assert [(r["item"], r["value"]) for r in rows.orderBy("item").collect()] == list(enumerate(items))
    assert sum(r["items"] for r in counts.collect()) == len(items)


@pytest.mark.parametrize("text", [
    "[1]", "[1, {}]", "[{} {}]", "[{},]", "[,{}]", "[{}", "{}]", "{", "{} {}", "{}{}", "[{}] x", "x [{}]", '[{"a]', "[[{}]]", '"a"', "[{}],[{}]", '[{"a":"x}]', "[{},,{}]", "nothing", '[{}, "}"]',
])
def test_other_documents_are_refused(spark, tmp_path, small_splits, text):
    small_splits(4)
    with pytest.raises(Exception, match="not one JSON array or object"):
        document_items(spark, write(tmp_path / "a.json", text))[0].collect()


def test_an_invalid_item_is_named(spark, tmp_path):
    path = write(tmp_path / "a.json", '[{"a": 1}, {"a": 2}, {"a" 3}, {"a": 4}]')
    with pytest.raises(Exception, match="invalid JSON in row 3 of"):
        read_records(spark, path, spark.createDataFrame([], "a long").schema).collect()


def test_files_of_all_kinds(spark, tmp_path, small_splits):
    """Lines, arrays and objects in one folder: rows in the order of the files' names."""
    write(tmp_path / "1.json", "\n".join(json.dumps({"a": i}) for i in range(5)))
    write(tmp_path / "2.json", json.dumps([{"a": i} for i in range(5, 30)]))
    write(tmp_path / "3.json", json.dumps({"a": 30}, indent=4))
    write(tmp_path / "4.json", "  \n")
    write(tmp_path / "5.json", json.dumps([{"a": i} for i in range(31, 40)], indent=2))
    small_splits(100)
    for schema in (spark.createDataFrame([], "a long").schema, None):
        got = read_records(spark, str(tmp_path), schema).orderBy("row_idx").collect()
        assert [(r.row_idx, r.a) for r in got] == [(i, i) for i in range(40)]
