"""Quality classifier, languages and shards."""

from __future__ import annotations

from zlib import crc32

from corpus import SF, empty, frame, rows

from spanlake.llm import language as lg
from spanlake.llm import quality_classifier as qc
from spanlake.llm import sharding as sh

SITE = "data"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = qc.classify_quality(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    assert got[got.truth == 1].kept.mean() > 0.97 and got[got.truth == 0].kept.mean() < 0.35


def test_hard_rows_of_quality(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (61, 0), (63, 0), (63, 0), (None, 1), (7, None)], "doc_id long, quality int")
    got = qc.classify_quality(frame(spark), labels)
    plain = got.collect()
    assert sorted(map(repr, (r.doc_id for r in plain))) == sorted(repr(i) for i, *_ in rows())
    assert not any(r.kept for r in plain if r.n_words == 0)
    stay = qc.keep_good(frame(spark), labels)
    assert stay.columns == frame(spark).columns and stay.count() == sum(r.kept for r in plain)
    assert qc.classify_quality(empty(spark), labels).count() == 0 == qc.keep_good(empty(spark), labels).count()
    nothing = qc.classify_quality(frame(spark), labels.limit(0)).collect()
    assert all(r.evidence == 0 and r.kept == (r.n_words > 0) for r in nothing)


def test_rates_shrink_to_the_level_above(spark):
    data = [("big", "a", 3.0)] * 400 + [("big", "b", -3.0)] * 2 + [("small", "a", -3.0)] + [(None, None, 0.0)]
    scored = spark.createDataFrame(data, "host string, path string, evidence double")
    rates = {(r.host, r.path): r for r in qc.site_rates(scored, 0.5).collect()}
    good = lambda x: 1 / (1 + 2.718281828459045 ** -x)
    big = (400 * good(3) + 2 * good(-3) + 0.5 * qc.HOST_STRENGTH) / (402 + qc.HOST_STRENGTH)
    assert len(rates) == 4 and abs(rates["big", "b"].host_rate - big) < 1e-9
    assert abs(rates["big", "b"].path_rate - (2 * good(-3) + big * qc.PATH_STRENGTH) / (2 + qc.PATH_STRENGTH)) < 1e-9
    assert rates["small", "a"].path_rate > good(-3) + 0.3  # one document says little
    assert abs(rates[None, None].path_rate - 0.5) < 1e-9


def test_languages_of_documents(spark):
    docs, _ = tables(spark)
    hidden = docs.selectExpr("doc_id", "text", "source", "lang as truth", "if(doc_id % 3 = 0, null, lang) as lang")
    got = lg.identify_languages(hidden).join(hidden.select("doc_id", "truth"), "doc_id").filter("declared is null and n_words > 5").toPandas()
    assert (got.language == got.truth).mean() > 0.95


def test_languages_of_pages(spark):
    pages = lg.page_rows(spark.read.parquet(f"{SF}/pages.parquet"))
    got = lg.identify_languages(pages, declared="declared", host="host", id_col="page_id").toPandas()
    assert len(got) == pages.count() and (got.language == got.declared).mean() > 0.9


def test_page_fields(spark):
    data = [("https://u@News.Example.CO.uk:80/x?y", "<HTML class=a LANG='de-AT'><script>no()</script><p>Ja &amp; gut</p>"), (None, None), ("nonsense", "<html>")]
    got = lg.page_rows(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(data)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.declared, r.host) for r in got] == [("de", "news.example.co.uk"), (None, None), (None, None)]
    assert "no()" not in got[0].text and "Ja" in got[0].text


def test_hard_rows_of_languages(spark):
    plain = lg.identify_languages(frame(spark)).collect()
    assert sorted(map(repr, (r.doc_id for r in plain))) == sorted(repr(i) for i, *_ in rows())
    assert all((r.language is None and not r.kept) == (r.n_words == 0) for r in plain)
    stay = lg.keep_languages(frame(spark))
    assert stay.columns == frame(spark).columns and stay.count() == sum(r.kept for r in plain)
    assert lg.identify_languages(empty(spark)).count() == 0 == lg.keep_languages(empty(spark)).count()


POLISH = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować".split()
FOREIGN = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "人人生而自由，在尊严和权利上一律平等。", "Bütün insanlar hür ve haklar bakımından eşit doğarlar",
           "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti", "xq zzkp qwv jjx kkq vbnm zxq wqp lkjx qqz xcvw zzq"]


def test_languages_are_the_declared_ones_or_none(spark):
    docs = tables(spark)[0].select("doc_id", "text", "lang", "source")
    polish = [(1000 + i, " ".join(POLISH[i % 5:] + POLISH[:i % 7]), ("pl", "pol", "pl-PL", None)[i % 4], "src0") for i in range(40)]
    foreign = [(2000 + i, text, lang, "src0") for i, (text, lang) in enumerate((t, x) for t in FOREIGN for x in (None, "en"))]
    both = docs.union(spark.createDataFrame(polish + foreign, docs.schema))
    got = {r.doc_id: r for r in lg.identify_languages(both).collect()}
    assert all(got[i].language == "pl" and got[i].kept for i, *_ in polish)
    assert all(got[i].language == got[i].text_language == "und" and not got[i].kept for i, *_ in foreign)
    known = [got[r.doc_id] for r in docs.collect()]
    assert sum(r.kept and r.language == r.declared for r in known if r.n_words > 5) > 0.95 * sum(r.n_words > 5 for r in known)
    assert {r.doc_id for r in lg.keep_languages(both).collect()} == {i for i, r in got.items() if r.kept}


def test_declarations_are_whole_subtags(spark):
    want = {"est": "et", "es-MX": "es", "ESP": "esp", "spa": "es", "en_US.UTF-8": "en", " German ": "de", "und": None, "n/a": None, "no info": None, "": None, "x-klingon": None, None: None}
    got = spark.createDataFrame([*enumerate(want)], "i int, says string").select("says", lg.declared_language(lg.F.col("says")).alias("lang")).collect()
    assert {r.says: r.lang for r in got} == want


def check_shards(docs, got, shards, close):
    bytes_of = lambda t: len((t or "").encode()) + 1
    crc = lambda t: crc32((t or "").encode())
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((i, bytes_of(t), crc(t)) for i, t in docs), key=repr)
    per, slots, homes = {}, {}, {}
    for r in got:
        per[r.shard] = per.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert set(per) <= set(range(shards))
    if close:
        assert len(per) == shards and max(per.values()) - min(per.values()) <= close * sum(per.values()) / shards


def test_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    check_shards(plain, sh.shard_documents(docs, 8).collect(), 8, 0.08)
    check_shards(plain, sh.shard_documents(docs, target_bytes=500_000).collect(), 5, 0.08)


def test_hard_rows_of_shards(spark):
    check_shards([(i, t) for i, t, *_ in rows()], sh.shard_documents(frame(spark), 4).collect(), 4, None)
    check_shards([(i, t) for i, t, *_ in rows()], sh.shard_documents(frame(spark), 1).collect(), 1, None)
    assert sh.shard_documents(empty(spark), 8).count() == 0


def test_even_leaves_where_all_points_agree(spark):
    points = spark.range(4000).selectExpr("cast(id as string) as key", "1L as weight", "1.0D as a", "0.0D as b")
    counts = [r["count"] for r in sh.kd_leaves(points, ["a", "b"], 6).groupBy("leaf").count().collect()]
    assert len(counts) == 6 and max(counts) - min(counts) <= 4


def test_strings_with_a_common_beginning_split_the_shards(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', lpad(id, 6, '0')) as text", "concat('https://site-', id % 4, '.org') as source", "'en' as lang")
    got = sh.shard_documents(docs, 4).join(docs, "doc_id").groupBy("source").agg({"shard": "min"}).collect()
    mixed = sh.shard_documents(docs, 4).join(docs, "doc_id").select("source", "shard").distinct().count()
    assert {r["min(shard)"] for r in got} == {0, 1, 2, 3} and mixed == 4
    ranks = sh.value_ranks(docs, "source").orderBy("_rank").collect()
    assert [tuple(r) for r in ranks] == [(f"https://site-{i}.org", float(i)) for i in range(4)]
