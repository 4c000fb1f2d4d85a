from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.queries import ORACLE, QUERIES
from ledgerloom.llm.urls import filter_urls, host_of, patterns_of
from ledgerloom.llm.warc import Bundle, parsed, read_bundles, write_bundles

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_as_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(ORACLE[name])
    got = QUERIES[name](spark, SF).select(want.columns).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want.fetchall()))


def test_target_weights(spark, monkeypatch):
    rows = [(i, "x" * 50, "big" if i % 3 else "small") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = Counter(r.source for r in mix_sources(df, {"big": 1.0, "small": 1.0}).collect())
    assert abs(n["big"] - 3000) < 300 and abs(n["small"] - 3000) < 300
    one = mix_sources(df, {"small": 1.0}, total=50.0 * 20_000)
    got = one.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copies").alias("c"), F.max("copy").alias("last"))
    assert got.where("n <> c or last <> c").count() == 0 and {r.source for r in one.select("source").distinct().collect()} == {"small"}
    assert abs(one.count() - 20_000) < 600
    plain = {(r.doc_id, r.copies) for r in mix_sources(df, {"big": 1.0, "small": 1.0}).collect()}
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)  # the way of many sources
    assert {(r.doc_id, r.copies) for r in mix_sources(df, {"big": 1.0, "small": 1.0}).collect()} == plain


def test_mixing_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "text", None), (3, "text", "b"), (3, "text", "b"), (4, "y" * 300_000, "b"), (5, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"copy": F.lit("own"), "extra": F.lit(1)})
    out = mix_sources(df, {"b": 1.0}, default=1.0, total=3e6)
    got = out.collect()
    assert {r.source for r in got} <= {"a", "b", None, "empty"} and "extra" in out.columns and not any(r.source == "empty" for r in got)
    assert Counter(r.copy for r in got if r.doc_id == 3).most_common(1)[0][1] in (0, 2)
    assert mix_sources(df.limit(0), {"b": 1.0}).count() == 0 and mix_sources(df, {}).count() == 0


def at(text):
    return datetime.fromisoformat(text)


def test_url_filter(spark):
    entries = [("example.org", "2024-01-10", "block"), ("example.org", "2024-02-10", "remove"), ("www.example.org", "2024-01-15", "allow"), ("www.example.org/ads", "2024-01-20", "block"), ("example.org", "2024-03-01", "block"), (None, "2024-01-01", "block")]
    e = spark.createDataFrame([(p, at(t), a) for p, t, a in entries], "pattern string, listed_at timestamp, action string")
    rows = [
        (1, "http://a.example.org/x", "2024-01-09", "pass", None), (2, "http://a.Example.org/x", "2024-01-10", "block", "example.org"), (3, "https://www.example.org/", "2024-01-16", "allow", "www.example.org"),
        (4, "https://u:p@www.example.org:8080/ads/1?q", "2024-01-21", "block", "www.example.org/ads"), (5, "https://www.example.org/adsense", "2024-01-21", "allow", "www.example.org"), (6, "http://example.org", "2024-02-10", "pass", None),
        (7, "http://example.org", "2024-03-02", "block", "example.org"), (8, "nonsense", "2024-03-02", "pass", None), (9, None, "2024-03-02", "pass", None), (10, "http://example.org.", None, "pass", None), (7, "http://example.org", "2024-03-02", "block", "example.org"),
        (11, "http://myexample.org/", "2024-03-02", "pass", None),
    ]
    captures = spark.createDataFrame([(i, u, t and at(t)) for i, u, t, _, _ in rows], "page_id long, url string, fetched_at timestamp").withColumns({"pattern": F.lit("own"), "u": F.lit(1), "t": F.lit(2)})
    got = sorted((r.page_id, r.verdict, r.pattern) for r in filter_urls(captures, e).collect())
    assert sorted(map(str, got)) == sorted(str((i, v, p)) for i, _, _, v, p in rows)
    assert filter_urls(captures.limit(0), e).count() == 0
    assert {r.verdict for r in filter_urls(captures, e.limit(0)).collect()} == {"pass"}


def test_patterns(spark):
    df = spark.createDataFrame([("HTTP://A.b.c.de:1/x//y/z/w?q#f",), ("http://localhost/",), ("x",), (None,)], "u string")
    got = [(r.h, r.p) for r in df.select(host_of(F.col("u")).alias("h"), patterns_of(F.col("u")).alias("p")).collect()]
    assert got[0] == ("a.b.c.de", [d + p for d in ("a.b.c.de", "b.c.de", "c.de") for p in ("", "/x", "/x/y", "/x/y/z")])
    assert got[1] == ("localhost", ["localhost"]) and got[2] == ("", []) and got[3][1] == []


def test_bundles(spark):
    big = "<p>" + "ü" * 400_000
    rows = [(3, "http://a/1", "x" * 100), (1, "http://a/2", "x" * 100), (2, "http://a/3", "x" * 99), (4, "http://a/4", "x" * 99), (5, "u\r\nWARC-Type: x", None), (6, None, ""), (7, "http://a/7", big), (8, "http://a/8", big), (None, "n", "x" * 100), (9, "d", "\r\n\r\nWARC/1.1"), (1, "http://a/2", "x" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("own"), "refers_to": F.lit(0)})
    index = write_bundles(df)
    back = read_bundles(index).collect()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in back}
    assert len(back) == len(rows)
    assert kinds == {(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (None, "revisit", 1), (9, "response", None)}
    html = {i: h for i, _, h in rows}
    assert all(r.payload.decode() == (html[r.page_id] or "") for r in back if r.record_type == "response")
    assert {r.page_id: r.payload_bytes for r in back}[8] == len(big.encode())
    assert write_bundles(df.limit(0)).count() == 0
    # one record by the index alone: a seek and one frame
    from pyarrow import fs

    row = index.where("page_id = 9").first()
    bundle = Bundle(fs.LocalFileSystem().open_input_file(row.bundle.removeprefix("file://")))
    assert parsed(bundle.frame(row.frame), row.offset)[2] == b"\r\n\r\nWARC/1.1"
    # all frames, one after the other, are an ordinary Zstandard stream of records
    import zstandard

    raw = open(row.bundle.removeprefix("file://"), "rb").read()
    text = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\nWARC-Type") == index.where(F.col("bundle") == row.bundle).count()


def test_deep_paths(spark):
    e = spark.createDataFrame([("example.com/a/b/c/d", at("2024-01-01"), "block"), ("example.com/a/b/c/d/e/f", at("2024-01-01"), "allow")], "pattern string, listed_at timestamp, action string")
    urls = ["http://example.com/a/b/c/d", "http://example.com/a/b/c/d/e/x", "http://example.com/a/b/c/d/e/f/g", "http://example.com/a/b/c"]
    captures = spark.createDataFrame([(u, at("2024-02-01")) for u in urls], "url string, fetched_at timestamp")
    got = {r.url: r.verdict for r in filter_urls(captures, e).collect()}
    assert [got[u] for u in urls] == ["block", "block", "allow", "pass"]


def test_paths_of_domains_above(spark):
    e = spark.createDataFrame([("example.com/fr", at("2024-01-01"), "block"), ("m.example.com", at("2024-01-01"), "allow"), ("a.b.m.example.com/fr/x", at("2024-01-01"), "block")], "pattern string, listed_at timestamp, action string")
    urls = ["http://x.example.com/fr/1", "http://a.b.m.example.com/fr", "http://a.b.m.example.com/fr/x", "http://example.com/de"]
    captures = spark.createDataFrame([(u, at("2024-02-01")) for u in urls], "url string, fetched_at timestamp").withColumns({"_b": F.lit(1), "best_entry": F.lit(2), "URL_asked": F.lit(3), "a.b": F.lit(4), "u": F.lit(5), "n": F.lit(6)})
    got = {r.url: r for r in filter_urls(captures, e).collect()}
    assert [(got[u].verdict, got[u].pattern) for u in urls] == [("block", "example.com/fr"), ("block", "example.com/fr"), ("block", "a.b.m.example.com/fr/x"), ("pass", None)]
    assert all((r._b, r.best_entry, r.URL_asked, r["a.b"], r.u, r.n) == (1, 2, 3, 4, 5, 6) for r in got.values())


def test_helper_columns_of_the_mixture_clash_with_none(spark):
    own = ["s_source", "s_bytes", "s_rate", "s_u", "s_salt", "rate_of_source", "u_of_row", "a.b"]
    df = spark.createDataFrame([(i, "x" * 50, "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string").select("*", *[F.lit(c).alias(c) for c in own])
    out = mix_sources(df, {"a": 3.0}, default=1.0)
    assert out.columns == [*df.columns, "copies", "copy", "shuffle_key"] and all(r[c] == c for r in out.collect() for c in own)
