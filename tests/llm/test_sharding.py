import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.sharding import balanced_shards


def checked(rows, texts, shards):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 8 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "rows" and r.grown_shard is None
    sizes = [len(by[s]) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("shards", [5, 24])
def test_even_and_together(spark, shards):
    texts = {i: f"t{i}" if i % 3 else f"copy{i % 60}" for i in range(1500)}
    rows = balanced_shards(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shards).collect()
    checked(rows, texts, shards)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    groups = [v for t, v in where.items() if t.startswith("copy")]
    assert sum(len(v) == 1 for v in groups) >= 0.8 * len(groups)


def test_a_group_of_a_third_fills_whole_shards(spark):
    texts = {i: "hot" if i % 3 == 0 else f"t{i}" for i in range(1200)}
    rows = balanced_shards(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 24).collect()
    checked(rows, texts, 24)
    hot = Counter(r.shard for r in rows if texts[r.doc_id] == "hot")
    assert len(hot) <= 16


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "x"), (None, "x"), (5, "é" * 200_000), (5, "é" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("own"), "g": F.lit(1), "part": F.lit(2)})
    got = balanced_shards(df, 3).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [2, 3, 3] and len({(r.shard, r.slot) for r in got}) == 8
    assert sorted(r.size for r in got) == [8, 8, 8, 8, 9, 9, 400_008, 400_008]
    assert balanced_shards(df.limit(0), 3).count() == 0
    few = balanced_shards(df.limit(1), 24).collect()
    assert [(r.shard, r.slot) for r in few] == [(0, 0)]
