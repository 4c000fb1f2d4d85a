"""What queries move and make: nothing twice, nothing that they don't need, and no partition that grows with the tables."""

import pytest

from ledgerloom.operators import history, preprocess, reorg
from ledgerloom.operators.evidence import folded
from ledgerloom.plans import queries
from ledgerloom.sources import storage
from tests.helpers import NOW, deltas, evidence

SF = "/root/testdata/sf0.001"


def test_reader_makes_the_registry_once(spark, monkeypatch):
    made, of = [], queries.registry_of
    monkeypatch.setattr(queries, "registry_of", lambda *a: made.append(1) or of(*a))
    reader = queries.reader(spark, SF)
    assert len(made) == 1
    assert reader.addresses.where("is_hub").count() == queries.hubs(spark, SF).count()


@pytest.mark.parametrize("name", ["j7_not_excluded", "j8_no_hub_touched", "h2_sweep"])
def test_no_registry_where_none_is_read(spark, monkeypatch, name):
    def none(*_):
        raise AssertionError("a registry was made")

    monkeypatch.setattr(queries, "registry_of", none)
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_degrees_up_to_a_number(spark):
    odd = ["a\x1fb", "a\x1b1b", "a", "b", "", "a\x1b0"]  # would run together without an escape
    rows = [(f"t{k}", a, 1) for k in range(3) for a in odd[: k + 2]] + [("t9", "alone", 1), ("t0", None, 1)] + [(f"u{k}", a, 1) for k in range(40) for a in ("big", f"p{k}")]
    d = deltas(spark, *rows)
    whole = {r.address: r.degree for r in history.degrees(d).collect()}
    assert whole["big"] == 40 and whole["a"] == 3
    for most in (1, 2, 3, 39, 40, 41):
        assert {r.address: r.degree for r in history.degrees(d, most=most).collect()} == {a: min(n, most) for a, n in whole.items()}
    asked = d.where("address in ('big', 'b')").select("chain_id", "address")
    assert {r.address: r.degree for r in history.degrees(d, asked, 5).collect()} == {"big": 5, "b": 3}


def test_hubs_are_marked_without_pairs(spark):
    rows = [(f"u{k}", a, 1) for k in range(40) for a in ("big", f"p{k}")]
    d = deltas(spark, *rows)
    none = spark.createDataFrame([], "label_id long, target_type string, chain_id string, target_address string, category string, status string")
    hubs = preprocess.mark_hubs(d, d, none)
    assert [(r.address, r.hub_confidence) for r in hubs.collect()] == [("big", 0.8)]
    assert "other" not in hubs._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_the_table(spark, monkeypatch, tmp_path):
    spark.range(20_000).selectExpr("id", "uuid() u").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").groupBy("u").count()
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    monkeypatch.setattr(storage, "PARTITION", 1 << 14)
    with storage.small_partitions(spark, df):
        assert int(spark.conf.get(key)) > 20
    assert spark.conf.get(key) == before
    with storage.small_partitions(spark, spark.createDataFrame([(1,)], "a int")):
        assert spark.conf.get(key) == before
    assert storage.written(df, "t", small=True).count() == 20_000


def test_registry_has_the_dust_flags(spark, monkeypatch):
    flags = lambda df: {(r.address, r.dust_flag) for r in df.collect()}
    registry = queries.registry_of(spark, SF)
    assert flags(registry) == flags(queries.QUERIES["k7_dust_flags"](spark, SF))
    assert {f for _, f in flags(registry)} == {True, False}
    monkeypatch.setattr(queries.T, "dust_inflows", lambda *_: 1 / 0)  # another pass over the movements
    assert queries.context(spark, SF).excluded.count() > 0


def test_rolled_back_as_by_events(spark):
    rows = evidence(spark, (1, "a", "b", 0.9, "t1", "active", "x"), (2, "a", "c", 0.5, None, "active", "y"), (3, "b", "c", 0.5, "t3", "invalidated", "x"), (4, "c", "d", 0.5, "t4", "active", None))
    gone = spark.createDataFrame([("bitcoin", "x"), ("bitcoin", "x"), ("other", "y"), ("bitcoin", None)], "chain_id string, block_hash string")
    events, _ = reorg.on_reorg(rows, gone, NOW)
    want = sorted(map(str, folded(rows, events).collect()))
    assert sorted(map(str, reorg.rolled_back(rows, gone).collect())) == want
    assert sum("reorg" in w for w in want) == 1
