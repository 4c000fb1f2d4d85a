import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import history, preprocess
from ledgerloom.operators import tx as T
from tests.helpers import deltas


def names(df, column="address"):
    return {r[column] for r in df.collect()}


def test_grouping_spent_and_received(spark):
    d = deltas(spark, ("t1", "A", -10), ("t2", "D", -5), ("t1", "B", -20), ("t1", "C", 30), ("t1", "A", -5), ("t1", "Z", 0), ("t1", "N", None))
    groups = T.tx_groups(d).orderBy("tx_pos").collect()
    assert [(g.txid, len(g.deltas)) for g in groups] == [("t1", 6), ("t2", 1)]
    assert [r.address for r in T.spent_addresses(d).where("txid = 't1'").orderBy("pos").collect()] == ["A", "B"]
    assert names(T.received_entries(d)) == {"C"}
    assert names(T.tx_addresses(d).where("txid = 't1'")) == {"A", "B", "C", "Z", "N"}


def test_dust_boundary(spark):
    d = deltas(spark, ("t", "A", 100), ("t", "B", 546), ("t", "C", 547), ("t", "D", -100), ("t", "A", 50))
    assert names(T.dust_inflows(d, "546")) == {"A", "B"}


def test_dust_only_counts_earlier_flags(spark):
    spend = deltas(spark, ("t", "P1", -50), ("t", "P2", -150), ("t", "R", 180))
    already = spark.createDataFrame([("bitcoin", "P1"), ("bitcoin", "P2")], "chain_id string, address string")
    assert names(preprocess.mark_dust(spend, already)[1], "txid") == {"t"}
    assert names(preprocess.mark_dust(spend, already.where("address = 'P1'"))[1], "txid") == set()


@pytest.mark.parametrize("outs,ins,found", [([300, 300, 300], 3, True), ([300, 300, 300, 2050], 3, True), ([300, 400], 2, False), ([300, 300, 300], 2, False)])
def test_collaborative(spark, outs, ins, found):
    rows = [("t", f"i{k}", -1000) for k in range(ins)] + [("t", f"o{k}", v) for k, v in enumerate(outs)]
    got = preprocess.mark_collaborative(deltas(spark, *rows)).collect()
    assert [(r.txid, r.reason, float(r.detector_confidence)) for r in got] == ([("t", "coinjoin", 0.8)] if found else [])


def test_later_exclusion_wins(spark):
    one = spark.createDataFrame([("c", "t", "coinjoin", None, None)], schemas.EXCLUDED_TX)
    two = spark.createDataFrame([("c", "t", "dust-only", None, None)], schemas.EXCLUDED_TX)
    assert [r.reason for r in preprocess.merged_exclusions(one.limit(0), one, two).collect()] == ["dust-only"]


def test_hub_scores(spark):
    df = spark.createDataFrame([(0, 50.0), (25, 50.0), (50, 50.0), (100, 50.0), (5, 0.0)], "d int, s double")
    assert [r[0] for r in df.select(preprocess.hub_score(F.col("d"), F.col("s"))).collect()] == [0, 0.5, 1, 1, 0]


def test_hubs_by_degree_and_label(spark):
    d = deltas(spark, *[x for k in range(4) for x in ((f"t{k}", "H", -10), (f"t{k}", f"p{k}", 9))])
    label = lambda i, a, c, s: (i, "address", "bitcoin", None, a, "L", c, "x", None, None, None, s)
    labels = spark.createDataFrame([label(1, "p1", "scam", "active"), label(2, "p1", "exchange", "retired"), label(3, "p1", "mixer", "active"), label(4, "p1", "bridge", "active")], schemas.LABEL)
    got = {r.address: (r.hub_type, r.hub_confidence) for r in preprocess.mark_hubs(d, d, labels, preprocess.Params(hub_degree_saturation=3)).collect()}
    assert got == {"H": ("unknown", 1.0), "p1": ("mixer", 0.99)}


def test_degrees_shared_and_sources(spark):
    d = deltas(spark, ("t1", "A", -5), ("t1", "B", -5), ("t1", "X", 10), ("t2", "A", -5), ("t2", "X", 5), ("t3", "X", -1), ("t3", "X", 1))
    assert {r.address: r.degree for r in history.degrees(d).collect()} == {"A": 2, "B": 2, "X": 2}
    assert {(r.a, r.b): r.shared for r in history.shared_transactions(d).collect()} == {("A", "B"): 1, ("A", "X"): 2, ("B", "X"): 1}
    assert {r.target: r.sources for r in history.sources_of_targets(d).collect()} == {"X": 2}
    approximate = {r.address: r.degree for r in history.approximate_degrees(d).collect()}
    assert approximate == {"A": 2, "B": 2, "X": 2}
