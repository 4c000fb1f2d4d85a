"""How often rows are sent: shuffles in plans, which grow with the input."""

import re

from ledgerloom.operators import evidence as ev
from ledgerloom.operators import history, replay
from ledgerloom.operators import tx as T
from ledgerloom.sources import derived

SF = "/root/testdata/sf0.001"


def shuffles(df) -> list[str]:
    """The keys of each shuffle in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


def test_movements_lie_by_transaction(spark):
    rows = derived.balance_delta(spark, SF)
    assert len(shuffles(T.tx_heads(rows))) == 1
    assert len(shuffles(T.ranked(T.spent_addresses(rows)))) == 1


def test_degrees_send_an_address_once_a_transaction(spark):
    odd = ["a", "b\x1f", "b", "\x1b1", "\x1f", "\x1b", ""]
    rows = [("c", "t1", x) for x in odd] + [("c", "t2", x) for x in odd[:2]] + [("c", "t3", "alone"), ("d", "t1", "a"), ("d", "t1", None), ("d", "t1", "z")]
    got = history.degrees(spark.createDataFrame(rows, "chain_id string, txid string, address string"))
    assert {(r.chain_id, r.address): r.degree for r in got.collect()} == {("c", x): 6 for x in odd} | {("d", "a"): 1, ("d", "z"): 1}
    assert not any("other" in keys for keys in shuffles(got))


def test_degrees_share_the_shuffle_of_transactions(spark):
    rows = derived.balance_delta(spark, SF)
    assert [k.split("#")[0] for k in shuffles(history.degrees(rows))] == ["address", "txid"]


def test_record_leaves_candidates_at_their_transactions(spark):
    rows = [("c", "a", "b", "t1"), ("c", "a", "h", "t1"), ("c", "h", "b", None), ("c", "x", "x", "t2"), ("d", "a", "h", "t1")]
    candidates = spark.createDataFrame(rows, "chain_id string, address_a string, address_b string, source_txid string")
    addresses = spark.createDataFrame([("c", "h", True), ("c", "a", False)], "chain_id string, address string, is_hub boolean")
    accepted, rejected = ev.record(candidates, addresses)
    assert sorted(map(tuple, accepted.collect())) == [("c", "a", "b", "t1"), ("d", "a", "h", "t1")]
    assert len(rejected.collect()) == 3
    assert not any("address_a" in keys or "address_b" in keys for keys in shuffles(accepted))


def test_pairs_are_combined_where_they_are(spark):
    rows = [("c", 1, "a", "b", "t1", 0.5), ("c", 2, "b", "a", "t2", 0.5), ("c", 3, "a", "b", "t2", 0.2)]
    evidence = spark.createDataFrame(rows, "chain_id string, op_id long, address_a string, address_b string, source_txid string, confidence double")
    pairs = replay.combined_pairs(evidence)
    assert len(shuffles(pairs)) == 1
    assert [tuple(r) for r in pairs.collect()] == [("c", "a", "b", 0.75, 1)]
