import pytest

from ledgerloom.operators import evidence as ev
from ledgerloom.operators import heuristics as h
from ledgerloom.operators.registry import HeuristicParams, heuristic_params
from tests.helpers import NOW, context, deltas, edges, registry_of

CREATED = '{"contract_creation":true}'


def test_common_input(spark):
    d = deltas(spark, ("t", "A", -10), ("t", "B", -20), ("t", "C", -30), ("t", "D", 55))
    found = h.common_input(d, context(spark, d))
    assert edges(found) == [("A", "B", 0.95), ("A", "C", 0.95)]
    assert {r.source_block_hash for r in found.collect()} == {"b100"}
    assert edges(h.common_input(d, context(spark, d, hubs=["B"]))) == [("A", "C", 0.95)]
    assert edges(h.common_input(d, context(spark, d, hubs=["A"]))) == [("B", "C", 0.95)]
    assert edges(h.common_input(d, context(spark, d, excluded=["t"]))) == []


def test_common_input_needs_two_spenders_and_keeps_transactions_in_order(spark):
    d = deltas(spark, ("t2", "X", -1), ("t1", "A", -1), ("t2", "Y", -1), ("t1", "B", -1), ("t3", "Z", -1))
    assert edges(h.common_input(d, context(spark, d))) == [("X", "Y", 0.95), ("A", "B", 0.95)]


def test_disabled_heuristics_give_nothing(spark):
    d = deltas(spark, ("t", "A", -10), ("t", "B", -20))
    off = {k: (0.5, False, HeuristicParams()) for k in h.ENGINES}
    c = context(spark, d)
    c.config = off
    assert h.generate(d, c) is None


def test_sweep(spark):
    d = deltas(spark, ("t1", "O1", -1000, 1), ("t1", "D1", 1000, 1), ("t2", "O2", -500, 1), ("t2", "D2", 500, 1), ("t3", "D1", -1000, 2), ("t3", "T", 1000, 2), ("t4", "D2", -500, 2), ("t4", "T", 500, 2))
    assert edges(h.sweep(d, context(spark, d, targets=[("T", 0.95)]))) == [("T", "D1", 0.9), ("T", "D2", 0.9)]
    assert edges(h.sweep(d, context(spark, d, targets=[("T", 0.7)]))) == [("T", "D1", 0.7), ("T", "D2", 0.7)]


def test_sweep_isn_t_a_part_payment_nor_exactly_nine_tenths(spark):
    d = deltas(spark, ("t1", "O", -1000), ("t1", "S", 1000), ("t2", "S", -100), ("t2", "T", 100), ("t3", "O2", -1000), ("t3", "S2", 1000), ("t4", "S2", -900), ("t4", "T", 900))
    assert edges(h.sweep(d, context(spark, d, targets=[("T", 0.95)]))) == []


def test_change(spark):
    d = deltas(spark, ("t1", "in", -9321, 10), ("t1", "pay", 5000, 10), ("t1", "back", 4321, 10))
    later = deltas(spark, ("t1", "in", -9321, 10), ("t1", "pay", 5000, 10), ("t1", "back", 4321, 10), ("t2", "back", -4321, 11))
    assert edges(h.change(d, context(spark, d, history_=later))) == [("in", "back", 0.4)]
    assert edges(h.change(d, context(spark, d, history_=later, hubs=["pay"]))) == []
    assert edges(h.change(d, context(spark, d, history_=later, excluded=["t1"]))) == []


def test_change_takes_the_first_of_equal_scores(spark):
    d = deltas(spark, ("t", "in", -30, 10), ("t", "x", 11, 10), ("t", "y", 19, 10))
    assert edges(h.change(d, context(spark, d)))[0][:2] == ("in", "x")


def test_funding_and_deployer(spark):
    d = deltas(spark, ("t", "F", -10**9), ("t", "N", 10**9), chain="ethereum")
    assert edges(h.funding(d, context(spark, d, chain="ethereum"))) == [("F", "N", 0.6)]
    assert edges(h.funding(d, context(spark, d, chain="ethereum", hubs=["F"]))) == []
    older = deltas(spark, ("t0", "N", 1, 50), ("t", "F", -10**9), ("t", "N", 10**9), chain="ethereum")
    assert edges(h.funding(d, context(spark, d, chain="ethereum", history_=older))) == []
    made = deltas(spark, ("t", "F", -5 * 10**8, 100), ("t", "K", 5 * 10**8, 100, CREATED), ("t", "L", 7, 100, '{"contract_creation":"true"}'), chain="ethereum")
    assert edges(h.deployer(made, context(spark, made, chain="ethereum"))) == [("F", "K", 0.85)]
    assert edges(h.funding(made, context(spark, made, chain="ethereum"))) == [("F", "L", 0.6)]


def test_behavioral(spark):
    d = deltas(spark, *[x for k in range(3) for x in ((f"t{k}", "B", -1), (f"t{k}", "A", 1))])
    got = h.behavioral(d, context(spark, d))
    assert edges(got) == [("A", "B", 0.3)] and got.first().source_txid == "t0"
    assert edges(h.behavioral(d, context(spark, d, hubs=["A"]))) == []
    few = d.where("txid <> 't2'")
    assert edges(h.behavioral(few, context(spark, few))) == []


@pytest.mark.parametrize("raw,want", [(None, (0.9, 2)), ('{"completeness_min":0.75}', (0.75, 2)), ("not json", (0.9, 2)), ('{"recurrence_min":"x"}', (0.9, 2)), ("[1]", (0.9, 2))])
def test_parameters(raw, want):
    p = heuristic_params(raw)
    assert (p.completeness_min, p.recurrence_min) == want


def test_merge_guards_and_dense_numbers(spark):
    rows = [("c", f"a{i}", f"b{i}", "common-input", "t", "h", 1, 0.95, i % 2, i, 0, 0) for i in range(50)] + [("c", "x", "x", "common-input", "t", "h", 1, 0.95, 0, 100, 0, 0), ("c", "hub", "y", "common-input", "t", "h", 1, 0.95, 0, 101, 0, 0)]
    from ledgerloom import schemas

    candidates = spark.createDataFrame(rows, schemas.CANDIDATE)
    accepted, rejected = ev.record(candidates, registry_of(spark, deltas(spark), hubs=["hub"], chain="c"))
    assert rejected.count() == 2
    numbered = ev.appended(ev.numbered(accepted, after=7, buckets=5), NOW).orderBy("op_id").collect()
    assert [r.op_id for r in numbered] == list(range(8, 58))
    assert [r.address_a for r in numbered] == [f"a{i}" for i in [*range(0, 50, 2), *range(1, 50, 2)]]
