"""What reads over rebuilt clusters make and send, and that odd names and heights come through it."""

import pytest

from ledgerloom import schemas
from ledgerloom.functions.names import short, whole
from ledgerloom.operators import evidence as ev
from ledgerloom.operators import heuristics, history, preprocess, replay
from ledgerloom.operators import tx as T
from ledgerloom.plans import api, queries
from ledgerloom.sources import derived
from tests.helpers import context, deltas, evidence
from tests.test_scale import shuffles

SF = "/root/testdata/sf0.001"
LABELS = "label_id long, target_type string, chain_id string, target_address string, category string, status string"


@pytest.mark.parametrize("name", ["q1_clusters_at_threshold", "q2_members_page_at_threshold"])
def test_names_at_a_threshold_take_no_replay(spark, monkeypatch, name):
    def none(*_, **__):
        raise AssertionError("a replay was made")

    monkeypatch.setattr(api, "replay", none)
    monkeypatch.setattr(replay, "replay", none)
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_clusters_without_confidences(spark):
    rows = evidence(spark, (1, "a", "b", 0.9, "t1"), (2, "y", "x", 0.5, "t2"), (3, "b", "c", 0.4, None), (4, "c", "d", 0.9, "t3", "invalidated"), (5, "q", "q", 0.9, "t4"))
    for least in (0.0, 0.5, 0.95):
        want = replay.replay(rows, least).select("chain_id", "address", "cluster_id", "anchor_address", "size")
        assert sorted(map(tuple, replay.clusters_of(rows, least).collect())) == sorted(map(tuple, want.collect()))


def test_entity_flow_sends_an_address_once(spark):
    name = "0123456789abcdef" * 2
    d = deltas(spark, ("t1", "a", -1), ("t1", "b", -1), ("t1", "x", 1), ("t1", name.upper(), 1), ("t1", "a", 1), ("t2", "b", -1), ("t2", "x", 2), ("t2", "", 3), ("t2", None, 3), ("t2", "z", 0))
    members = spark.createDataFrame([("bitcoin", "a", name), ("bitcoin", "b", name)], "chain_id string, address string, cluster_id string")
    flow = api.entity_flow(d, members)
    assert {(r.from_entity, r.to_entity): r.transactions for r in flow.collect()} == {(name, "x"): 2, (name, name.upper()): 1, (name, ""): 1}
    stored = derived.stored_balance_delta(spark, SF)
    keys = shuffles(api.entity_flow(stored, stored.select("chain_id", "address", "address").toDF("chain_id", "address", "cluster_id")))
    assert {k.split("#")[0] for k in keys} == {"address", "txid", "f"} and not any("entity" in k for k in keys)


def test_stored_movements_lie_by_transaction(spark):
    stored = derived.stored_balance_delta(spark, SF)
    assert shuffles(T.tx_heads(stored)) == []
    assert sorted(map(str, stored.collect())) == sorted(map(str, derived.balance_delta(spark, SF).collect()))


def test_registry_by_one_shuffle(spark):
    big = [(f"u{k}", a, 1, 7 + k) for k in range(40) for a in ("big", f"p{k}")]
    odd = [("t1", "a\x1fb", 5, 3), ("t1", "a", -5, 4), ("t1", None, 600, 2), ("t2", "a", 600, None), ("t3", "", 9, 9), ("t3", "a\x1fb", 900, 1), ("t4", "alone", 900, None)]
    d = deltas(spark, *big, *odd)
    labels = spark.createDataFrame([(1, "address", "bitcoin", "a", "mixer", "active"), (2, "address", "bitcoin", "absent", "mixer", "active")], LABELS)
    got = preprocess.registered(d, labels)
    assert got.schema.simpleString() == spark.createDataFrame([], schemas.ADDRESS).schema.simpleString()
    rows = {r.address: tuple(r)[2:] for r in got.collect()}
    by = {}
    for r in d.collect():
        by.setdefault(r.address, []).append(r)
    assert rows.keys() == by.keys()
    for a, of in by.items():
        heights = [r.block_height for r in of if r.block_height is not None]
        assert rows[a][:2] == (min(heights, default=None), max(heights, default=None))
        assert rows[a][-1] == any(0 < int(r.amount) <= 546 for r in of)
    assert {a: (r[3], float(r[4])) for a, r in rows.items() if r[2]} == {"big": ("unknown", 0.8), "a": ("mixer", 0.99)}
    table = derived.stored_balance_delta(spark, SF)
    found = history.summaries(table, preprocess.hub_labels(derived.label(spark, SF)).limit(0), T.is_dust(table["amount"], "546"), 50)
    assert sum("address" in k and "target" not in k for k in shuffles(found)) == 1


def test_candidates_that_are_judged(spark):
    d = deltas(spark, ("t1", "a", -5), ("t1", "b", -5), ("t1", "hub", 3), ("t1", "new", 3))
    c = context(spark, d, hubs=["hub"])
    rows = lambda dfs: [sorted(map(str, df.collect())) for df in dfs]
    for engine in (heuristics.common_input, heuristics.funding):
        judged = ev.record(engine(d, c, judged=True), c.addresses)
        assert rows(judged) == rows(ev.record(engine(d, c), c.addresses))
        assert not any("source" in k for k in shuffles(judged[0]))


def test_evidence_of_addresses_meets_the_log_once(spark):
    rows = evidence(spark, (1, "a", "b", 0.9, "t1"), (2, "b", "c", 0.9, "t2"), (3, "c", "d", 0.9, "t3", "invalidated"), (4, "x", "x", 0.9, "t4"))
    asked = spark.createDataFrame([("bitcoin", a) for a in ("a", "b", "d", "d", "x", "none")] + [("other", "c")], "chain_id string, address string")
    found = ev.by_addresses(rows, asked)
    assert [r.op_id for r in found.collect()] == [1, 2, 3, 4] and found.columns == rows.columns
    assert len(found._jdf.queryExecution().optimizedPlan().collectLeaves().toString().split("LogicalRDD")) <= 3


def test_short_names_are_whole_again(spark):
    names = ["", "a", "ab", "abc", "AB", "00", "ä", "0" * 64, "\x01ab", None, "ab\n"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", short(df.n).alias("s"), whole(short(df.n)).alias("w")).collect()
    assert all(r.n == r.w for r in got) and len({bytes(r.s) for r in got if r.s is not None}) == len(names) - 1
