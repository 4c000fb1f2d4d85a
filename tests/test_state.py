"""Ingest, evidence, rollback, labels, reads and metrics over stored state; the stream into it."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import evidence as ev
from ledgerloom.operators import ingest, labels, registry, reorg
from ledgerloom.plans import api
from ledgerloom.plans.pipeline import Pipeline
from ledgerloom.plans.producer import produce
from ledgerloom.plans.state import State
from ledgerloom.streaming.consumer import consume, label_maintenance, start
from ledgerloom.sources import wire
from tests.helpers import NOW, deltas, evidence


@pytest.fixture
def state(spark, tmp_path):
    s = State(spark, f"file://{tmp_path}/state")
    catalogue = registry.heuristics(spark)
    chains, own = registry.add_chain(s.read("chain"), s.read("chain_heuristic"), catalogue, "bitcoin", "Bitcoin", "utxo", "BTC", 8, 6, "bitcoin", now=NOW)
    chains, own = registry.add_chain(chains, own, catalogue, "ethereum", "Ethereum", "account", "ETH", 18, 12, "evm-lowercase", now=NOW)
    s.commit(replace={"chain": chains, "heuristic": catalogue, "chain_heuristic": own})
    return s


def reader(state):
    return api.Reader(state.read("cluster_membership"), state.read("cluster"), Pipeline(state).evidence(), state.read("label"), state.read("address"))


def test_chains_get_the_heuristics_of_their_model(state):
    keys = {(r.chain_id, r.heuristic_key) for r in state.read("chain_heuristic").collect()}
    assert ("bitcoin", "common-input") in keys and ("ethereum", "common-input") not in keys and ("ethereum", "manual") in keys
    config = registry.heuristic_config(state.read("chain_heuristic"), state.read("heuristic"))
    assert registry.confidence_for(config, "bitcoin", "change") == (0.4, True)
    assert registry.confidence_for(config, "bitcoin", "deployer") == (0.0, False)


@pytest.mark.parametrize("config,want", [("{}", "546"), ('{"dust_threshold":"1000","hub_threshold":0.7}', "1000"), ('{"dust_threshold":1000}', ValueError), ('{"dust_threshold":"x"}', ValueError), ("[]", ValueError), ("no json", ValueError)])
def test_preprocessing_parameters(spark, config, want):
    chains = spark.createDataFrame([("c", "C", "utxo", "C", 8, 6, "n", config, True, NOW)], schemas.CHAIN)
    if isinstance(want, str):
        assert registry.preprocessing_params(chains, "c").dust_threshold == want
    else:
        with pytest.raises(want):
            registry.preprocessing_params(chains, "c")
    with pytest.raises(LookupError):
        registry.preprocessing_params(chains, "other")


def test_config_file(tmp_path, monkeypatch):
    monkeypatch.setenv("LOOM_HOST", "db:1")
    (tmp_path / "c.yaml").write_text("# c\nstore:\n  url: ${LOOM_HOST}/x\n  name: 'n'\nlabel:\n  ttl: ${LOOM_UNSET}\nport: 8\n")
    assert registry.load_config(tmp_path / "c.yaml") == {"store": {"url": "db:1/x", "name": "n"}, "label": {"ttl": {}}, "port": "8"}


def test_first_writer_wins_and_a_second_time_all_is_skipped(spark):
    d = deltas(spark, ("t", "A", -1000), ("t", "B", -500), ("t", "C", 1500))
    again = d.unionByName(d.withColumns({"amount": F.lit("7"), "pos": F.col("pos") + 10}))
    new = ingest.new_deltas(again, d.limit(0))
    assert {r.amount for r in new.collect()} == {"-1000", "-500", "1500"}
    assert ingest.new_deltas(d, new).count() == 0
    assert ingest.ingest_counts(again, new).first().asDict() == {"inserted": 3, "skipped": 3}


def test_addresses_keep_their_first_height(spark):
    old = spark.createDataFrame([("bitcoin", "A", 5, 9, True, "mixer", None, False)], schemas.ADDRESS)
    got = {r.address: (r.first_seen_height, r.last_seen_height, r.is_hub, r.dust_flag) for r in ingest.upserted_addresses(old, deltas(spark, ("t", "A", 1, 3), ("u", "A", 1, 12), ("t", "B", 1, 3), ("u", "B", 1, 4))).collect()}
    assert got == {"A": (5, 12, True, False), "B": (4, 4, False, False)}


def test_evidence_scans(spark):
    e = evidence(spark, (1, "A", "B", 0.9, "t1"), (2, "B", "A", 0.9, "t2", "invalidated"), (3, "C", "D", 0.9, "t3"), (4, "A", "C", 0.9, "t4"))
    ops = lambda df: [r.op_id for r in df.collect()]
    assert ops(ev.active(e)) == [1, 3, 4]
    assert ops(ev.by_pair(e, "bitcoin", "B", "A")) == [1, 2]
    assert ops(ev.by_addresses(e, spark.createDataFrame([("bitcoin", "A"), ("bitcoin", "B")], "chain_id string, address string"))) == [1, 2, 4]
    assert ops(ev.by_blocks(e, spark.createDataFrame([("bitcoin", "b3")], "chain_id string, block_hash string"))) == [3]


def test_rollback_changes_active_rows_once(spark):
    e = evidence(spark, (1, "A", "B", 0.9, "t1", "active", "x"), (2, "C", "D", 0.9, "t2"), (3, "E", "F", 0.9, "t3", "invalidated", "x"))
    hashes = spark.createDataFrame([("bitcoin", "x")], "chain_id string, block_hash string")
    events, audit = reorg.on_reorg(e, hashes, NOW)
    assert [(r.op_id, r.reason) for r in events.collect()] == [(1, "reorg")]
    assert [json.loads(r.target) for r in audit.collect()] == [{"chain_id": "bitcoin", "op_id": 1}]
    after = ev.folded(e, events)
    assert {r.op_id: r.status for r in after.collect()} == {1: "invalidated", 2: "active", 3: "invalidated"}
    assert reorg.on_reorg(after, hashes, NOW)[0].count() == 0


def blocks(spark, rows):
    return spark.createDataFrame([("c", h, x, p, NOW) for h, x, p in rows], schemas.BLOCK)


@pytest.mark.parametrize(
    "stored,now,gone,ancestor",
    [
        ([(9, "h9"), (10, "old10")], {9: "h9", 10: "new10"}, ["old10"], 9),
        ([(7, "h7"), (8, "old8"), (9, "old9"), (10, "old10")], {7: "h7", 8: "n8", 9: "n9", 10: "n10"}, ["old10", "old9", "old8"], 7),
        ([(9, "old9"), (10, "old10")], {9: "n9", 10: "n10"}, ["old10", "old9"], 8),
    ],
)
def test_finding_a_rollback(spark, stored, now, gone, ancestor):
    s = blocks(spark, [(h, x, "") for h, x in stored])
    n = blocks(spark, [(h, x, "") for h, x in now.items()])
    tip = spark.createDataFrame([("c", 11)], "chain_id string, new_height long")
    found, ancestors = reorg.rollback(s, n, tip)
    assert [r.hash for r in found.orderBy(F.desc("height")).collect()] == gone
    assert ancestors.first().ancestor == ancestor
    assert {r.height for r in reorg.without_orphans(s, ancestors).collect()} == {h for h, _ in stored if h <= ancestor}


def test_rollback_without_history(spark):
    found, ancestors = reorg.rollback(blocks(spark, []), blocks(spark, [(4, "n4", "")]), spark.createDataFrame([("c", 5)], "chain_id string, new_height long"))
    assert found.count() == 0 and ancestors.first().ancestor == 4


def test_continuity(spark):
    rows = [(1, "a", "-"), (2, "b", "a"), (3, "c", "x"), (7, "d", "?")]
    assert {r.height: r.continuous for r in reorg.continuity(blocks(spark, rows)).collect()} == {1: True, 2: True, 3: False, 7: True}


def test_label_maintenance(spark):
    from decimal import Decimal

    row = lambda i, a, c, status, days: (i, "address", "bitcoin", None, a, "L", c, "x", Decimal("0.600"), NOW, NOW - timedelta(days=days), status)
    rows = [row(1, "A", "exchange", "active", 365), row(2, "B", "exchange", "active", 1), row(3, "B", "mixer", "active", 1), row(4, "C", "exchange", "active", 1), row(5, "C", "exchange", "stale", 1), row(6, "D", "exchange", "active", 1), row(7, "D", "mixer", "retired", 1), row(8, "E", "scam", "stale", 1), row(9, "E", "mixer", "active", 365)]
    got = {r.label_id: (r.status, str(r.source_confidence)) for r in labels.maintained(spark.createDataFrame(rows, schemas.LABEL), timedelta(days=30), 0.5, NOW).collect()}
    assert got == {1: ("stale", "0.300"), 2: ("conflicted", "0.600"), 3: ("conflicted", "0.600"), 4: ("active", "0.600"), 5: ("stale", "0.600"), 6: ("active", "0.600"), 7: ("retired", "0.600"), 8: ("conflicted", "0.600"), 9: ("conflicted", "0.300")}


def test_a_batch_end_to_end(spark, state):
    p = Pipeline(state)
    d = deltas(spark, ("t", "A", -1000, 500), ("t", "B", -2000, 500), ("t", "C", -500, 500), ("t", "R", 3450, 500))
    first = p.run("bitcoin", d, NOW)
    assert (first.inserted, first.skipped, first.rejected) == (4, 0, 0) and first.generated == first.recorded == 3  # and one of change
    r = reader(state)
    a = r.cluster_of("bitcoin", "A").first()
    assert a.confidence == 1.0 and [x.address for x in r.members_of("bitcoin", a.cluster_id).collect()] == ["A", "B", "C", "R"]
    assert r.same_cluster("bitcoin", "A", "B").first().asDict() == {"same": True, "confidence": 0.95}
    assert r.same_cluster("bitcoin", "A", "nobody").first().asDict() == {"same": False, "confidence": 0.0}
    assert r.cluster_of("bitcoin", "R", 0.9).count() == 0 and r.cluster_of("bitcoin", "B", 0.9).count() == 1
    assert [x.address for x in r.members_of("bitcoin", r.cluster_of("bitcoin", "A", 0.9).first().cluster_id, 0.9, limit=0, offset=1).collect()] == ["B", "C"]
    assert r.members_of("bitcoin", a.cluster_id, limit=0).count() == 0
    assert r.evidence_of("bitcoin", pair=("B", "A")).first().source_block_hash == "b500"
    assert r.evidence_of("bitcoin", cluster_id=a.cluster_id).count() == 3
    assert r.hub_status("bitcoin", "A").first().is_hub is False and r.hub_status("bitcoin", "nobody").count() == 0
    m = {(x.chain_id, x.name, x.label): x.value for x in api.metrics(state.read("cluster"), p.evidence(), state.read("label"), state.read("chain")).collect()}
    assert m["bitcoin", "merge_evidence_active", "common-input"] == 2 and m["bitcoin", "cluster_max_size", None] == 4 and m["ethereum", "cluster_count", None] == 0
    # a second delivery changes no membership
    again = p.run("bitcoin", d, NOW)
    assert (again.inserted, again.skipped) == (0, 4) and reader(state).cluster_of("bitcoin", "A").first() == a
    # an operator takes an edge back: once
    assert p.on_correction("bitcoin", 1, "wrong") and not p.on_correction("bitcoin", 1, "wrong")
    # the block is rolled back
    assert p.on_reorg("bitcoin", ["other"]) == 0
    assert p.on_reorg("bitcoin", ["b500"]) == 5 and p.on_reorg("bitcoin", ["b500"]) == 0
    assert reader(state).cluster_of("bitcoin", "A").count() == 0
    assert state.read("audit_log").count() == 6
    assert p.run("bitcoin", d.limit(0)).inserted == 0


def test_hubs_and_exclusions_gate_the_engines(spark, state):
    p = Pipeline(state)
    state.commit(replace={"chain": state.read("chain").withColumn("config", F.lit('{"hub_degree_saturation":8}'))})
    p.run("bitcoin", deltas(spark, *[x for k in range(4) for x in ((f"p{k}", "H", -10, 1), (f"p{k}", f"q{k}", 9, 1))]), NOW)
    p.run("bitcoin", deltas(spark, ("t", "H", -500, 2), ("t", "Ua", -300, 2), ("t", "Ub", -200, 2), ("t", "R", 1000, 2)), NOW)
    common = p.evidence().where("heuristic_key = 'common-input'").collect()
    assert [(r.address_a, r.address_b) for r in common] == [("Ua", "Ub")]
    p.run("bitcoin", deltas(spark, *[("j", f"i{k}", -1000, 3) for k in range(3)], *[("j", f"o{k}", 300, 3) for k in range(3)]), NOW)
    assert [(r.txid, r.reason) for r in state.read("excluded_tx").collect()] == [("j", "coinjoin")]
    assert p.evidence().where("source_txid = 'j' and heuristic_key in ('common-input', 'change')").count() == 0


def message(**fields):
    return json.dumps({"type": "balance_delta", "chain_id": "bitcoin", "kind": "native", "block_height": 1, "block_hash": "b1", "delta_index": 0} | fields)


def test_messages(spark):
    big = "123456789012345678901234567890"
    texts = [message(txid="t", address="A", amount=big, meta='{"x":1}'), json.dumps({"type": "reorg", "chain_id": "bitcoin", "rolled_back_block_hashes": ["h1", "h2"]}), message(txid="t", address="A", amount="not-a-number"), message(txid="t", address="A", amount=12), json.dumps({"type": "other"}), "{no"]
    rows = wire.decoded(spark.createDataFrame([(t, "bitcoin", i) for i, t in enumerate(texts)], "value string, key string, offset long"))
    d = wire.deltas_of(rows).collect()
    assert [(r.amount, r.meta, r.pos) for r in d] == [(big, '{"x":1}', 0)]
    assert [r.block_hash for r in wire.reorgs_of(rows).collect()] == ["h1", "h2"]
    assert {r.offset: r.error for r in wire.poison(rows).collect()} == {2: "amount is no integer", 3: "amount is no string", 4: "unknown type", 5: "not JSON"}


@pytest.mark.parametrize("by_block", [False, True])
def test_micro_batch_with_a_barrier(spark, state, by_block):
    one = [message(txid="t", delta_index=i, address=a, amount=v, block_hash="b9") for i, (a, v) in enumerate([("A", "-1000"), ("B", "-2000"), ("R", "3000")])]
    two = [message(txid="u", delta_index=i, address=a, amount=v, block_hash="b10", block_height=2) for i, (a, v) in enumerate([("C", "-10"), ("D", "-20"), ("S", "30")])]
    texts = [*one, "poison", json.dumps({"type": "reorg", "chain_id": "bitcoin", "rolled_back_block_hashes": ["b9"]}), *two]
    consume(Pipeline(state), spark.createDataFrame([(t, "bitcoin", i) for i, t in enumerate(texts)], "value string, key string, offset long"), by_block)
    r = reader(state)
    assert r.cluster_of("bitcoin", "A").count() == 0
    assert r.same_cluster("bitcoin", "C", "D").first().same
    assert state.read("poison").count() == 1


def test_stream_of_files(spark, state, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(message(txid="t", delta_index=i, address=a, amount=v, block_hash="b999") for i, (a, v) in enumerate([("A", "-1000"), ("B", "-2000"), ("R", "3000")])))
    stream = wire.message_stream(spark, str(folder))
    start(Pipeline(state), stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert reader(state).same_cluster("bitcoin", "A", "B").first().same
    start(Pipeline(state), stream, str(tmp_path / "checkpoint")).awaitTermination()  # nothing new
    assert state.read("balance_delta").count() == 3


def test_stored_label_maintenance(spark, state):
    from decimal import Decimal

    state.commit(append={"label": spark.createDataFrame([(1, "address", "bitcoin", None, "A", "L", "mixer", "x", Decimal("0.600"), NOW, NOW - timedelta(days=365), "active")], schemas.LABEL)})
    label_maintenance(state, timedelta(days=30), 0.5, NOW)
    assert [(r.status, str(r.source_confidence)) for r in state.read("label").collect()] == [("stale", "0.300")]


def test_producer_publishes_reorganisations_before_blocks(spark, state, tmp_path):
    out = str(tmp_path / "topic")
    node = lambda rows: spark.createDataFrame([("eth", h, x, p, NOW) for h, x, p in rows], schemas.BLOCK)
    txs = spark.createDataFrame([("eth", 1, "b1", 0, "0xt1", "0xF", "0xN", "5"), ("eth", 2, "b2", 0, "0xt2", "0xF", "0xM", "6"), ("eth", 2, "c2", 0, "0xt3", "0xF", "0xK", "7")], schemas.RAW_TX)
    receipts = spark.createDataFrame([(t, 1, None, []) for t in ("0xt1", "0xt2", "0xt3")], schemas.RECEIPT)
    assert produce(state, node([(1, "b1", "b0"), (2, "b2", "b1")]), txs, receipts, "eth", "account", path=out) == {"rolled_back": 0, "blocks": 2, "deltas": 4}
    assert produce(state, node([(1, "b1", "b0"), (2, "c2", "b1")]), txs, receipts, "eth", "account", path=out) == {"rolled_back": 1, "blocks": 1, "deltas": 2}
    assert {r.hash for r in state.read("block").collect()} == {"b1", "c2"}
    values = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert [v for v in values if v["type"] == "reorg"] == [{"type": "reorg", "chain_id": "eth", "rolled_back_block_hashes": ["b2"]}]
    assert sum(v["type"] == "balance_delta" for v in values) == 6
