import pytest

from ledgerloom.plans import stores
from ledgerloom.plans.pipeline import Pipeline
from ledgerloom.plans.state import State
from tests.helpers import NOW


@pytest.fixture
def state(spark, tmp_path):
    return State(spark, f"file://{tmp_path}/state")


def test_cursor(state):
    assert stores.cursor(state, "c", "kafka") is None
    for position in ("offset-42", "offset-99"):
        stores.set_cursor(state, "c", "kafka", position, NOW)
        assert stores.cursor(state, "c", "kafka") == position
    assert state.read("ingest_cursor").count() == 1


def test_evidence_by_hand(state):
    assert [stores.append_evidence(state, "c", "A", b, "manual", 0.5, "operator", NOW) for b in "BC"] == [1, 2]
    with pytest.raises(ValueError):
        stores.append_evidence(state, "c", "A", "A", "manual", 1.0)
    row = Pipeline(state).evidence().where("op_id = 2").first()
    assert (row.address_b, str(row.confidence), row.status, row.created_by, row.source_txid) == ("C", "0.500", "active", "operator", None)


def test_labels_targets_and_audit(state):
    assert stores.add_label(state, "c", "address", "A", "Big", "exchange", "x", 0.9, now=NOW) == 1
    assert stores.add_label(state, "c", "cluster", "K", "Big", "exchange", "x", 0.9, now=NOW) == 2
    with pytest.raises(ValueError):
        stores.add_label(state, "c", "other", "A", "Big", "exchange", "x", 0.9)
    assert {(r.target_address, r.target_cluster_id, r.status) for r in state.read("label").collect()} == {("A", None, "active"), (None, "K", "active")}
    for confidence in (0.9, 0.8):
        stores.add_sweep_target(state, "c", "T", "seed", confidence)
    assert [str(r.confidence) for r in stores.sweep_target(state, "c").collect()] == ["0.800"]
    assert stores.sweep_target(state, "c", "other").count() == 0
    stores.log(state, "operator", "note", {"b": 1, "a": 2}, "why", NOW)
    assert state.read("audit_log").first().target == '{"a": 2, "b": 1}'
    assert not stores.is_excluded(state, "c", "t") and stores.address(state, "c", "A").count() == 0
