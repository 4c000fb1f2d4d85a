"""Single writes and lookups over stored state, as operators and schedulers make them."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ingest import latest
from ledgerloom.plans.state import TABLES, State


def _row(state: State, table: str, values: dict[str, Any]) -> DataFrame:
    names = [f.name for f in state.read(table).schema]
    return state.spark.createDataFrame([tuple(values.get(n) for n in names)], TABLES[table])


def _upsert(state: State, table: str, keys: list[str], values: dict[str, Any]) -> None:
    """The last writer of a key wins."""
    rows = state.read(table).withColumn("turn", F.lit(0)).unionByName(_row(state, table, values).withColumn("turn", F.lit(1)))
    state.commit(replace={table: latest(rows, keys, "turn").drop("turn")})


def append_evidence(state: State, chain_id: str, a: str, b: str, heuristic_key: str, confidence: float, created_by: str = "system", now: datetime | None = None, **source: Any) -> int:
    """A row of evidence, active; its op_id. source: source_txid, source_block_hash, source_block_height."""
    if a == b:
        raise ValueError("evidence joins two different addresses")
    last = state.read("merge_evidence").where(F.col("chain_id") == chain_id).agg(F.max("op_id")).first()[0] or 0
    kinds = {f.name: f.dataType for f in state.read("merge_evidence").schema}
    row = {"chain_id": chain_id, "op_id": last + 1, "address_a": a, "address_b": b, "heuristic_key": heuristic_key, "status": "active", "created_at": now or datetime.now(timezone.utc), "created_by": created_by} | source
    one = _row(state, "merge_evidence", row).withColumn("confidence", F.round(F.lit(float(confidence)), 3).cast(kinds["confidence"]))
    state.commit(append={"merge_evidence": one})
    return last + 1


def add_label(state: State, chain_id: str, target_type: str, target_id: str, label: str, category: str, source: str, confidence: float, status: str = "active", now: datetime | None = None) -> int:
    """A label of a cluster or an address; its id."""
    if target_type not in ("cluster", "address"):
        raise ValueError(f"no such type of target: {target_type}")
    now = now or datetime.now(timezone.utc)
    last = state.read("label").agg(F.max("label_id")).first()[0] or 0
    row = {"label_id": last + 1, "target_type": target_type, "chain_id": chain_id, "target_cluster_id" if target_type == "cluster" else "target_address": target_id, "label": label, "category": category, "source": source, "collected_at": now, "last_verified_at": now, "status": status}
    state.commit(append={"label": _row(state, "label", row).withColumn("source_confidence", F.lit(float(confidence)).cast("decimal(4,3)"))})
    return last + 1


def add_sweep_target(state: State, chain_id: str, address: str, source: str, confidence: float, entity_hint: str | None = None) -> None:
    from decimal import Decimal

    _upsert(state, "sweep_target", ["chain_id", "address"], {"chain_id": chain_id, "address": address, "entity_hint": entity_hint, "source": source, "confidence": Decimal(f"{confidence:.3f}")})


def sweep_target(state: State, chain_id: str, address: str | None = None) -> DataFrame:
    """One known target, or all of a chain."""
    rows = state.read("sweep_target").where(F.col("chain_id") == chain_id)
    return rows if address is None else rows.where(F.col("address") == address)


def is_excluded(state: State, chain_id: str, txid: str) -> bool:
    return not state.read("excluded_tx").where((F.col("chain_id") == chain_id) & (F.col("txid") == txid)).isEmpty()


def address(state: State, chain_id: str, name: str) -> DataFrame:
    """An address' registry row; none if it was never seen."""
    return state.read("address").where((F.col("chain_id") == chain_id) & (F.col("address") == name))


def set_cursor(state: State, chain_id: str, source: str, position: str, now: datetime | None = None) -> None:
    """Where a source of a chain stands. The stream itself keeps its offsets in its checkpoint."""
    _upsert(state, "ingest_cursor", ["chain_id", "source"], {"chain_id": chain_id, "source": source, "position": position, "updated_at": now or datetime.now(timezone.utc)})


def cursor(state: State, chain_id: str, source: str) -> str | None:
    row = state.read("ingest_cursor").where((F.col("chain_id") == chain_id) & (F.col("source") == source)).first()
    return row.position if row else None


def log(state: State, actor: str, action: str, target: Any, rationale: str | None = None, now: datetime | None = None) -> None:
    """A row of the audit log, the target as JSON."""
    row = {"actor": actor, "action": action, "target": json.dumps(target, sort_keys=True), "rationale": rationale, "at": now or datetime.now(timezone.utc)}
    state.commit(append={"audit_log": _row(state, "audit_log", row)})
