"""Small domain tables for the scenarios."""

from datetime import datetime, timezone

from ledgerloom import schemas
from ledgerloom.operators import heuristics

NOW = datetime(2024, 6, 1, tzinfo=timezone.utc)


def deltas(spark, *rows, chain="bitcoin"):
    """rows: (txid, address, amount[, height[, meta]]) in order of arrival."""
    out, seen = [], {}
    for pos, (txid, address, amount, *rest) in enumerate(rows):
        height, meta = (rest + [100, None][len(rest) :])[:2]
        seen[txid] = seen.get(txid, -1) + 1
        out.append((chain, txid, seen[txid], address, None if amount is None else str(amount), "native", height, f"b{height}", meta, pos))
    return spark.createDataFrame(out, schemas.DELTA)


def registry_of(spark, history_, hubs=(), chain="bitcoin", dusted=()):
    first = {}
    for r in history_.collect():
        first.setdefault(r.address, []).append(r.block_height)
    for a in hubs:
        first.setdefault(a, [1])
    rows = [(chain, a, min(h), max(h), a in hubs, "unknown" if a in hubs else None, None, a in dusted) for a, h in first.items()]
    return spark.createDataFrame(rows, schemas.ADDRESS)


def context(spark, batch, hubs=(), excluded=(), targets=(), history_=None, chain="bitcoin", **config):
    whole = history_ if history_ is not None else batch
    return heuristics.Context(
        whole,
        registry_of(spark, whole, hubs, chain),
        spark.createDataFrame([(chain, t, "x", None, None) for t in excluded], schemas.EXCLUDED_TX),
        spark.createDataFrame([(chain, a, c) for a, c in targets], "chain_id string, address string, confidence double"),
        {k.replace("_", "-"): v for k, v in config.items()},
    )


def edges(df):
    return [(r.address_a, r.address_b, round(r.confidence, 6)) for r in df.orderBy("tx_pos", "k1", "k2").collect()]


def evidence(spark, *rows, chain="bitcoin"):
    """rows: (op_id, a, b, confidence, txid[, status[, block]])"""
    from decimal import Decimal

    out = []
    for op, a, b, c, txid, *rest in rows:
        status, block = (rest + ["active", f"b{op}"][len(rest) :])[:2]
        out.append((chain, op, a, b, "manual" if txid is None else "common-input", txid, block, op, Decimal(str(c)), status, None, NOW, "system"))
    return spark.createDataFrame(out, schemas.EVIDENCE)
