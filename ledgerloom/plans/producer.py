"""The producing side: new blocks to movements and reorganisation events, published before they are recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.extract import ADAPTERS
from ledgerloom.operators.ingest import new_blocks
from ledgerloom.operators.reorg import rollback, without_orphans
from ledgerloom.plans.state import State
from ledgerloom.sources.storage import written
from ledgerloom.sources.wire import delta_messages, publish, reorg_messages


def produce(state: State, canonical: DataFrame, txs: DataFrame, receipts: DataFrame, chain_id: str, model: str, **sink) -> dict[str, int]:
    """One round over what a node now has: canonical (chain_id, height, hash, parent_hash, timestamp), transactions and receipts.

    Stored blocks that aren't canonical any more are published as a reorganisation, the highest first, and forgotten;
    then the movements of all blocks that aren't stored are published, and the blocks recorded. What was published but
    not recorded is published again: consumers skip it by key.
    """
    stored = state.read("block")
    tip = canonical.where(F.col("chain_id") == chain_id).groupBy("chain_id").agg((F.max("height") + 1).alias("new_height"))
    top = stored.where(F.col("chain_id") == chain_id).groupBy("chain_id").agg((F.max("height") + 1).alias("new_height"))
    gone, ancestors = rollback(stored, canonical, top if not top.isEmpty() else tip)
    gone = written(gone, "gone")
    depth = gone.count()
    if depth:
        publish(reorg_messages(gone), **sink)
        stored = written(without_orphans(stored, ancestors), "blocks")
    fresh = written(new_blocks(canonical.where(F.col("chain_id") == chain_id), stored), "fresh")
    deltas = ADAPTERS[model](txs.join(fresh.select("chain_id", F.col("hash").alias("block_hash")), ["chain_id", "block_hash"], "left_semi"), receipts)
    deltas = written(deltas, "deltas")
    order = ["block_height", "tx_index", "delta_index"] if "tx_index" in deltas.columns else ["block_height", "txid", "delta_index"]
    publish(delta_messages(deltas.orderBy(*order)), **sink)
    state.commit(replace={"block": stored.unionByName(fresh)})
    return {"rolled_back": depth, "blocks": fresh.count(), "deltas": deltas.count()}
