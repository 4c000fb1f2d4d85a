"""Chain reorganisations: finding what was rolled back, and undoing its evidence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.evidence import by_blocks, invalidated


def continuity(blocks: DataFrame) -> DataFrame:
    """Blocks with continuous: the parent hash is that of a stored block one height below, or there is none there."""
    below = blocks.select("chain_id", (F.col("height") + 1).alias("height"), F.col("hash").alias("below"))
    joined = blocks.join(below, ["chain_id", "height"], "left")
    per = joined.groupBy("chain_id", "height", "hash", "parent_hash").agg(F.coalesce(F.max(F.col("below") == F.col("parent_hash")), F.lit(True)).alias("continuous"))
    return per


def rollback(stored: DataFrame, canonical: DataFrame, new_height: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rolled back (chain_id, height, hash), ancestors (chain_id, ancestor)) for new blocks (chain_id, new_height).

    From the height below the new one down, stored hashes differ from the canonical ones up to the first height that is
    equal, or isn't stored: that is the ancestor. Heights are runs, so no walk is needed: the ancestor is the largest
    height below at which hashes are equal or nothing is stored.
    """
    below = stored.join(new_height, "chain_id").where("height < new_height").join(canonical.select("chain_id", "height", F.col("hash").alias("now")), ["chain_id", "height"], "left")
    equal = below.where("hash = now").groupBy("chain_id").agg(F.max("height").alias("h"))
    # heights with a block whose height below isn't stored: the run ends there
    gaps = below.select("chain_id", "height").distinct().join(below.select("chain_id", (F.col("height") + 1).alias("height")).distinct(), ["chain_id", "height"], "left_anti")
    top = below.groupBy("chain_id").agg(F.max("height").alias("top"))
    gap = gaps.groupBy("chain_id").agg(F.max(F.col("height") - 1).alias("g"))
    known = new_height.join(top, "chain_id", "left").join(equal, "chain_id", "left").join(gap, "chain_id", "left")
    broken = F.col("top").isNull() | (F.col("top") < F.col("new_height") - 1)
    ancestors = known.select("chain_id", F.when(broken, F.col("new_height") - 1).otherwise(F.greatest(F.coalesce("h", F.lit(-1)), F.coalesce("g", F.lit(-1)))).cast("long").alias("ancestor"))
    gone = below.join(ancestors, "chain_id").where("height > ancestor").select("chain_id", "height", "hash")
    return gone, ancestors


def without_orphans(blocks: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Blocks up to the ancestors; chains without one stay whole."""
    return blocks.join(ancestors, "chain_id", "left").where("ancestor is null or height <= ancestor").select(blocks.columns)


def on_reorg(evidence: DataFrame, hashes: DataFrame, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(invalidation events, audit rows) for the evidence of rolled-back blocks (chain_id, block_hash)."""
    events = invalidated(evidence, by_blocks(evidence, hashes), "reorg", at)
    return events, audit(events, "system", "reorg", at)


def rolled_back(evidence: DataFrame, hashes: DataFrame) -> DataFrame:
    """Evidence with the status that on_reorg's events leave. A row's block decides, so that no row has to meet its event."""
    gone = hashes.select("chain_id", F.col("block_hash").alias("source_block_hash"), F.lit(True).alias("gone")).distinct()
    rows = evidence.join(F.broadcast(gone), ["chain_id", "source_block_hash"], "left")
    changed = (F.col("status") == "active") & F.col("gone").isNotNull()
    return rows.withColumns({"status": F.when(changed, "invalidated").otherwise(F.col("status")), "invalidated_reason": F.when(changed, "reorg").otherwise(F.col("invalidated_reason"))}).select(evidence.columns)


def on_correction(evidence: DataFrame, chain_id: str, op_id: int, why: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """(invalidation events, audit rows) of an operator's correction; none if the row isn't active."""
    ops = evidence.sparkSession.createDataFrame([(chain_id, op_id)], "chain_id string, op_id long")
    events = invalidated(evidence, ops, "manual-correction", at)
    return events, audit(events, "operator", "manual-correction", at, why)


def audit(events: DataFrame, actor: str, action: str, at: datetime, rationale: str | None = None) -> DataFrame:
    return events.select(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.to_json(F.struct("chain_id", "op_id")).alias("target"), F.lit(rationale).cast("string").alias("rationale"), F.lit(at).alias("at"))
