"""The append-only evidence log: appends and invalidations are events, and a row's status is what they fold to."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import short, whole
from ledgerloom.sources.storage import written

#: The order of op ids: engines, transactions, and places in them.
ORDER = ["engine_ord", "tx_pos", "k1", "k2"]


def record(candidates: DataFrame, addresses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): loops, and edges of which an end is a hub, are rejected. Candidates with hub_end, which must
    come from these addresses, say it themselves."""
    loop = F.coalesce(F.col("address_a") == F.col("address_b"), F.lit(False))
    if "hub_end" in candidates.columns:
        bad = loop | F.col("hub_end")
        return candidates.where(~bad).drop("hub_end"), candidates.where(bad).drop("hub_end")
    hub = addresses.where("is_hub").select("chain_id", "address").distinct()
    # only the ends go to the hubs, and only those that are hubs come back, to their transactions
    key = F.coalesce("source_txid", F.lit("")).alias("source")
    ends = candidates.select("chain_id", key, F.explode(F.array("address_a", "address_b")).alias("address")).distinct()
    found = ends.join(hub, ["chain_id", "address"], "left_semi").groupBy("chain_id", "source").agg(F.collect_set("address").alias("hubs"))
    judged = candidates.withColumn("source", key).join(found, ["chain_id", "source"], "left")
    is_hub = lambda c: F.coalesce(F.array_contains("hubs", F.col(c)), F.lit(False))
    bad = loop | is_hub("address_a") | is_hub("address_b")
    return judged.where(~bad).select(candidates.columns), judged.where(bad).select(candidates.columns)


def numbered(candidates: DataFrame, after: int = 0, buckets: int | None = None) -> DataFrame:
    """Candidates with op_id: after + 1, + 2, ... by engine, transaction and place in it, without gaps.

    Ranges of the order go to different tasks; a range's first number comes from the sizes of those before it.
    """
    # null places come first, as they would in one task
    ranges = candidates.withColumn("source_block_hash", short(F.col("source_block_hash")))
    ranges = ranges.repartitionByRange(*([buckets] if buckets else []), *[F.col(c).asc_nulls_first() for c in ORDER], "address_a", "address_b").sortWithinPartitions(*ORDER, "address_a", "address_b")
    ranges = ranges.withColumns({"at": F.monotonically_increasing_id(), "source_block_hash": whole(F.col("source_block_hash"))})
    placed = ranges.withColumns({"part": F.shiftright("at", 33), "within": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("at")
    placed = written(placed, "placed", small=True)  # the numbers hold only if no task is run anew with other rows
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    return placed.join(F.broadcast(before), "part").withColumn("op_id", F.col("before") + F.col("within") + 1 + after).drop("part", "within", "before")


def appended(numbered_candidates: DataFrame, created_at: datetime, created_by: str = "system") -> DataFrame:
    """Evidence rows, active, of numbered candidates; confidences are rounded to three places as they are stored."""
    return numbered_candidates.where("address_a <> address_b").select(
        "chain_id", "op_id", "address_a", "address_b", "heuristic_key", "source_txid", "source_block_hash", "source_block_height", F.round("confidence", 3).cast("decimal(4,3)").alias("confidence"),
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("invalidated_reason"), F.lit(created_at).alias("created_at"), F.lit(created_by).alias("created_by"),
    )


def folded(evidence: DataFrame, invalidations: DataFrame) -> DataFrame:
    """Evidence with the status that invalidation events (chain_id, op_id, reason, at) leave; of several the first counts."""
    first = invalidations.groupBy("chain_id", "op_id").agg(F.min_by("reason", "at").alias("why"))
    return evidence.join(first, ["chain_id", "op_id"], "left").select(
        *[c for c in evidence.columns if c not in ("status", "invalidated_reason")],
        F.when((F.col("status") == "active") & F.col("why").isNotNull(), "invalidated").otherwise(F.col("status")).alias("status"),
        F.when((F.col("status") == "active") & F.col("why").isNotNull(), F.col("why")).otherwise(F.col("invalidated_reason")).alias("invalidated_reason"),
    ).select(evidence.columns)


def invalidated(evidence: DataFrame, ops: DataFrame, reason: str, at: datetime) -> DataFrame:
    """Events that invalidate those of ops (chain_id, op_id) that are active; others change nothing."""
    changed = evidence.where("status = 'active'").join(ops.select("chain_id", "op_id").distinct(), ["chain_id", "op_id"], "left_semi")
    return changed.select("chain_id", "op_id", F.lit(reason).alias("reason"), F.lit(at).alias("at"))


def active(evidence: DataFrame) -> DataFrame:
    return evidence.where("status = 'active'").orderBy("chain_id", "op_id")


def by_blocks(evidence: DataFrame, hashes: DataFrame) -> DataFrame:
    """Evidence from the blocks of (chain_id, block_hash). Blocks are few beside their evidence, which stays where it is."""
    return evidence.join(F.broadcast(hashes.select("chain_id", F.col("block_hash").alias("source_block_hash")).distinct()), ["chain_id", "source_block_hash"], "left_semi")


def by_pair(evidence: DataFrame, chain_id: str, a: str, b: str) -> DataFrame:
    """Evidence of an unordered pair, of any status, in order."""
    one, other = (F.col("address_a") == a) & (F.col("address_b") == b), (F.col("address_a") == b) & (F.col("address_b") == a)
    return evidence.where((F.col("chain_id") == chain_id) & (one | other)).orderBy("op_id")


def by_addresses(evidence: DataFrame, addresses: DataFrame) -> DataFrame:
    """Evidence with an end among (chain_id, address), each row once, in order."""
    # a row goes to both its ends with what is asked of it, so that those found needn't meet the whole log again
    ends = evidence.withColumn("address", F.explode(F.array_distinct(F.array("address_a", "address_b"))))
    found = ends.join(addresses.select("chain_id", "address"), ["chain_id", "address"], "left_semi")
    return found.dropDuplicates(["chain_id", "op_id"]).select(evidence.columns).orderBy("chain_id", "op_id")
