"""Idempotent ingest, and tables that are upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.history import max_heights

KEY = ["chain_id", "txid", "delta_index"]


def new_deltas(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the batch whose key isn't stored; of rows with one key the first to arrive."""
    rest = [c for c in batch.columns if c not in KEY]
    first = batch.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "pos").alias("r")).select(*KEY, "r.*").select(batch.columns)
    return first.join(stored.select(*KEY), KEY, "left_anti")


def ingest_counts(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """(inserted, skipped)"""
    n = inserted.agg(F.count("*").alias("inserted"))
    return n.join(batch.agg(F.count("*").alias("all")), how="cross").select("inserted", (F.col("all") - F.col("inserted")).alias("skipped"))


def upserted_addresses(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry after a batch: a new address is first and last seen at its largest height there; a known one's last
    height grows, its first stays. Flags stay, and are false for new addresses."""
    seen = max_heights(batch)
    out = registry.join(seen, ["chain_id", "address"], "full")
    return out.select(
        "chain_id", "address", F.coalesce("first_seen_height", "height").alias("first_seen_height"), F.greatest("last_seen_height", "height").alias("last_seen_height"),
        F.coalesce("is_hub", F.lit(False)).alias("is_hub"), "hub_type", "hub_confidence", F.coalesce("dust_flag", F.lit(False)).alias("dust_flag"),
    )


def with_hubs(registry: DataFrame, hubs: DataFrame) -> DataFrame:
    """The registry with hub flags of (chain_id, address, hub_type, hub_confidence); addresses that aren't in it are left out."""
    new = hubs.select("chain_id", "address", F.col("hub_type").alias("t"), F.round("hub_confidence", 3).cast("decimal(4,3)").alias("c"), F.lit(True).alias("h"))
    out = registry.join(new, ["chain_id", "address"], "left")
    is_new = F.coalesce("h", F.lit(False))
    return out.select("chain_id", "address", "first_seen_height", "last_seen_height", (F.col("is_hub") | is_new).alias("is_hub"), F.when(is_new, F.col("t")).otherwise(F.col("hub_type")).alias("hub_type"), F.when(is_new, F.col("c")).otherwise(F.col("hub_confidence")).alias("hub_confidence"), "dust_flag")


def with_dust(registry: DataFrame, dust: DataFrame) -> DataFrame:
    """The registry with dust flags of (chain_id, address); a flag is never taken away."""
    new = dust.select("chain_id", "address", F.lit(True).alias("d")).distinct()
    return registry.join(new, ["chain_id", "address"], "left").withColumn("dust_flag", F.col("dust_flag") | F.coalesce("d", F.lit(False))).drop("d")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table that upserts leave: of rows with one key the last in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(rows.columns)


def new_blocks(blocks: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks whose (chain_id, hash) isn't stored."""
    return blocks.dropDuplicates(["chain_id", "hash"]).join(stored.select("chain_id", "hash"), ["chain_id", "hash"], "left_anti").select(blocks.columns)
