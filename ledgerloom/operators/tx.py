"""Features of one transaction: what it spends and receives, and how it is grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amount as A

TX = ["chain_id", "txid"]


def spent_addresses(deltas: DataFrame) -> DataFrame:
    """(chain_id, txid, address, pos): distinct spenders of each transaction, by first occurrence. Null and zero amounts don't count."""
    return deltas.where(A.sign(F.col("amount")) < 0).groupBy(*TX, "address").agg(F.min("pos").alias("pos"))


def received_entries(deltas: DataFrame) -> DataFrame:
    """Rows with a positive amount, not deduplicated."""
    return deltas.where(A.sign(F.col("amount")) > 0)


def tx_addresses(deltas: DataFrame) -> DataFrame:
    """(chain_id, txid, address, pos): all distinct addresses of each transaction, by first occurrence."""
    return deltas.groupBy(*TX, "address").agg(F.min("pos").alias("pos"))


def batch_addresses(deltas: DataFrame) -> DataFrame:
    return deltas.select("chain_id", "address").distinct()


def distinct_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, in order."""
    return df.groupBy(*keys).agg(F.min(order).alias(order)).orderBy(order)


def tx_groups(deltas: DataFrame) -> DataFrame:
    """Transactions with their rows in order of arrival, and the block of their first row."""
    row = F.struct("pos", "delta_index", "address", "amount", "kind", "block_height", "block_hash", "meta")
    grouped = deltas.groupBy(*TX).agg(F.min("pos").alias("tx_pos"), F.array_sort(F.collect_list(row)).alias("deltas"))
    return grouped.select(*TX, "tx_pos", "deltas", F.col("deltas")[0]["block_height"].alias("block_height"), F.col("deltas")[0]["block_hash"].alias("block_hash"))


def tx_heads(deltas: DataFrame) -> DataFrame:
    """(chain_id, txid, tx_pos, block_height, block_hash) of each transaction's first row, without collecting its rows."""
    first = F.min(F.struct("pos", "block_height", "block_hash")).alias("f")
    return deltas.groupBy(*TX).agg(first).select(*TX, F.col("f.pos").alias("tx_pos"), F.col("f.block_height").alias("block_height"), F.col("f.block_hash").alias("block_hash"))


def dust_inflows(deltas: DataFrame, threshold: str | Column) -> DataFrame:
    """Distinct (chain_id, address) that receive more than 0 and at most the threshold in a row."""
    return deltas.where(is_dust(F.col("amount"), threshold)).select("chain_id", "address").distinct()


def is_dust(amount: Column, threshold: str | Column) -> Column:
    """Whether it is more than 0 and at most the threshold."""
    least = F.lit(threshold) if isinstance(threshold, str) else threshold
    return (A.sign(amount) > 0) & A.at_most(amount, least)


def is_contract_creation(meta: Column) -> Column:
    """Whether the JSON says contract_creation true, as a boolean; malformed, absent and other types don't."""
    return F.coalesce(F.from_json(meta, "contract_creation boolean")["contract_creation"], F.lit(False))


def anchors(spent: DataFrame) -> DataFrame:
    """The first spender of each transaction: (chain_id, txid, anchor)."""
    return spent.groupBy(*TX).agg(F.min_by("address", "pos").alias("anchor"))


def ranked(df: DataFrame, order: str = "pos", first: str | None = None) -> DataFrame:
    """With rank, from 0, in each transaction; first: a column of that name has the address of rank 0."""
    turn = Window.partitionBy(*TX).orderBy(order)
    out = df.withColumn("rank", F.row_number().over(turn) - 1)
    return out.withColumn(first, F.first("address").over(turn.rowsBetween(Window.unboundedPreceding, 0))) if first else out
