"""The event stream: JSON messages of two kinds, read from files or Kafka, checked, and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amount as A
from ledgerloom.sources.storage import written

_DELTA = "type string, chain_id string, txid string, delta_index int, address string, amount string, kind string, block_height bigint, block_hash string, meta string"
_REORG = "type string, chain_id string, rolled_back_block_hashes array<string>"


def message_stream(spark: SparkSession, path: str | None = None, kafka: dict[str, str] | None = None, max_files: int = 100) -> DataFrame:
    """A stream of (value, key, offset) from Kafka where its connector is installed, or from text files of JSON lines:
    then with the place of each line's split, from which placed() makes the offset in a micro-batch."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load()
        return raw.select(F.col("value").cast("string").alias("value"), F.col("key").cast("string").alias("key"), "offset")
    at = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select("value", F.get_json_object("value", "$.chain_id").alias("key"), at.alias("split"))


def placed(lines: DataFrame) -> DataFrame:
    """(value, key, offset) of a micro-batch of lines: files by time and name, lines as they stand in them. Lines of a
    split are in order where they are read; only splits are ranked among each other."""
    rows = written(lines.withColumn("row", F.monotonically_increasing_id()), "lines")
    splits = rows.groupBy("split").agg(F.min("row").alias("base"))
    ranked = splits.withColumn("turn", F.row_number().over(Window.orderBy("split")).cast("long"))
    return rows.join(ranked, "split").select("value", "key", (F.shiftleft("turn", 40) + F.col("row") - F.col("base")).alias("offset"))


def decoded(messages: DataFrame) -> DataFrame:
    """(value, offset, kind, delta, reorg, error): kind is balance_delta, reorg or null; error says why a message is none.

    The amount is a JSON string of an integer: a number, though it would read as text, is an error."""
    v = F.try_parse_json("value")
    kind = F.try_variant_get(v, "$.type", "string")
    amount_kind = F.schema_of_variant(F.try_variant_get(v, "$.amount", "variant"))
    delta, reorg = F.from_json("value", _DELTA), F.from_json("value", _REORG)
    error = (
        F.when(v.isNull(), "not JSON")
        .when(kind.isNull() | ~kind.isin("balance_delta", "reorg"), "unknown type")
        .when((kind == "balance_delta") & (F.coalesce(amount_kind, F.lit("")) != "STRING"), "amount is no string")
        .when((kind == "balance_delta") & ~A.is_integer_text(delta["amount"]), "amount is no integer")
        .when((kind == "balance_delta") & (delta["chain_id"].isNull() | delta["txid"].isNull() | delta["delta_index"].isNull()), "key is missing")
    )
    rows = messages.select("value", "offset", kind.alias("type"), delta.alias("delta"), reorg.alias("reorg"), error.alias("error"))
    return rows.select("value", "offset", F.when(F.col("error").isNull(), F.col("type")).alias("kind"), "delta", "reorg", "error")


def deltas_of(rows: DataFrame) -> DataFrame:
    good = rows.where("kind = 'balance_delta'").select("delta.*", F.col("offset").alias("pos")).drop("type")
    return good.withColumn("amount", A.canonical(F.col("amount")))


def reorgs_of(rows: DataFrame) -> DataFrame:
    """(chain_id, block_hash, pos), a row for each rolled-back block."""
    return rows.where("kind = 'reorg'").select("reorg.chain_id", F.explode("reorg.rolled_back_block_hashes").alias("block_hash"), F.col("offset").alias("pos"))


def poison(rows: DataFrame) -> DataFrame:
    return rows.where("error is not null").select("value", "offset", "error")


def delta_messages(deltas: DataFrame) -> DataFrame:
    """(key, value): movements as messages, keyed by chain."""
    body = F.struct(F.lit("balance_delta").alias("type"), "chain_id", "txid", "delta_index", "address", "amount", "kind", "block_height", "block_hash", "meta")
    return deltas.select(F.col("chain_id").alias("key"), F.to_json(body).alias("value"))


def reorg_messages(rolled_back: DataFrame) -> DataFrame:
    """(key, value): one message for each chain with the hashes of (chain_id, height, hash), the highest first."""
    hashes = F.transform(F.sort_array(F.collect_list(F.struct("height", "hash")), asc=False), lambda x: x["hash"])
    per = rolled_back.groupBy("chain_id").agg(hashes.alias("rolled_back_block_hashes"))
    return per.select(F.col("chain_id").alias("key"), F.to_json(F.struct(F.lit("reorg").alias("type"), "chain_id", "rolled_back_block_hashes")).alias("value"))


def publish(messages: DataFrame, path: str | None = None, kafka: dict[str, str] | None = None) -> None:
    if kafka:
        messages.write.format("kafka").options(**kafka).save()
    else:
        messages.select("value").write.mode("append").text(path)
