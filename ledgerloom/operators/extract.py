"""Raw blocks to balance movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amount as A

#: Fixed value: Keccak-256 of Transfer(address,address,uint256).
TRANSFER_TOPIC = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
NO_ADDRESS = "0x" + "0" * 40


def uint256(hexadecimal: Column) -> Column:
    """Decimal text of a hexadecimal number of up to 64 digits, exact without a Python function: groups of seven digits
    times the limbs of their weights, which stay far below what a long holds, then carried."""
    digits = F.lpad(F.regexp_replace(hexadecimal, "^0[xX]", ""), 70, "0")
    groups = F.array(*[F.conv(F.substring(digits, 70 - 7 * (i + 1) + 1, 7), 16, 10).cast("long") for i in range(10)])
    weight = lambda i, k: 16 ** (7 * i) // A.BASE**k % A.BASE

    def limbs(g: Column) -> Column:
        return F.array(*[sum((g[i] * F.lit(weight(i, k)).cast("long") for i in range(10) if weight(i, k)), F.lit(0).cast("long")) for k in range(A.LIMBS)])

    return A.from_limbs(A.let(groups, limbs))


def topic_address(topic: Column) -> Column:
    """The address in the low 20 bytes of a topic."""
    return F.concat(F.lit("0x"), F.right(topic, F.lit(40)))


def account_deltas(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Movements of account-model transactions (chain_id, block_height, block_hash, tx_index, tx_hash, from, to, value)
    with their receipts (tx_hash, status, contract_address, logs).

    In this order: what the sender pays and what the receiver gets, if the value isn't zero; for a deployment what the
    contract gets, even if zero; for each log of three topics that is a token transfer, out and in. delta_index is the
    place. Failed transactions (status 0) move nothing; transactions without a receipt are left out. Addresses are
    lower-case; the negative of a token amount of zero is '-0', as senders of such events write it.
    """
    tx = txs.join(receipts, "tx_hash").where("status <> 0")
    row = lambda address, amount, kind, meta: F.struct(F.lower(address).alias("address"), amount.alias("amount"), F.lit(kind).alias("kind"), meta.cast("string").alias("meta"))
    none = F.lit(None).cast("string")
    pays = F.col("value") != "0"
    deployed = F.col("to").isNull() & F.col("contract_address").isNotNull() & (F.col("contract_address") != NO_ADDRESS)
    native = F.array(
        F.when(pays, row(F.col("from"), F.concat(F.lit("-"), F.col("value")), "native", none)),
        F.when(F.col("to").isNotNull() & pays, row(F.col("to"), F.col("value"), "native", none)).when(deployed, row(F.col("contract_address"), F.col("value"), "native", F.lit('{"contract_creation":true}'))),
    )
    transfers = F.filter("logs", lambda log: (F.size(log["topics"]) == 3) & (F.lower(log["topics"][0]) == TRANSFER_TOPIC))

    def token(log: Column) -> Column:
        meta = F.to_json(F.struct(F.lower(log["address"]).alias("token_contract")))
        both = lambda value: F.array(row(topic_address(log["topics"][1]), F.concat(F.lit("-"), value), "token", meta), row(topic_address(log["topics"][2]), value, "token", meta))
        return A.let(uint256(log["data"]), both)

    rows = F.concat(F.filter(native, lambda r: r.isNotNull()), F.flatten(F.transform(transfers, token)))
    out = tx.select("chain_id", "block_height", "block_hash", "tx_index", F.col("tx_hash").alias("txid"), F.posexplode(rows).alias("delta_index", "r"))
    return out.select("chain_id", "txid", "delta_index", "r.address", "r.amount", "r.kind", "block_height", "block_hash", "r.meta", "tx_index")


def utxo_deltas(vin: DataFrame, vout: DataFrame) -> DataFrame:
    """Movements of output-model transactions: inputs by the output that they spend, negative; outputs, positive.

    vin: (chain_id, txid, n, prev_txid, prev_n), null for coinbase inputs, which are skipped; vout: (chain_id, txid, n,
    address, amount, block_height, block_hash). An output without an address has `unparsed:<txid>:<n>`; inputs whose
    output isn't known are left out. delta_index: inputs first, then outputs.
    """
    named = vout.withColumn("address", F.coalesce("address", F.concat_ws(":", F.lit("unparsed"), "txid", F.col("n").cast("string"))))
    block = vout.select("chain_id", "txid", "block_height", "block_hash").distinct()
    source = named.select("chain_id", F.col("txid").alias("prev_txid"), F.col("n").alias("prev_n"), "address", "amount")
    ins = vin.where("prev_txid is not null").join(source, ["chain_id", "prev_txid", "prev_n"]).join(block, ["chain_id", "txid"])
    sizes = vin.where("prev_txid is not null").groupBy("chain_id", "txid").agg(F.count("*").alias("inputs"))
    spent = ins.select("chain_id", "txid", F.col("n").cast("int").alias("delta_index"), "address", A.negated(F.col("amount")).alias("amount"), F.lit("native").alias("kind"), "block_height", "block_hash", F.lit(None).cast("string").alias("meta"))
    outs = named.join(sizes, ["chain_id", "txid"], "left")
    got = outs.select("chain_id", "txid", (F.coalesce("inputs", F.lit(0)) + F.col("n")).cast("int").alias("delta_index"), "address", "amount", F.lit("native").alias("kind"), "block_height", "block_hash", F.lit(None).cast("string").alias("meta"))
    return spent.unionByName(got)


#: By model of chain; what they take differs.
ADAPTERS = {"account": account_deltas, "utxo": utxo_deltas}
