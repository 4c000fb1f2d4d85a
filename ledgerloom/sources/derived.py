"""Domain tables derived from the driver's TPC-H-like tables, which hold no blockchain data.

Every function takes (spark, sf_dir). WITH has the same tables as common table expressions in DuckDB's SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.storage import bucketed

CHAIN = "tpch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents_of(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txid, l_linenumber, l_suppkey, slot, cents, at, n, height): all lines, numbered within their order by at, of n in
    all; height is that of the order's first line, slot the line's address of a wallet."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    height = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    # Lines are numbered before they become two movements each, and by txid: what groups by transaction finds them together.
    # A price goes as cents and what is left of it, mostly 0, which order as it does and take fewer bytes.
    cents = cents_of(F.col("l_extendedprice"))
    lines = lines.select(F.concat(F.lit("o"), "l_orderkey").alias("txid"), *keys[:3], cents.alias("cents"), (F.col("l_extendedprice") - cents / 100).alias("rest"), "l_quantity", height.alias("h"))
    keys = [*keys[:3], "cents", "rest", "l_quantity"]
    tx = Window.partitionBy("txid").orderBy(*keys, "h")
    rows = lines.withColumns({"at": F.row_number().over(tx) - 1, "height": F.first("h").over(tx.rowsBetween(Window.unboundedPreceding, 0)), "n": F.count("*").over(tx.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")})
    return rows.select("txid", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 6).alias("slot"), "cents", "at", "n", "height")


def balance_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as movements, an order's as one transaction.

    Eight orders in a row share a wallet of six addresses, from which their lines are paid; what the second line of an order
    pays to a new address, line 1 of the next order spends, where the wallet is the same. Of three orders two pay suppliers;
    the third pays a new address on even lines, and on odd ones an address of the wallet beside its own. Every tenth
    order's lines are paid out alike.
    """
    return movements(ordered_lines(spark, sf_dir))


def stored_balance_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balance_delta() for those who read it in several jobs: its lines are numbered once, and written by transaction."""
    return movements(bucketed(ordered_lines(spark, sf_dir), "lines", "txid"))


def movements(lines: DataFrame) -> DataFrame:
    """ordered_lines() as balance_delta()."""
    rows = lines.withColumn("l_orderkey", F.substring("txid", 2, 20).cast("long"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    wallet = F.expr("l_orderkey div 8")
    home = lambda w: F.concat(F.lit("w"), w, F.lit("-"), F.col("slot"))
    new = lambda order, line: F.concat(F.lit("n"), order, F.lit("-"), line)
    payer = F.when((n == 1) & (o % 8 > 0) & ((o - 1) % 3 == 0), new(o - 1, F.lit(2))).otherwise(home(wallet))
    payee = F.when(o % 3 > 0, F.concat(F.lit("s"), "l_suppkey")).when(n % 2 == 0, new(o, n)).otherwise(home(wallet.bitwiseXOR(F.lit(1).cast("long"))))
    cents = F.col("cents")
    move = lambda side, address, amount, i: F.struct(F.lit(side).alias("side"), address.alias("address"), amount.alias("cents"), i.alias("i"))
    paid = F.when(o % 10 == 7, F.lit(5_000_000).cast("long")).otherwise(cents)
    side = F.explode(F.array(move(0, payer, -cents, F.col("at")), move(1, payee, paid, F.col("at") + F.col("n")))).alias("m")
    rows = rows.select("txid", "l_orderkey", "l_linenumber", "height", side).select("txid", "l_orderkey", "l_linenumber", "height", "m.*")
    creation = F.when((F.col("side") == 1) & (n == 7), F.lit('{"contract_creation":true}'))
    return rows.select(
        F.lit(CHAIN).alias("chain_id"),
        "txid",
        F.col("i").alias("delta_index"),
        "address",
        F.col("cents").cast("string").alias("amount"),
        F.lit("native").alias("kind"),
        F.col("height").alias("block_height"),
        F.sha2(F.col("height").cast("string"), 256).alias("block_hash"),
        creation.alias("meta"),
        # arrival: blocks in order, transactions of a block by number
        (F.col("height") * 100_000_000_000 + F.col("l_orderkey") * 1_000 + F.col("i")).alias("pos"),
    )


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as outputs of output-model transactions; those after the third of an order have no address."""
    lines = table(spark, sf_dir, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")) - 1
    return lines.select(
        F.lit(CHAIN).alias("chain_id"), F.concat(F.lit("o"), "l_orderkey").alias("txid"), n.cast("int").alias("n"), F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("s"), "l_suppkey")).alias("address"),
        cents_of(F.col("l_extendedprice")).cast("string").alias("amount"), F.lit(1).cast("long").alias("block_height"), F.lit("h").alias("block_hash"),
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input for each output: of every fifth order coinbase inputs; else the output of that number of the order before,
    which not all orders have."""
    o = F.substring("txid", 2, 20).cast("long")
    rows = outputs(spark, sf_dir).select("chain_id", "txid", "n", o.alias("o"))
    spends = F.col("o") % 5 > 0
    return rows.select("chain_id", "txid", "n", F.when(spends, F.concat(F.lit("o"), F.col("o") - 1)).alias("prev_txid"), F.when(spends, F.col("n")).alias("prev_n"))


def address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after the deltas, without flags."""
    return balance_delta(spark, sf_dir).groupBy("chain_id", "address").agg(F.min("block_height").alias("first_seen_height"), F.max("block_height").alias("last_seen_height"))


def label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every fourth supplier, and a second one, of another category, of every twelfth."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0")
    again = s.where("s_suppkey % 12 = 0").select("s_suppkey", F.lit(1).alias("n"))
    rows = s.select("s_suppkey", F.lit(0).alias("n")).union(again)
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    k = F.col("s_suppkey")
    return rows.select(
        (k * 2 + F.col("n")).alias("label_id"), F.lit("address").alias("target_type"), F.lit(CHAIN).alias("chain_id"), F.lit(None).cast("string").alias("target_cluster_id"), F.concat(F.lit("s"), k).alias("target_address"),
        F.concat(F.lit("L"), k).alias("label"), pick(["exchange", "mixer", "bridge", "scam"], k / 4 + F.col("n")).alias("category"), F.lit("derived").alias("source"),
        (F.lit(1.0) - (k % 10) / 20).cast("decimal(4,3)").alias("source_confidence"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("collected_at"),
        (F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (k % 60) * 86_400).cast("timestamp").alias("last_verified_at"),
        pick(["active", "active", "stale", "retired"], k / 8).alias("status"),
    )


def sweep_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return s.select(F.lit(CHAIN).alias("chain_id"), F.concat(F.lit("s"), "s_suppkey").alias("address"), F.col("s_name").alias("entity_hint"), F.lit("derived").alias("source"), F.when(F.col("s_suppkey") % 4 == 0, 0.95).otherwise(0.85).cast("decimal(4,3)").alias("confidence"))


def block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each height of a delta; every fiftieth has a parent hash that doesn't fit."""
    heights = balance_delta(spark, sf_dir).select(F.col("block_height").alias("height")).distinct()
    fits = F.sha2((F.col("height") - 1).cast("string"), 256)
    return heights.select(F.lit(CHAIN).alias("chain_id"), "height", F.sha2(F.col("height").cast("string"), 256).alias("hash"), F.when(F.col("height") % 50 == 0, F.lit("fork")).otherwise(fits).alias("parent_hash"))


def raw_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as account-model transactions: customer to clerk; some deploy, some transfer tokens, some fail."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    height = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return o.select(
        F.lit("tpch-acc").alias("chain_id"), height.alias("block_height"), F.sha2(height.cast("string"), 256).alias("block_hash"), k.alias("tx_index"), F.concat(F.lit("0xT"), k).alias("tx_hash"),
        F.concat(F.lit("0xC"), "o_custkey").alias("from"), F.when(k % 11 != 0, F.concat(F.lit("0xD"), k % 997)).alias("to"),
        F.when(k % 5 == 0, F.lit("0")).otherwise(F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).alias("value"),
    )


TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"


def receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    word = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    log = F.struct(F.concat(F.lit("0xTok"), k % 7).alias("address"), F.array(F.lit(TRANSFER), F.concat(F.lit("0x"), word(F.col("o_custkey"))), F.concat(F.lit("0x"), word(k % 997))).alias("topics"), F.concat(F.lit("0x"), word(k * 3 % 1000)).alias("data"))
    other = F.struct(F.lit("0xNft").alias("address"), F.array(F.lit(TRANSFER), F.lit("0x1"), F.lit("0x2"), F.lit("0x3")).alias("topics"), F.lit("0x").alias("data"))
    return o.select(
        F.concat(F.lit("0xT"), k).alias("tx_hash"), F.when(k % 13 == 0, 0).otherwise(1).alias("status"), F.when(k % 11 == 0, F.concat(F.lit("0xNEW"), k)).alias("contract_address"),
        F.when(k % 3 == 0, F.array(log, other)).when(k % 3 == 1, F.array(log)).otherwise(F.array().cast("array<struct<address:string,topics:array<string>,data:string>>")).alias("logs"),
    )


#: The same in SQL. Names as above; every oracle begins with it.
WITH = """
with recursive lines as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as h,
    cast(round(l_extendedprice * 100) as bigint) as cents, side, l_orderkey // 8 as wallet
  from lineitem, (values (0), (1)) s(side)),
moved as (
  select *, case when side = 0 then -cents when l_orderkey % 10 = 7 then 5000000 else cents end as amount,
    case when side = 0 and l_linenumber = 1 and l_orderkey % 8 > 0 and (l_orderkey - 1) % 3 = 0 then 'n' || (l_orderkey - 1) || '-2'
      when side = 0 then 'w' || wallet || '-' || (l_partkey % 6) when l_orderkey % 3 > 0 then 's' || l_suppkey
      when l_linenumber % 2 = 0 then 'n' || l_orderkey || '-' || l_linenumber else 'w' || xor(wallet, 1) || '-' || (l_partkey % 6) end as address from lines),
numbered as (
  select *, row_number() over w - 1 as i, first_value(h) over w as height from moved
  window w as (partition by l_orderkey order by side, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, h)),
balance_delta as (
  select 'tpch' as chain_id, 'o' || l_orderkey as txid, cast(i as integer) as delta_index, address,
    amount, 'native' as kind, cast(height as bigint) as block_height, sha256(cast(height as varchar)) as block_hash,
    case when side = 1 and l_linenumber = 7 then '{"contract_creation":true}' end as meta, cast(height as bigint) * 100000000000 + l_orderkey * 1000 + i as pos
  from numbered),
outputs as (
  select l_orderkey as o, 'o' || l_orderkey as txid, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as integer) as n,
    case when l_linenumber <= 3 then 's' || l_suppkey end as address, cast(round(l_extendedprice * 100) as bigint) as amount from lineitem),
address as (select chain_id, address, min(block_height) as first_seen_height, max(block_height) as last_seen_height from balance_delta group by all),
labelled as (select s_suppkey as k, 0 as n from supplier where s_suppkey % 4 = 0 union all select s_suppkey, 1 from supplier where s_suppkey % 12 = 0),
label as (
  select k * 2 + n as label_id, 'address' as target_type, 'tpch' as chain_id, cast(null as varchar) as target_cluster_id, 's' || k as target_address, 'L' || k as label,
    (['exchange', 'mixer', 'bridge', 'scam'])[cast(floor((k / 4.0 + n) % 4) as integer) + 1] as category, 'derived' as source,
    cast(1.0 - (k % 10) / 20.0 as decimal(4,3)) as source_confidence, timestamp '2024-01-01' as collected_at, timestamp '2024-01-01' + to_days(cast(k % 60 as integer)) as last_verified_at,
    (['active', 'active', 'stale', 'retired'])[cast(floor((k / 8.0) % 4) as integer) + 1] as status
  from labelled),
sweep_target as (
  select 'tpch' as chain_id, 's' || s_suppkey as address, s_name as entity_hint, 'derived' as source, cast(case when s_suppkey % 4 = 0 then 0.95 else 0.85 end as decimal(4,3)) as confidence
  from supplier where s_suppkey % 2 = 0),
block as (
  select 'tpch' as chain_id, height, sha256(cast(height as varchar)) as hash, case when height % 50 = 0 then 'fork' else sha256(cast(height - 1 as varchar)) end as parent_hash
  from (select distinct block_height as height from balance_delta)),
raw_tx as (
  select 'tpch-acc' as chain_id, cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) as block_height, o_orderkey as tx_index, '0xT' || o_orderkey as tx_hash,
    '0xC' || o_custkey as "from", case when o_orderkey % 11 <> 0 then '0xD' || (o_orderkey % 997) end as "to",
    case when o_orderkey % 5 = 0 then 0 else cast(round(o_totalprice * 100) as bigint) end as value, case when o_orderkey % 13 = 0 then 0 else 1 end as status,
    case when o_orderkey % 11 = 0 then '0xNEW' || o_orderkey end as contract_address, o_orderkey as k, o_custkey
  from orders)
"""
