from ledgerloom import schemas
from ledgerloom.operators import extract as x

TOPIC = x.TRANSFER_TOPIC


def rows(spark, to="0xTO", value="1000000000000000000", status=1, contract=None, logs=()):
    tx = spark.createDataFrame([("ethereum", 7, "0xblock", 0, "0xhash", "0xFroM", to, value)], schemas.RAW_TX)
    receipt = spark.createDataFrame([("0xhash", status, contract, list(logs))], schemas.RECEIPT)
    return [(r.delta_index, r.address, r.amount, r.kind, r.meta) for r in x.account_deltas(tx, receipt).orderBy("delta_index").collect()]


def word(n):
    return f"0x{n:064x}"


def test_native_transfer(spark):
    assert rows(spark) == [(0, "0xfrom", "-1000000000000000000", "native", None), (1, "0xto", "1000000000000000000", "native", None)]


def test_reverted_and_empty(spark):
    assert rows(spark, status=0) == [] and rows(spark, value="0") == []


def test_deployment_of_nothing(spark):
    assert rows(spark, to=None, value="0", contract="0xNEW") == [(0, "0xnew", "0", "native", '{"contract_creation":true}')]
    assert [r[1] for r in rows(spark, to=None, value="3", contract="0xNEW")] == ["0xfrom", "0xnew"]
    assert rows(spark, to=None, value="0", contract=x.NO_ADDRESS) == []


def test_tokens(spark):
    amount = 123456789012345678901234567890
    logs = [("0xTOKEN", [TOPIC, word(0xAB), word(0xCD)], word(amount)), ("0xNFT", [TOPIC, word(1), word(2), word(3)], "0x"), ("0xOTHER", ["0x01", word(1), word(2)], word(1)), ("0xTOKEN", [TOPIC, word(0xAB), word(0xCD)], word(0))]
    meta = '{"token_contract":"0xtoken"}'
    a, b = "0x" + f"{0xAB:040x}", "0x" + f"{0xCD:040x}"
    assert rows(spark, value="0", logs=logs) == [(0, a, f"-{amount}", "token", meta), (1, b, str(amount), "token", meta), (2, a, "-0", "token", meta), (3, b, "0", "token", meta)]


def test_outputs(spark):
    vout = spark.createDataFrame([("b", "t0", 0, "A", "50", 1, "h1"), ("b", "t1", 0, "B", "30", 2, "h2"), ("b", "t1", 1, None, "19", 2, "h2")], "chain_id string, txid string, n int, address string, amount string, block_height long, block_hash string")
    vin = spark.createDataFrame([("b", "t0", 0, None, None), ("b", "t1", 0, "t0", 0)], "chain_id string, txid string, n int, prev_txid string, prev_n int")
    got = sorted((r.txid, r.delta_index, r.address, r.amount) for r in x.utxo_deltas(vin, vout).collect())
    assert got == [("t0", 0, "A", "50"), ("t1", 0, "A", "-50"), ("t1", 1, "B", "30"), ("t1", 2, "unparsed:t1:1", "19")]
