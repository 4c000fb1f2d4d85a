"""Aggregates over the whole history of balance movements."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amount as A
from ledgerloom.operators.tx import TX, received_entries, spent_addresses, tx_addresses


def _members(deltas: DataFrame) -> DataFrame:
    return deltas.select(*TX, "address").distinct()


SEPARATOR, ESCAPE = "\x1f", "\x1b"


def _plain(a: Column) -> Column:
    """Different for different addresses, and without the separator."""
    return F.replace(F.replace(a, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(SEPARATOR), F.lit(ESCAPE + "1"))


def _up_to(most: int):
    """mapInArrow function over (chain_id, address, all) sorted by the first two: an address's degree, most at most. Only
    one address's others are held, and no more than most of them, however many rows it has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, known = None, set()
        for batch in batches:
            out: list[tuple] = []
            for chain, address, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (chain, address) != key:
                    if key is not None:
                        out.append((*key, min(len(known) - 1, most)))  # the address itself is among them
                    key, known = (chain, address), set()
                if len(known) <= most:
                    known.update(members.split(SEPARATOR))
            if out:
                yield _degree_rows(out)
        if key is not None:
            yield _degree_rows([(*key, min(len(known) - 1, most))])

    return counted


def _degree_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], names=["chain_id", "address", "degree"])


def degrees(deltas: DataFrame, of: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(chain_id, address, degree): distinct other addresses that share a transaction. of: (chain_id, address) asked for.

    most: for those who need no larger degrees, which are then given as that. Pairs are not made then: an address's rows
    are read in order, and its others counted until there are that many.

    Each address of a transaction is sent once, with the transaction's others in one text, not once for each other; an
    address's pairs meet where all of them are, and are made distinct there before they are counted."""
    # by pos, where there is one, members come from the shuffle that other features of transactions share
    at = ["pos", "address"] if "pos" in deltas.columns else ["address"]
    members = tx_addresses(deltas) if "pos" in deltas.columns else _members(deltas)
    members = members.where("address is not null")
    groups = members.groupBy(*TX).agg(F.collect_list(F.struct(*at)).alias("all")).where(F.size("all") > 1)
    groups = groups.select(*TX, F.transform("all", lambda m: m["address"]).alias("all"))
    if most is not None:
        rows = groups.select("chain_id", F.array_join(F.transform("all", _plain), SEPARATOR).alias("text"), "all").select("chain_id", F.explode("all").alias("address"), "text")
        if of is not None:
            rows = rows.join(of.select("chain_id", "address").distinct(), ["chain_id", "address"], "left_semi")
        rows = rows.select("chain_id", "address", "text").repartition("chain_id", "address").sortWithinPartitions("chain_id", "address")
        return rows.mapInArrow(_up_to(most), "chain_id string, address string, degree long")
    others = F.array_join(F.transform(F.array_remove("all", F.col("address")), _plain), SEPARATOR)
    rows = groups.select("chain_id", "all", F.explode("all").alias("address"))
    if of is not None:
        rows = rows.join(of.select("chain_id", "address").distinct(), ["chain_id", "address"], "left_semi")
    rows = rows.select("chain_id", "address", others.alias("others")).repartition("address")
    pairs = rows.select("chain_id", "address", F.explode(F.split("others", SEPARATOR)).alias("other")).distinct()
    return pairs.groupBy("chain_id", "address").agg(F.count("*").alias("degree"))


_SUMMARY = "chain_id string, address string, hub_type string, first_seen_height long, last_seen_height long, dust_flag boolean, degree long"


def _summed(most: int):
    """mapInArrow function over (chain_id, address, hub_type, first, last, dust, text) sorted by the first two: _SUMMARY of
    each address that has a transaction. text has a transaction's height and its members, and is null in an address's row
    of labels; first and last are null where they are that height, dust where it is false."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, label, low, high, dust, known, met = None, None, None, None, False, set(), False
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        names = [c.split()[0] for c in _SUMMARY.split(", ")]
        out: list[tuple] = []

        def close() -> None:
            if met:
                out.append((*key, label, low, high, dust, min(max(len(known) - 1, 0), most)))

        for batch in batches:
            for chain, address, kind, first, last, dusted, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None or address != key[1] or chain != key[0]:
                    close()
                    key, label, low, high, dust, known, met = (chain, address), None, None, None, False, set(), False
                if text is None:
                    label = kind
                    continue
                met = True
                height, _, members = text.partition(SEPARATOR)
                if height:
                    first, last = int(height) if first is None else first, int(height) if last is None else last
                if first is not None:
                    low, high = first if low is None or first < low else low, last if high is None or last > high else high
                dust = dust or bool(dusted)
                if len(known) <= most and address is not None:
                    known.update(members.split(SEPARATOR))  # the address itself is among them
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return summed


def summaries(deltas: DataFrame, labels: DataFrame, is_dust: Column, most: int) -> DataFrame:
    """(chain_id, address, hub_type, first_seen_height, last_seen_height, dust_flag, degree): all that a registry asks of
    an address, by one trip of its rows. labels: (chain_id, address, hub_type), one row an address; degree: as degrees()
    has it, most at most."""
    per = deltas.groupBy(*TX, "address").agg(F.min("block_height").alias("first"), F.max("block_height").alias("last"), F.max(F.coalesce(is_dust, F.lit(False))).alias("dust"))
    # an address without a height would take that of the text for its own: then the text has none
    least = F.when(F.count("first") == F.count("*"), F.min("first")).cast("string")
    groups = per.groupBy(*TX).agg(F.collect_list(F.struct("address", "first", "last", "dust")).alias("all"), F.coalesce(least, F.lit("")).alias("height"))
    others = F.transform(F.filter("all", lambda m: m["address"].isNotNull()), lambda m: _plain(m["address"]))
    text = F.concat("height", F.lit(SEPARATOR), F.array_join(others, SEPARATOR)).alias("text")
    rows = groups.select("chain_id", "height", text, "all").select("chain_id", "height", "text", F.explode("all").alias("m"))
    unless = lambda c: F.when(F.col(c).cast("string") != F.col("height"), F.col(c)).alias(c.split(".")[1])
    rows = rows.select("chain_id", "m.address", F.lit(None).cast("string").alias("hub_type"), unless("m.first"), unless("m.last"), F.when(F.col("m.dust"), True).alias("dust"), "text")
    none = lambda kind: F.lit(None).cast(kind)
    named = labels.select("chain_id", "address", "hub_type", none("long").alias("first"), none("long").alias("last"), none("boolean").alias("dust"), none("string").alias("text"))
    rows = rows.unionByName(named).repartition("chain_id", "address").sortWithinPartitions("chain_id", "address")
    return rows.mapInArrow(_summed(most), _SUMMARY)


def approximate_degrees(deltas: DataFrame, error: float = 0.02) -> DataFrame:
    """degrees() by a sketch: one shuffle less, with the given relative deviation."""
    members = _members(deltas)
    pairs = members.join(members.withColumnRenamed("address", "other"), TX).where("address <> other")
    return pairs.groupBy("chain_id", "address").agg(F.approx_count_distinct("other", error).alias("degree"))


def shared_transactions(deltas: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(chain_id, a, b, shared): in how many transactions both addresses of an unordered pair, a < b, take part."""
    members = _members(deltas)
    if pairs is not None:  # only what the pairs' addresses take part in meets itself
        asked = pairs.select("chain_id", F.explode(F.array("a", "b")).alias("address")).distinct()
        members = members.join(asked, ["chain_id", "address"], "left_semi")
    both = members.withColumnRenamed("address", "a").join(members.withColumnRenamed("address", "b"), TX).where("a < b")
    if pairs is not None:
        both = both.join(pairs.select("chain_id", "a", "b").distinct(), ["chain_id", "a", "b"], "left_semi")
    return both.groupBy("chain_id", "a", "b").agg(F.count("*").alias("shared"))


def sources_of_targets(deltas: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(chain_id, target, sources): distinct other addresses that spend in transactions in which the target receives."""
    received = received_entries(deltas).select(*TX, F.col("address").alias("target")).distinct()
    if targets is not None:
        received = received.join(targets.select("chain_id", F.col("address").alias("target")), ["chain_id", "target"], "left_semi")
    spent = spent_addresses(deltas).select(*TX, F.col("address").alias("source"))
    pairs = received.join(spent, TX).where("target <> source").select("chain_id", "target", "source").distinct()
    return pairs.groupBy("chain_id", "target").agg(F.count("*").alias("sources"))


def received_in_total(deltas: DataFrame) -> DataFrame:
    """(chain_id, address, received): the exact sum of positive amounts, of all kinds; 0 for an address that only spends."""
    return deltas.groupBy("chain_id", "address").agg(A.sum_of(F.col("amount"), A.sign(F.col("amount")) > 0).alias("received"))


def spent_in_tx(deltas: DataFrame) -> DataFrame:
    """(chain_id, txid, address, spent): the exact sum of what the address spends in the transaction."""
    return deltas.where(A.sign(F.col("amount")) < 0).groupBy(*TX, "address").agg(A.sum_of(A.negated(F.col("amount"))).alias("spent"))


def largest_equal_group(deltas: DataFrame) -> DataFrame:
    """(chain_id, txid, equal): the largest number of received rows of one amount."""
    by = received_entries(deltas).groupBy(*TX, "amount").agg(F.count("*").alias("n"))
    return by.groupBy(*TX).agg(F.max("n").alias("equal"))


def last_spent(deltas: DataFrame) -> DataFrame:
    """(chain_id, address, last_spent_height): decides 'spends again above a height' without a join over a range."""
    return deltas.where(A.sign(F.col("amount")) < 0).groupBy("chain_id", "address").agg(F.max("block_height").alias("last_spent_height"))


def max_heights(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("chain_id", "address").agg(F.max("block_height").alias("height"))

