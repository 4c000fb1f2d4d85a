"""Engines that propose 'one owner' edges between addresses. They only propose: evidence is written by the merge step."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amount as A
from ledgerloom.operators.history import last_spent, received_in_total, shared_transactions, sources_of_targets, spent_in_tx
from ledgerloom.operators.registry import CATALOGUE, HeuristicParams
from ledgerloom.operators.tx import TX, anchors, is_contract_creation, ranked, received_entries, spent_addresses, tx_addresses, tx_heads


@dataclass
class Context:
    """What engines look up: history has all deltas, the batch's included; addresses the registry (first_seen_height, is_hub).

    config: (confidence, enabled, params) by heuristic; those not named are enabled with their default confidence.
    """

    history: DataFrame
    addresses: DataFrame
    excluded: DataFrame | None = None
    sweep_targets: DataFrame | None = None
    config: dict[str, tuple[float, bool, HeuristicParams]] = field(default_factory=dict)

    def of(self, key: str) -> tuple[float, bool, HeuristicParams]:
        return self.config.get(key) or (next(c for k, _, c in CATALOGUE if k == key), True, HeuristicParams())

    def hubs(self) -> DataFrame:
        return self.addresses.where("is_hub").select("chain_id", "address").distinct()

    def not_excluded(self, batch: DataFrame) -> DataFrame:
        batch = batch.where("txid is not null")  # as joins by transaction ask for, which then find the same shuffle
        return batch if self.excluded is None else batch.join(self.excluded.select(*TX).distinct(), TX, "left_anti")


class Engine(Protocol):
    """What proposes candidates (schemas.CANDIDATE) for a batch; engines of one's own are given to generate() and Pipeline."""

    def __call__(self, batch: DataFrame, context: Context) -> DataFrame: ...


def without(df: DataFrame, hubs: DataFrame, column: str) -> DataFrame:
    """Rows whose address in that column is no hub."""
    return df.join(hubs.withColumnRenamed("address", column), ["chain_id", column], "left_anti")


def _candidates(df: DataFrame, batch: DataFrame, key: str, confidence: Column, a: str, b: str, k1: Column, k2: Column, hub_end: Column | None = None) -> DataFrame:
    """hub_end: whether an end is a hub, for record(), where an engine knows it anyway."""
    heads = tx_heads(batch)
    return df.join(heads, TX).select(
        "chain_id", F.col(a).alias("address_a"), F.col(b).alias("address_b"), F.lit(key).alias("heuristic_key"), F.col("txid").alias("source_txid"), F.col("block_hash").alias("source_block_hash"),
        F.col("block_height").alias("source_block_height"), confidence.cast("double").alias("confidence"), F.lit([k for k, _, _ in CATALOGUE].index(key)).alias("engine_ord"),
        "tx_pos", k1.cast("long").alias("k1"), k2.cast("long").alias("k2"), *([] if hub_end is None else [hub_end.alias("hub_end")]),
    )


def common_input(batch: DataFrame, context: Context, judged: bool = False) -> DataFrame:
    """Transactions that aren't excluded: a star from the first spender that is no hub to each other one. judged: with
    hub_end, which record() then needn't look up."""
    confidence, _, _ = context.of("common-input")
    spent = ranked(without(spent_addresses(context.not_excluded(batch)), context.hubs(), "address"), first="anchor")
    return _candidates(spent.where("rank > 0"), batch, "common-input", F.lit(confidence), "anchor", "address", F.col("rank"), F.lit(0), F.lit(False) if judged else None)


def sweep(batch: DataFrame, context: Context) -> DataFrame:
    """Spenders that hand nearly all they ever received to a known target, which collects from several sources."""
    confidence, _, params = context.of("sweep-seed")
    targets = context.sweep_targets.select("chain_id", F.col("address").alias("target"), F.col("confidence").cast("double").alias("trust"))
    outs = received_entries(batch).select(*TX, F.col("address").alias("target"), F.col("pos").alias("out_pos")).join(targets, ["chain_id", "target"])
    pairs = outs.join(spent_addresses(batch).select(*TX, F.col("address").alias("source"), F.col("pos").alias("in_pos")), TX).where("target <> source")
    spent = spent_in_tx(batch).withColumnRenamed("address", "source")
    asked = pairs.select("chain_id", F.col("source").alias("address")).distinct()
    received = received_in_total(context.history.join(asked, ["chain_id", "address"], "left_semi")).withColumnRenamed("address", "source")
    recurring = sources_of_targets(context.history, pairs.select("chain_id", F.col("target").alias("address")).distinct()).where(F.col("sources") >= params.recurrence_min)
    found = pairs.join(spent, [*TX, "source"]).join(received, ["chain_id", "source"]).where(A.sign(F.col("received")) > 0)
    found = found.where(A.ratio_at_least(F.col("spent"), F.col("received"), params.completeness_min)).join(recurring, ["chain_id", "target"])
    return _candidates(found, batch, "sweep-seed", F.least("trust", F.lit(confidence)), "target", "source", F.col("out_pos"), F.col("in_pos"))


def change_scores(batch: DataFrame, context: Context, params: HeuristicParams) -> DataFrame:
    """Received rows with the score of being change: a new address, an amount that isn't round, spent again later."""
    seen = context.addresses.select("chain_id", "address", "first_seen_height")
    received = received_entries(batch)
    later = last_spent(context.history.join(received.select("chain_id", "address").distinct(), ["chain_id", "address"], "left_semi"))
    heads = tx_heads(batch).select(*TX, F.col("block_height").alias("tx_height"))
    outs = received.join(heads, TX).join(seen, ["chain_id", "address"], "left").join(later, ["chain_id", "address"], "left")
    weight = lambda is_so, w: F.when(F.coalesce(is_so, F.lit(False)), F.lit(w)).otherwise(F.lit(0.0))
    score = (
        weight(F.col("first_seen_height") == F.col("tx_height"), params.new_address_weight)
        + weight(~A.is_round(F.col("amount")), params.not_round_amount_weight)
        + weight(F.col("last_spent_height") > F.col("tx_height"), params.respent_weight)
    )
    return outs.withColumn("score", score)


def change(batch: DataFrame, context: Context) -> DataFrame:
    """Transactions that aren't excluded and touch no hub: the first spender with the received row of the best score."""
    confidence, _, params = context.of("change")
    batch = context.not_excluded(batch)
    hubs = context.hubs()
    touching = batch.where(A.sign(F.col("amount")) != 0).join(hubs, ["chain_id", "address"], "left_semi").select(*TX).distinct()
    clean = batch.join(touching, TX, "left_anti")
    scored = change_scores(clean, context, params)
    best = scored.groupBy(*TX).agg(F.max_by(F.struct("address", "score", "pos"), F.struct("score", (-F.col("pos")).alias("first"))).alias("b"))
    best = best.select(*TX, F.col("b.address").alias("best"), F.col("b.score").alias("score")).where(F.col("score") >= params.change_min)
    return _candidates(best.join(anchors(spent_addresses(clean)), TX), batch, "change", F.least("score", F.lit(confidence)), "anchor", "best", F.lit(0), F.lit(0))


def _from_first_spender(received: DataFrame, batch: DataFrame, context: Context) -> DataFrame:
    first = without(anchors(spent_addresses(batch)), context.hubs(), "anchor")
    return received.join(first, TX).where("address <> anchor")


def _received(batch: DataFrame, created: bool) -> DataFrame:
    return received_entries(batch).where(is_contract_creation(F.col("meta")) == created).select(*TX, "address", "pos")


def funding(batch: DataFrame, context: Context, judged: bool = False) -> DataFrame:
    """The first spender, if no hub, with each address that appears for the first time by what it receives here. judged:
    as in common_input()."""
    confidence, _, _ = context.of("funding")
    seen = context.addresses.select("chain_id", "address", "first_seen_height", *([F.coalesce("is_hub", F.lit(False)).alias("hub_end")] if judged else []))
    heads = tx_heads(batch).select(*TX, F.col("block_height").alias("tx_height"))
    # few rows are of new addresses: only these go on to the spenders
    new = _received(batch, created=False).join(heads, TX).join(seen, ["chain_id", "address"]).where("first_seen_height = tx_height").select(*TX, "address", "pos", *(["hub_end"] if judged else []))
    return _candidates(_from_first_spender(new, batch, context), batch, "funding", F.lit(confidence), "anchor", "address", F.col("pos"), F.lit(0), F.col("hub_end") if judged else None)


def deployer(batch: DataFrame, context: Context) -> DataFrame:
    """The first spender, if no hub, with each contract that it creates."""
    confidence, _, _ = context.of("deployer")
    return _candidates(_from_first_spender(_received(batch, created=True), batch, context), batch, "deployer", F.lit(confidence), "anchor", "address", F.col("pos"), F.lit(0))


def behavioral(batch: DataFrame, context: Context) -> DataFrame:
    """Pairs of a batch's transactions, neither a hub, that share enough transactions over the whole history; the
    batch's first transaction of a pair is its source."""
    confidence, _, params = context.of("behavioral")
    members = without(ranked(tx_addresses(batch)), context.hubs(), "address")
    left, right = (members.select(*TX, F.col("address").alias(x), F.col("rank").alias(f"rank_{x}")) for x in "xy")
    pairs = left.join(right, TX).where("rank_x < rank_y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    heads = tx_heads(batch).select(*TX, F.col("tx_pos").alias("at"))
    first = pairs.join(heads, TX).groupBy("chain_id", "a", "b").agg(F.min(F.struct("at", "rank_x", "rank_y", "txid")).alias("f"))
    shared = shared_transactions(context.history, first).where(F.col("shared") >= params.min_interactions)
    found = first.join(shared, ["chain_id", "a", "b"]).select("chain_id", F.col("f.txid").alias("txid"), "a", "b", F.col("f.rank_x").alias("rank_x"), F.col("f.rank_y").alias("rank_y"))
    return _candidates(found, batch, "behavioral", F.lit(confidence), "a", "b", F.col("rank_x"), F.col("rank_y"))


#: In the order in which their candidates become evidence.
ENGINES: dict[str, Engine] = {
    "common-input": common_input, "sweep-seed": sweep, "change": change, "funding": funding, "deployer": deployer, "behavioral": behavioral,
}


def generate(batch: DataFrame, context: Context, engines: dict[str, Engine] | None = None) -> DataFrame:
    """Candidates of all enabled engines, in their order by engine_ord."""
    out = None
    for key, engine in (engines or ENGINES).items():
        if context.of(key)[1] and not (key == "sweep-seed" and context.sweep_targets is None):
            part = engine(batch, context)
            out = part if out is None else out.unionByName(part)
    return out
