"""What pollutes clustering: hubs, collaborative transactions, dust."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.history import degrees, largest_equal_group, summaries
from ledgerloom.operators.tx import TX, batch_addresses, dust_inflows, is_dust, received_entries, spent_addresses

#: Categories of labels that make an address a hub, and the confidence that goes with them.
HUB_CATEGORIES, HUB_LABEL_CONFIDENCE = ("exchange", "mixer", "bridge"), 0.99


@dataclass(frozen=True)
class Params:
    """Tunables of a chain; the defaults hold where its config is silent."""

    hub_threshold: float = 0.5
    hub_degree_saturation: float = 50.0
    dust_threshold: str = "546"
    coinjoin_confidence: float = 0.8
    dust_exclusion_confidence: float = 0.8
    equal_output_min: int = 3
    collab_input_min: int = 3
    collab_output_min: int = 3


def hub_score(degree: Column, saturation: Column) -> Column:
    """degree / saturation, 1 at most; 0 for a saturation that isn't positive."""
    return F.when(saturation <= 0, F.lit(0.0)).otherwise(F.least(degree / F.when(saturation > 0, saturation), F.lit(1.0)))


def hub_labels(labels: DataFrame) -> DataFrame:
    """(chain_id, address, hub_type): the category of the first active label that makes a hub."""
    active = labels.where((F.col("status") == "active") & (F.col("target_type") == "address") & F.col("category").isin(*HUB_CATEGORIES))
    return active.groupBy("chain_id", F.col("target_address").alias("address")).agg(F.min_by("category", "label_id").alias("hub_type"))


def mark_hubs(batch: DataFrame, history: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """(chain_id, address, hub_type, hub_confidence) of the batch's addresses that are hubs: by label, else by degree over the whole history."""
    asked = batch_addresses(batch)
    named = asked.join(hub_labels(labels), ["chain_id", "address"], "left").join(degrees(history, None if history is batch else asked, _saturated(params)), ["chain_id", "address"], "left")
    is_hub, kind, confidence = _judged(params)
    return named.where(is_hub).select("chain_id", "address", kind.alias("hub_type"), confidence.alias("hub_confidence"))


def _saturated(params: Params) -> int:
    return max(math.ceil(params.hub_degree_saturation), 1)  # from there on the score is 1


def _judged(params: Params) -> tuple[Column, Column, Column]:
    """Whether an address is a hub, of what type and how surely, by hub_type, that of its label, and degree."""
    score = hub_score(F.coalesce("degree", F.lit(0)), F.lit(float(params.hub_degree_saturation)))
    by_label = F.col("hub_type").isNotNull()
    return by_label | (score >= params.hub_threshold), F.coalesce("hub_type", F.lit("unknown")), F.when(by_label, F.lit(HUB_LABEL_CONFIDENCE)).otherwise(score)


def registered(deltas: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """The registry (schemas.ADDRESS) after all deltas, flags of hubs and dust included, by one shuffle of addresses."""
    found = summaries(deltas, hub_labels(labels), is_dust(F.col("amount"), params.dust_threshold), _saturated(params))
    is_hub, kind, confidence = _judged(params)
    return found.select(
        "chain_id", "address", "first_seen_height", "last_seen_height", is_hub.alias("is_hub"), F.when(is_hub, kind).alias("hub_type"), F.when(is_hub, F.round(confidence, 3)).cast("decimal(4,3)").alias("hub_confidence"), "dust_flag"
    )


def mark_collaborative(batch: DataFrame, params: Params = Params()) -> DataFrame:
    """excluded_tx rows of transactions with enough equal outputs, spenders and received rows."""
    spenders = spent_addresses(batch).groupBy(*TX).agg(F.count("*").alias("inputs"))
    outputs = received_entries(batch).groupBy(*TX).agg(F.count("*").alias("outputs"))
    found = largest_equal_group(batch).join(spenders, TX).join(outputs, TX)
    found = found.where((F.col("equal") >= params.equal_output_min) & (F.col("inputs") >= params.collab_input_min) & (F.col("outputs") >= params.collab_output_min))
    return _excluded(found, "coinjoin", params.coinjoin_confidence)


def _excluded(found: DataFrame, reason: str, confidence: float) -> DataFrame:
    return found.select(*TX, F.lit(reason).alias("reason"), F.lit(confidence).cast("decimal(4,3)").alias("detector_confidence"), F.lit(None).cast("string").alias("signal"))


def dust_only(batch: DataFrame, dusted: DataFrame, params: Params = Params()) -> DataFrame:
    """excluded_tx rows of transactions all of whose spenders, at least one, are flagged. dusted: (chain_id, address)."""
    flag = dusted.select("chain_id", "address").distinct().withColumn("dusted", F.lit(True))
    spenders = spent_addresses(batch).join(flag, ["chain_id", "address"], "left")
    found = spenders.groupBy(*TX).agg(F.every(F.coalesce("dusted", F.lit(False))).alias("all")).where("all")
    return _excluded(found, "dust-only", params.dust_exclusion_confidence)


def mark_dust(batch: DataFrame, already: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(newly flagged (chain_id, address), excluded_tx rows): flags of this batch count at once, beside those already there."""
    new = dust_inflows(batch, params.dust_threshold)
    return new, dust_only(batch, new.union(already.select("chain_id", "address")), params)


def merged_exclusions(earlier: DataFrame, *later: DataFrame) -> DataFrame:
    """excluded_tx after upserts in this order: of rows of one transaction the last stays."""
    all_ = earlier.withColumn("turn", F.lit(0))
    for k, part in enumerate(later, 1):
        all_ = all_.unionByName(part.withColumn("turn", F.lit(k)))
    row = F.struct("reason", "detector_confidence", "signal")
    return all_.groupBy(*TX).agg(F.max_by(row, "turn").alias("r")).select(*TX, "r.*")
