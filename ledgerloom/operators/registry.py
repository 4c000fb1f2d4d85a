"""Chains, heuristics and their configuration."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators.preprocess import Params

#: Heuristic, kind of chain it applies to, and default confidence.
CATALOGUE = (
    ("common-input", "utxo", 0.950), ("sweep-seed", "both", 0.900), ("change", "utxo", 0.400), ("funding", "account", 0.600),
    ("deployer", "account", 0.850), ("behavioral", "account", 0.300), ("manual", "both", 1.000),
)


@dataclass(frozen=True)
class HeuristicParams:
    """Tunables of the engines; what a chain's parameters don't name keeps its default."""

    completeness_min: float = 0.9
    recurrence_min: int = 2
    change_min: float = 0.3
    new_address_weight: float = 0.5
    not_round_amount_weight: float = 0.2
    respent_weight: float = 0.3
    min_interactions: int = 3


def heuristics(spark: SparkSession) -> DataFrame:
    rows = [(k, None, a, c) for k, a, c in CATALOGUE]
    return spark.createDataFrame(rows, "heuristic_key string, description string, applies_to string, c double").select("heuristic_key", "description", "applies_to", F.col("c").cast("decimal(4,3)").alias("default_confidence"))


def add_chain(
    chains: DataFrame, chain_heuristics: DataFrame, catalogue: DataFrame, chain_id: str, display_name: str, model_type: str, native_symbol: str, native_decimals: int, finality_depth: int, address_normalization: str, config: str = "{}", now: datetime | None = None
) -> tuple[DataFrame, DataFrame]:
    """chain and chain_heuristic with a new chain, for which the heuristics of its model and of both are enabled."""
    if model_type not in ("utxo", "account", "other"):
        raise ValueError(f"no such model of chain: {model_type}")
    spark = chains.sparkSession
    row = (chain_id, display_name, model_type, native_symbol, native_decimals, finality_depth, address_normalization, config, True, now or datetime.now(timezone.utc))
    more = catalogue.where(F.col("applies_to").isin(model_type, "both")).select(F.lit(chain_id).alias("chain_id"), "heuristic_key", F.lit(True).alias("enabled"), F.lit(None).cast("decimal(4,3)").alias("confidence_override"), F.lit("{}").alias("params"))
    return chains.unionByName(spark.createDataFrame([row], schemas.CHAIN)), chain_heuristics.unionByName(more)


def enabled_chains(chains: DataFrame) -> DataFrame:
    return chains.where("enabled").orderBy("chain_id")


def heuristic_config(chain_heuristics: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(chain_id, heuristic_key, enabled, confidence, params): the override, else the heuristic's default."""
    joined = chain_heuristics.join(catalogue, "heuristic_key")
    return joined.select("chain_id", "heuristic_key", "enabled", F.coalesce("confidence_override", "default_confidence").cast("double").alias("confidence"), "params")


def confidence_for(config: DataFrame, chain_id: str, key: str) -> tuple[float, bool]:
    """(confidence, enabled); a heuristic that isn't registered is disabled."""
    row = config.where((F.col("chain_id") == chain_id) & (F.col("heuristic_key") == key)).select("confidence", "enabled").first()
    return (row.confidence, row.enabled) if row else (0.0, False)


def heuristic_params(raw: str | None) -> HeuristicParams:
    """Overrides from JSON; anything malformed leaves the defaults."""
    kinds = {f.name: type(f.default) for f in fields(HeuristicParams)}
    try:
        given = json.loads(raw or "{}")
        if not isinstance(given, dict) or any(isinstance(given.get(k), (bool, str, list, dict)) or t is int and isinstance(given.get(k), float) for k, t in kinds.items()):
            return HeuristicParams()
    except ValueError:
        return HeuristicParams()
    return replace(HeuristicParams(), **{k: t(given[k]) for k, t in kinds.items() if given.get(k) is not None})


def preprocessing_params(chains: DataFrame, chain_id: str) -> Params:
    """A chain's parameters: defaults under what its config names. An unknown chain and a malformed config are errors."""
    row = chains.where(F.col("chain_id") == chain_id).select("config").first()
    if row is None:
        raise LookupError(f"chain {chain_id} isn't registered")
    given = json.loads(row.config or "{}")
    if not isinstance(given, dict):
        raise ValueError("a chain's config is a JSON object")
    named = {f.name: given[f.name] for f in fields(Params) if given.get(f.name) is not None}
    if "dust_threshold" in named and not (isinstance(named["dust_threshold"], str) and re.fullmatch(r"[+-]?[0-9]+", named["dust_threshold"])):
        raise ValueError(f"dust_threshold isn't an integer in a string: {named['dust_threshold']!r}")
    return replace(Params(), **named)


def load_config(path: str) -> dict:
    """A YAML file of nested keys and scalars, in which ${NAME} stands for an environment variable; an unset one is empty."""
    out: dict = {}
    levels = [(-1, out)]
    for line in open(path, encoding="utf-8"):
        text = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), line.split(" #")[0].rstrip())
        if not text.strip() or text.lstrip().startswith("#"):
            continue
        indent, (key, _, value) = len(text) - len(text.lstrip()), text.strip().partition(":")
        while levels[-1][0] >= indent:
            levels.pop()
        value = value.strip().strip("\"'")
        levels[-1][1][key] = value if value else {}
        if not value:
            levels.append((indent, levels[-1][1][key]))
    return out
