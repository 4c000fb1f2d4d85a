"""Schemas of all domain tables, as Spark DDL."""

DELTA = "chain_id string, txid string, delta_index int, address string, amount string, kind string, block_height bigint, block_hash string, meta string, pos bigint"
REORG = "type string, chain_id string, rolled_back_block_hashes array<string>"
WIRE = "value string, key string, offset bigint"
ADDRESS = "chain_id string, address string, first_seen_height bigint, last_seen_height bigint, is_hub boolean, hub_type string, hub_confidence decimal(4,3), dust_flag boolean"
CANDIDATE = (
    "chain_id string, address_a string, address_b string, heuristic_key string, source_txid string, source_block_hash string,"
    " source_block_height bigint, confidence double, engine_ord int, tx_pos bigint, k1 bigint, k2 bigint"
)
EVIDENCE = (
    "chain_id string, op_id bigint, address_a string, address_b string, heuristic_key string, source_txid string, source_block_hash string,"
    " source_block_height bigint, confidence decimal(4,3), status string, invalidated_reason string, created_at timestamp, created_by string"
)
EVIDENCE_EVENT = "chain_id string, op_id bigint, seq bigint, event string, reason string, at timestamp"
LABEL = (
    "label_id bigint, target_type string, chain_id string, target_cluster_id string, target_address string, label string, category string,"
    " source string, source_confidence decimal(4,3), collected_at timestamp, last_verified_at timestamp, status string"
)
SWEEP_TARGET = "chain_id string, address string, entity_hint string, source string, confidence decimal(4,3)"
EXCLUDED_TX = "chain_id string, txid string, reason string, detector_confidence decimal(4,3), signal string"
CHAIN = (
    "chain_id string, display_name string, model_type string, native_symbol string, native_decimals int, finality_depth int,"
    " address_normalization string, config string, enabled boolean, created_at timestamp"
)
HEURISTIC = "heuristic_key string, description string, applies_to string, default_confidence decimal(4,3)"
CHAIN_HEURISTIC = "chain_id string, heuristic_key string, enabled boolean, confidence_override decimal(4,3), params string"
CURSOR = "chain_id string, source string, position string, updated_at timestamp"
CLUSTER = "chain_id string, cluster_id string, size bigint, entity_type string, representative_confidence decimal(4,3), anchor_address string"
MEMBERSHIP = "chain_id string, address string, cluster_id string, membership_confidence decimal(4,3)"
AUDIT = "event_id bigint, actor string, action string, target string, rationale string, at timestamp"
SUPER_ENTITY = "super_entity_id bigint, name string, created_at timestamp"
SUPER_ENTITY_MEMBER = "super_entity_id bigint, chain_id string, cluster_id string"
BLOCK = "chain_id string, height bigint, hash string, parent_hash string, timestamp timestamp"
CHAIN_CONFIG = "chain_id string, model_type string, node_endpoint string, node_auth_ref string, finality_depth int, address_normalization string, start_height bigint, enabled boolean"
RAW_TX = "chain_id string, block_height bigint, block_hash string, tx_index int, tx_hash string, `from` string, `to` string, value string"
RECEIPT = "tx_hash string, status int, contract_address string, logs array<struct<address:string,topics:array<string>,data:string>>"
