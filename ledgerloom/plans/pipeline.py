"""A batch of movements through ingest, preprocessing, heuristics, merge and rebuild; and the undoing of evidence."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import evidence as ev
from ledgerloom.operators import ingest, preprocess, registry, reorg
from ledgerloom.operators.heuristics import ENGINES, Context, generate
from ledgerloom.operators.replay import materialised, replay
from ledgerloom.plans.state import State
from ledgerloom.sources.storage import written


@dataclass(frozen=True)
class Result:
    inserted: int
    skipped: int
    generated: int
    recorded: int
    rejected: int


class Pipeline:
    """Preprocessing always runs before heuristics, heuristics only propose, and only the merge step writes evidence.
    All tables of a run are committed at once, so that a run that failed can be made again."""

    def __init__(self, state: State, engines=None):
        self.state, self.engines = state, engines or ENGINES

    def evidence(self) -> DataFrame:
        return ev.folded(self.state.read("merge_evidence"), self.state.read("invalidation"))

    def run(self, chain_id: str, batch: DataFrame, now: datetime | None = None) -> Result:
        s, now = self.state, now or datetime.now(timezone.utc)
        batch = written(batch.where(F.col("chain_id") == chain_id), "batch")
        count = batch.count()
        if not count:
            return Result(0, 0, 0, 0, 0)
        params = registry.preprocessing_params(s.read("chain"), chain_id)
        stored = s.read("balance_delta")
        new = written(ingest.new_deltas(batch, stored), "new")
        history = stored.unionByName(new).where(F.col("chain_id") == chain_id)
        addresses = ingest.upserted_addresses(s.read("address"), batch)
        hubs = preprocess.mark_hubs(batch, history, s.read("label"), params)
        dusted = addresses.where("dust_flag").select("chain_id", "address")
        dust, dust_only = preprocess.mark_dust(batch, dusted, params)
        addresses = written(ingest.with_dust(ingest.with_hubs(addresses, hubs), dust), "addresses")
        excluded = written(preprocess.merged_exclusions(s.read("excluded_tx"), preprocess.mark_collaborative(batch, params), dust_only), "excluded")
        config = {r.heuristic_key: (r.confidence, r.enabled, registry.heuristic_params(r.params)) for r in registry.heuristic_config(s.read("chain_heuristic"), s.read("heuristic")).where(F.col("chain_id") == chain_id).collect()}
        config = {k: config.get(k, (0.0, False, registry.HeuristicParams())) for k in self.engines}
        context = Context(history, addresses, excluded, s.read("sweep_target"), config)
        found = generate(batch, context, self.engines)
        replace = {"address": addresses, "excluded_tx": excluded}
        generated = recorded = 0
        old = self.evidence()
        more = None
        if found is not None:
            found = written(found, "candidates")
            generated = found.count()
            accepted, _ = ev.record(found, addresses)
            last = old.where(F.col("chain_id") == chain_id).agg(F.max("op_id")).first()[0] or 0
            more = written(ev.appended(ev.numbered(accepted, last), now), "evidence")
            recorded = more.count()
        clusters, members = self._rebuilt(chain_id, old if more is None else old.unionByName(more))
        append = {"balance_delta": new} | ({"merge_evidence": more} if recorded else {})
        s.commit(append, replace | {"cluster": clusters, "cluster_membership": members})
        inserted = new.count()
        return Result(inserted, count - inserted, generated, recorded, generated - recorded)

    def _rebuilt(self, chain_id: str, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
        clusters, members = materialised(written(replay(evidence.where(F.col("chain_id") == chain_id)), "replayed"))
        other = F.col("chain_id") != chain_id
        return self.state.read("cluster").where(other).unionByName(clusters), self.state.read("cluster_membership").where(other).unionByName(members)

    def _undo(self, chain_id: str, events: DataFrame, audit: DataFrame) -> int:
        events = written(events, "events")
        n = events.count()
        if n:
            after = ev.folded(self.evidence(), events)
            clusters, members = self._rebuilt(chain_id, after)
            self.state.commit({"invalidation": events, "audit_log": written(audit, "audit")}, {"cluster": clusters, "cluster_membership": members})
        return n

    def on_reorg(self, chain_id: str, hashes: list[str], now: datetime | None = None) -> int:
        """Invalidates the evidence of rolled-back blocks; clusters are rebuilt if that was any. How many rows it was."""
        rows = self.state.spark.createDataFrame([(chain_id, h) for h in hashes], "chain_id string, block_hash string")
        return self._undo(chain_id, *reorg.on_reorg(self.evidence(), rows, now or datetime.now(timezone.utc)))

    def on_correction(self, chain_id: str, op_id: int, why: str, now: datetime | None = None) -> bool:
        return self._undo(chain_id, *reorg.on_correction(self.evidence(), chain_id, op_id, why, now or datetime.now(timezone.utc))) > 0
