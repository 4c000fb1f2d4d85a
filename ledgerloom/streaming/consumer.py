"""The event stream into the pipeline: Structured Streaming with a barrier at every reorganisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.pipeline import Pipeline
from ledgerloom.sources.storage import written
from ledgerloom.sources.wire import decoded, deltas_of, placed, poison, reorgs_of


def segments(rows: DataFrame, by_block: bool) -> DataFrame:
    """Decoded rows with the number of their segment: a reorganisation is a segment of its own, and movements between
    two of them are one, of each chain, or one for every run of a block's rows.

    Order is total by nature, so this looks at one micro-batch, in one task for each chain."""
    chain = F.coalesce("delta.chain_id", "reorg.chain_id")
    w = Window.partitionBy("chain").orderBy("offset")
    mark = F.when(F.col("kind") == "reorg", F.concat(F.lit("reorg:"), F.col("offset"))).otherwise(F.col("delta.block_hash") if by_block else F.lit("deltas"))
    marked = rows.where("error is null").withColumn("chain", chain).withColumn("mark", mark)
    begins = F.coalesce(F.lag("mark").over(w) != F.col("mark"), F.lit(True)).cast("long")
    return marked.withColumn("segment", F.sum(begins).over(w))


def consume(pipeline: Pipeline, rows: DataFrame, by_block: bool = False) -> None:
    """One micro-batch: bad messages to quarantine, then every chain's segments in order. Whatever was stored before a
    failure is skipped when the micro-batch comes again."""
    parsed = written(decoded(placed(rows) if "split" in rows.columns else rows), "decoded")
    bad = written(poison(parsed), "poison")
    if not bad.isEmpty():
        pipeline.state.commit(append={"poison": bad})
    cut = written(segments(parsed, by_block), "segments")
    order = cut.groupBy("chain", "segment").agg(F.min("kind").alias("kind"), F.min("offset").alias("first")).orderBy("first").collect()  # one row for each segment
    for part in order:
        own = cut.where((F.col("chain") == part.chain) & (F.col("segment") == part.segment))
        if part.kind == "reorg":
            pipeline.on_reorg(part.chain, [r.block_hash for r in reorgs_of(own).select("block_hash").collect()])
        else:
            pipeline.run(part.chain, deltas_of(own))


def start(pipeline: Pipeline, messages: DataFrame, checkpoint: str, by_block: bool = False, interval: str | None = None) -> StreamingQuery:
    """Runs until stopped, at that interval, or over what is there if none is given. Offsets are committed after a
    micro-batch was processed: at least once, which ingest by key makes harmless."""
    writer = messages.writeStream.foreachBatch(lambda df, _: consume(pipeline, df, by_block)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def label_maintenance(state, stale_after, decay: float, now) -> None:
    """A run of label maintenance over the stored labels, for a scheduler to call."""
    from ledgerloom.operators.labels import maintained

    state.commit(replace={"label": written(maintained(state.read("label"), stale_after, decay, now), "labels")})
