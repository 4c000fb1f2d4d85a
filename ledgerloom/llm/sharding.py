"""Sharding by balanced label propagation over groups of equal texts."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import dropped, written

#: Parts of a shard that start together: the documents of a group that begin in one part move as one.
PARTS = 4
#: Rounds at most.
ROUNDS = 12
#: Documents of a bucket within which positions are counted.
BUCKET = 4_096


def _unit(*cols: Column) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _by_shard(shards: int, values: list, shard: str) -> Column:
    """The value of the shard in that column, from a list with one for each shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(shard).cast("int") + 1)


def propagated(state: DataFrame, shards: int, cap: int) -> DataFrame:
    """The groups' parts (g, part, n, total, shard) after rounds in which they move towards their groups' largest shards.

    In a round every group looks at the shards that hold most of it. One that takes half a shard at most wants to be
    whole in the first of these with room for that. A large one keeps to as many shards as it fills, and its parts elsewhere want to
    go to any of them with room. As large a share of what is wanted is let in as the room allows, by a hash: of a small
    group, which moves as a whole, or of a part. cap: linked rows that a shard takes at most; rows without equals have
    no edges to cut and fill what is left.
    """
    spark = state.sparkSession
    for turn in range(ROUNDS):
        load = [0] * shards
        for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row for each shard
            load[r.shard] += r.n
        room = [max(0, cap - x) for x in load]
        room_of = lambda x: F.element_at(F.array(*[F.lit(v) for v in room]), x["shard"] + 1)
        held = state.groupBy("g", "shard").agg(F.sum("n").alias("held"), F.first("total").alias("total"))
        place = F.struct("held", F.xxhash64("g", "shard").alias("lot"), F.col("shard").cast("int").alias("shard"))
        # a row for each group and shard at most, so no list is longer than there are shards
        ranked = held.groupBy("g").agg(F.sort_array(F.collect_list(place), asc=False).alias("places"), F.first("total").alias("total"))
        large = F.col("total") > cap // 2
        fills = (F.ceil(F.col("total") / cap) + turn // 4).cast("int")
        ranked = ranked.select("g", "total", large.alias("large"), F.when(large, F.slice("places", F.lit(1), fills)).otherwise(F.col("places")).alias("keep"), (F.col("places")[0]["held"] == F.col("total")).alias("whole"))
        fits = lambda x: F.when(F.col("large"), room_of(x) > 0).otherwise(room_of(x) + x["held"] >= F.col("total"))
        ranked = ranked.withColumn("open", F.filter("keep", fits)).drop("total")
        now = state.join(ranked, "g")
        choice = F.when(F.col("large"), F.pmod(F.xxhash64("g", "part", F.lit(turn)), F.size("open"))).otherwise(F.lit(0)).cast("int")
        to = F.when((F.size("open") > 0) & ~F.col("whole"), F.get("open", choice)["shard"])
        stays = F.col("large") & F.exists("keep", lambda x: x["shard"] == F.col("shard"))
        asks = F.when(~stays & (to != F.col("shard")), to)
        now = written(now.select("g", "part", "n", "total", "large", "shard", asks.alias("to")), "asks")
        wanted = [0] * shards
        for r in now.where("to is not null").groupBy("to").agg(F.sum("n").alias("n")).collect():
            wanted[r.to] = r.n
        if not any(wanted):
            dropped(spark, now)
            break
        share = [min(1.0, room[s] / wanted[s]) if wanted[s] else 0.0 for s in range(shards)]
        lot = F.when(F.col("large"), _unit(F.col("g"), F.col("part"), F.lit(turn))).otherwise(_unit(F.col("g"), F.lit(turn)))
        moved = now.select("g", "part", "n", "total", F.when(F.col("to").isNotNull() & (lot < _by_shard(shards, share, "to")), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        dropped(spark, state)
        state = written(moved, "labels")
        dropped(spark, now)
    return state


def balanced_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row; law is `rows`.

    Shards 0 to shards - 1 get floor(rows / shards) rows, the first rows % shards one more; slots count each shard's
    rows from 0. Rows with equal texts are linked: labels that begin as a hash of the id move towards the linked rows'
    shards by propagated(), over groups' parts with counts, so that a group of any number of rows is a few rows there.
    What is over a quota at the end, rows without equals first, fills what is under one.

    size: UTF-8 bytes of the text and 8; text_crc32: of these bytes. A null text has no bytes and is linked with
    nothing; empty texts are equal. Null ids are rows like others. Repeated rows each get a slot of their own.
    grown_shard is null. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("g"),
    )
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards * PARTS)).cast("int")), "rows")
    counts = rows.where("g is not null").groupBy("g", "part").agg(F.count("*").alias("n"))
    many = written(counts.groupBy("g").agg(F.sum("n").alias("total")).where("total > 1"), "groups")
    state = written(counts.join(many, "g").select("g", "part", "n", "total", (F.col("part") % shards).cast("int").alias("shard")), "labels")
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    final = propagated(state, shards, max(1, total // shards)).select("g", "part", F.col("shard").alias("label"))
    labelled = rows.join(final, ["g", "part"], "left").select("doc_id", "size", "text_crc32", F.coalesce("label", F.col("part") % shards).alias("label"), F.col("label").isNull().alias("alone"))
    # positions in a shard: linked rows first; within buckets of a few thousand rows, then by the buckets' counts
    buckets = max(1, total // (shards * BUCKET))
    labelled = written(labelled.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets))), "labelled")
    sizes = labelled.groupBy("label", "alone", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("alone", "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("label", "alone", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    ranked = labelled.withColumn("within", within).join(sizes.select("label", "alone", "bucket", before.alias("before")), ["label", "alone", "bucket"])
    ranked = ranked.withColumn("pos", F.col("before") + F.col("within"))
    load = [0] * shards
    for r in labelled.groupBy("label").count().collect():
        load[r.label] = r["count"]
    surplus = [max(0, load[s] - quota[s]) for s in range(shards)]
    gaps = [max(0, quota[s] - load[s]) for s in range(shards)]
    first = [0, *accumulate(surplus)]
    filled = list(accumulate(gaps))
    over = F.col("pos") - _by_shard(shards, quota, "label")
    number = _by_shard(shards, first[:-1], "label") + over
    goes = F.size(F.filter(F.array(*[F.lit(x) for x in filled]), lambda x: x <= F.col("number")))
    out = ranked.withColumn("number", F.when(over >= 0, number)).withColumn("goes", F.when(F.col("number").isNotNull(), goes))
    shard = F.coalesce("goes", "label")
    slot = F.when(F.col("goes").isNull(), F.col("pos")).otherwise(F.col("number") - _by_shard(shards, [f - g for f, g in zip(filled, gaps, strict=True)], "goes") + _by_shard(shards, load, "goes"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
