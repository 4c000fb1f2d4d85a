"""Evidence to clusters: combined pairs, spanning forest in order of appearance, confidences from the anchor."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.components import LOCAL_EDGES as LOCAL
from ledgerloom.operators.components import components
from ledgerloom.sources.storage import dropped, written

#: Edges of a component that one task replays; larger ones are replayed with joins.
LOCAL_EDGES = 200_000


def usable(evidence: DataFrame, least: float = 0.0) -> DataFrame:
    """Active evidence that is no loop and has that confidence by itself, before it is combined."""
    return evidence.where((F.col("status") == "active") & (F.col("address_a") != F.col("address_b")) & (F.col("confidence").cast("double") >= least))


def combined_pairs(evidence: DataFrame) -> DataFrame:
    """(chain_id, a, b, confidence, first_order): of one source the largest confidence counts, sources combine as
    1 - product(1 - c). Without a transaction each row is a source. Sources are counted by confidence, of which three
    places allow 1,001, and the counts are folded in order: a pair of any number of sources is a short list, and the
    result is the same in every run."""
    source = F.coalesce("source_txid", F.concat(F.lit("op:"), F.col("op_id")))
    rows = evidence.select("chain_id", F.least("address_a", "address_b").alias("a"), F.greatest("address_a", "address_b").alias("b"), source.alias("source"), F.col("confidence").cast("double").alias("c"), "op_id")
    # rows go to their pair once, where all that follows finds them
    by_source = rows.repartition("a", "b").groupBy("chain_id", "a", "b", "source").agg(F.max("c").alias("c"), F.min("op_id").alias("first"))
    counted = by_source.groupBy("chain_id", "a", "b", "c").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    left = F.aggregate(F.array_sort(F.collect_list(F.struct("c", "n"))), F.lit(1.0), lambda p, s: p * F.pow(1 - s["c"], s["n"]))
    return counted.groupBy("chain_id", "a", "b").agg((1 - left).alias("confidence"), F.min("first").alias("first_order"))


def first_seen(evidence: DataFrame) -> DataFrame:
    """(chain_id, address, seen): the order in which addresses first occur; of one row's ends the first comes first."""
    ends = F.explode(F.array(F.struct(F.col("address_a").alias("address"), (F.col("op_id") * 2).alias("o")), F.struct(F.col("address_b").alias("address"), (F.col("op_id") * 2 + 1).alias("o")))).alias("e")
    return evidence.select("chain_id", ends).groupBy("chain_id", F.col("e.address").alias("address")).agg(F.min("e.o").alias("seen"))


def labelled(pairs: DataFrame, local_edges: int = LOCAL) -> DataFrame:
    """(chain_id, address, component): components of each chain. A vertex is chain and address in one text."""
    vertex = lambda c: F.concat(F.length("chain_id"), F.lit(":"), "chain_id", F.col(c))
    chain = lambda c: F.substr(c, F.locate(":", c) + 1, F.split_part(c, F.lit(":"), F.lit(1)).cast("int"))
    address = lambda c: F.substr(c, F.locate(":", c) + 1 + F.split_part(c, F.lit(":"), F.lit(1)).cast("int"))
    found = components(pairs.select(vertex("a").alias("x"), vertex("b").alias("y")), local_edges)
    v, c = F.col("vertex"), F.col("component")
    return found.select(chain(v).alias("chain_id"), address(v).alias("address"), address(c).alias("component"))


_MEMBER = "chain_id string, component string, address string, confidence double"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over (chain_id, component, anchor, a, b, confidence) sorted by component and order: joins the
    edges in order, keeps those that connect, and takes the least confidence on the way from the anchor."""
    key, anchor, edges, out = None, None, [], []

    def find(root: dict, v: str) -> str:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    def close() -> None:
        root: dict[str, str] = {}
        near: dict[str, list[tuple[str, float]]] = {}
        for a, b, c in edges:
            x, y = find(root, a) if root.setdefault(a, a) else a, find(root, b) if root.setdefault(b, b) else b
            if x != y:
                root[x] = y
                near.setdefault(a, []).append((b, c))
                near.setdefault(b, []).append((a, c))
        reached, todo = {anchor: 1.0}, [anchor]
        while todo:
            v = todo.pop()
            for w, c in near.get(v, ()):
                if w not in reached:
                    reached[w] = min(c, reached[v])
                    todo.append(w)
        out.extend((*key, v, c) for v, c in reached.items())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.float64()), strict=True)], names=["chain_id", "component", "address", "confidence"])

    for part in batches:
        for chain, component, first, a, b, c in zip(*(x.to_pylist() for x in part.columns), strict=True):
            if (chain, component) != key:
                if key is not None:
                    close()
                    if len(out) > 50_000:
                        yield batch()
                        out = []
                key, anchor, edges = (chain, component), first, []
            edges.append((a, b, c))
    if key is not None:
        close()
    if out:
        yield batch()


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (chain_id, a, b, confidence, first_order) that connect something when joined in order: in every round each
    component takes its earliest edge to another one, so that large components need no single task."""
    spark = edges.sparkSession
    live = written(edges.select("chain_id", "a", "b", "confidence", "first_order", F.col("a").alias("x"), F.col("b").alias("y")), "live")
    taken: list[DataFrame] = []
    while not live.isEmpty():
        row = F.struct("first_order", "a", "b", "confidence")
        ends = live.select("chain_id", F.col("x").alias("v"), row.alias("e")).union(live.select("chain_id", F.col("y").alias("v"), row.alias("e")))
        best = ends.groupBy("chain_id", "v").agg(F.min("e").alias("e")).select("chain_id", "e.*").distinct()
        best = written(best, "forest")
        taken.append(best)
        chosen = live.join(best.select("chain_id", "first_order"), ["chain_id", "first_order"], "left_semi").select("chain_id", F.col("x").alias("a"), F.col("y").alias("b"))
        names = labelled(chosen, local_edges=0)
        x, y = names.select("chain_id", F.col("address").alias("x"), F.col("component").alias("nx")), names.select("chain_id", F.col("address").alias("y"), F.col("component").alias("ny"))
        moved = live.join(x, ["chain_id", "x"], "left").join(y, ["chain_id", "y"], "left")
        moved = moved.select("chain_id", "a", "b", "confidence", "first_order", F.coalesce("nx", "x").alias("x"), F.coalesce("ny", "y").alias("y")).where("x <> y")
        following = written(moved, "live")
        dropped(spark, live)
        live = following
    out = taken[0] if taken else edges.select("chain_id", "first_order", "a", "b", "confidence").limit(0)
    for part in taken[1:]:
        out = out.unionByName(part)
    return out


def _spread(forest: DataFrame, anchors: DataFrame) -> DataFrame:
    """(chain_id, component, address, confidence): the least confidence on each address's way from its anchor.

    Trees are contracted: in a round every leaf goes, and of vertices between two others those whose hash is smaller than
    their neighbours', whose two edges become one with the smaller confidence. A constant fraction goes in each round, whatever
    the trees' shapes. Then what went comes back in reverse: a leaf through its neighbour, another by the better of its two
    sides, as the one that leads away from the anchor can't be better. Anchors stay.
    """
    spark = forest.sparkSession
    key = ["chain_id", "v"]
    near = forest.select("chain_id", F.col("a").alias("v"), F.col("b").alias("w"), "confidence").union(forest.select("chain_id", F.col("b").alias("v"), F.col("a").alias("w"), "confidence"))
    near = written(near, "near")
    root = anchors.select("chain_id", "component", F.col("anchor").alias("v"))
    gone: list[DataFrame] = []
    while not near.isEmpty():
        kind = near.groupBy(*key).agg(F.count("*").alias("n")).join(root.select(*key, F.lit(True).alias("anchor")), key, "left")
        kind = kind.select(*key, F.when(F.col("anchor").isNotNull() | (F.col("n") > 2), 0).otherwise(F.col("n")).cast("int").alias("n"))
        other = kind.select("chain_id", F.col("v").alias("w"), F.col("n").alias("nw"))
        first = F.struct(F.xxhash64("v"), "v") < F.struct(F.xxhash64("w"), "w")
        free = (F.col("nw") == 0) | ((F.col("nw") == 2) & first)
        sides = near.join(kind.where("n > 0"), key).join(other, ["chain_id", "w"])
        sides = sides.groupBy(*key, "n").agg(F.every(free).alias("free"), F.sort_array(F.collect_list(F.struct("w", "confidence"))).alias("sides"))  # two at most
        out = written(sides.where((F.col("n") == 1) | F.col("free")).select(*key, "sides"), "gone")
        gone.append(out)
        stay = near.join(out, key, "left_anti").join(out.select("chain_id", F.col("v").alias("w")), ["chain_id", "w"], "left_anti").select("chain_id", "v", "w", "confidence")
        a, b = F.col("sides")[0], F.col("sides")[1]
        bridged = out.where(F.size("sides") == 2).select("chain_id", a["w"].alias("v"), b["w"].alias("w"), F.least(a["confidence"], b["confidence"]).alias("confidence"))
        following = written(stay.unionByName(bridged).unionByName(bridged.select("chain_id", F.col("w").alias("v"), F.col("v").alias("w"), "confidence")), "near")
        dropped(spark, near)
        near = following
    dropped(spark, near)
    found = root.select(*key, "component", F.lit(1.0).alias("confidence"))
    for out in reversed(gone):
        side = out.select(*key, F.explode("sides").alias("s")).select(*key, F.col("s.w").alias("w"), F.col("s.confidence").alias("c"))
        back = side.join(found.select("chain_id", F.col("v").alias("w"), "component", "confidence"), ["chain_id", "w"])
        back = written(back.groupBy(*key, "component").agg(F.max(F.least("c", "confidence")).alias("confidence")), "back")
        found = found.unionByName(back)
    dropped(spark, *gone)
    return found.select("chain_id", "component", F.col("v").alias("address"), "confidence")


def _anchors(names: DataFrame, rows: DataFrame) -> DataFrame:
    """(chain_id, component, anchor, size): of each component the address that the rows of evidence name first."""
    return names.join(first_seen(rows), ["chain_id", "address"]).groupBy("chain_id", "component").agg(F.min_by("address", "seen").alias("anchor"), F.count("*").alias("size"))


def clusters_of(evidence: DataFrame, least: float = 0.0) -> DataFrame:
    """(chain_id, address, cluster_id, anchor_address, size): as replay() has them, for those who ask for no confidence.
    Which edges connect something, and how surely, then doesn't matter: no pair is combined and no forest made."""
    rows = usable(evidence, least)
    names = labelled(rows.select("chain_id", F.col("address_a").alias("a"), F.col("address_b").alias("b")))
    anchor = written(_anchors(names, rows), "anchors", small=True)
    out = names.join(anchor, ["chain_id", "component"])
    return out.select("chain_id", "address", cluster_id(F.col("anchor")).alias("cluster_id"), F.col("anchor").alias("anchor_address"), "size")


def replay(evidence: DataFrame, least: float = 0.0, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(chain_id, address, cluster_id, anchor_address, size, confidence, representative_confidence): a row per address.

    The anchor is a component's address seen first and has confidence 1; an address has the least confidence on the
    way from it over the edges that connected something when the combined pairs were joined in order of appearance. The
    id is the first half of the SHA-256 of the anchor; the representative confidence the mean over the members.
    Only active evidence counts. No evidence: no rows. The result doesn't depend on the order of rows.
    """
    rows = usable(evidence, least)
    pairs = written(combined_pairs(rows), "pairs", small=True)
    names = labelled(pairs)
    anchor = _anchors(names, rows)
    edges = pairs.join(names.withColumnRenamed("address", "a"), ["chain_id", "a"])
    weight = edges.groupBy("chain_id", "component").agg(F.count("*").alias("n_edges"))
    anchor = written(anchor.join(weight, ["chain_id", "component"]), "anchors", small=True)
    whole = edges.join(anchor, ["chain_id", "component"])
    small = whole.where(F.col("n_edges") <= local_edges).repartition("chain_id", "component").sortWithinPartitions("chain_id", "component", "first_order", "a", "b")
    members = small.select("chain_id", "component", "anchor", "a", "b", "confidence").mapInArrow(_local, _MEMBER)
    if not anchor.where(F.col("n_edges") > local_edges).isEmpty():
        large = whole.where(F.col("n_edges") > local_edges).select("chain_id", "a", "b", "confidence", "first_order")
        members = members.unionByName(_spread(spanning_forest(large), anchor.where(F.col("n_edges") > local_edges)))
    members = written(members, "members", small=True)
    mean = members.groupBy("chain_id", "component").agg(F.avg("confidence").alias("representative_confidence"))
    return members.join(anchor.join(mean, ["chain_id", "component"]), ["chain_id", "component"]).select(
        "chain_id", "address", cluster_id(F.col("anchor")).alias("cluster_id"), F.col("anchor").alias("anchor_address"), "size", "confidence", "representative_confidence"
    )


def cluster_id(anchor):
    return F.substring(F.sha2(anchor, 256), 1, 32)


def materialised(replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cluster, cluster_membership) as they are stored: confidences rounded to three places."""
    stored = lambda c: F.round(c, 3).cast("decimal(4,3)")
    clusters = replayed.groupBy("chain_id", "cluster_id").agg(F.first("size").alias("size"), F.first("anchor_address").alias("anchor_address"), F.first("representative_confidence").alias("r"))
    clusters = clusters.select("chain_id", "cluster_id", "size", F.lit("unknown").alias("entity_type"), stored("r").alias("representative_confidence"), "anchor_address")
    return clusters, replayed.select("chain_id", "address", "cluster_id", stored("confidence").alias("membership_confidence"))
