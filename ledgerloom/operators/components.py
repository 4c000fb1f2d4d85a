"""Connected components of an edge table by repeated contraction, with joins only."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.storage import dropped, written


#: Distinct edges up to which one task joins them: a graph of that size is known to fit, and needs one job, not many.
LOCAL_EDGES = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over all edges: vertex and component."""
    root: dict = {}

    def find(v):
        while (up := root.setdefault(v, v)) != v:
            root[v] = root.setdefault(up, up)
            v = root[v]
        return v

    kind = None
    for batch in batches:
        kind = batch.schema.field("x").type
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        names = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array([find(v) for v in names], kind)], names=["vertex", "component"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(vertex, component): for each end of an edge the smallest vertex that it reaches. edges: (x, y) of an ordered type.

    Up to local_edges distinct edges of longs or texts are joined by one task; beyond, and for other types, as follows.

    In a round every vertex goes over to the neighbour, or itself, whose hash is smallest; the edges between what
    they went over to have the same components and a constant fraction of the vertices. Hashed order keeps chains
    from taking as many rounds as they have vertices. Rounds are written to the shared folder, none is collected.
    Loops and repeated edges are harmless; edges with a null end are left out. No edges: no rows.
    """
    spark, kind = edges.sparkSession, edges.schema["x"].dataType
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = written(edges.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    if local_edges and kind.simpleString() in ("bigint", "string") and edges.count() <= local_edges:
        out = written(edges.coalesce(1).mapInArrow(_joined, f"vertex {kind.simpleString()}, component {kind.simpleString()}"), "components")
        dropped(spark, edges)
        return out
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        least = both.select(F.col("x").alias("u"), order("y").alias("o")).groupBy("u").agg(F.min("o").alias("o"))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("v"))
        to = written(least.select("u", F.when(own < F.col("o"), F.col("u")).otherwise(F.col("o.v")).alias("to")), "hook")
        maps.append(to)
        a, b = to.select(F.col("u").alias("x"), F.col("to").alias("tx")), to.select(F.col("u").alias("y"), F.col("to").alias("ty"))
        on = edges.join(a, "x").join(b, "y").where("tx != ty")
        following = written(on.select(F.least("tx", "ty").alias("x"), F.greatest("tx", "ty").alias("y")).distinct(), "edges")
        dropped(spark, edges)
        edges = following
    dropped(spark, edges)
    if not maps:
        return spark.createDataFrame([], f"vertex {kind.simpleString()}, component {kind.simpleString()}")

    def through(label: DataFrame, step: DataFrame) -> DataFrame:
        then = step.select(F.col("u").alias("to"), F.col("to").alias("then"))
        return label.join(then, "to", "left").select("vertex", F.coalesce("then", "to").alias("to"))

    first = maps[0].select(F.col("u").alias("vertex"), "to")
    label = written(reduce(through, maps[1:], first), "roots") if maps[1:] else first
    root = label.groupBy("to").agg(F.min("vertex").alias("component"))
    # one component can have a large part of all vertices: what reads the result finds them spread again
    out = written(label.join(root, "to").select("vertex", "component").repartition("vertex"), "components")
    dropped(spark, *maps, *([label] if maps[1:] else []))
    return out
