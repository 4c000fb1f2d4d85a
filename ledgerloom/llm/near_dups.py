"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.storage import Scratch, small_batches
from ledgerloom.llm.words import U, Words, mix, shingles, text_chunks, tidy

#: Collections of minhashes on each side of the tensor, and minhashes in each. A table key is one collection of the
#: left side with one of the right: LANES * LANES tables of 2 * ROWS minhashes, from 2 * LANES * ROWS minhashes.
LANES, ROWS = 20, 4
#: A pair whose sketches agree on fewer of the 160 minhashes isn't looked at: five deviations below what a
#: similarity of 0.8 gives, so that fewer than one link in a million is lost by it.
SURE = 5.0
#: Rows outside of a bucket's largest component, and rows of all, that meet in a cell, and shingles of either at most.
OUTSIDE, INSIDE, BLOCK_SHINGLES = 1_024, 1_024, 400_000
#: Left and right collections of whose tables each representative's best candidate is taken, before all are looked at.
GLANCE = 3
SALT = 32

_A = mix(np.arange(1, 2 * LANES * ROWS + 1, dtype=U)) | U(1)
_B = mix(np.arange(1001, 2 * LANES * ROWS + 1001, dtype=U))


def least_agreeing(similarity: float) -> int:
    """Minhashes, of all, on which two sets of that similarity agree at least."""
    n = 2 * LANES * ROWS
    return max(1, int(n * similarity - SURE * (n * similarity * (1 - similarity)) ** 0.5))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 2 * LANES * ROWS minhashes for each set; none of the sets is empty."""
    out = np.empty((len(sets), len(_A)), U)
    begin = 0
    while begin < len(sets):
        stop, total = begin, 0
        while stop < len(sets) and (total == 0 or total + len(sets[stop]) <= 32_768):
            total += len(sets[stop])
            stop += 1
        if stop == begin + 1 and total > 262_144:  # a very long document, in pieces
            parts = [sets[begin][i : i + 65_536] for i in range(0, total, 65_536)]
            out[begin] = np.min([minhashes([p])[0] for p in parts], axis=0)
        else:
            flat = np.concatenate(sets[begin:stop])
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin : stop - 1]])]).astype(np.int64)
            for k in range(len(_A)):
                out[begin:stop, k] = np.minimum.reduceat((flat ^ _B[k]) * _A[k], at)
        begin = stop
    return out


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        fp1 = np.array([s.sum() for s in sets], U).view(np.int64)
        fp2 = np.array([mix(s ^ U(0xA5A5A5A5DEADBEEF)).sum() if len(s) else 0 for s in sets], U).view(np.int64)
    return fp1, fp2


def sketched(words: int):
    """mapInArrow function: (doc_id, t, text) to doc_id, t, n, a fingerprint of the set, left keys and sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("a", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                sets = shingles(Words(chunk.column("text")), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = minhashes([sets[i] for i in full])
                keys = np.zeros((len(full), LANES), U)
                for k in range(ROWS):
                    keys = mix(keys * U(0x9FB21C651E98DF25) + hashes[:, k : LANES * ROWS : ROWS])
                low = (hashes & U(255)).astype(np.uint8)
                a, sketch = [None] * len(sets), [b""] * len(sets)
                for row, i in enumerate(full):
                    a[i], sketch[i] = keys[row].view(np.int64), low[row].tobytes()
                fp1, fp2 = _fingerprints(sets)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("t"), pa.array(n), pa.array(fp1), pa.array(fp2), pa.array(a, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], schema=schema)

    return of


SKETCHED = "doc_id long, t long, n long, fp1 long, fp2 long, a array<long>, sketch binary"


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (rep, sketch, lefts: lane and key of left collections) to (key, place, rep), a row for each
    pair of one of these and a right collection: the keys of the tensor's tables, and the tables' places."""
    lane_of = mix(np.arange(7, 7 + LANES * LANES, dtype=U)).reshape(LANES, LANES)
    for batch in batches:
        if not batch.num_rows:
            continue
        rep, lefts = batch.column("rep").to_numpy(), batch.column("lefts")
        right = _sketches(batch).view(np.uint32)[:, LANES:].astype(U)
        count = np.diff(lefts.offsets.to_numpy())
        flat = lefts.flatten()
        row = np.repeat(np.arange(len(rep)), count)
        lane, left = flat.field("lane").to_numpy(zero_copy_only=False), flat.field("key").to_numpy(zero_copy_only=False).view(U)
        for k in range(0, len(row), 20_000):
            r = row[k : k + 20_000]
            key = mix(mix(left[k : k + 20_000, None] + lane_of[lane[k : k + 20_000]]) + right[r] * U(0x9E3779B97F4A7C15))
            place = lane[k : k + 20_000, None].astype(np.int32) * LANES + np.arange(LANES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(place.ravel()), pa.array(np.repeat(rep[r], LANES))], names=["key", "place", "rep"])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int) -> Iterator[pa.Table]:
    """Runs of whole groups of the sorted input, of about that many rows."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows < most_rows:
            continue
        cut = _edges(held, keys)[-2]
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _edges(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of a sorted table begin, and its end."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), n)


def _crossing(edges: np.ndarray, side: np.ndarray, comp: np.ndarray, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each cell, one of side 0 and one of side 1, of different components. Some at a time."""
    xs, ys, held = [], [], 0
    for b, e in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        cut = b + int(np.searchsorted(side[b:e], 1))
        if cut == b or cut == e:
            continue
        step = max(1, at_once // (e - cut))
        for k in range(b, cut, step):
            i, j = np.repeat(np.arange(k, min(k + step, cut)), e - cut), np.tile(np.arange(cut, e), min(k + step, cut) - k)
            ok = comp[i] != comp[j]
            xs.append(i[ok])
            ys.append(j[ok])
            held += len(i)
            if held >= at_once:
                yield np.concatenate(xs), np.concatenate(ys)
                xs, ys, held = [], [], 0
    if held:
        yield np.concatenate(xs), np.concatenate(ys)


def _alike(sketch: np.ndarray, n: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows those that may be links, and the minhashes they agree on: enough, for sets whose sizes allow
    the similarity. A pair that several tables have is looked at in the first of them only."""
    fits = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
    lanes, agree = sketch.view(np.uint32), np.zeros(len(x), np.int32)
    at = np.flatnonzero(fits)
    for i in range(0, len(at), 1 << 16):
        rows = at[i : i + (1 << 16)]
        same = lanes[x[rows]] == lanes[y[rows]]
        rows = rows[same[:, :LANES].argmax(1) * LANES + same[:, LANES:].argmax(1) == place[x[rows]]]
        agree[rows] = (sketch[x[rows]] == sketch[y[rows]]).sum(1)
    ok = np.flatnonzero(agree >= least)
    return ok, agree[ok]


def _sketches(table: pa.Table | pa.RecordBatch, column: str = "sketch") -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint8).reshape(table.num_rows, 2 * LANES * ROWS)


def _agreeing(num: int, den: int):
    """mapInArrow function: (x, y, nx, ny, sx, sy) to x, y and the minhashes they agree on, of pairs that may be links."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_agreeing(num / den)
        for batch in batches:
            if not batch.num_rows:
                continue
            nx, ny = batch.column("nx").to_numpy(), batch.column("ny").to_numpy()
            same = (_sketches(batch, "sx") == _sketches(batch, "sy")).sum(1)
            ok = pa.array((same >= least) & (den * np.minimum(nx, ny) >= num * np.maximum(nx, ny)))
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(ok), batch.column("y").filter(ok), pa.array(same.astype(np.int32)).filter(ok)], names=["x", "y", "agree"])

    return of


def _common(s: np.ndarray, t: np.ndarray) -> int:
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _similar(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    common = _common(s, t)
    return den * common >= num * (len(s) + len(t) - common)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), U) for s in column]


def _confirmed(num: int, den: int):
    """mapInArrow function: (x, y, sx, sy) to those whose full sets are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([_similar(s, t, num, den) for s, t in zip(_sets(batch.column("sx")), _sets(batch.column("sy")), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(ok), batch.column("y").filter(ok)], names=["x", "y"])

    return of


_CELL = ["key", "p", "q"]


def _flagged(num: int, den: int):
    """mapInArrow function over sorted cells: (key, rep, other, agree) of the rows that, by their sketches, may be linked to
    one of another component, with the one that agrees best."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_agreeing(num / den)
        for table in _groups(batches, _CELL, 8_192):
            key, rep, comp, n, side, place = (table.column(c).to_numpy() for c in ("key", "rep", "comp", "n", "side", "place"))
            sketch, best, partner = _sketches(table), np.zeros(table.num_rows, np.int32), np.zeros(table.num_rows, np.int64)
            for x, y in _crossing(_edges(table, _CELL), side, comp):
                ok, agree = _alike(sketch, n, place, x, y, num, den, least)
                if not len(ok):
                    continue
                mine, other, agree = np.concatenate([x[ok], y[ok]]), np.concatenate([y[ok], x[ok]]), np.concatenate([agree, agree])
                order = np.lexsort((rep[other], -agree, mine))
                first = order[np.flatnonzero(np.diff(mine[order], prepend=-1))]
                first = first[agree[first] > best[mine[first]]]
                best[mine[first]], partner[mine[first]] = agree[first], rep[other[first]]
            if (hit := best > 0).any():
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(rep[hit]), pa.array(partner[hit]), pa.array(best[hit])], names=["key", "rep", "other", "agree"])

    return of


def _linked(num: int, den: int):
    """mapInArrow function over sorted cells with full sets: edges of a forest that, with the components, connects all that
    is linked across components."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_agreeing(num / den)
        for table in _groups(batches, _CELL, 256):
            rep, comp, n, side, place = (table.column(c).to_numpy() for c in ("rep", "comp", "n", "side", "place"))
            sketch, sets = _sketches(table), _sets(table.column("shingles"))
            names, back = np.unique(comp, return_inverse=True)
            root, out = list(range(len(names))), []

            def find(v: int, root: list[int] = root) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for x, y in _crossing(_edges(table, _CELL), side, comp):
                ok, _ = _alike(sketch, n, place, x, y, num, den, least)
                for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                    a, b = find(back[i]), find(back[j])
                    if a != b and _similar(sets[i], sets[j], num, den):
                        root[max(a, b)] = min(a, b)
                        out.append((rep[i], rep[j]))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return of


def _full_sets(words: int):
    """mapInArrow function: (rep, text) to rep and the sorted set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                sets = shingles(Words(chunk.column("text")), words)
                yield pa.RecordBatch.from_arrays([chunk.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "shingles"])

    return of


def _cells(rows: DataFrame, outside: int, inside: int) -> DataFrame:
    """rows (key, rep, comp, home, n, ...) in cells (key, p, q): a bucket's rows that aren't of its home component, its
    largest, in blocks p, beside all its rows in blocks q. With few rows outside, every row is in few cells. Blocks hold
    about so many rows, and shingles not beyond a bound."""
    out = F.col("comp") != F.col("home")
    size = rows.groupBy("key").agg(F.count("*").alias("all"), F.count_if(out).alias("r"), F.sum("n").alias("w"), F.coalesce(F.sum(F.when(out, F.col("n"))), F.lit(0)).alias("wr"))
    blocks = lambda c, w, most: F.ceil(F.greatest(F.col(c) / most, F.col(w) / BLOCK_SHINGLES)).cast("int")
    size = size.where("r > 0 and all > 1").select("key", blocks("r", "wr", outside).alias("ps"), blocks("all", "w", inside).alias("qs"))
    rows = rows.join(size, "key").drop("home")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(c)).cast("int")
    kept = [c for c in rows.columns if c not in ("ps", "qs", "out")]
    left = rows.where("out").select(*kept, block("ps", 1).alias("p"), every("qs").alias("q"), F.lit(0).alias("side"))
    right = rows.select(*kept, every("ps").alias("p"), block("qs", 2).alias("q"), F.lit(1).alias("side"))
    return left.unionByName(right).repartition(*_CELL).sortWithinPartitions(*_CELL, "side")


def _named(frame: DataFrame, end: str, **cols: str) -> DataFrame:
    """Columns of representatives under the names that one end of a pair has."""
    return frame.select(F.col("rep").alias(end), *[F.col(c).alias(f"{name}{end}") for c, name in cols.items()])


def _verified(candidates: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links among each representative's best candidate: candidates (x, y, agree)."""
    # the smallest of those that agree best
    best = candidates.groupBy("x").agg(F.max(F.struct("agree", (-F.col("y")).alias("y")))["y"].alias("y")).select("x", (-F.col("y")).alias("y"))
    pairs = best.join(_named(sets, "x", shingles="s"), "x").join(_named(sets, "y", shingles="s"), "y")
    return pairs.select("x", "y", "sx", "sy").mapInArrow(tidy(_confirmed(num, den)), "x long, y long")


def _open(buckets: DataFrame, comps: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (key, place, rep, comp, home, n, sketch, out) of the buckets that have several components."""
    now = buckets.join(comps.select(F.col("vertex").alias("rep"), "component"), "rep", "left").select("key", "place", "rep", F.coalesce("component", "rep").alias("comp"))
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("home"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    rows = now.join(open_, "key").join(reps.select("rep", "n", "sketch"), "rep")
    return rows.select("key", "place", "rep", "comp", "home", "n", "sketch", (F.col("comp") != F.col("home")).alias("out"))


def _across(buckets: DataFrame, links: DataFrame, reps: DataFrame, sets: DataFrame, num: int, den: int, tables: Scratch) -> DataFrame:
    """Components by the links so far and all links between rows of one bucket (key, place, rep) that are of different ones:
    first, of a few tables' buckets, each representative's best candidate is confirmed; what is open after that in any
    bucket is compared on full sets."""
    for last in (False, True):
        if last:
            comps = tables.owns(components(links))
        else:  # every representative has one link at most so far: where that leads to in two steps does for now
            once = links.select(F.col("x").alias("vertex"), "y")
            comps = once.join(once.select(F.col("vertex").alias("y"), F.col("y").alias("z")), "y", "left").select("vertex", F.coalesce("z", "y").alias("component"))
        some = buckets if last else buckets.where((F.col("place") % LANES < GLANCE) & (F.floor(F.col("place") / LANES) < GLANCE))
        rows = tables.written(_open(some, comps, reps), "open")
        flagged = tables.written(_cells(rows, OUTSIDE, INSIDE).mapInArrow(tidy(_flagged(num, den)), "key long, rep long, other long, agree int"), "flagged")
        if last and flagged.isEmpty():
            return comps
        if last:
            whole = tables.written(rows.join(flagged.select("key", "rep").distinct(), ["key", "rep"], "left_semi").join(sets, "rep"), "flagged-sets")
            more = _cells(whole, OUTSIDE // 2, INSIDE // 2).mapInArrow(tidy(_linked(num, den)), "x long, y long")
        else:
            more = _verified(flagged.select(F.col("rep").alias("x"), F.col("other").alias("y"), "agree"), sets, num, den)
        links = tables.written(links.union(more), "links")
    return tables.owns(components(links))


def near_duplicates(docs: DataFrame, words: int = 4, similarity: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; written as a table.

    A document's set: distinct shingles of that many words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); with fewer words,
    the whole sequence as one. Documents are linked if den * intersection >= num * union, for similarity (num, den).
    component_id: the smallest id reachable; kept: whether that is the document's own.

    Equal sets go on as one representative. A table's key is a pair of a left and a right collection of minhashes; pairs
    are formed for the left collections that representatives share, so that a text like no other is never written once
    for each of the LANES * LANES tables. Every bucket's rows meet its smallest only, so rows and candidates grow with the
    rows of the buckets, not with their squares; of its candidates each representative confirms the one that agrees best,
    on full sets. Buckets whose rows are then in different components take the exact way: rows outside of the largest component
    against all rows, in blocks, by sketches; again the best candidates are confirmed first, and all of what then is still
    open is compared on full sets. A pair at a similarity of exactly 0.8 is lost with a
    chance of 5 in 100,000, as it may share no bucket.

    Null or empty texts: no shingles, linked with nothing. Null ids: never linked, component_id null, kept.
    Rows that repeat an id and a text are in one component. Rows that repeat an id with another text are linked each by
    its own text; component_id is an id all the same. An empty table gives an empty result. Other columns are
    left alone. Texts of any length are taken whole.
    """
    num, den = similarity
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    with Scratch(spark) as tables, small_batches(spark, "2m"):
        sketch = tables.written(rows.mapInArrow(tidy(sketched(words)), SKETCHED), "sketch")
        full = sketch.where("n > 0 and doc_id is not null")
        # a representative stands for a set, not for an id: one id can come with several texts
        reps = full.groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "t")).alias("at"), F.first("a").alias("a"), F.first("sketch").alias("sketch"))
        reps = tables.written(reps.select(F.monotonically_increasing_id().alias("rep"), "fp1", "fp2", "n", F.col("at.doc_id").alias("first"), F.col("at.t").alias("t"), "a", "sketch"), "reps")
        lanes = reps.select("rep", F.posexplode("a").alias("lane", "key"))
        crowded = lanes.groupBy("lane", "key").agg(F.count("*").alias("size")).where("size > 1")
        lefts = lanes.join(crowded.drop("size"), ["lane", "key"]).groupBy("rep").agg(F.collect_list(F.struct("lane", "key")).alias("lefts"))  # LANES at most
        keyed = lefts.join(reps.select("rep", "sketch"), "rep").select("rep", "sketch", "lefts").mapInArrow(tidy(_table_keys), "key long, place int, rep long")
        keyed = tables.written(keyed, "keys")
        hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
        buckets = tables.written(keyed.join(hubs, "key"), "buckets")
        edges = tables.written(buckets.where("rep != hub").select(F.col("rep").alias("x"), F.col("hub").alias("y")).distinct(), "edges")
        active = edges.select(F.col("x").alias("rep")).union(edges.select("y")).distinct()
        wanted = active.join(reps.select("rep", "first", "t"), "rep")
        texts = rows.withColumnRenamed("doc_id", "first").join(wanted.hint("shuffle_hash"), ["first", "t"]).dropDuplicates(["first", "t"]).select("rep", "text")
        sets = tables.written(texts.mapInArrow(tidy(_full_sets(words)), "rep long, shingles binary"), "sets")
        both = edges.join(_named(reps, "x", n="n", sketch="s"), "x").join(_named(reps, "y", n="n", sketch="s"), "y")
        near = both.select("x", "y", "nx", "ny", "sx", "sy").mapInArrow(tidy(_agreeing(num, den)), "x long, y long, agree int")
        links = tables.written(_verified(near, sets, num, den), "links")
        comps = _across(buckets.drop("hub"), links, reps, sets, num, den, tables)
        # a component can have any number of documents: its smallest is looked up under a salt of each
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")
        named = reps.select("rep", "first").join(comps.withColumnRenamed("vertex", "rep"), "rep")
        least = named.groupBy("component").agg(F.min("first").alias("least")).select("component", "least", salts)
        smallest = comps.withColumn("salt", F.pmod(F.xxhash64("vertex"), F.lit(SALT))).join(least, ["component", "salt"])
        classes = reps.join(smallest.select(F.col("vertex").alias("rep"), "least"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("least", "first").alias("component_id"))
        own = sketch.select("doc_id", "n", "fp1", "fp2")
        linked = own.where("n > 0 and doc_id is not null").join(classes, ["fp1", "fp2", "n"]).select("doc_id", "n", "component_id")
        out = linked.union(own.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id")))
        kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
        return tables.kept(out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept), "near-dups")
