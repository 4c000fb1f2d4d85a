"""Approximate nearest neighbours by additive quantisation with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import Scratch

#: Codebooks, codewords in each, and partial codes that the search for a code keeps.
BOOKS, WORDS, BEAM = 8, 256, 4
#: Vectors on which the codebooks are fitted: those with the smallest hashes of their ids. All vectors are indexed.
FIT_ROWS, FIT_SEED = 8_192, 17
#: Vectors of a block of the index, queries of a block, and candidates of each query for exact reranking at most.
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 2_048, 256, 1_024
#: Deviations of the codes' errors within which a candidate could still be among the nearest.
DEVIATIONS = 2.0
#: Blocks of queries and of the index that meet in a place of the grid.
PLACE_GROUPS, PLACE_BLOCKS = 4, 32


@dataclass
class Codebooks:
    """books: (BOOKS, WORDS, dimensions); a vector is about the sum of one codeword of each book."""

    books: np.ndarray

    @property
    def gram(self) -> np.ndarray:
        flat = self.books.reshape(-1, self.books.shape[2])
        return flat @ flat.T

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows, BOOKS) by beam search: each step adds the codewords that leave the smallest residuals."""
        m, k, _ = self.books.shape
        dots, gram = x @ self.books.reshape(m * k, -1).T, self.gram
        n = len(x)
        codes, error = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for j in range(m):
            own = np.diagonal(gram)[j * k : (j + 1) * k]
            step = error[:, :, None] + own - 2 * dots[:, None, j * k : (j + 1) * k]
            for i in range(j):
                step = step + 2 * gram[codes[:, :, i] + i * k, j * k : (j + 1) * k]
            flat = step.reshape(n, -1)
            keep = min(beam, flat.shape[1]) if j < m - 1 else 1
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            error = np.take_along_axis(flat, best, 1)
            before = codes[np.arange(n)[:, None], best // k]
            codes = np.concatenate([before, (best % k)[:, :, None]], axis=2)
        return codes[np.arange(n), error.argmin(1)].astype(np.uint8 if k <= 256 else np.uint16)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(self.books.shape[0]), codes.astype(np.int64)].sum(1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.flatnonzero(count))
        centres[count > 0] = np.add.reduceat(x[order], starts) / count[count > 0, None]
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = FIT_SEED) -> Codebooks:
    """Codebooks of unit vectors: residual k-means to begin with, then beam codes and least squares over all books."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = max(1, min(words, len(x)))
    rest, out = x.copy(), []
    for _ in range(books):
        centres = _kmeans(rest, words, rng)
        rest = rest - centres[((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)]
        out.append(centres)
    model = Codebooks(np.stack(out))
    for _ in range(rounds):
        design = np.zeros((len(x), books * words), np.float32)
        codes = model.encode(x).astype(np.int64)
        for j in range(books):
            design[np.arange(len(x)), j * words + codes[:, j]] = 1
        normal = design.T @ design + np.eye(books * words, dtype=np.float32) * 0.5
        right = design.T @ x + 0.5 * model.books.reshape(books * words, -1)
        model = Codebooks(np.linalg.solve(normal.astype(np.float64), right.astype(np.float64)).astype(np.float32).reshape(books, words, -1))
    return model


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return df.where(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True) if len(x) else np.ones((0, 1))
    x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, with the largest component at about 1: products neither overflow nor vanish, and
    cosines stay the same to the last bit where they didn't."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosine of every pair of rows, in double precision."""
    q, x = scaled(q), scaled(x)
    return (q * x).sum(-1) / (np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1)))


def _indexed(model: Codebooks):
    """mapInArrow function: (row, id, v) to blocks of rows, ids, codes, and norms and errors of the decoded vectors."""
    schema = pa.schema([(c, pa.binary()) for c in ("rows", "ids", "codes", "norms", "errors")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(b, BLOCK_ROWS)
                unit = _unit(_matrix(part.column("v"))).astype(np.float32)
                codes = np.concatenate([model.encode(unit[i : i + 1024]) for i in range(0, len(unit), 1024)])
                near = model.decode(codes)
                norms, errors = (np.linalg.norm(d, axis=1).astype(np.float32) for d in (near, unit - near))
                cells = (part.column("row").to_numpy(), part.column("id").to_numpy(), codes, norms, errors)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], schema=schema)

    return of


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in range(0, batch.num_rows, BLOCK_QUERIES):
            part = batch.slice(b, BLOCK_QUERIES)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([_unit(_matrix(part.column("v"))).astype(np.float32).tobytes()], pa.binary())], names=["q_ids", "q_units"])


_CANDIDATE = "query_id long, row long, vec_id long, near float, error float"


def _searched(model: Codebooks, k: int, rerank: int):
    """applyInArrow function over a place of the grid: its blocks of queries and of the index, to the candidates that
    lookup tables score best for each query, ties to smaller ids, without those that, by the errors of the codes, can
    hardly be among the k nearest."""

    def of(groups: pa.Table, blocks: pa.Table) -> pa.Table:
        dim, code_type = model.books.shape[2], np.uint8 if model.books.shape[1] <= 256 else np.uint16
        out = []
        for g in range(groups.num_rows):
            read = lambda table, name, i, kind: np.frombuffer(table.column(name)[i].as_buffer(), kind)
            q_ids, q = read(groups, "q_ids", g, np.int64), read(groups, "q_units", g, np.float32).reshape(-1, dim)
            table = np.ascontiguousarray(np.einsum("qd,mkd->mkq", q, model.books))
            best = [np.zeros((len(q_ids), 0), kind) for kind in (np.float32, np.int64, np.int64, np.float32)]
            for b in range(blocks.num_rows):
                rows, ids = (read(blocks, c, b, np.int64) for c in ("rows", "ids"))
                norms, errors = (read(blocks, c, b, np.float32) for c in ("norms", "errors"))
                codes = read(blocks, "codes", b, code_type).reshape(len(ids), -1).astype(np.int64)
                score = table[0][codes[:, 0]]
                for m in range(1, codes.shape[1]):
                    score += table[m][codes[:, m]]
                score /= np.maximum(norms, 1e-12)[:, None]
                score = score.T
                score[q_ids[:, None] == ids[None, :]] = -np.inf
                error = DEVIATIONS / np.sqrt(dim) * errors
                found = [np.concatenate([held, np.broadcast_to(new, score.shape)], 1) for held, new in zip(best, (score, rows, ids, error.astype(np.float32)), strict=True)]
                best = _top(found, rerank)
            near, rows, ids, error = best
            kept = near > -np.inf
            if near.shape[1] > k:
                low = near - error
                kept &= near + error >= np.partition(low, low.shape[1] - k, axis=1)[:, -k][:, None]
            out.append((np.repeat(q_ids, kept.sum(1)), rows[kept], ids[kept], near[kept], error[kept]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.float32, np.float32)]
        return pa.table(dict(zip(("query_id", "row", "vec_id", "near", "error"), cols, strict=True)))

    return of


def _top(found: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Of each query's (scores, rows, ids, errors) the best so many; of those that tie with the last one the smaller ids."""
    score, _, ids, _ = found
    if score.shape[1] <= most:
        return found
    least = np.partition(score, score.shape[1] - most, axis=1)[:, score.shape[1] - most]
    sure, tied = score > least[:, None], score == least[:, None]
    crowded = np.flatnonzero(sure.sum(1) + tied.sum(1) > most)
    keep = sure | tied
    for i in crowded.tolist():
        at = np.flatnonzero(tied[i])
        room = most - int(sure[i].sum())
        keep[i, at] = False
        keep[i, at[np.argpartition(ids[i, at], room - 1)[:room]]] = True
    return [x[keep].reshape(len(score), most) for x in found]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (query_id, vec_id, row, q, v) to the pairs' cosines."""
    for batch in batches:
        if batch.num_rows:
            score = cosines(_matrix(batch.column("q")), _matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), batch.column("row"), pa.array(score)], names=["query_id", "vec_id", "row", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by cosine found for each query, ties to smaller ids; written
    as a table.

    Codebooks are fitted on FIT_ROWS vectors at most, all vectors are encoded. Queries and the index go in blocks to the
    places of a grid that grows with both, so that a place has a bounded number of either; what goes there are codes and
    norms, no vectors. Lookup tables give approximate scores; of the best `rerank` of each query, over all places, those
    that can be among the k nearest within DEVIATIONS of their codes' errors are scored exactly on the original vectors,
    which a join by row brings.

    Vectors that are null, of another length than most, zero, or hold null or non-finite components take no part, nor
    do rows with a null id. Magnitudes of any size are fine. A vector isn't its own neighbour: rows with the query's id
    are left out. With fewer candidates all are given; without vectors or queries there are no rows. Rows that repeat an
    id and a vector each count. A query id that comes with several vectors asks for the smallest in order of components.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as tables:
        rows = tables.written(_usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "ann-vectors")
        asked = _usable(queries, id_col, vec_col)
        sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(FIT_ROWS).collect()
        if not sample:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        lengths = [len(r.v) for r in sample]
        dim = max(set(lengths), key=lambda n: (lengths.count(n), n))
        fits = F.size("v") == dim
        model = fit(_unit(np.array([r.v for r in sample if len(r.v) == dim])))
        rows = rows.where(fits)
        asked = tables.written(asked.where(fits).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
        blocks = tables.written(rows.select("row", "id", "v").mapInArrow(_indexed(model), "rows binary, ids binary, codes binary, norms binary, errors binary").withColumn("block", F.monotonically_increasing_id()), "ann-index")
        groups = tables.written(asked.mapInArrow(_query_blocks, "q_ids binary, q_units binary").withColumn("group", F.monotonically_increasing_id()), "ann-groups")
        found = _grid(groups, blocks, model, k, rerank)
        # of each query the best of all places, and the k-th of the scores that they have at least
        of = Window.partitionBy("query_id")
        low = F.col("near") - F.col("error")
        found = found.withColumn("r", F.row_number().over(of.orderBy(F.desc("near"), "vec_id", "row"))).withColumn("s", F.row_number().over(of.orderBy(low.desc(), "row")))
        found = found.withColumn("bound", F.max(F.when(F.col("s") == k, low)).over(of))
        near = F.col("bound").isNull() | (F.col("near") + F.col("error") >= F.col("bound"))
        best = tables.written(found.where((F.col("r") <= rerank) & near).select("query_id", "vec_id", "row"), "ann-candidates")
        near = best.join(rows.select("row", "v"), "row").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        scored = near.select("query_id", "vec_id", "row", "q", "v").mapInArrow(_exact, "query_id long, vec_id long, row long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "row"))
        return tables.kept(scored.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-nearest")


def _grid(groups: DataFrame, blocks: DataFrame, model: Codebooks, k: int, rerank: int) -> DataFrame:
    """Each block of queries beside each block of the index, once: rows and columns of the grid are as many as leave
    PLACE_GROUPS and PLACE_BLOCKS of them to a place, so that tasks become more, not larger, with the input."""
    down, across = (max(1, -(-table.count() // most)) for table, most in ((groups, PLACE_GROUPS), (blocks, PLACE_BLOCKS)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = groups.select("q_ids", "q_units", place("group", down).alias("r"), every(across).alias("c"))
    right = blocks.select("rows", "ids", "codes", "norms", "errors", place("block", across).alias("c"), every(down).alias("r"))
    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(_searched(model, k, rerank), _CANDIDATE)
