"""Language-model scores of whole documents: exact unigram counts and a gated recurrent model over all words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.gru import Model, laid_out
from ledgerloom.llm.storage import Scratch, small_batches
from ledgerloom.llm.words import U, Words, mix, text_chunks, tidy

#: The token after the last word of each document, as a hash.
END = U(0x454E444F46444F43)
#: Words whose counts are sent to all tasks, at most; words that the recurrent model knows by themselves; classes, by the end
#: of the word, of all others.
HEAD, KNOWN, TAILS = 1 << 17, 8_192, 32
#: Words after which a task gives the counts on, and tokens that are scored at a time.
COUNTED, AT_ONCE = 3_000_000, 2_000_000
#: The part of the documents on which a first average of models is made, tokens from which one model learns then, and
#: afterwards, and the rates at which it learns; rows in which models are averaged.
FIRST, LEARNED, RATES, MEETINGS = 12, (1 << 19, 1 << 21), (0.1, 0.03), 8


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, END after each text; their classes by the last two bytes; where each text begins, with the end."""
    words = Words(texts)
    bounds = words.bounds + np.arange(len(words.bounds))
    out, tails = np.empty(int(bounds[-1]), U), np.zeros(int(bounds[-1]), np.uint8)
    ends = bounds[1:] - 1
    out[ends] = END
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words.hashes()
    if len(words.begin):
        last = words.data[words.end - 1].astype(np.uint16) << 8 | words.data[np.maximum(words.end - 2, words.begin)]
        tails[inner] = _TAIL[last]
    return out, tails, bounds


_TAIL = (mix(np.arange(1 << 16, dtype=U)) % U(TAILS)).astype(np.uint8)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (text) to hashes, classes and counts of its tokens."""
    import pandas as pd

    held, size = [], 0

    def counted() -> pa.RecordBatch:
        hashes, tails = (np.concatenate(x) for x in zip(*held, strict=True))
        code, distinct = pd.factorize(hashes)
        tail = np.zeros(len(distinct), np.int32)
        tail[code] = tails
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(tail), pa.array(np.bincount(code, minlength=len(distinct)))], names=["hash", "tail", "c"])

    for batch in batches:
        for chunk in text_chunks(batch, "text"):
            held.append(tokens_of(chunk.column("text"))[:2])
            size += len(held[-1][0])
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


@dataclass
class Head:
    """The most frequent words: sorted hashes, their counts, and their number in the model (known, if they have none of
    their own). mass: (c + 1) summed over the words of each class that have none, and 1 for those that never came."""

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    known: int
    total: int
    distinct: int
    mass: np.ndarray

    def __post_init__(self):
        self._tables = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1: by tables of its low bits, and by search for those that met in all of them."""
        if self._tables is None:
            left, self._tables = np.arange(len(self.hashes)), []
            for shift in (0, 20, 40):
                table = np.full(1 << 20, -1, np.int32)
                slot = ((self.hashes[left] >> U(shift)) & U((1 << 20) - 1)).astype(np.int64)
                table[slot] = left
                self._tables.append((U(shift), table))
                left = left[table[slot] != left]
            self._rest = left
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.hashes):
            return out
        todo = None
        for shift, table in self._tables:
            h = hashes if todo is None else hashes[todo]
            at = table[((h >> shift) & U((1 << 20) - 1)).astype(np.int64)]
            ok = (at >= 0) & (self.hashes[at] == h)
            if todo is None:
                out[ok] = at[ok]
                todo = np.flatnonzero(~ok)
            else:
                out[todo[ok]] = at[ok]
                todo = todo[~ok]
        if len(self._rest):
            at = self._rest[np.minimum(np.searchsorted(self.hashes[self._rest], hashes[todo]), len(self._rest) - 1)]
            ok = self.hashes[at] == hashes[todo]
            out[todo[ok]] = at[ok]
        return out

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}


def head_of(counts: DataFrame, most: int = HEAD, known: int = KNOWN) -> Head:
    """The head of a table (hash, c): the words at or above the least count of which no more than `most` words are."""
    level = F.floor(F.log2("c") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # under 1024 rows
    least, held = 1 << 30, 0
    for r in sorted(levels, key=lambda r: -r.level):
        if held + r.n > most:
            break
        least, held = r.level, held + r.n
    top = counts.where((level >= least) | (F.col("hash") == int(END.view(np.int64)))).toArrow()
    hashes, c, tails = top.column("hash").to_numpy().view(U), top.column("c").to_numpy(), top.column("tail").to_numpy()
    order = np.argsort(hashes)
    hashes, c = hashes[order], c[order]
    rank = np.lexsort((hashes, -c, hashes != END))  # the end first, then by count
    number = np.full(len(hashes), min(known, len(hashes)), np.int32)
    number[rank[:known]] = np.arange(min(known, len(hashes)))
    mass = np.ones(TAILS)
    for r in counts.groupBy("tail").agg(F.sum(F.col("c") + 1).alias("m")).collect():  # TAILS rows
        mass[r.tail] += r.m
    mass -= np.bincount(tails[order][rank[:known]], c[rank[:known]] + 1.0, minlength=TAILS)
    return Head(hashes, c, number, min(known, len(hashes)), sum(r.c for r in levels), sum(r.n for r in levels), mass)


_CODED = "row long, doc_id long, held_out boolean, lot long, n_tokens long, n_known long, base double, rest double, tokens binary, others array<long>"


def _coded(head: Head):
    """mapInArrow function: (doc_id, held_out, lot, text) to the model's tokens as uint16, sums over the words of the head,
    and hashes of all others. rest: what the words without a number of their own add to their classes' probabilities."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a place of -1 is that of a word outside the head
        log_c, numbers = np.append(np.log10(head.counts + 1.0), 0.0), np.append(head.number, np.int32(head.known))
        share = np.log10(head.mass)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                hashes, tails, bounds = tokens_of(chunk.column("text"))
                at = head.find(hashes)
                token, base = numbers[at], log_c[at]
                tail = token == head.known
                rest = np.where(tail, base - share[tails], 0.0)
                token = np.where(tail, np.int32(head.known) + tails.astype(np.int32), token).astype("<u2")
                missing = at < 0
                sums = lambda v: np.add.reduceat(v, bounds[:-1])
                n = np.diff(bounds)
                others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sums(missing.astype(np.int64)))]).astype(np.int32)), pa.array(hashes[missing].view(np.int64)))
                raw = token.tobytes()
                tokens = [raw[2 * b : 2 * e] for b, e in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                rows = np.arange(row, row + len(n))
                row += len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), chunk.column("doc_id"), chunk.column("held_out"), chunk.column("lot"), pa.array(n), pa.array(sums((~missing).astype(np.int64))), pa.array(sums(base)), pa.array(sums(rest)), pa.array(tokens, pa.binary()), others],
                    names=["row", "doc_id", "held_out", "lot", "n_tokens", "n_known", "base", "rest", "tokens", "others"],
                )

    return of


def _laid(tokens: list[bytes], other: int):
    lengths = np.array([len(t) // 2 for t in tokens])
    return laid_out(np.frombuffer(b"".join(tokens), "<u2").astype(np.int32), np.concatenate([[0], np.cumsum(lengths)]), other)


def _trained(known: int, start: np.ndarray, rate: float):
    """mapInArrow function over (bucket, tokens), sorted by bucket: for each bucket the parameters after one pass over its
    documents from the start's, and their tokens."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def learned() -> pa.RecordBatch:
            model = Model(known, TAILS)
            model.load(start)
            tokens, follows, weight, _ = _laid(held, known)
            model.learn(tokens, follows, weight, rate=rate)
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([sum(map(len, held)) // 2], pa.int64()), pa.array([model.flat().tobytes()], pa.binary())], names=["bucket", "seen", "flat"])

        for batch in batches:
            for b, t in zip(batch.column("bucket").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if b != bucket:
                    if held:
                        yield learned()
                    bucket, held = b, []
                held.append(t)
        if held:
            yield learned()

    return of


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen, first = None, 0, 0
    for batch in batches:
        for bucket, n, flat in zip(batch.column("bucket").to_pylist(), batch.column("seen").to_pylist(), batch.column("flat"), strict=True):
            part = np.frombuffer(flat.as_buffer(), np.float32).astype(np.float64) * n
            total, seen, first = part if total is None else total + part, seen + n, first if seen else bucket
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], names=["bucket", "seen", "flat"])


def dealt(part: DataFrame, turn: int, buckets: int) -> DataFrame:
    """(bucket, lot, tokens) of documents (lot, tokens), sorted; each bucket is a partition, and none has two."""
    bucket = F.pmod(F.xxhash64("lot", F.lit(turn)), F.lit(buckets))
    return part.select(bucket.alias("bucket"), "lot", "tokens").repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "lot", "tokens")


def train(coded: DataFrame, head: Head) -> np.ndarray:
    """The recurrent model's parameters, from all documents (lot, tokens): buckets of documents by a hash of their lots, as
    many as there are tokens for, each give a model, and these are averaged; first over one document of FIRST, then
    over all others from that average. Which documents are in a bucket, and their order, depends on the documents only."""
    model = Model(head.known, TAILS)
    known = np.zeros(head.known)
    inner = head.number < head.known
    known[head.number[inner]] = head.counts[inner]
    model.begin_with(known, head.mass)
    flat = model.flat()
    first = F.pmod(F.col("lot"), F.lit(FIRST)) == 0
    kinds = "bucket long, seen long, flat binary"
    for turn, (part, size) in enumerate(zip((coded.where(first), coded.where(~first)), LEARNED, strict=True)):
        buckets = max(1, -(-(part.agg(F.sum("n_tokens")).first()[0] or 0) // size))
        models = dealt(part, turn, buckets).select("bucket", "tokens").mapInArrow(tidy(_trained(head.known, flat, RATES[turn])), kinds)
        meetings = -(-buckets // 16)
        while meetings > MEETINGS:  # however many models there are, a task averages a few of them
            models, meetings = models.repartition(meetings, "bucket").sortWithinPartitions("bucket").mapInArrow(_averaged, kinds), -(-meetings // 16)
        met = models.repartition(MEETINGS, "bucket").sortWithinPartitions("bucket").mapInArrow(_averaged, kinds).toArrow()  # MEETINGS rows at most
        if met.num_rows:
            seen = met.column("seen").to_numpy()
            parts = [np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * n for x, n in zip(met.column("flat"), seen, strict=True)]
            flat = (sum(parts) / seen.sum()).astype(np.float32)
    return flat


def _scores(known: int, flat: np.ndarray):
    """mapInArrow function: rows of the coded documents with, instead of their tokens, the model's score of these."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(known, TAILS)
        model.load(flat)
        held: list[pa.RecordBatch] = []
        size = 0

        def scored() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            tokens = rows.column("tokens").to_pylist()
            grid, follows, _, place = _laid(tokens, known)
            logp = model.score(grid, follows).T.reshape(-1)[place].astype(np.float64) / np.log(10)
            begins = np.concatenate([[0], np.cumsum([len(t) // 2 for t in tokens])[:-1]])
            at = rows.schema.get_field_index("tokens")
            return rows.set_column(at, "score", pa.array(np.add.reduceat(logp, begins)))

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                held.append(batch.slice(k, 256))
                size += sum(len(t) for t in held[-1].column("tokens").to_pylist()) // 2
                if size >= AT_ONCE:
                    yield scored()
                    held.clear()
                    size = 0
        if held:
            yield scored()

    return of


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; written as a table.

    Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end. Counts, and the model, come from all rows
    that aren't held out. base_score: the sum of log10((c + 1) / (N + V + 1)). score: the sum of the log10 probabilities
    of a gated recurrent model. The KNOWN most frequent words have embeddings and outputs of their own; all others have
    those of one of TAILS classes, by their last two bytes, whose probability they share by c + 1, with 1 for all that
    never came: each token is read by the state and has a probability from it, and all of them add up to 1.

    Texts are turned into tokens once; what is written of them, two bytes for each, is what the model learns from and
    scores. Counts of the HEAD most frequent words are sent to all tasks; the rest of each text's words meets the table
    of counts in a join. The model is trained by truncated backpropagation through every training document, in buckets that
    depend on the documents only, so that scores don't depend on how the input is split, and averaged; a document's
    state is carried over all windows from its begin to its end.

    A null text is empty: one token, the end. Null ids and repeated rows are scored like others. Without training rows
    every count is 0. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), held_out.alias("held_out"))
    with Scratch(spark) as tables, small_batches(spark):
        counts = rows.where("not held_out").select("text").mapInArrow(tidy(_counts), "hash long, tail int, c long")
        counts = tables.written(counts.groupBy("hash").agg(F.sum("c").alias("c"), F.max("tail").alias("tail")), "counts")
        head = head_of(counts)
        lot = F.xxhash64("doc_id", "text").alias("lot")
        coded = tables.written(rows.select("doc_id", "held_out", lot, "text").mapInArrow(tidy(_coded(head)), _CODED), "coded")
        flat = train(coded.where("not held_out").select("lot", "n_tokens", "tokens"), head)
        given = coded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rest", "tokens")
        scored = given.mapInArrow(tidy(_scores(head.known, flat)), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rest double, score double")
        tail = coded.select("row", F.explode("others").alias("hash")).join(counts.select("hash", "c"), "hash")
        tail = tail.groupBy("row").agg(F.count("*").alias("tail_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("tail_log"))
        each, tail_log = float(np.log10(head.total + head.distinct + 1.0)), F.coalesce("tail_log", F.lit(0.0))
        out = scored.join(tail, "row", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(head.total).cast("long").alias("train_tokens"),
            (F.col("base") + tail_log - F.col("n_tokens") * F.lit(each)).alias("base_score"), (F.col("score") + F.col("rest") + tail_log).alias("score"),
        )
        return tables.kept(out, "lm-scores")
