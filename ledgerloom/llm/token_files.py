"""Documents to files of token ids in directly addressable codes, and back."""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.dac import DacFile, Ranged, encode
from ledgerloom.llm.storage import file_system, new_path, small_batches, written
from ledgerloom.llm.words import U, hashes, mix, text_bytes, text_chunks, tidy

#: Tokens after which a task begins another file; one longer document is a file of its own.
FILE_TOKENS = 4 << 20
#: Pieces of text whose ids a worker remembers, and how many are encoded at a time. A text whose words stand apart by
#: single spaces and line ends is cut before each of these: byte-level BPE of this kind never joins what stands on both
#: sides. Other texts, and those that hold an added token's text, are encoded as they are.
REMEMBERED, AT_ONCE = 700_000, 400
#: Bytes that end a piece, and other white space: its bytes, or the first two of its bytes.
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
_ODD = np.zeros(256, bool)
_ODD[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


class Encoder:
    """Ids of whole texts by the tokenizers library; pieces that were met before aren't encoded again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts of added tokens: where one stands in a text, the tokenizer gives its id, whatever is around it.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self._forget()
        self.bytes_of = self._lengths()
        self.line_end = len(self._plain(["\n"])[0]) // 4

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's own encoder, kept from task to task."""
        kept = sys.modules.setdefault("_loom_kept", types.ModuleType("_loom_kept"))
        key = ("encoder", path)
        if key not in kept.__dict__:
            kept.__dict__[key] = cls(path)
        return kept.__dict__[key]

    def _lengths(self) -> np.ndarray | None:
        """Bytes of each id, if the vocabulary is byte-level without a prefix space, else None."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("type") != "BPE":
            return None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)  # one character stands for each byte
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes], keys: list[int]) -> None:
        """Remembers the ids of pieces, each with the space or line end before it: some are encoded as one text, which
        is cut by their bytes."""
        for k in range(0, len(pieces), AT_ONCE):
            some = pieces[k : k + AT_ONCE]
            ids = np.frombuffer(self._plain([b"".join(some).decode()])[0], "<u4")
            ends = np.cumsum([len(p) for p in some])
            at = np.cumsum(self.bytes_of[ids])
            cuts = np.searchsorted(at, ends) + 1
            if (at[np.minimum(cuts - 1, len(at) - 1)] != ends).any():  # a piece isn't a whole number of ids
                each = [np.frombuffer(x, "<u4") for x in self._plain([p.decode() for p in some])]
                ids, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            n, used = len(some), self.used
            while used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while len(self.known) + n > len(self.at):
                self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
            self.ids[used : used + len(ids)] = ids
            first = len(self.known)
            begins = np.concatenate([[0], cuts[:-1]])
            self.at[first : first + n], self.n[first : first + n] = used + begins, cuts - begins
            self.known.update(zip(keys[k : k + AT_ONCE], range(first, first + n), strict=True))
            self.used = used + len(ids)

    def _forget(self) -> None:
        """known: a piece's hash to its number; at and n: where its ids are in ids, and how many."""
        self.known: dict[int, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """For each text its ids as little-endian uint32; a null is empty."""
        if self.bytes_of is None:
            return self._plain([t or "" for t in texts.to_pylist()])
        import pandas as pd

        if len(self.known) > REMEMBERED:
            self._forget()
        data, bounds = text_bytes(texts)
        full = np.flatnonzero(np.diff(bounds) > 0)
        out = [b""] * len(texts)
        if not len(full):
            return out
        cut, firsts = _CUT[data], np.zeros(len(data) + 1, bool)
        firsts[bounds[full]] = True
        after = np.append(data[1:], np.uint8(0))
        odd = _ODD[data] | (cut & (firsts[:-1] | firsts[1:])) | (cut & np.append(cut[1:], True))
        odd |= ((data == 0xC2) & ((after == 0x85) | (after == 0xA0))) | ((data == 0xE1) & (after == 0x9A)) | ((data == 0xE3) & (after == 0x80))
        for i in np.flatnonzero((data == 0xE2) & ((after == 0x80) | (after == 0x81))):
            odd[i] = data[i : i + 3].tobytes().decode().isspace()
        plain = np.ones(len(texts), bool)
        plain[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = False
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                plain[np.searchsorted(bounds, at, "right") - 1] = False
                at = raw.find(token, at + 1)
        other = [i for i in full.tolist() if not plain[i]]
        for i, ids in zip(other, self._plain([texts[i].as_py() for i in other]), strict=True):
            out[i] = ids
        full = full[plain[full]]
        if not len(full):
            return out
        # a text's first piece counts as one after a line end
        start = cut | firsts[:-1]
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        of = np.searchsorted(bounds, begin, "right") - 1
        keep = plain[of]
        begin, end, of = begin[keep], end[keep], of[keep]
        first = firsts[begin]
        line = first | (data[begin] == 0x0A)
        inner = begin + ~first
        code, distinct = pd.factorize(mix(hashes(data, inner, end) + line.astype(U)))
        number = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            where = np.zeros(len(distinct), np.int64)
            where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            known = len(self.known)
            self._learn([(b"\n" if g else b" ") + raw[b:e] for g, b, e in zip(line[where[new]].tolist(), inner[where[new]].tolist(), end[where[new]].tolist(), strict=True)], distinct[new].tolist())
            number[new] = np.arange(known, known + len(new))
        at, n = self.at[number][code], self.n[number][code]
        at, n = at + first * self.line_end, n - first * self.line_end
        stop = np.cumsum(n)
        ids = self.ids[np.repeat(at - (stop - n), n) + np.arange(stop[-1])].astype("<u4").tobytes()
        cuts = np.concatenate([[0], stop])[np.searchsorted(of, [*full.tolist(), len(texts)])] * 4
        for i, b, e in zip(full.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
            out[i] = ids[b:e]
        return out


def _writes(path: str, folder: str, end_id: int):
    """mapInArrow function over (doc_id, text) in order: writes files, gives a row for each."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, end = TaskContext.get().partitionId(), Encoder.of(path), np.array([end_id], "<u4").tobytes()
        fs, base = file_system(folder)
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        tokens = seq = 0

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            data = encode(doc_ids, starts, np.frombuffer(b"".join(ids), "<u4"))
            name = f"part-{part:06d}-{seq:05d}.dac"
            fs.create_dir(base, recursive=True)
            mine = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(mine) as out:
                out.write(data)
            fs.move(mine, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [f"{folder}/{name}"], "documents": [len(doc_ids)], "tokens": [int(starts[-1])]})

        for batch in batches:
            for chunk in text_chunks(batch, "text", 4 << 20):
                coded = encoder.encode(chunk.column("text"))
                for d, x in zip(chunk.column("doc_id").to_pylist(), coded, strict=True):
                    if doc_ids and tokens + len(x) // 4 + 1 > FILE_TOKENS:
                        yield flush()
                        doc_ids, ids, tokens, seq = [], [], 0, seq + 1
                    doc_ids.append(d)
                    ids.append(x + end)
                    tokens += len(x) // 4 + 1
        if doc_ids:
            yield flush()

    return of


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, adds end_id, and writes files in ascending id order; the manifest, written as a table.

    Manifest, a row per file: part, seq (the order of files), file, documents, tokens, start (ids before the file).
    Null texts are empty: the end id alone. Null ids come first, rows with the same id in the order of a hash of their
    texts: however many they are, ranges of that hash are different tasks'. An empty table gives no files. A task that
    is run again writes the same file under the same name. Special tokens' texts are encoded as the tokenizer does.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("lot", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "lot").sortWithinPartitions("doc_id", "lot", "text").select("doc_id", "text")
    files = ordered.mapInArrow(tidy(_writes(tokenizer_path, folder, end_id)), "part long, seq long, file string, documents long, tokens long")
    with small_batches(spark):
        files = written(files, "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file of millions of tokens, so one task holds the order of files
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, path = file_system(file)
            with fs.open_input_file(path) as f:
                dac = DacFile(f.readall())  # all of it is wanted here
            lens, ids = np.diff(dac.starts.astype(np.int64)), dac.doc_ids
            for b in range(0, dac.documents, 4096):
                e = min(b + 4096, dac.documents)
                crc = [zlib.crc32(dac.document(k).astype("<u4").tobytes()) for k in range(b, e)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[b:e], pa.int64()), pa.array(dac.starts[b:e].astype(np.int64) + start), pa.array(lens[b:e]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, read from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "start").repartition(tasks, "file").mapInArrow(tidy(_reads), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(manifest: DataFrame, start: int, count: int) -> list[int]:
    """count token ids from place start of all documents' ids: of each file that has some, only the bytes that the codes'
    chunks, bitmaps and ranks take are read."""
    files = manifest.where((F.col("start") < start + count) & (F.col("start") + F.col("tokens") > start)).orderBy("start").select("file", "start", "tokens").collect()
    out: list[int] = []
    for r in files:  # as many as hold the tokens asked for
        fs, path = file_system(r.file)
        with fs.open_input_file(path) as f:
            dac = DacFile(Ranged(f))
            out += dac.slice(max(0, start - r.start), min(r.tokens, start + count - r.start)).tolist()
    return out
