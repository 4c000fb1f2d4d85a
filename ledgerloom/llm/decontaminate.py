"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import aside, columns, file_system, new_path
from ledgerloom.llm.words import WHITE, U, Words, mix, text_chunks, tidy

#: Edits (words inserted, left out or replaced) that are allowed for each word of an item.
RATE = 0.2
#: Bytes of items in a file, whose matcher a task holds at a time, and words of an item up to which it keeps all masks.
BLOCK_BYTES, KEPT = 16 << 20, 1_024
#: Bytes that are no part of a word here: ASCII other than letters and digits.
_BREAK = WHITE.copy()
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True
_GENERAL = "[\\x{2000}-\\x{206F}]"
_M = U(0x9FB21C651E98DF25)


def words_of(texts: pa.Array) -> Words:
    """Words of lower-case letters and digits; all other ASCII, and punctuation from U+2000 to U+206F, is between them."""
    text = pc.utf8_lower(texts.cast(pa.string()).fill_null(""))
    if pc.any(pc.match_substring_regex(text, _GENERAL)).as_py():
        text = pc.replace_substring_regex(text, _GENERAL, " ")
    return Words(text, _BREAK)


class Item:
    """A test item as word hashes; ids are those of all items that are the same words."""

    def __init__(self, ids: list[int | None], words: np.ndarray, rate: float):
        self.ids, self.words, self.budget = ids, words, int(len(words) * rate)

    def pieces(self) -> Iterator[tuple[int, int]]:
        """(begin, end) of budget + 1 pieces of near equal length: one of them is whole in whatever is within budget."""
        n, parts = len(self.words), self.budget + 1
        for k in range(parts):
            yield n * k // parts, n * (k + 1) // parts

    def _masks(self) -> Callable[[int], int]:
        """Bit i of a word's mask is set if word i of the item is that. Of items of over KEPT words a mask is made where it is
        asked for and not kept, so that memory is linear in the item's length."""
        at: dict[int, list[int]] = {}
        for i, w in enumerate(self.words.tolist()):
            at.setdefault(w, []).append(i)

        def mask(w: int) -> int:
            out = 0
            for i in at.get(w, ()):
                out |= 1 << i
            return out

        if len(self.words) > KEPT:
            return mask
        masks = {w: mask(w) for w in at}
        return lambda w: masks.get(w, 0)

    def nearest(self, text: list[int]) -> tuple[int, int]:
        """The least edit distance of the item to a part of the text, and where the first such part ends, by Myers' bit
        vectors."""
        n, masks = len(self.words), self._masks()
        mask, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score = mask, 0, n
        best, at = n, 0
        for j, w in enumerate(text):
            eq = masks(w)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1, mh << 1
            pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
            if score < best:
                best, at = score, j + 1
        return best, at


def _gram(hashes: np.ndarray, size: int) -> np.ndarray:
    rolled = np.zeros(max(0, len(hashes) - size + 1), U)
    for k in range(size):
        rolled = rolled * _M + hashes[k : k + len(rolled)]
    return mix(rolled)


class Matcher:
    """Items to look for. Pieces are kept by length, each a sorted array of hashes behind a table of their low bits."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        texts = words_of(pa.array([t for _, t in items], pa.string()))
        hashes = texts.hashes()
        same: dict[bytes, Item] = {}
        for (i, _), b, e in zip(items, texts.bounds, texts.bounds[1:], strict=False):
            if e > b:
                same.setdefault(hashes[b:e].tobytes(), Item([], hashes[b:e], rate)).ids.append(i)
        self.items = list(same.values())
        by: dict[int, list[tuple[int, int, int]]] = {}
        for number, item in enumerate(self.items):
            for b, e in item.pieces():
                by.setdefault(e - b, []).append((int(_gram(item.words[b:e], e - b)[0]), number, b))
        self.pieces = {}
        for size, found in by.items():
            found.sort()
            keys = np.array([h for h, _, _ in found], U)
            table = np.zeros(1 << 20, bool)
            table[keys & U((1 << 20) - 1)] = True
            self.pieces[size] = (keys, np.array([x[1:] for x in found], np.int64), table)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, edits, budget, words up to the passage's end) of the items within budget in each text."""
        words = words_of(texts)
        hashes = words.hashes()
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for size, (keys, whose, table) in self.pieces.items():
            rolled = _gram(hashes, size)
            at = np.flatnonzero(table[rolled & U((1 << 20) - 1)])
            left = np.searchsorted(keys, rolled[at], "left")
            right = np.searchsorted(keys, rolled[at], "right")
            hit = right > left
            at, left, right = at[hit], left[hit], right[hit]
            text = np.searchsorted(words.bounds, at, "right") - 1
            inside = at + size <= words.bounds[text + 1]
            for p, t, l, r in zip(at[inside].tolist(), text[inside].tolist(), left[inside].tolist(), right[inside].tolist(), strict=True):
                for number, offset in whose[l:r].tolist():
                    item = self.items[number]
                    begin = max(int(words.bounds[t]), p - offset - item.budget)
                    end = min(int(words.bounds[t + 1]), p - offset + len(item.words) + item.budget)
                    spans.setdefault((t, number), []).append((begin, end))
        out = []
        for (t, number), windows in spans.items():
            item, best = self.items[number], None
            windows.sort()
            merged: list[list[int]] = []
            for b, e in windows:
                if merged and b <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([b, e])
            for b, e in merged:
                edits, end = item.nearest(hashes[b:e].tolist())
                if edits <= item.budget and (best is None or edits < best[0]):
                    best = (edits, b + end - int(words.bounds[t]))
            if best is not None:
                out += [(t, i, best[0], item.budget, best[1]) for i in item.ids]
        return out


def _stores(folder: str):
    """mapInArrow function over (block, i, t) sorted by block: a file for each block, and its path."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        block, sink, writer, attempt = None, None, None, TaskContext.get().taskAttemptId()

        def end() -> pa.RecordBatch:
            writer.close()
            sink.close()
            fs.move(f"{base}/.{block}.{attempt}", f"{base}/{block}.arrow")
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{block}.arrow"]})

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for b, e in zip(cuts, cuts[1:], strict=False):
                if e == b:
                    continue
                if blocks[b] != block:
                    if block is not None:
                        yield end()
                    block = int(blocks[b])
                    sink = fs.open_output_stream(f"{base}/.{block}.{attempt}")
                    writer = pa.ipc.new_stream(sink, batch.schema)
                writer.write_batch(batch.slice(b, e - b))
        if block is not None:
            yield end()

    return of


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[str]:
    """All items in files of about BLOCK_BYTES in the shared folder; the driver gets nothing but their names."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    if not blocks:
        return []
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks))).repartition(blocks, "block").sortWithinPartitions("block", "i", "t")
    files = dealt.select("block", "i", "t").mapInArrow(_stores(new_path(items.sparkSession, "items")), "path string")
    return sorted(r.path for r in files.collect())


def _matcher(path: str, rate: float) -> Matcher:
    """The matcher of a block; a worker keeps the last one from task to task."""
    store = sys.modules.setdefault("_loom_kept", types.ModuleType("_loom_kept")).__dict__
    if store.get("matcher", (None,))[0] != (path, rate):
        store.pop("matcher", None)
        fs, at = file_system(path)
        with fs.open_input_stream(at) as source:
            items = pa.ipc.open_stream(source).read_all()
        store["matcher"] = (path, rate), Matcher(list(zip(items.column("i").to_pylist(), items.column("t").to_pylist(), strict=True)), rate)
    return store["matcher"][1]


MATCHES = "doc_id long, item_id long, edits int, budget int, end_word int"


def contaminations(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits, budget, end_word: each document and each item of which it holds a passage within budget.

    The distance is in words (lower case, letters and digits): insertions, deletions and replacements between the item
    and the nearest passage of the document, floor(rate * words of the item) at most. An item within budget has at
    least one of budget + 1 pieces unchanged; pieces are looked up by hash in the whole text, and what surrounds a hit
    is verified by Myers' bit vectors. end_word: words of the document up to the passage's end. An item of fewer than
    1 / rate words has no budget: it is found wherever it stands word for word, an item of one word in every document
    with that word.

    Items go to files of BLOCK_BYTES in the shared folder. There is one pass over the documents; a task holds the matcher
    of one block at a time, whatever the number of items.

    Null or wordless items and documents match nothing. Null ids are kept as null. Rows that repeat are compared each.
    No documents or no items: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    paths = _blocks(items, item_col, item_text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for path in paths:
                matcher = _matcher(path, rate)
                for chunk in text_chunks(batch, "text"):
                    ids = chunk.column("doc_id").to_pylist()
                    found = [(ids[t], *rest) for t, *rest in matcher.matches(chunk.column("text"))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "edits", "budget", "end_word"])

    return rows.mapInArrow(tidy(of), MATCHES)


def decontaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without those that hold a passage of an item, as contaminations() finds them.

    Null and empty texts, and documents whose words are few, stay as long as they hold no item. Rows that repeat, null ids
    and texts of any length are judged each, on the whole text. All columns stay as they are, whatever their names. No
    documents: no rows; no items: all documents.
    """
    paths = _blocks(items, item_col, item_text_col)
    given = aside(docs)
    names = given.columns
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *columns(docs)).toDF("text", *names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for path in paths:
                matcher, at = _matcher(path, rate), 0
                for chunk in text_chunks(batch, "text"):
                    clean[[at + m[0] for m in matcher.matches(chunk.column("text"))]] = False
                    at += chunk.num_rows
            kept = batch.filter(pa.array(clean))
            yield pa.RecordBatch.from_arrays(kept.columns[1:], names=names)

    return rows.mapInArrow(tidy(of), given.schema).toDF(*docs.columns)
