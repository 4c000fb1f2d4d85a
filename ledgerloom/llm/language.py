"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.storage import aside, columns, small_batches
from ledgerloom.llm.words import text_chunks, tidy

#: Components of a vector, letters of an n-gram, and the seed of the letters' random vectors.
DIM, GRAM, SEED = 512, 3, 20240
UNKNOWN = "und"
_CHUNK = 1 << 20
#: N-grams after which a task gives its counts on, and salts over which an n-gram's rows are spread.
_HELD, SALT = 1 << 20, 16


def _kept(name: str, make):
    """A table that the worker makes once and keeps from task to task."""
    store = sys.modules.setdefault("_loom_kept", types.ModuleType("_loom_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def _is_letter() -> np.ndarray:
    return _kept("letters", lambda: np.array([chr(c).isalpha() for c in range(0x110000)]))


def letter_vector(code: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter; code 0 is the gap between words."""
    known = _kept(f"vectors{DIM}", dict)
    if code not in known:
        known[code] = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIM, np.int8) * np.int8(2) - np.int8(1)
    return known[code]


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text of each, letters): the letter n-grams of some texts as columns of a small table.

    Returns the column and the text of every n-gram, and the code points of each column's GRAM letters, 0 for a gap.
    Runs of other characters are one gap; n-grams whose inner letters have a gap are left out.
    """
    lower = [t.lower() for t in texts]
    cps = np.frombuffer(("\0".join(lower) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(lower)), [len(t) + 1 for t in lower])
    letter = _is_letter()[cps]
    ended = np.ones(len(cps), bool)  # the first of a run of other characters, and every letter, stay
    ended[1:] = letter[1:] | letter[:-1] | (text[1:] != text[:-1])
    cps, text, letter = cps[ended], text[ended], letter[ended]
    # a gap before the first letter of a text: where a text begins with a letter, one is put in
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]) & letter)
    cps, text, letter = np.insert(cps, begins, 0), np.insert(text, begins, text[begins]), np.insert(letter, begins, False)
    present = np.zeros(0x110000, bool)
    present[cps[letter]] = True
    alphabet = np.flatnonzero(present)
    index = np.zeros(0x110000, np.int64)
    index[alphabet] = np.arange(1, len(alphabet) + 1)
    seq = np.where(letter, index[cps], 0)
    size, n = len(alphabet) + 1, len(seq) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, GRAM), np.int64)
    code = np.zeros(n, np.int64)
    ok = text[:n] == text[GRAM - 1 :]
    for k in range(GRAM):
        code = code * size + seq[k : k + n]
        if 0 < k < GRAM - 1:
            ok &= seq[k : k + n] > 0
    code, of = code[ok], text[:n][ok]
    if size**GRAM <= 1 << 22:
        column = np.zeros(size**GRAM, np.int64)
        column[code] = 1
        distinct = np.flatnonzero(column)
        column[distinct] = np.arange(len(distinct))
        code = column[code]
    else:
        distinct, code = np.unique(code, return_inverse=True)
    codes = np.append(0, alphabet)
    return code, of, np.stack([codes[distinct // size ** (GRAM - 1 - k) % size] for k in range(GRAM)], axis=1)


def bound(letters: np.ndarray) -> np.ndarray:
    """One vector per row of GRAM code points: the product of the letters' vectors, each permuted by its distance from
    the last one."""
    alphabet, at = np.unique(letters, return_inverse=True)
    at = at.reshape(letters.shape)
    known = np.stack([letter_vector(c) for c in alphabet.tolist()]) if len(alphabet) else np.zeros((0, DIM), np.int8)
    vectors = np.ones((len(letters), DIM), np.int8)
    for k in range(GRAM):
        vectors *= np.roll(known, GRAM - 1 - k, axis=1)[at[:, k]]
    return vectors.astype(np.float32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, text of each, vectors' rows): coded n-grams with one bound vector per column."""
    code, of, letters = coded(texts)
    return code, of, bound(letters)


def bundled(texts: list[str]) -> np.ndarray:
    """One vector for each text: the sum of its n-grams' vectors; zero if it has no letter."""
    code, of, vectors = grams(texts)
    out = np.zeros((len(texts), DIM), np.float32)
    step = max(1, (3 << 20) // max(1, len(vectors)))
    bounds = np.searchsorted(of, np.arange(0, len(texts) + step, step))
    for k, (b, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
        rows = min(step, len(texts) - k * step)
        if rows > 0 and e > b:
            count = np.bincount((of[b:e] - k * step) * len(vectors) + code[b:e], minlength=rows * len(vectors))
            out[k * step : k * step + rows] = count.astype(np.float32).reshape(rows, -1) @ vectors
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (lang, text) to each language's bundle over the task's documents."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for chunk in text_chunks(batch, "text", _CHUNK):
            langs = chunk.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            code, of, vectors = grams([t or "" for t in chunk.column("text").to_pylist()])
            if not len(code):
                continue
            row = np.array([number[x] for x in langs])[of]
            count = np.bincount(row * len(vectors) + code, minlength=len(names) * len(vectors)).reshape(len(names), -1)
            for name, vector in zip(names, count.astype(np.float64) @ vectors, strict=True):
                total[name] = total.get(name, 0) + vector
    for name, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(range(DIM), pa.int32()), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "k", "v"])


def language_prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the bundle of all their documents' n-gram vectors.

    All documents with a language count, none is sampled; DIM sums for each language come to the driver. Documents
    without a language or text add nothing.
    """
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    return _collected(known.mapInArrow(tidy(_sums), "lang string, k int, v long"))


def _collected(sums: DataFrame) -> tuple[list[str], np.ndarray]:
    with small_batches(sums.sparkSession):
        parts = sums.groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    names = sorted({r.lang for r in parts})
    out = np.zeros((len(names), DIM))
    for r in parts:
        out[names.index(r.lang), r.k] = r.v
    return names, out


def _packed(letters: np.ndarray) -> np.ndarray:
    """The code points of an n-gram as one number."""
    return letters[:, 0] << 42 | letters[:, 1] << 21 | letters[:, 2]


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (lang, text) to how often each n-gram comes in a language, in parts."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def parts() -> Iterator[pa.RecordBatch]:
        for lang, (gram, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(c)], names=["lang", "gram", "c"])

    for batch in batches:
        for chunk in text_chunks(batch, "text", _CHUNK):
            langs = chunk.column("lang").to_pylist()
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            code, of, letters = coded(chunk.column("text").to_pylist())
            if not len(code):
                continue
            packed = _packed(letters)
            cell, count = np.unique(np.array([number[x] for x in langs])[of] * len(letters) + code, return_counts=True)
            for i, name in enumerate(names):
                b, e = np.searchsorted(cell, [i * len(letters), (i + 1) * len(letters)])
                gram, c = packed[cell[b:e] - i * len(letters)], count[b:e]
                if name in held:
                    gram, at = np.unique(np.concatenate([held[name][0], gram]), return_inverse=True)
                    c = np.bincount(at, np.concatenate([held[name][1], c])).astype(np.int64)
                held[name] = gram, c
            if sum(len(g) for g, _ in held.values()) > _HELD:
                yield from parts()
                held.clear()
    yield from parts()


def gram_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, c): how often each n-gram comes in all documents of a language, exactly."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    return known.mapInArrow(tidy(_profiles), "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _bundled_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows of gram_profiles to each language's bundle over them."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        gram, c, langs = batch.column("gram").to_numpy(), batch.column("c").to_numpy(), np.array(batch.column("lang").to_pylist(), object)
        vectors = bound(np.stack([gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF], axis=1)).astype(np.float64)
        for name in set(langs.tolist()):
            total[name] = total.get(name, 0) + c[langs == name].astype(np.float64) @ vectors[langs == name]
    for name, vector in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIM), pa.array(range(DIM), pa.int32()), pa.array(np.rint(vector).astype(np.int64))], names=["lang", "k", "v"])


def prototypes_of(profiles: DataFrame) -> tuple[list[str], np.ndarray]:
    """The same as language_prototypes of the documents that the profiles are of."""
    return _collected(profiles.mapInArrow(tidy(_bundled_profiles), "lang string, k int, v long"))


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: (key, text) to the text's n-grams, each with its share of the norm of the text's counts."""
    for batch in batches:
        for chunk in text_chunks(batch, "text", _CHUNK):
            code, of, letters = coded(chunk.column("text").to_pylist())
            if not len(code):
                continue
            cell, count = np.unique(of * len(letters) + code, return_counts=True)
            row, packed = cell // len(letters), _packed(letters)[cell % len(letters)]
            norm = np.sqrt(np.bincount(row, count.astype(np.float64) ** 2))
            yield pa.RecordBatch.from_arrays([chunk.column("key").take(pa.array(row)), pa.array(packed), pa.array(count / norm[row])], names=["key", "gram", "part"])


def exact_cosines(texts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(key, cosine) of texts (key, text): the largest cosine of the text's n-gram counts with a language's, without the
    noise of vectors. Texts that share no n-gram with any language have no row.

    N-grams of all texts meet the profiles in a join, each n-gram spread over salts."""
    norms = profiles.groupBy("lang").agg(F.sqrt(F.sum(F.col("c").cast("double") * F.col("c"))).alias("norm"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))
    learned = profiles.join(F.broadcast(norms), "lang").select("lang", "gram", (F.col("c") / F.col("norm")).alias("w"), salts.alias("salt"))
    rows = texts.select("key", "text").mapInArrow(tidy(_text_grams), "key string, gram long, part double")
    met = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT))).join(learned, ["gram", "salt"])
    return met.groupBy("key", "lang").agg(F.sum(F.col("part") * F.col("w")).alias("cosine")).groupBy("key").agg(F.max("cosine").alias("cosine"))


def identify_language(docs: DataFrame, prototypes: tuple[list[str], np.ndarray], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_pred string and score double: the language whose prototype has the largest cosine with the
    text's bundle, and that cosine, at least 0.

    A text that is null or has no letter is 'und' with 0, and so is every text if no language was learned. Ties go to
    the first language in order of names. Columns named as pred_col and score_col are replaced; all others stay as they are.
    Any character can stand in a text, U+0000 included; texts are taken whole; an empty table gives no rows.
    """
    names, learned = prototypes
    unit = learned / np.maximum(np.linalg.norm(learned, axis=1, keepdims=True), 1e-9)
    docs = docs.select(*columns(docs, pred_col, score_col))
    given = aside(docs)
    schema = T.StructType([*given.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    # the text beside the columns, which go through as they came
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *columns(docs)).toDF("text", *given.columns)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text", _CHUNK):
                vectors = bundled(chunk.column("text").to_pylist()).astype(np.float64)
                norm = np.linalg.norm(vectors, axis=1)
                pred, score = np.full(len(norm), UNKNOWN, object), np.zeros(len(norm))
                if names:
                    cos = vectors @ unit.T / np.maximum(norm, 1e-9)[:, None]
                    best = cos.argmax(1)
                    some = norm > 0
                    pred[some] = np.array(names, object)[best[some]]
                    score[some] = np.clip(cos[np.arange(len(norm)), best][some], 0, 1)
                yield pa.RecordBatch.from_arrays([*chunk.columns[1:], pa.array(pred.tolist(), pa.string()), pa.array(score)], names=schema.fieldNames())

    return rows.mapInArrow(tidy(of), schema).toDF(*docs.columns, pred_col, score_col)
