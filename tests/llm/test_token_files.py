import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import token_files as tf
from ledgerloom.llm.dac import DacFile, Ranged, encode
from ledgerloom.llm.queries import TOKENIZER as PATH


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), max_size=4))
def test_round_trip_and_random_access(docs):
    ids = np.array([i for d in docs for i in d], np.uint32)
    starts = np.cumsum([0] + [len(d) for d in docs])
    f = DacFile(encode([None if k == 1 else k - 5 for k in range(len(docs))], starts, ids))
    assert [f.document(k).tolist() for k in range(len(docs))] == docs
    assert f.doc_ids == [None if k == 1 else k - 5 for k in range(len(docs))]
    for i in random.Random(0).sample(range(len(ids)), min(20, len(ids))):
        assert f.token(i) == ids[i]
    with pytest.raises(IndexError):
        f.token(len(ids))


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    r = random.Random(1)
    parts = ["a", "the", "'s", " ", "\n", " ", "é", "1", "!", "日本", " ", "’", "\t", "_", "don't", "<|endoftext|>", "\x1c", "\0", "<|endoftext", "|>", "x" * 70]
    texts = ["", None, " ", "a b a b", "a  b", " a", "a\n\nb", "Word\nWord word"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(800)]
    got = tf.Encoder(PATH).encode(pa.array(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def rows_of(docs):
    from tokenizers import Tokenizer

    plain, start, out = Tokenizer.from_file(PATH), 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files(spark, monkeypatch):
    docs = [(i * 7 % 60, f"text number {i} " * (i % 9)) for i in range(60) if i * 7 % 60 != 5] + [(None, "none"), (5, ""), (61, None), (-3, "a <|endoftext|> b"), (-2, "\0 nul\0"), (-1, "<|endoftext|>"), (62, ""), (63, "long " * 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"start": F.lit("own"), "part": F.lit(1)})
    monkeypatch.setattr(tf, "FILE_TOKENS", 200)
    manifest = tf.write_token_files(df, PATH)
    assert manifest.count() > 5
    got = [tuple(r) for r in tf.read_token_files(manifest).collect()]
    want = rows_of(docs)
    assert sorted(got, key=lambda r: r[1]) == want
    # a range of tokens over several files, and one token of the largest by a few of its bytes
    ids = tf.read_tokens(manifest, 150, 700)
    assert len(ids) == 700 and tf.read_tokens(manifest, want[-1][1] + want[-1][2] - 1, 5) == [0]
    whole = tf.read_tokens(manifest, 0, want[-1][1] + want[-1][2])
    assert whole[150:850] == ids and all(zlib.crc32(np.array(whole[b : b + n], "<u4").tobytes()) == c for _, b, n, c in want)


def test_ranged_reads_take_few_bytes(tmp_path):
    from pyarrow import fs

    ids = np.random.default_rng(1).integers(0, 50_000, 400_000, np.uint32)
    data = encode([1, 2], np.array([0, 100, len(ids)]), ids)
    (tmp_path / "f").write_bytes(data)
    ranged = Ranged(fs.LocalFileSystem().open_input_file(str(tmp_path / "f")))
    f = DacFile(ranged)
    assert [f.token(i) for i in (0, 77_777, 399_999)] == ids[[0, 77_777, 399_999]].tolist()
    assert f.slice(200_000, 200_100).tolist() == ids[200_000:200_100].tolist() and f.doc_ids == [1, 2]
    assert ranged.taken < len(data) / 200


def test_rows_that_repeat_an_id_are_written_whole(spark):
    docs = [(None, f"none {i}") for i in range(30)] + [(4, "same")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in tf.read_token_files(tf.write_token_files(df, PATH)).collect()]
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in rows_of(docs))
    at = 0
    for r in sorted(got, key=lambda r: r[1]):
        assert r[1] == at
        at += r[2]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_token_files(tf.write_token_files(df, PATH)).count() == 0
