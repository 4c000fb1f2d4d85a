import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ann
from ledgerloom.llm.ann import Codebooks, cosines, fit, nearest
from ledgerloom.llm.queries import op8_additive_quantisation


def exact(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[ids == ids[i]] = -9
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


@pytest.mark.parametrize("spread", [None, 0.02])
def test_recall(spark, spread):
    """Random directions, or a third of all vectors nearly the same."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 24))
    if spread:
        x[::3] = x[0] + spread * rng.standard_normal((2000, 24))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(cosines(x[r.query_id].astype(float), x[r.vec_id].astype(float))), abs=1e-12)
    want = exact(np.arange(6000), x.astype(float), 5)
    assert set(got) == set(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.97 * 5 * len(want)


def test_copies_tie_to_smaller_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(1000 + i, [float(i), 1.0, -1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [(r.rank, r.vec_id) for r in nearest(df, df.where("vec_id = 100")).orderBy("rank").collect()]
    assert got == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1e300, 1e300]), (7, [1e-300, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("own"), "score": F.lit(1)})
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest(df, df.where("vec_id % 2 = 0")).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0][0][2] in (6, 7) and {g[0] for g in got} == {0, 6}
    assert nearest(df.limit(0), df).count() == 0 and nearest(df, df.limit(0)).count() == 0


def test_beam_codes_are_no_worse_than_greedy_ones():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    m = fit(x, books=4, words=16)
    error = lambda beam: float(((x - m.decode(m.encode(x, beam))) ** 2).sum())
    assert error(8) <= error(1) and isinstance(m, Codebooks)


def test_large_and_small_magnitudes(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, -1e-320]), (4, [3.0, 4.0]), (5, [1e308, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 12)) for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    half = round(0.5**0.5, 12)
    assert [g[0] for g in got[:2]] == [1, 4] and sorted(got[2:4]) == [(2, half), (5, half)] and got[4] == (3, -half) and got[0][1] == 1.0
    x = np.random.default_rng(1).standard_normal((50, 8))
    plain = (x[0] * x).sum(1) / (np.sqrt((x[0] * x[0]).sum()) * np.sqrt((x * x).sum(1)))
    assert np.allclose(cosines(x[0], x), plain, rtol=0, atol=4e-16)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    """Against brute force over all embeddings."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toArrow()
    ids, raw = table.column("vec_id").to_numpy(), table.column("embedding").to_pylist()
    fine = np.array([v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in raw])
    ids, x = ids[fine], np.array([v for v, ok in zip(raw, fine, strict=True) if ok], float)
    want = exact(ids, x, 5)
    got = {}
    for r in op8_additive_quantisation(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    at = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == pytest.approx(float(cosines(x[at[q]], x[at[v]])), abs=1e-12) for v, s in found)
    print(sf, sum(len({v for v, _ in got[q]} & set(want[q])) for q in want) / 5 / len(want))
    assert sum(len({v for v, _ in got[q]} & set(want[q])) for q in want) >= 0.95 * 5 * len(want)


def test_a_grid_of_many_places_finds_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.standard_normal(12).tolist()) for i in range(900)], "vec_id long, embedding array<double>").repartition(4)
    one = sorted(map(tuple, nearest(df, df.where("vec_id % 9 = 0")).collect()))
    for name, n in (("BLOCK_ROWS", 50), ("BLOCK_QUERIES", 20), ("PLACE_GROUPS", 2), ("PLACE_BLOCKS", 3)):
        monkeypatch.setattr(ann, name, n)
    assert sorted(map(tuple, nearest(df, df.where("vec_id % 9 = 0")).collect())) == one and len(one) == 500


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (2, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id) for r in nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 1), (3, 2)]
