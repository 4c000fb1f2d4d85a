import random
from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import amount as A
from ledgerloom.operators.extract import uint256


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-(10**78) + 1, 10**78 - 1), min_size=1, max_size=40))
def test_sums_are_exact(spark, values):
    df = spark.createDataFrame([(str(v),) for v in values], "a string")
    assert df.agg(A.sum_of(F.col("a")).alias("s")).first().s == str(sum(values))


def test_sum_of_no_rows_is_zero(spark):
    assert spark.createDataFrame([], "a string").agg(A.sum_of(F.col("a")).alias("s")).first().s == "0"


def test_canonical_sign_round(spark):
    rows = [("+5", "5", 1, False), ("-0", "0", 0, True), ("007", "7", 1, False), ("1000", "1000", 1, True), ("-12000", "-12000", -1, True), ("999", "999", 1, False), ("1234", "1234", 1, False), ("5000", "5000", 1, True)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)] + [(98, "x"), (99, None)], "i int, a string").withColumn("c", A.canonical(F.col("a")))
    got = df.orderBy("i").select("c", A.sign(F.col("c")).alias("s"), A.is_round(F.col("c")).alias("r")).collect()
    assert [tuple(g) for g in got[: len(rows)]] == [r[1:] for r in rows]
    assert [tuple(g) for g in got[len(rows) :]] == [(None, None, False)] * 2


def test_ratio_compares_with_the_double_itself(spark):
    r = random.Random(3)
    pairs = [(900, 1000), (901, 1000), (9 * 10**70, 10**71), (9 * 10**69 + 1, 10**70)] + [(r.randrange(1, 10**40), r.randrange(1, 10**40)) for _ in range(50)]
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [x.r for x in df.orderBy("i").select(A.ratio_at_least(F.col("a"), F.col("b"), 0.9).alias("r")).collect()]
    assert got == [Fraction(a, b) >= Fraction(0.9) for a, b in pairs]
    assert got[:3] == [False, True, False]  # nine tenths are under the double 0.9


def test_uint256(spark):
    values = [0, 1, 255, 2**64, 2**128 + 7, 2**256 - 1, 123456789012345678901234567890]
    df = spark.createDataFrame([(i, f"0x{v:064x}") for i, v in enumerate(values)], "i int, h string")
    assert [r.v for r in df.orderBy("i").select(uint256(F.col("h")).alias("v")).collect()] == [str(v) for v in values]


def test_short_amounts_as_long_ones(spark):
    """Sums and ratios at the ends of what longs and decimals hold; arrays are left out where those are enough."""
    sums = [[10**18, 10**18], [-(10**18), 1 - 10**18], [10**18 - 1], [999_999_999] * 3, [-1, 1], [10**9, -(10**9) - 1], [10**17, -(10**18)], [5 * 10**26, -1], [-(10**27), 10**27], [A.BASE**8, 7]]
    rows = spark.createDataFrame([(k, str(v)) for k, vs in enumerate(sums) for v in vs], "k int, v string")
    assert {r.k: int(r.s) for r in rows.groupBy("k").agg(A.sum_of(F.col("v")).alias("s")).collect()} == {k: sum(vs) for k, vs in enumerate(sums)}
    assert {r.s for r in rows.where("k in (4, 8)").groupBy("k").agg(A.sum_of(F.col("v")).alias("s")).collect()} == {"0"}
    pairs = [(9, 10), (8, 10), (10**18 - 1, 10**18 - 1), (9 * 10**17, 10**18), (9 * 10**17 + 1, 10**18), (10**18 - 1, 10**18), (10**30, 10**30), (1, 10**18 - 1), (899999999999999999, 999999999999999999), (900000000000000000, 999999999999999999)]
    for t in (0.9, 0.5, 1.0, 0.0):
        df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string").select("*", A.ratio_at_least(F.col("a"), F.col("b"), t).alias("r"))
        assert [r.r for r in df.collect()] == [Fraction(a, b) >= Fraction(t) for a, b in pairs]
    plan = rows.groupBy("k").agg(A.sum_of(F.col("v")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert ">= -1000000000)" in plan and "decimal(18,0)" in df._jdf.queryExecution().optimizedPlan().toString()
