"""Signed integers of up to 81 digits as canonical text, with arithmetic on limbs of nine digits.

Limbs are longs, least significant first, that all carry the number's sign; a sum of limbs is exact for 9 * 10^9 rows,
and beyond that ANSI mode raises an error instead of a wrong sum.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS, DIGITS = 9, 9
BASE = 10**DIGITS


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it: inside lambdas nothing else shares it."""
    return F.transform(F.array(value), f)[0]


def is_integer_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[+-]?[0-9]+$"), F.lit(False))


def canonical(c: Column) -> Column:
    """Without a plus sign, leading zeros or minus zero; null if it is no integer."""
    digits = F.regexp_replace(F.regexp_replace(c, r"^[+-]", ""), r"^0+(?=[0-9])", "")
    return F.when(is_integer_text(c), F.when(c.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits))


def sign(c: Column) -> Column:
    """-1, 0 or 1 of canonical text."""
    return F.when(c.isNull(), None).when(c == "0", 0).when(c.startswith("-"), -1).otherwise(1)


def magnitude(c: Column) -> Column:
    return F.regexp_replace(c, "^-", "")


def negated(c: Column) -> Column:
    """Canonical text of the negative."""
    return F.when(c == "0", c).when(c.startswith("-"), F.substring(c, 2, 100)).otherwise(F.concat(F.lit("-"), c))


def is_round(c: Column) -> Column:
    """Divisible by 1000; zero is, null isn't."""
    return F.coalesce(F.right(F.concat(F.lit("000"), magnitude(c)), F.lit(3)) == "000", F.lit(False)) & ((c == "0") | (F.length(magnitude(c)) > 3))


def limb(c: Column, k: int) -> Column:
    """Limb k of canonical text, with the number's sign."""
    padded = F.lpad(magnitude(c), LIMBS * DIGITS, "0")
    value = F.substring(padded, (LIMBS - 1 - k) * DIGITS + 1, DIGITS).cast("long")
    return F.when(c.startswith("-"), -value).otherwise(value)


def _carried(limbs: Column) -> Column:
    """struct(carry, digits): limbs from 0 to BASE - 1, most significant first, and what is left over."""
    zero = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<long>").alias("digits"))

    def step(s: Column, x: Column) -> Column:
        total = x + s["carry"]
        low = F.pmod(total, F.lit(BASE).cast("long"))
        return F.struct(F.call_function("div", total - low, F.lit(BASE).cast("long")).alias("carry"), F.concat(F.array(low), s["digits"]).alias("digits"))

    return F.aggregate(limbs, zero, step)


def from_limbs(limbs: Column) -> Column:
    """Canonical text of limbs of any size and sign."""

    def text(s: Column) -> Column:
        top = F.when(s["carry"] != 0, s["carry"].cast("string")).otherwise(F.lit(""))
        digits = F.array_join(F.transform(s["digits"], lambda x: F.lpad(x.cast("string"), DIGITS, "0")), "")
        return F.regexp_replace(F.concat(top, digits), r"^0+(?=[0-9])", "")

    def signed(x: Column) -> Column:
        down = let(_carried(F.transform(x, lambda v: -v)), text)
        return let(_carried(x), lambda up: F.when(up["carry"] >= 0, text(up)).otherwise(F.concat(F.lit("-"), down)))

    return let(limbs, signed)


def sum_of(c: Column, where: Column | None = None) -> Column:
    """Aggregate: the exact sum of canonical texts, as canonical text; 0 of no rows."""
    part = lambda k: limb(c, k) if where is None else F.when(where, limb(c, k))
    sums = [F.coalesce(F.sum(part(k)), F.lit(0).cast("long")) for k in range(LIMBS)]
    # what a long holds needs no arrays, which are slow
    short = (sums[0].between(-(10**18), 10**18)) & (sums[1].between(-BASE, BASE))
    for s in sums[2:]:
        short &= s == 0
    return F.when(short, (sums[1] * F.lit(BASE).cast("long") + sums[0]).cast("string")).otherwise(from_limbs(F.array(*sums)))


def at_most(a: Column, b: Column) -> Column:
    """a <= b for canonical texts that aren't negative: the shorter is the smaller, and of one length text order decides."""
    return (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a <= b))


def times(c: Column, factor: int) -> Column:
    """Limbs, most significant first, of the magnitude times a factor of up to 16 digits: arrays that compare as numbers."""
    zero = F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.array().cast("array<decimal(38,0)>").alias("digits"))
    base = F.lit(BASE).cast("decimal(38,0)")

    def step(s: Column, x: Column) -> Column:
        total = (x.cast("decimal(9,0)") * F.lit(factor).cast("decimal(17,0)") + s["carry"]).cast("decimal(38,0)")
        low = (total % base).cast("decimal(38,0)")
        return F.struct(((total - low).cast("decimal(38,0)") / base).cast("decimal(38,0)").alias("carry"), F.concat(F.array(low), s["digits"]).alias("digits"))

    m = magnitude(c)
    out = F.aggregate(F.array(*[limb(m, k) for k in range(LIMBS)]), zero, step)
    return F.concat(F.array(out["carry"]), out["digits"])


def ratio_at_least(part: Column, whole: Column, threshold: float) -> Column:
    """part / whole >= threshold for positive amounts, compared with the double's exact value: 900/1000 is under 0.9."""
    num, den = float(threshold).as_integer_ratio()
    exact = times(part, den) >= times(whole, num)
    if not (0 <= num < 10**17 and den < 10**17):
        return exact
    # decimals hold the products of up to 18 digits, and are much faster than arrays
    product = lambda c, factor: c.try_cast("decimal(18,0)") * F.lit(Decimal(factor)).cast("decimal(17,0)")
    return F.when((F.length(part) <= 18) & (F.length(whole) <= 18), product(part, den) >= product(whole, num)).otherwise(exact)
