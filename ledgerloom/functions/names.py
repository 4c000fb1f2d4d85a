"""Texts that are sent in fewer bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(name: Column) -> Column:
    """A text as binary, hexadecimal digits in half their bytes: different for different texts, and whole() undoes it."""
    return F.when(name.rlike(r"\A([0-9a-f]{2})+\z"), F.concat(F.lit(b"\x01"), F.unhex(name))).otherwise(F.concat(F.lit(b"\x00"), name.cast("binary")))


def whole(short: Column) -> Column:
    rest = F.substring(short, 2, 1 << 30)
    return F.when(F.substring(short, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
