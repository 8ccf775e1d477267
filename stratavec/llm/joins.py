"""Joins that keep one plan at every size of their input.

A sieve is a bit table of fixed size: rows whose keys have no bit are known to have no partner and
stay where they are; only the others are shuffled, and an exact join decides about them. Hot keys,
of which there can only be a few, are broadcast, so that their rows stay where they are, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a sieve: what is broadcast is at most so many rows of two numbers.
SIEVE_WORDS = 1 << 20
#: At most so many keys hold more than this part of all rows.
HOT_KEYS = 256


def _slot(columns: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SIEVE_WORDS * 64))


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """(__word, __bits): the words that hold a bit for any row of ``keys``."""
    slots = keys.select(_slot([F.col(c) for c in columns]).alias("slot"))
    bits = slots.select(F.expr("slot div 64").alias("__word"), F.expr("shiftleft(1L, cast(slot % 64 AS int))").alias("bit"))
    return bits.groupBy("__word").agg(F.bit_or("bit").alias("__bits"))


def sieved(rows: DataFrame, bits: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with column __passes: false only where the keys ``columns`` are certainly not in ``bits``."""
    placed = rows.withColumn("__slot", _slot(list(columns)))
    met = placed.join(F.broadcast(bits), F.expr("__slot div 64") == F.col("__word"), "left")
    passes = F.coalesce(F.expr("shiftright(__bits, cast(__slot % 64 AS int)) & 1L") == 1, F.lit(False))
    return met.withColumn("__passes", passes).drop("__slot", "__word", "__bits")


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", hot_keys: int = HOT_KEYS) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has one row a key with the number of its
    rows in ``size``. ``total`` is the number of rows or more, so fewer than ``hot_keys`` keys have
    over total / hot_keys rows: those are broadcast, and no task gets more than that of one key."""
    limit = total // hot_keys
    hot, cold = table.where(F.col(size) > limit), table.where(F.col(size) <= limit)
    few = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return few.unionByName(others)
