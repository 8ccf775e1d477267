"""Column builders of the hash indexes: composite identifiers, buckets, sign bits and vertices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The modulus of composite identifiers and the prime of the sign-bit hash.
MODULUS = 4294967291
SIGN_PRIME = 2147483647
_HALF = 65536
#: The factor that sets projections apart in a seed, and the constants of mt19937 (seeding
#: factor, words between an output and the word that is mixed in, twist, tempering masks).
PLACE_FACTOR = 1315423911
MT_FACTOR = 1812433253
MT_SHIFT = 397
MT_TWIST = 0x9908B0DF
MT_MASKS = (0x9D2C5680, 0xEFC60000)


def composite(hashes: Column, weights: Column) -> Column:
    """sum(weight * (hash mod M)) mod M without overflow: weights are split at 16 bits, so every
    product stays below 2**49."""

    def term(h: Column, r: Column) -> Column:
        h = F.pmod(h, F.lit(MODULUS))
        high, low = F.shiftright(r, 16), F.pmod(r, F.lit(_HALF))
        return F.pmod(F.pmod(high * h, F.lit(MODULUS)) * _HALF + low * h, F.lit(MODULUS))

    return F.aggregate(F.zip_with(hashes, weights, term), F.lit(0).cast("long"), lambda s, x: F.pmod(s + x, F.lit(MODULUS)))


def bucket(identifier: Column, rows: int) -> Column:
    """The hash-table slot of an identifier in a table for ``rows`` rows."""
    return identifier % F.lit(max(1, rows // 4))


def sign_bits(hashes: Column, factors: Column, shifts: Column) -> Column:
    """A pseudo-random bit of each hash: a pure function of the hash and its place."""
    pairs = F.arrays_zip(hashes.alias("h"), factors.alias("a"), shifts.alias("b"))
    prime = F.lit(SIGN_PRIME)
    return F.transform(pairs, lambda p: F.pmod(F.pmod(p["h"], prime) * p["a"] + p["b"], prime) % 2)


def first_outputs(seeds: np.ndarray) -> np.ndarray:
    """The first output of mt19937 for each seed. It depends on three words of the seeded state only, which are
    worked out for all seeds at once."""
    word = seeds.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    kept = {0: word}
    for i in range(1, MT_SHIFT + 1):
        word = (np.uint64(MT_FACTOR) * (word ^ (word >> np.uint64(30))) + np.uint64(i)) & np.uint64(0xFFFFFFFF)
        if i in (1, MT_SHIFT):
            kept[i] = word
    mixed = (kept[0] & np.uint64(0x80000000)) | (kept[1] & np.uint64(0x7FFFFFFF))
    y = kept[MT_SHIFT] ^ (mixed >> np.uint64(1)) ^ np.where(kept[1] & np.uint64(1), np.uint64(MT_TWIST), np.uint64(0))
    y ^= y >> np.uint64(11)
    y ^= (y << np.uint64(7)) & np.uint64(MT_MASKS[0])
    y ^= (y << np.uint64(15)) & np.uint64(MT_MASKS[1])
    return (y ^ (y >> np.uint64(18))) & np.uint64(0xFFFFFFFF)


def twister_bits(hashes: np.ndarray, seed: int) -> np.ndarray:
    """The sign bit of each hash (rows x projections) as the lowest bit of mt19937's first output, seeded by the hash
    and its place: a pure function, so every task finds the same bits without a shared map. Each distinct
    hash of a batch is worked out once."""
    places = np.arange(hashes.shape[1], dtype=np.uint64) * np.uint64(PLACE_FACTOR)
    seeds = (np.uint64(seed) ^ (places & np.uint64(0xFFFFFFFF)) ^ hashes.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
    distinct, at = np.unique(seeds, return_inverse=True)
    return (first_outputs(distinct) & np.uint64(1)).astype(np.int64)[at.reshape(seeds.shape)]


def vertex(bits: Column) -> Column:
    """The cube vertex whose i-th bit is ``bits[i]``."""
    powers = F.transform(bits, lambda b, i: b * F.pow(F.lit(2.0), i).cast("long"))
    return F.aggregate(powers, F.lit(0).cast("long"), lambda s, x: s + x)


def hamming(a: Column, b: Column) -> Column:
    """The number of cube edges between two vertices."""
    return F.bit_count(a.bitwiseXOR(b))
