"""Random draws as data: they depend on the seed and on sizes only, never on the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.hashing import MODULUS, SIGN_PRIME
from .params import CubeParams, LshParams


@dataclass(frozen=True)
class LshDraws:
    """For each table: directions, offsets and weights of its hashes."""

    directions: list[list[list[float]]]
    offsets: list[list[float]]
    weights: list[list[int]]


def lsh_draws(dim: int, p: LshParams) -> LshDraws:
    rng = np.random.default_rng(p.seed)
    weights = rng.integers(1, MODULUS, (p.tables, p.hashes)).tolist()
    directions = rng.standard_normal((p.tables, p.hashes, dim)).tolist()
    offsets = (rng.random((p.tables, p.hashes)) * p.width).tolist()
    return LshDraws(directions, offsets, weights)


@dataclass(frozen=True)
class CubeDraws:
    directions: list[list[float]]
    offsets: list[float]
    factors: list[int]
    shifts: list[int]


def cube_draws(dim: int, p: CubeParams) -> CubeDraws:
    rng = np.random.default_rng(p.seed)
    directions = rng.standard_normal((p.projections, dim)).tolist()
    offsets = (rng.random(p.projections) * p.width).tolist()
    factors = rng.integers(1, SIGN_PRIME, p.projections).tolist()
    shifts = rng.integers(0, SIGN_PRIME, p.projections).tolist()
    return CubeDraws(directions, offsets, factors, shifts)


def uniforms(seed: int, count: int) -> list[float]:
    """The draws that pick centres: one for each, in order."""
    return np.random.default_rng(seed).random(count).tolist()


@dataclass(frozen=True)
class Permutation:
    """Ids in the order of (id * factor + shift) mod prime, which samples without replacement."""

    factor: int
    shift: int
    prime: int = 2147483647


def permutation(seed: int) -> Permutation:
    rng = np.random.default_rng([seed, 7])
    return Permutation(int(rng.integers(1, 2147483647)), int(rng.integers(0, 2147483647)))


def probe_masks(projections: int, probes: int) -> list[int]:
    """The first ``probes`` vertices that a breadth-first walk from vertex 0 visits, flipping bits
    in ascending order. Flipping commutes with any start vertex, so these are masks for all queries."""
    order, seen, at = [0], {0}, 0
    while len(order) < probes and at < len(order):
        for b in range(projections):
            v = order[at] ^ (1 << b)
            if v not in seen:
                seen.add(v)
                order.append(v)
        at += 1
    return order[:probes]
