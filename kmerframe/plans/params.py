"""Sketch parameters: k-mers of 2k bases, sampled by the 2*subk bases in their middle."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LEAST_SPACE = 4096  # fixed value: dimensions that are kept at least


@dataclass(frozen=True)
class SketchParams:
    """k: half the k-mer length; subk: half the inner length; level: dimensions are cut by 16^level."""

    k: int = 8
    subk: int = 5
    level: int = 2
    seed: str = "seed42"

    def __post_init__(self) -> None:
        if not 2 <= self.k <= 15:
            raise ValueError("k must be from 2 to 15")
        if not self.subk < 8 or self.k < self.subk:
            raise ValueError("subk must be under 8 and at most k")
        if not 0 <= self.level < self.k - 2:
            raise ValueError("level must be from 0 to k - 3")
        if self.subk - self.level < 3:
            raise ValueError("a reduced space of under 4096 dimensions makes codes collide: subk - level must be 3 at least")

    @classmethod
    def for_level(cls, level: int, k: int = 8, seed: str = "seed42") -> SketchParams:
        return cls(k, level + 3, level, seed)

    @property
    def outer(self) -> int:
        return self.k - self.subk

    @property
    def width(self) -> int:
        return 2 * self.k

    @property
    def dims(self) -> int:
        return 16**self.subk

    @property
    def kept(self) -> int:
        return max(16 ** (self.subk - self.level), LEAST_SPACE)

    @property
    def rank_bits(self) -> int:
        return 4 * (self.subk - self.level)

    def permutation(self) -> tuple[np.ndarray, np.ndarray]:
        """Kept dimensions in ascending order and the rank of each; ranks follow the md5 of seed and dimension."""
        return _permutation(self.seed, self.dims, self.kept)


@dataclass(frozen=True)
class GivenPermutation(SketchParams):
    """Parameters whose permutation comes from a file; only its kept part is held."""

    given_dims: bytes = b""
    given_ranks: bytes = b""

    def permutation(self) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.given_dims, np.int64), np.frombuffer(self.given_ranks, np.int64)


@lru_cache(maxsize=8)
def _permutation(seed: str, dims: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
    digests = np.array([hashlib.md5(f"{seed}:{d}".encode()).hexdigest() for d in range(dims)], dtype="S32")
    first = np.argsort(digests, kind="stable")[:kept]
    order = np.argsort(first)
    return first[order].astype(np.int64), order.astype(np.int64)
