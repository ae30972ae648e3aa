"""Shapes and settings of tensors and factorizations."""

from __future__ import annotations

from dataclasses import dataclass

TENSOR = "i long, j long, k long"
FACTOR = "idx long, r int"
MASKS = "idx long, m long"
CORE = "r1 int, r2 int, r3 int"
#: Ranks are held as bits of a long.
MOST_RANK = 63
#: Rows of a mask table, of 16 bytes each, up to which it is broadcast; beyond it joins are shuffled.
BROADCAST_ROWS = 2_000_000


@dataclass(frozen=True)
class Dims:
    i: int
    j: int
    k: int

    def __post_init__(self):
        if min(self.i, self.j, self.k) < 1:
            raise ValueError(f"mode lengths must be positive: {self}")

    def __iter__(self):
        return iter((self.i, self.j, self.k))

    @property
    def cells(self) -> int:
        return self.i * self.j * self.k


@dataclass(frozen=True)
class Config:
    """How to factorize. method is cp (rank) or tk (ranks)."""

    dims: Dims
    method: str = "cp"
    rank: int = 0
    ranks: tuple[int, int, int] = (0, 0, 0)
    density: float = 0.01
    core_density: float = 0.0
    seed: int | None = None
    candidates: int = 1
    iterations: int | None = 10
    error_delta: float | None = None
    consecutive: int = 3
    zero_probability: float = 0.9
    most_zeros: float = 0.95

    def __post_init__(self):
        if self.method not in ("cp", "tk"):
            raise ValueError("method must be cp or tk")
        if not all(0 < r <= MOST_RANK for r in self.all_ranks):
            raise ValueError(f"ranks must be from 1 to {MOST_RANK}: {self.all_ranks}")
        for name in ("density", "core_density", "zero_probability", "most_zeros"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if self.iterations is None and self.error_delta is None:
            raise ValueError("give a number of iterations or an error delta")

    @property
    def all_ranks(self) -> tuple[int, int, int]:
        return (self.rank,) * 3 if self.method == "cp" else self.ranks
