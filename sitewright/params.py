"""Parameters of a call."""

from __future__ import annotations

import math
from dataclasses import dataclass


def fraction(value: str | float) -> float:
    """A number from 0 to 1; anything else, NaN included, is an error."""
    x = float(value)
    if math.isnan(x) or not 0 <= x <= 1:
        raise ValueError(f"{value} is not between 0 and 1")
    return x


@dataclass(frozen=True)
class CallParams:
    min_mapq: int = 20
    min_baseq: int = 20
    min_alt_count: int = 1
    min_alt_fraction: float = 0.0
    max_depth: int = 100_000

    def __post_init__(self) -> None:
        for name in ("min_mapq", "min_baseq"):
            if not 0 <= getattr(self, name) <= 60:
                raise ValueError(f"{name} must be between 0 and 60")
        for name in ("min_alt_count", "max_depth"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        fraction(self.min_alt_fraction)
