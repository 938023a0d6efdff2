"""Two named sets of constants: how the scoring was run (`IMPL`) and how it was specified (`SPEC`)."""

from __future__ import annotations

from dataclasses import dataclass

from .schema import FEATURES, SPEC_FEATURES


@dataclass(frozen=True)
class Profile:
    name: str
    trees: int
    features: tuple[str, ...]
    scale: tuple[float, float]        # quantiles that map to 0 and 100
    rate_limit_heavy: float
    long_duration_s: float
    sequence_reduce: str              # how token losses become a session score
    flat: str                         # what a flat score distribution scales to
    top_k: int
    sample: int = 256
    seed: int = 42


IMPL = Profile("impl", 300, FEATURES, (0.01, 0.99), 0.20, 1800.0, "mean", "minmax", 100)
SPEC = Profile("spec", 200, SPEC_FEATURES, (0.50, 0.95), 0.15, 7200.0, "sum", "zero", 200)
