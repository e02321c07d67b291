"""What a scorer is: weights, steepness, bias, thresholds, as one frozen value."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import lexicons as L


@dataclass(frozen=True)
class ScoringSpec:
    version: str = L.SCORER_VERSION
    weights: dict[str, float] = field(default_factory=lambda: {f[0]: f[4] for f in L.FEATURES})
    rates: dict[str, float] = field(default_factory=lambda: {f[0]: f[5] for f in L.FEATURES})
    steepness: float = 1.6
    bias: float = 1.05
    green: float = 0.28
    red: float = 0.60
    margin: float = 0.08
    least_words: int = 25

    def informativeness(self, key: str) -> float:
        rate = self.rates.get(key, 0.5)
        return 1.4 if rate <= 0 else max(0.35, min(1.4, 1 / (0.35 + rate)))


RULES = ScoringSpec()
