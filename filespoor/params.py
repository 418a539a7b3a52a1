"""Inference parameters."""

from __future__ import annotations

from dataclasses import dataclass

from filespoor import fixed_values as fv

# Weights are kept as whole micro units, so sums are exact in any order and ties
# between strengths can be tested for equality.
MICRO = 1_000_000
# Match weights are applied as whole thousandths, strengths are whole nano units.
MILLI = 1_000
NANO = MICRO * MILLI


@dataclass(frozen=True)
class InferenceParams:
    guess_limit: int = fv.GUESS_LIMIT
    guess_ignore_distance: float = fv.GUESS_IGNORE_DISTANCE
    guess_ignore_min_positive: float = fv.GUESS_IGNORE_MIN_POSITIVE
    guess_relative_ignore_distance: float = fv.GUESS_RELATIVE_IGNORE_DISTANCE
    iteration_min_improvement: float = fv.ITERATION_MIN_IMPROVEMENT
    max_iterations: int = fv.MAX_ITERATIONS
    max_iterations_without_improvement: int = fv.MAX_ITERATIONS_WITHOUT_IMPROVEMENT
    min_assets_per_iteration: int = fv.MIN_ASSETS_PER_ITERATION
    max_assets_per_iteration: int = fv.MAX_ASSETS_PER_ITERATION
    min_absolute_support: float = fv.MIN_ABSOLUTE_SUPPORT
    min_support: float = fv.MIN_SUPPORT
    positive_match_weight: float = fv.POSITIVE_MATCH_WEIGHT
    negative_match_weight: float = fv.NEGATIVE_MATCH_WEIGHT
    failed_asset_weight: float = fv.FAILED_ASSET_WEIGHT

    @property
    def positive_milli(self) -> int:
        return round(self.positive_match_weight * MILLI)

    @property
    def negative_milli(self) -> int:
        return round(self.negative_match_weight * MILLI)

    @property
    def failed_micro(self) -> int:
        return round(self.failed_asset_weight * MICRO)
