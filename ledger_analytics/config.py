"""Tunable constants of the analysis, in one immutable object."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from ledger_analytics import fixed_values as fv


@dataclass(frozen=True)
class AnalysisConfig:
    # isolation forest
    n_estimators: int = 200
    contamination: float = 0.05
    max_samples: int = 256
    random_seed: int = 42
    # the log-amount axis is cut into this many equal cells; the forest splits
    # on cell edges, so every score is a lookup by cell
    forest_cells: int = 1 << 16

    # relative size factor
    rsf_threshold: float = 3.0
    rsf_min_vendor_rows: int = 5

    # fuzzy duplicates
    fuzzy_band: int = 1000
    # only pairs with a row at or above the ledger's upper median amount
    fuzzy_material_only: bool = False

    # split invoices
    approval_thresholds: tuple[float, ...] = tuple(fv.APPROVAL_THRESHOLDS)
    split_window_days: int = 7
    split_max_ratio: float = 3.5
    split_similarity: float = 0.15

    # round numbers
    round_thresholds: tuple[float, ...] = tuple(fv.ROUND_THRESHOLDS)
    round_margin: float = 15
    round_rate_limit: float = 0.15

    # description audit
    missing_description_score: int = 60

    # external screening
    sanctions_max_distance: int = 2
    # the distance may also be no more than this share of the vendor name's length
    sanctions_max_ratio: float | None = None
    sanctions_min_entity_tokens: int = 3
    registry_min_jaccard: float = 0.7
    blocked_address_types: tuple[str, ...] = tuple(fv.BLOCKED_ADDRESS_TYPES)

    # ingest: date given to rows whose date cannot be read; None = such rows are rejected
    run_date: dt.date | None = None

    def __post_init__(self) -> None:
        # what the forest brings to the driver is bounded by these
        for name, most in (("forest_cells", 1 << 20), ("n_estimators", 10_000), ("max_samples", 1 << 16)):
            if not 1 <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be 1 to {most}")
