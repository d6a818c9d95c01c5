"""All numbers of detection, overlap and review in one place; each can be overridden per call."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

#: Opportunity types in rule order, and score points by type and component (each row sums to 100).
TYPES = ("LOW_CTR", "PAGE_ONE_NEAR_TOP", "HIGH_IMPRESSIONS_LOW_CLICKS", "PERFORMANCE_DECLINE", "CONTENT_COVERAGE_SIGNAL")
COMPONENTS = ("impressions", "ctr", "position", "trend", "query", "coverage")
WEIGHTS = {
    "LOW_CTR": {"ctr": 35, "impressions": 25, "position": 20, "trend": 10, "query": 10, "coverage": 0},
    "PAGE_ONE_NEAR_TOP": {"position": 35, "impressions": 25, "ctr": 15, "query": 15, "trend": 10, "coverage": 0},
    "HIGH_IMPRESSIONS_LOW_CLICKS": {"impressions": 35, "ctr": 30, "query": 15, "position": 10, "trend": 10, "coverage": 0},
    "PERFORMANCE_DECLINE": {"trend": 40, "impressions": 25, "ctr": 15, "position": 10, "query": 10, "coverage": 0},
    "CONTENT_COVERAGE_SIGNAL": {"coverage": 40, "impressions": 25, "position": 15, "ctr": 10, "trend": 10, "query": 0},
}
#: Typical click-through rate by position, linear in between.
CTR_CURVE = ((1, 0.28), (2, 0.15), (3, 0.11), (4, 0.08), (5, 0.06), (6, 0.05), (7, 0.04), (8, 0.032), (9, 0.028), (10, 0.025), (15, 0.01), (20, 0.006), (50, 0.002))


@dataclass(frozen=True)
class DetectionConfig:
    window_days: int = 28
    min_impressions: int = 200
    low_ctr_ratio: float = 0.6
    low_ctr_max_position: float = 20
    low_ctr_min_impressions: int = 500
    page_one_min_position: float = 4
    page_one_max_position: float = 10
    page_one_min_impressions: int = 300
    high_impressions: int = 5000
    high_impressions_max_ctr: float = 0.015
    min_decline_percent: float = 25
    decline_min_previous_clicks: int = 50
    decline_min_previous_impressions: int = 1000
    position_change_min: float = 1
    min_query_impressions: int = 100
    coverage_min_term_ratio: float = 0.5
    coverage_max_queries: int = 5
    coverage_full_share: float = 0.5
    query_concentration_share: float = 0.5
    top_queries_limit: int = 25
    dismiss_snooze_days: int = 28
    impressions_scale_max: int = 100_000
    trend_full_decline_percent: float = 60
    final_lag_days: int = 3

    def scaled(self) -> DetectionConfig:
        """Thresholds for tables of a few dozen impressions per page and two windows of 14 days."""
        return replace(self, window_days=14, min_impressions=10, low_ctr_min_impressions=15, page_one_min_impressions=12, high_impressions=30, high_impressions_max_ctr=0.05, decline_min_previous_clicks=1, decline_min_previous_impressions=10, min_query_impressions=4, impressions_scale_max=1000)

    def snapshot(self) -> dict:
        """What a detection run stores beside its results."""
        return asdict(self) | {"ctr_curve": [list(x) for x in CTR_CURVE], "weights": WEIGHTS}


@dataclass(frozen=True)
class OverlapConfig:
    n: int = 6
    significant_run: int = 12
    significant_coverage: float = 0.5
    common_min_pages: int = 3
    common_page_ratio: float = 0.3
    max_gap: int = 3
    max_matches: int = 25
    max_other_sources: int = 5
    ttl_minutes: int = 60


@dataclass(frozen=True)
class ReviewConfig:
    evidence_change_ratio: float = 0.3
    min_impressions_baseline: int = 100
    min_clicks_baseline: int = 20
    position_change: float = 2
