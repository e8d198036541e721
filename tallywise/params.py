"""Parameters of the scoring rules, the value model and the retention plans."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Results are only comparable when these are kept as they are.
# ---------------------------------------------------------------------------

# Segments in display order.
SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "At-Risk Customers",
    "Lost Customers",
)

# Segment rules, the first that holds decides.
SEGMENT_RULES = (
    ("Champions", "rfm_composite >= 4.0D and R_score >= 4"),
    ("Loyal Customers", "rfm_composite >= 3.0D and rfm_composite < 4.0D and F_score >= 3"),
    (
        "Potential Loyalists",
        "rfm_composite between 2.5D and 3.4D and R_score >= 3 and F_score <= 2",
    ),
    (
        "At-Risk Customers",
        "rfm_composite >= 2.0D and rfm_composite < 3.0D and R_score <= 2"
        " and (F_score >= 2 or M_score >= 3)",
    ),
    ("Lost Customers", "rfm_composite < 2.0D or (R_score = 1 and F_score = 1)"),
)

# Composite score each segment centres on, for customers no rule matches.
SEGMENT_MIDPOINTS = {
    "Champions": 4.5,
    "Loyal Customers": 3.5,
    "Potential Loyalists": 2.95,
    "At-Risk Customers": 2.5,
    "Lost Customers": 1.5,
}

# Upper recency bound in days -> score; anything older scores 1.
RECENCY_BANDS = ((30, 5), (60, 4), (90, 3), (150, 2))

# Orders needed -> score; anything below scores 1.
FREQUENCY_BANDS = ((5, 5), (4, 4), (3, 3), (2, 2))

# Weights of the recency, frequency and monetary scores.
DEFAULT_WEIGHTS = {"R": 0.40, "F": 0.35, "M": 0.25}
COLLAPSE_LIMIT = 0.60
DEFAULT_TOLERANCE = 0.05

# Value model.
GROSS_MARGIN = 0.65
SENSITIVITY_MARGINS = (0.50, 0.60, 0.65, 0.70)
DAYS_PER_YEAR = 365
MAX_YEARLY_ORDERS = 12.0
SAME_DAY_YEARLY_ORDERS = 2.0
MIN_EMPIRICAL_YEARS = 0.5
NO_REPEAT_YEARS = 1.0
MIN_MODEL_YEARS = 0.1
MODEL_YEARS_UNKNOWN = 0.5
HORIZON_YEARS = 2
MODEL_PENALTY = 0.001

# Names of the published tables, in the order of their steps.
PUBLISHED_STAGES = ("customer_base", "rfm_segments", "clv_scores", "clv_sensitivity", "retention_roi")
PUBLISHED_EXPORTS = (
    "01_customer_detail", "02_segment_summary", "03_retention_comparison", "04_clv_sensitivity",
    "05_geographic_summary",
)

# Retention plans.
RETENTION_BUDGET = 180_000.0
ELIGIBLE_MAX_RECENCY_SCORE = 3
UNIFORM_RECOVERY_RATE = 0.08
SHARE_TOLERANCE = 0.01


@dataclass(frozen=True)
class Intervention:
    """What the segmented plan does for one segment and what it expects."""

    segment: str
    description: str
    cost: float
    share: float
    effect: str
    rate: float = 0.0
    base_rate: float = 0.0


INTERVENTIONS = (
    Intervention(
        "Champions", "Loyalty recognition program (no discount)",
        cost=12.0, share=0.02, effect="churn_reduction", rate=0.04, base_rate=0.08,
    ),
    Intervention(
        "Loyal Customers", "Referral incentive program",
        cost=18.0, share=0.15, effect="frequency_uplift", rate=0.15,
    ),
    Intervention(
        "Potential Loyalists", "Second-purchase nudge at day 45 with 10% offer",
        cost=9.0, share=0.35, effect="conversion_to_repeat", rate=0.22,
    ),
    Intervention(
        "At-Risk Customers", "Three-email win-back sequence",
        cost=24.0, share=0.48, effect="recovery_rate", rate=0.28,
    ),
    Intervention(
        "Lost Customers", "No spend — reallocate budget elsewhere",
        cost=0.0, share=0.0, effect="none",
    ),
)

# ---------------------------------------------------------------------------
# Values chosen here.
# ---------------------------------------------------------------------------

# Histogram buckets per doubling of a value, see functions.order_stats.
BUCKETS_PER_OCTAVE = 4096

# Smaller budget that leaves some customers of every large segment unreached.
TIGHT_BUDGET = 18_000.0

# Model parameters used where a query must not depend on a fit.
ILLUSTRATIVE_MODEL = {"r": 0.9, "alpha": 120.0, "a": 0.6, "b": 2.5}

# The same for buyers who come back within days: small alpha, so forecasts reach far.
QUICK_MODEL = {"r": 0.25, "alpha": 4.0, "a": 0.8, "b": 2.4}
