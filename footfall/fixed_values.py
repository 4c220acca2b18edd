"""Names, labels and defaults that results are expected to carry.

Reports and downstream consumers match on these exact strings and numbers, so
they are stated once here, in their natural order, and imported everywhere else.
"""

from datetime import timedelta

# Order states that count as revenue.
REVENUE_STATUSES = ("Complete", "Shipped")

# Inactivity longer than this starts a new session.
SESSION_GAP = timedelta(minutes=30)

# Funnel milestones, shallow to deep.
FUNNEL_STAGES = ("home", "department", "product", "cart", "purchase")

# Label of a session by its deepest milestone, shallow to deep.
DEEPEST_STAGE_LABELS = {
    "home": "Abandoned at Department",
    "department": "Abandoned at Product",
    "product": "Abandoned at Cart",
    "cart": "Abandoned at Checkout",
    "purchase": "Completed Purchase",
}
NO_STAGE_LABEL = "Bounced Immediately"

# Rows of the step report: label and the milestones of which any one is enough.
FUNNEL_STEPS = (
    ("Total Sessions", ()),
    ("Browsed Products", ("department", "product")),
    ("Reached Cart", ("cart",)),
    ("Completed Purchase", ("purchase",)),
)

# Identity resolution outcomes.
STATUS_RESOLVED = "anonymous resolved"
STATUS_AUTHENTICATED = "authenticated"
STATUS_UNRESOLVED = "anonymous unresolved"

# Months after acquisition shown in the retention matrix.
RETENTION_OFFSETS = (0, 1, 2, 3, 6)

# Customer scoring.
SCORE_BUCKETS = 5

# Experiments.
ARM_CONTROL = "control"
ARM_TREATMENT = "treatment"
EXPECTED_SPLIT = (0.5, 0.5)
ALPHA = 0.05
POWER = 0.80
SRM_BROKEN = "ABORT — randomisation broken"
SRM_PASS = "PASS"
DECISION_SHIP = "SHIP"
DECISION_ABORT = "ABORT"
DECISION_INCONCLUSIVE = "INCONCLUSIVE"
DECISION_BLOCKED = "BLOCKED"

# Customer segments.
SEGMENT_COUNT = 4
SEGMENT_SWEEP = (2, 3, 4, 5, 6, 7)
SEGMENT_RESTARTS = 10
SEGMENT_SEED = 42
SEGMENT_SAMPLE = 5000
RFM_FEATURES = ("recency_days", "frequency", "monetary_value")
LABEL_CHAMPIONS = "Champions"
LABEL_PROMISING = "Promising"
LABEL_AT_RISK = "At Risk"
LABEL_LOST = "Lost"
SEGMENT_ACTIONS = {
    "Champions": "Loyalty perks, early product access, referral incentive",
    "Promising": "Targeted upsell, second-category purchase onboarding",
    "At Risk": "Win-back campaign, personalized discount, churn survey",
    "Lost": "Low-cost re-engagement email only — no paid budget",
}
