"""Table schemas, code maps and rule parameters.

Values in the "fixed values" blocks must equal the original application's for
results to agree; they are stated plainly and in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Schemas (timestamps carry no zone: TimestampNTZType)
# ---------------------------------------------------------------------------

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("transaction_date", T.TimestampNTZType(), False),
    T.StructField("sales_amount", T.LongType(), False),
    T.StructField("service_category", T.StringType(), False),
    T.StructField("modification_count", T.IntegerType(), False),
    T.StructField("additional_payment", T.LongType(), False),
    T.StructField("service_rating", T.DoubleType(), False),
    T.StructField("fee_rate", T.DoubleType(), False),
    T.StructField("transaction_canceled", T.IntegerType(), False),
    T.StructField("cancellation_date", T.TimestampNTZType(), True),
])

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("total_purchase_amount", T.DoubleType(), True),
    T.StructField("customer_segment", T.StringType(), True),
    T.StructField("registration_date", T.TimestampNTZType(), True),
    T.StructField("total_modification_count", T.DoubleType(), True),
    T.StructField("total_additional_payment", T.DoubleType(), True),
])

PREDICTIONS = T.StructType([
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("churn_probability", T.DoubleType(), True),
    T.StructField("risk_level", T.StringType(), True),
])

# Transactions as bound to the driver's tables (FIXTURES.md section 2): numeric
# keys, amounts as double; the quality check verifies these names and types.
BOUND_TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("seller_id", T.LongType()),
    T.StructField("transaction_date", T.TimestampNTZType()),
    T.StructField("sales_amount", T.DoubleType()),
    T.StructField("service_category", T.StringType()),
    T.StructField("modification_count", T.IntegerType()),
    T.StructField("additional_payment", T.DoubleType()),
    T.StructField("service_rating", T.DoubleType()),
    T.StructField("transaction_canceled", T.IntegerType()),
    T.StructField("cancellation_date", T.TimestampNTZType()),
])

# CSV tables as written by the table builder; the two timestamp columns that
# may hold unparseable text are read as strings and converted afterwards.
CSV_SCHEMAS = {"transactions": TRANSACTIONS, "customers": CUSTOMERS, "predictions": PREDICTIONS}

# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's)
# ---------------------------------------------------------------------------

# Feature order of the full model.
FEATURES = [
    "age", "total_spent", "total_orders", "avg_order_value", "last_order_days",
    "support_tickets", "subscription_type_encoded", "customer_type_encoded", "region_encoded",
]
# Feature order of the dashboard model.
DASHBOARD_FEATURES = ["age", "total_spent", "total_orders", "avg_order_value", "last_order_days"]

SUBSCRIPTION_CODES = {"Basic": 0, "Premium": 1, "Enterprise": 2}
SUBSCRIPTION_DEFAULT = 0
REGION_DEFAULT = 5

# Original vocabulary, for tables that carry it.
ORIGINAL_REGION_CODES = {"서울": 0, "경기": 1, "부산": 2, "인천": 3, "대구": 4, "기타": 5}
ORIGINAL_COMPANY_LABEL = "기업"
ORIGINAL_SEGMENT_LABELS = ("일반", "프리미엄", "VIP")
ORIGINAL_RISK_LABELS = ("낮음", "중간", "높음")
ORIGINAL_GAUGE_LABELS = ("낮음", "보통", "높음")

# Vocabulary of the bound tables (FIXTURES.md section 2).
REGION_CODES = {"AFRICA": 0, "AMERICA": 1, "ASIA": 2, "EUROPE": 3}
COMPANY_LABEL = "company"
SEGMENT_LABELS = ("regular", "premium", "VIP")
RISK_LABELS = ("low", "mid", "high")
GAUGE_LABELS = ("low", "medium", "high")
AGE_EDGES = (0, 20, 30, 40, 50, 100)
AGE_LABELS = ("10s", "20s", "30s", "40s", "50s+")
RISK_EDGES = (0.0, 0.3, 0.7, 1.0)
GAUGE_EDGES = (30.0, 70.0)

# Quality-check targets of the table builder.
EXPECTED_TRANSACTION_ROWS = 10000
AMOUNT_RANGE = (1_000_000, 30_000_000)
MOD_CANCEL_CORR_RANGE = (0.5, 0.7)
CANCEL_RATE_RANGE = (0.01, 0.03)


@dataclass(frozen=True)
class RuleRiskParams:
    """Weights of the rule-based churn score, applied in this order."""

    high_mod_threshold: float = 5.0
    high_mod_weight: float = 0.8
    no_payment_weight: float = 0.7
    short_duration_days: int = 30
    short_duration_weight: float = 0.5
    low_rating_threshold: float = 3.0
    low_rating_weight: float = 0.6
    premium_factor: float = 0.2
    premium_segments: tuple = ("premium", "VIP")
    cancellation_weight: float = 0.3


@dataclass(frozen=True)
class ChurnLabelParams:
    """Weights of the churn label rule of the dashboard tables."""

    inactive_days: int = 90
    inactive_weight: float = 0.3
    tickets: int = 5
    tickets_weight: float = 0.2
    few_orders: int = 5
    few_orders_weight: float = 0.2
    low_value_quantile: float = 0.25
    low_value_weight: float = 0.15
    threshold: float = 0.5


@dataclass(frozen=True)
class PropensityParams:
    """Cancel propensity of one transaction: each term is ``x * corr * scale``."""

    base: float = 0.013
    mod_divisor: float = 10.0
    mod_corr: float = 0.6
    mod_scale: float = 0.05
    payment_corr: float = 0.5
    payment_scale: float = 0.03
    rating_top: float = 5.0
    rating_divisor: float = 4.0
    rating_corr: float = 0.55
    rating_scale: float = 0.04
    amount_corr: float = 0.2
    amount_scale: float = 0.01
    lower: float = 0.0
    upper: float = 0.15


@dataclass(frozen=True)
class TreeParams:
    """Decision-tree settings; defaults are the full model's."""

    max_depth: int = 10
    min_leaf: int = 10
    balanced: bool = True
    max_bins: int = 256
    seed: int = 42
    features: tuple = field(default_factory=lambda: tuple(FEATURES))
