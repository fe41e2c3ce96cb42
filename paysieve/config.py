"""Thresholds, plans and enumerations."""

from __future__ import annotations

from dataclasses import dataclass

# Must equal the screened protocol's published defaults and domains.
VERDICTS = ("allow", "flag", "block")
SEVERITY_SCORE = {"info": 0, "low": 15, "medium": 40, "high": 70, "critical": 95}
DIRECTIONS = ("outgoing", "incoming")
ORIGINS = ("planning", "user_instruction", "tool_result", "fetched_content", "unknown")
UNTRUSTED_ORIGINS = ("tool_result", "fetched_content")
PHASES = ("pre_sign", "post_sign")
REPORT_CATEGORIES = ("scam", "non_delivery", "prompt_injection", "overcharge", "impersonation", "replay_abuse", "other")
OUTCOMES = ("delivered", "not_delivered", "partial", "wrong_content")
RATING_LEVELS = ("HIGH", "MEDIUM", "LOW", "VERY_LOW")
CANONICAL_ASSETS = {
    "eip155:1": "0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48",
    "eip155:8453": "0x833589fCD6eDb6E08f4c7C32D4f71b54bdA02913",
    "eip155:84532": "0x036CbD53842c5426634e7929541eC2318f3dCF7e",
    "eip155:137": "0x3c499c542cEF5E3811e1192ce70d8cC03d5c3359",
    "eip155:42161": "0xaf88d065e77c8cC2239327C5EDb3A432268e5831",
}
# plan id, display name, price, days, price per scan, payments/min, USD/hour, first payment USD, force deep, directory check
PLANS = (
    ("pro", "Pro", 4.99, 30, 0.005, 60, 50.0, 5.0, True, True),
    ("scale", "Scale", 19.99, 30, 0.002, 300, 250.0, 25.0, True, True),
)
PLAN_SCHEMA = ("plan_id string, plan_name string, plan_price double, duration_days int, price_per_scan double, "
               "max_payments_per_minute int, max_usd_per_hour double, first_payment_max_usd double, "
               "force_deep boolean, directory_verify boolean")
CEILING_PER_MINUTE, CEILING_USD_PER_HOUR, CEILING_FIRST_PAYMENT = 300, 250.0, 50.0
DEFAULT_PRICE_PER_SCAN = 0.01
HALF_LIFE_DAYS = 90
RISK_HIGH, RISK_MEDIUM, RISK_NOISE = 2.5, 1.0, 0.1
GENESIS_HASH = "0" * 64

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
MINUTE_MS = 60_000


@dataclass(frozen=True)
class ScreenConfig:
    """Defaults of every threshold. Per-account values override them as columns, see ``resolve_config``."""

    overpay_flag_multiple: float = 3.0
    overpay_block_multiple: float = 10.0
    max_payment_usd: float = 10.0
    nonce_ttl_hours: int | None = 24
    max_payments_per_minute: int = 10
    max_usd_per_hour: float = 5.0
    first_payment_max_usd: float = 1.0
    micro_bypass_usd: float = 0.005
    allow_other_assets: bool = False
    pinning: bool = True
    ratings: bool = True
    delivery_min_outcomes: int = 5
    delivery_flag_rate: float = 0.7
    delivery_prior_rate: float = 0.9
    delivery_prior_strength: float = 10.0
    free_calls: int = 100
    approvals_ttl_minutes: int = 10
    approvals_max: int | None = None        # no limit; the screened protocol's table holds 10,000
    # physical: width of the time buckets a hot key is split into, and the bound on fixpoint rounds
    bucket_ms: int = HOUR_MS
    max_rounds: int = 200
