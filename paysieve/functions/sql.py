"""The scalar functions and the tells of a text, registered for SQL.

All are SQL functions over built-ins, so a query that calls them is planned as if their bodies stood in it. ``paysieve_tells`` is a
table function, to be joined laterally.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import DAY_MS, HALF_LIFE_DAYS
from . import patterns as P
from .tells import sql_text, tells_sql

_TELLS = tells_sql("s.text", "s.low")
#: name, parameters, what comes back, body
FUNCTIONS = (
    ("paysieve_redact", "secret STRING", "STRING", "CASE WHEN length(secret) <= 8 THEN '****' ELSE concat(substring(secret, 1, 4), '…', right(secret, 2), ' (', length(secret), ' chars)') END"),
    ("paysieve_decay", "event_ms BIGINT, as_of_ms BIGINT", "DOUBLE",
     f"CASE WHEN event_ms IS NULL THEN 0.0D ELSE pow(2.0D, -greatest(0.0D, (as_of_ms - event_ms) / {float(DAY_MS)}D) / {float(HALF_LIFE_DAYS)}D) END"),
    ("paysieve_credibility", "distinct_payees BIGINT", "DOUBLE", "0.5D + 0.5D * least(1.0D, coalesce(distinct_payees, 0) / 10.0D)"),
    ("paysieve_smoothed_rate", "delivered BIGINT, total BIGINT", "DOUBLE", "(delivered + 9.0D) / (total + 10.0D)"),
    ("paysieve_risk_grade", "score DOUBLE", "STRING", "CASE WHEN score >= 2.5 THEN 'high' WHEN score >= 1.0 THEN 'medium' WHEN score > 0.1 THEN 'low' ELSE 'none' END"),
    ("paysieve_delivery", "status INT", "STRING", "CASE WHEN status BETWEEN 200 AND 299 THEN 'delivered' ELSE 'not_delivered' END"),
    ("paysieve_worst", "verdicts ARRAY<STRING>", "STRING", "CASE WHEN array_contains(verdicts, 'block') THEN 'block' WHEN array_contains(verdicts, 'flag') THEN 'flag' ELSE 'allow' END"),
    ("paysieve_strip_invisible", "content STRING", "STRING", f"regexp_replace(content, {sql_text(P.INVISIBLE)}, '')"),
)


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION paysieve_tells(content STRING) RETURNS TABLE(tell_id STRING, weight INT, idx INT) RETURN "
              f"SELECT h.id, h.weight, h.idx FROM (SELECT explode(transform(array(named_struct('text', content, 'low', lower(content))), s -> {_TELLS})[0]) AS h)")
    return [*(f[0] for f in FUNCTIONS), "paysieve_tells"]
