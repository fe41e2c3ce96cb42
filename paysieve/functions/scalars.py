"""Scalar building blocks, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import DAY_MS, HALF_LIFE_DAYS

# ECMAScript white space; Java's \s is ASCII only.
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value computed once, however often the body names it: a plain column would be written out anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))




def trimmed(c) -> Column:
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")




def iso_utc(ms) -> Column:
    """ISO-8601 UTC text of epoch milliseconds, in any session time zone."""
    wall = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(col(ms) / 1000).cast("decimal(18,6)"))
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def number_of(text) -> Column:
    """Text to double under ECMAScript's rules: blank is 0, hexadecimal is allowed, anything else odd is null."""
    t = trimmed(text)
    digits = F.lpad(F.substring(t, 3, 64), 64, "0")
    pieces = [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("double") * float(16 ** (8 * (7 - i))) for i in range(8)]
    hexa = pieces[0]
    for p in pieces[1:]:
        hexa = hexa + p
    plain = t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z")
    return (F.when(t == "", F.lit(0.0))
            .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,64}\z"), hexa)
            .when(plain, t.try_cast("double")))


def finite(c) -> Column:
    """The value where it is a finite number, else null."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def usd_value(amount_usd="amount_usd", amount="amount", decimals="asset_decimals") -> Column:
    """Explicit USD if finite, else atomic amount scaled by its decimals (6 by default), else null."""
    scaled = number_of(amount) / F.pow(F.lit(10.0), F.coalesce(col(decimals), F.lit(6.0)))
    return F.coalesce(finite(amount_usd), finite(scaled))


def number_text(c) -> Column:
    """A double in ECMAScript's notation: ``3``, ``0.0005``, ``5e-7``, ``1e+21``."""
    c = col(c).cast("double")
    s = c.cast("string")
    big, small = s.try_cast("decimal(38,16)").cast("string"), s.try_cast("decimal(38,30)")
    # decimals below 1e-6 print in scientific form, so format_string is not usable here
    plain_small = F.concat(F.when(c < 0, "-").otherwise(""), F.lit("0."),
                           F.lpad((F.abs(small) * F.lit("1000000000000000000000000").cast("decimal(25,0)"))
                                  .cast("decimal(38,0)").cast("string"), 24, "0"))
    strip = lambda x: F.regexp_replace(x, r"\.?0+\z", "")
    sci = F.regexp_replace(F.regexp_replace(s, r"\.0E", "E"), r"E(\d)", "e+$1")
    a = F.abs(c)
    return (F.when(a == 0, F.lit("0"))
            .when((a >= 1) & (a < 1e21), F.when(big.contains("."), strip(big)).otherwise(big))
            .when((a >= 1e-6) & (a < 1), strip(plain_small))
            .otherwise(F.replace(sci, F.lit("E"), F.lit("e"))))


def commitment() -> Column:
    """SHA-256 binding network, payee, asset, amount and nonce of a payment row."""
    amount = F.coalesce(F.col("amount"), F.concat(F.lit("usd:"), number_text("amount_usd")), F.lit(""))
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("|", part(F.col("network")), part(F.lower("pay_to")), part(F.lower("asset")),
                              amount, part(F.col("nonce"))), 256)


def json_string(c) -> Column:
    """A JSON string literal with ECMAScript's escapes."""
    s = F.replace(F.replace(col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    esc = s
    for code in range(32):
        esc = F.replace(esc, F.lit(chr(code)), F.lit(named.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(s.rlike(r"[\x00-\x1f]"), esc).otherwise(s), F.lit('"'))


def digest() -> Column:
    """SHA-256 of the key-sorted JSON of all payment fields; absent fields print as ``undefined``."""
    undefined = F.lit("undefined")
    text = lambda c: F.coalesce(json_string(c), undefined)
    num = lambda c: F.coalesce(number_text(c), undefined)
    entries = F.array_sort(F.transform(F.map_entries("metadata"), lambda e: F.concat(
        json_string(e["key"]), F.lit(":"), json_string(e["value"]))))
    metadata = F.when(F.size(entries) > 0, F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))).otherwise(undefined)
    parts = [("amount", text("amount")), ("amount_usd", num("amount_usd")), ("asset", text("asset")),
             ("asset_decimals", num("asset_decimals")), ("description", text("description")), ("metadata", metadata),
             ("network", text("network")), ("nonce", text("nonce")), ("pay_to", text("pay_to")), ("payer", text("payer")),
             ("reason", text("reason")), ("resource_url", text("resource_url")), ("scheme", text("scheme")),
             ("valid_until", text("valid_until"))]
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def redact(c) -> Column:
    c = col(c)
    n = F.length(c)
    return F.when(n <= 8, F.lit("****")).otherwise(
        F.concat(F.substring(c, 1, 4), F.lit("…"), F.right(c, F.lit(2)), F.lit(" ("), n.cast("string"), F.lit(" chars)")))


def decay(event_ms, as_of) -> Column:
    """Weight halving every 90 days; a missing time weighs nothing."""
    age = F.greatest(F.lit(0.0), (col(as_of) - col(event_ms)) / float(DAY_MS))
    return F.when(col(event_ms).isNotNull(), F.pow(F.lit(2.0), -age / float(HALF_LIFE_DAYS))).otherwise(0.0)


def credibility(distinct_payees) -> Column:
    return 0.5 + 0.5 * F.least(F.lit(1.0), F.coalesce(col(distinct_payees), F.lit(0)) / 10.0)


def smoothed_rate(delivered, total, prior_rate: float = 0.9, prior_strength: float = 10.0) -> Column:
    return (col(delivered) + prior_rate * prior_strength) / (col(total) + prior_strength)


def classify_delivery(status) -> Column:
    return F.when(col(status).between(200, 299), "delivered").otherwise("not_delivered")


def risk_grade(score) -> Column:
    return (F.when(col(score) >= 2.5, "high").when(col(score) >= 1.0, "medium")
            .when(col(score) > 0.1, "low").otherwise("none"))


def verdict_rank(c) -> Column:
    return F.when(col(c) == "block", 2).when(col(c) == "flag", 1).otherwise(0)


def verdict_name(rank) -> Column:
    return F.when(col(rank) == 2, "block").when(col(rank) == 1, "flag").otherwise("allow")


def severity_score(c) -> Column:
    c = col(c)
    return (F.when(c == "critical", 95).when(c == "high", 70).when(c == "medium", 40).when(c == "low", 15).otherwise(0))


def advisory(direction, verdict) -> Column:
    """Advice by direction and verdict."""
    out, v = col(direction) == "outgoing", col(verdict)
    return (F.when(v == "allow", "No issue was found. The result is advice; settling stays with the wallet.")
            .when((v == "flag") & out, "Review the flagged checks and confirm the intent before settling.")
            .when(v == "flag", "Review the flagged checks and verify the counterparty before acting on this request.")
            .when(out, "Do not settle this payment: a check found signs of theft or leakage.")
            .otherwise("Do not comply with this payment request: a check found signs of fraud."))
