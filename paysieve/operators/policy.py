"""Spending policy, attestation and authorisation audits, provenance of a payment decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import MINUTE_MS
from ..functions.scalars import iso_utc, trimmed
from ..session import Workspace
from .rowlocal import _is
from .windows import asof_last, previous_value, running_totals, sorted_fold

ATOMIC = "decimal(38,0)"


# ---------------------------------------------------------------- local spending policy

def cumulative_cap(rows: DataFrame, key: str, amount: str, cap: int, workspace: Workspace | None = None) -> DataFrame:
    """Adds ``within_cap``: a row passes when the passed amounts before it plus its own stay within ``cap`` per key.

    Refused rows do not count, so plain running sums are not enough. Running sums accept every row up to the first one that does not
    fit; of the rest, rows larger than what is left are refused, and one ordered pass decides the others with what is left as state.
    Caps below 10^28.
    """
    ws = workspace or Workspace(rows.sparkSession)
    given = rows.select(F.col(key).alias("_k"), "ms", "seq", F.col(amount).cast(ATOMIC).alias("_a")).filter(F.col("_a").between(0, cap))
    run = running_totals(given, ["_k"], {"_sum": F.col("_a")})
    room = F.lit(cap).cast(ATOMIC)
    stop = run.filter(F.col("_sum") > room).groupBy("_k").agg(F.min(F.struct("ms", "seq")).alias("_stop"))
    run = ws.materialize(run.join(stop, "_k", "left").withColumn("_ok", F.col("_stop").isNull() | (F.struct("ms", "seq") < F.col("_stop"))), "cap-run")
    used = run.filter("_ok").groupBy("_k").agg(F.sum("_a").cast(ATOMIC).alias("_used"))
    rest = run.filter(~F.col("_ok")).select("_k", "ms", "seq", "_a").join(used, "_k", "left")
    rest = rest.withColumn("_room", (room - F.coalesce("_used", F.lit(0).cast(ATOMIC))).cast(ATOMIC)).filter(F.col("_a") <= F.col("_room"))

    def fold():
        left = 0

        def step(new, seq, a, free):
            nonlocal left
            if new:
                left = free
            if a <= left:
                left -= a
                return True
            return None
        return step

    late = sorted_fold(rest, ["_k"], ["ms", "seq"], ["seq", "_a", "_room"], fold, "_w").select("seq")
    passed = run.filter("_ok").select("seq").unionByName(late)
    return rows.join(passed.withColumn("_w", F.lit(True)), "seq", "left").withColumn("within_cap", F.coalesce("_w", F.lit(False))).drop("_w")


def check_policy(payments: DataFrame, allowlist: DataFrame | None = None, max_amount: int | None = None, max_total: int | None = None,
                 overrides: DataFrame | None = None, key: str = "agent_key", approved: str | None = None, workspace: Workspace | None = None) -> DataFrame:
    """Adds ``policy_reason``: why a payment is refused, null when it may be signed.

    Recipient allow-list (an override for the payment's commitment admits it), per-payment cap, cumulative cap over
    authorised rows per ``key``. ``approved`` names a boolean column of the verdict gate; unapproved rows are not counted.
    """
    d = payments.withColumn("_payee", F.lower(trimmed(F.coalesce("pay_to", F.lit("")))))
    d = d.withColumn("_atomic", F.when(F.col("amount").rlike(r"^[0-9]+\z"), F.col("amount").try_cast(ATOMIC)))
    if allowlist is not None:
        ok = allowlist.select(F.lower(trimmed("address")).alias("_payee")).distinct().withColumn("_listed", F.lit(True))
        d = d.join(ok, "_payee", "left")
        if overrides is not None:
            o = overrides.select(F.col("commitment").alias("payment_commitment")).distinct().withColumn("_admit", F.lit(True))
            d = d.join(o, "payment_commitment", "left").withColumn("_listed", F.coalesce("_listed", "_admit")).drop("_admit")
        listed = F.coalesce(F.col("_listed"), F.lit(False))
    else:
        listed = F.lit(True)
    capped = max_amount is not None or max_total is not None
    reason = F.when(~listed, "recipient is not on the allow-list")
    if capped:
        reason = reason.when(F.col("_atomic").isNull(), "amount is not a plain integer")
    if max_amount is not None:
        reason = reason.when(F.col("_atomic") > F.lit(max_amount).cast(ATOMIC), "above the per-payment cap")
    d = d.withColumn("policy_reason", reason)
    if max_total is not None:
        ws = workspace or Workspace(payments.sparkSession)
        d = ws.materialize(d, "policy")
        gate = F.col("policy_reason").isNull()
        if approved:
            gate = gate & F.col(approved)
        fits = cumulative_cap(d.filter(gate), key, "_atomic", max_total, ws).select("seq", "within_cap")
        d = d.join(fits, "seq", "left").withColumn("policy_reason", F.coalesce(
            "policy_reason", F.when(~F.col("within_cap"), "above the cumulative cap"))).drop("within_cap")
    return d.drop("_payee", "_atomic", *(["_listed"] if allowlist is not None else []))


# ---------------------------------------------------------------- attestations

def format_attestation(decisions: DataFrame, ttl_seconds: int = 300) -> DataFrame:
    """Adds the attested message and the evidence message of a decision with ``scanned_at, expires_at`` texts and pin evidence."""
    msg = F.concat_ws("|", "scan_id", "direction", "verdict", F.col("risk_score").cast("string"), "scanned_at", "payment_commitment", "expires_at")
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ev = F.concat_ws("|", F.lit("evidence-v1"), "scan_id", "payment_commitment", none("pin_domain"), none("pin_age_seconds"), none("pin_corroboration"))
    d = decisions
    if "scanned_at" not in d.columns:
        d = d.withColumn("scanned_at", iso_utc("ms")).withColumn("expires_at", iso_utc(F.col("ms") + ttl_seconds * 1000))
    return d.withColumn("message", msg).withColumn("evidence_message", ev)


def parse_attestations(att: DataFrame, message: str = "message", evidence: str = "evidence_message") -> DataFrame:
    """Typed fields of the attested message (7 parts) and of an evidence-v1 message (6 parts)."""
    p, e = F.split(message, r"\|", -1), F.split(evidence, r"\|", -1)
    names = ("scan_id", "direction", "verdict", "risk", "scanned_at", "commitment", "expires_at")
    d = att.withColumns({f"att_{n}": F.get(p, F.lit(i)) for i, n in enumerate(names)})
    d = d.withColumn("att_risk", F.col("att_risk").try_cast("double")).withColumn("att_parts", F.size(p))
    v1 = F.get(e, F.lit(0)) == "evidence-v1"
    d = d.withColumns({f"ev_{n}": F.when(v1, F.get(e, F.lit(i + 1))) for i, n in enumerate(("scan_id", "commitment", "domain", "age", "sources"))})
    return d.withColumn("ev_version", F.get(e, F.lit(0))).withColumn("ev_parts", F.size(e))


def audit_attestations(att: DataFrame, scans: DataFrame, payments: DataFrame, as_of: int) -> DataFrame:
    """Adds ``failure``: the first reason an attestation must not be trusted, null when it holds.

    ``att``: scan_id, message, evidence_message, signature_ok, evidence_signature_ok, pin_mirror (JSON text or null);
    ``scans``: the response fields; ``payments``: scan_id with the recomputed ``payment_commitment``.
    """
    s = scans.select("scan_id", F.col("direction").alias("_d"), F.col("verdict").alias("_v"), F.col("risk_score").alias("_r"), F.col("scanned_at").alias("_t"))
    c = payments.select("scan_id", F.col("payment_commitment").alias("_c"))
    d = parse_attestations(att).join(s, "scan_id", "left").join(c, "scan_id", "left")
    eq = lambda a, b: F.coalesce(F.col(a) == b, F.lit(False))
    fields = (eq("att_scan_id", F.col("scan_id")) & eq("att_direction", F.col("_d")) & eq("att_verdict", F.col("_v"))
              & eq("att_risk", F.col("_r").cast("double")) & eq("att_scanned_at", F.col("_t")))
    until = F.unix_millis(F.try_to_timestamp("att_expires_at"))
    has_ev = F.col("evidence_message").isNotNull()
    v1 = has_ev & (F.col("ev_version") == "evidence-v1")
    pinned = v1 & (F.length("ev_domain") > 0)
    mirror = F.try_parse_json("pin_mirror")
    get = lambda p, t: F.try_variant_get(mirror, p, t)
    sources = F.when(F.col("ev_sources").isin("", "none"), F.array().cast("array<string>")).otherwise(F.split("ev_sources", ","))
    same = (_is(mirror, "object") & (F.size(F.json_object_keys("pin_mirror")) == 3) & (get("$.domain", "string") == F.col("ev_domain"))
            & (get("$.age_seconds", "bigint") == F.col("ev_age").try_cast("bigint")) & (get("$.corroboration", "array<string>") == sources))
    mirrored = F.when(F.col("pin_mirror").isNull(), True).when(pinned, F.coalesce(same, F.lit(False))).otherwise(F.trim("pin_mirror") == "null")
    failure = (F.when(~F.coalesce("signature_ok", F.lit(False)), "signature invalid")
               .when(~fields, "message does not match the scan")
               .when(~eq("att_commitment", F.col("_c")), "commitment belongs to another payment")
               .when(F.coalesce(until <= as_of, F.lit(False)), "expired")
               .when(has_ev & ~F.coalesce("evidence_signature_ok", F.lit(False)), "evidence signature invalid")
               .when(v1 & (F.col("ev_parts") != 6), "malformed evidence")
               .when(v1 & ~(eq("ev_scan_id", F.col("scan_id")) & eq("ev_commitment", F.col("att_commitment"))), "evidence belongs to another scan")
               .when(pinned & ~F.col("ev_age").rlike(r"^[0-9]+\z"), "malformed evidence")
               .when(v1 & ~mirrored, "pin mirror differs"))
    return d.withColumn("failure", failure).drop("_d", "_v", "_r", "_t", "_c")


def audit_authorizations(auths: DataFrame, approvals: DataFrame, *, allow_flagged: bool = False, accept_overrides: bool = False,
                         reusable: bool = False, max_age_ms: int | None = None) -> DataFrame:
    """Adds ``violation`` to signed authorisations ``seq, ms, commitment``; null when a live, unused verdict covered it.

    ``approvals``: commitment, ms, seq, verdict, expires_ms. The newest accepted verdict before the signature counts and
    serves one signature.
    """
    v = F.col("verdict")
    ok = (v == "allow") | (F.lit(allow_flagged) & (v == "flag")) | (F.lit(accept_overrides) & (v == "override:allow"))
    until = F.col("expires_ms") if max_age_ms is None else F.least("expires_ms", F.col("ms") + max_age_ms)
    a = approvals.filter(ok).select("commitment", "ms", "seq", F.struct(F.col("seq").alias("id"), until.alias("until")).alias("_a"))
    d = asof_last(auths, a, ["commitment"], "_a")
    first = d.filter(F.col("_a").isNotNull()).groupBy("commitment", F.col("_a.id").alias("_id")).agg(F.min(F.struct("ms", "seq")).alias("_f"))
    d = d.withColumn("_id", F.col("_a.id")).join(first, ["commitment", "_id"], "left")
    lead = F.col("_f.seq") == F.col("seq")
    live = F.col("ms") < F.col("_a.until")
    spent = F.col("_f.ms") < F.col("_a.until")
    why = (F.when(F.col("_a").isNull(), "no accepted verdict")
           .when(F.lit(not reusable) & ~lead & spent, "verdict already used")
           .when(~lead & ~spent, "no accepted verdict")
           .when(~live, "verdict is stale"))
    if reusable:
        why = F.when(F.col("_a").isNull(), "no accepted verdict").when(~live, "verdict is stale")
    return d.withColumn("violation", why).drop("_a", "_id", "_f")


# ---------------------------------------------------------------- provenance

def tag_provenance(payments: DataFrame, observations: DataFrame, ttl_ms: int = 5 * MINUTE_MS, default: str = "unknown") -> DataFrame:
    """Adds ``origin`` and ``observation_seq``: what the agent read or noted since its last payment.

    ``observations``: agent_key, ms, seq (one numbering with payments), kind - tool_result, fetched_content, planning or
    user_instruction. The newest entry counts, once; readings lapse after ``ttl_ms``, notes do not. Texts stay out of the
    time line; join them by ``observation_seq``.
    """
    rows = payments.filter(F.col("agent_key").isNotNull())
    o = observations.select("agent_key", "ms", "seq", F.struct("ms", "seq", "kind").alias("_o"))
    d = asof_last(rows, o, ["agent_key"], "_o", order=("ms", "seq"))
    d = previous_value(d.withColumn("_now", F.struct("ms", "seq")), ["agent_key"], "_now", "_before")
    fresh = F.col("_o").isNotNull() & (F.col("_before").isNull() | (F.struct(F.col("_o.ms"), F.col("_o.seq")) > F.col("_before")))
    note = F.col("_o.kind").isin("planning", "user_instruction")
    use = fresh & (note | (F.col("ms") - F.col("_o.ms") <= ttl_ms))
    d = d.withColumn("origin", F.when(use, F.col("_o.kind")).otherwise(F.lit(default))).withColumn(
        "observation_seq", F.when(use & ~note, F.col("_o.seq"))).drop("_o", "_now", "_before")
    rest = payments.filter(F.col("agent_key").isNull()).withColumn("origin", F.lit(default)).withColumn("observation_seq", F.lit(None).cast("bigint"))
    return d.unionByName(rest)


# ---------------------------------------------------------------- external ratings, trust queries

def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings with a known level, a finite score and at most 12 flags of 64 characters."""
    score = F.when(~F.isnan("score") & (F.abs("score") < float("inf")), F.col("score"))
    flags = F.transform(F.slice(F.filter(F.coalesce("flags", F.array().cast("array<string>")), lambda f: f.isNotNull()), 1, 12), lambda f: F.substring(f, 1, 64))
    return ratings.filter(F.col("level").isin("HIGH", "MEDIUM", "LOW", "VERY_LOW")).withColumn("score", score).withColumn("flags", flags)


def ratings_to_refresh(domains: DataFrame, ratings: DataFrame, as_of: int) -> DataFrame:
    """Domains without a fresh rating: good answers hold a day, failures an hour."""
    last = ratings.groupBy("domain").agg(F.max_by(F.struct("checked_ms", "level"), "checked_ms").alias("r"))
    d = domains.select("domain").distinct().join(last, "domain", "left")
    hold = F.when(F.col("r.level") == "unavailable", 60 * MINUTE_MS).otherwise(24 * 60 * MINUTE_MS)
    return d.filter(F.col("r").isNull() | (F.lit(as_of) - F.col("r.checked_ms") >= hold)).select("domain")


def join_ratings(payments: DataFrame, ratings: DataFrame) -> DataFrame:
    """Adds ``rating_level, rating_score``: the latest rating of the domain at the time of the scan, however old."""
    r = ratings.select("domain", F.col("checked_ms").alias("ms"), F.struct("level", "score").alias("_r"))
    d = asof_last(payments.filter(F.col("domain").isNotNull()), r, ["domain"], "_r")
    d = d.withColumn("rating_level", F.col("_r.level")).withColumn("rating_score", F.col("_r.score")).drop("_r")
    return d.unionByName(payments.filter(F.col("domain").isNull()), allowMissingColumns=True)


def parse_trust_queries(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``wallet`` and ``query_agent`` of a JSON query; both null when it names no subject."""
    v = F.try_parse_json(raw)

    def text(path):
        x = F.try_variant_get(v, path, "variant")
        t = F.when(_is(x, "string"), trimmed(F.try_variant_get(x, "$", "string")))
        return F.when(F.length(t) >= 6, F.lower(t))

    agent = F.try_variant_get(v, "$.payer.agent_id", "variant")
    return df.withColumn("wallet", F.coalesce(text("$.payer.wallet"), text("$.wallet"), text("$.address"))).withColumn(
        "query_agent", F.when(_is(agent, "string"), F.substring(F.try_variant_get(agent, "$", "string"), 1, 200)))


def evaluate_trust(queries: DataFrame, badlist: DataFrame, reputation: DataFrame) -> DataFrame:
    """Adds ``decision, score, reason_code, ttl_seconds``; unknown subjects are never passed, reports never fail one."""
    bad = badlist.select(F.lower("address").alias("wallet")).distinct().withColumn("_bad", F.lit(True))
    rep = reputation.select(F.col("address").alias("wallet"), F.col("risk").alias("_risk"))
    d = queries.join(bad, "wallet", "left").join(rep, "wallet", "left")
    cases = [(F.col("wallet").isNull(), "UNCERTAIN", 50, "NO_WALLET_SUBJECT", 300), (F.col("_bad"), "FAIL", 0, "BADLISTED", 86400),
             (F.col("_risk") == "high", "UNCERTAIN", 15, "REPORTED_HIGH_DENSITY", 3600),
             (F.col("_risk") == "medium", "UNCERTAIN", 35, "REPORTED_MEDIUM_DENSITY", 3600),
             (F.col("_risk") == "low", "PASS", 60, "REPORTED_LOW_DENSITY", 3600)]
    out = F.struct(F.lit("PASS").alias("decision"), F.lit(70).alias("score"), F.lit("NO_ADVERSE_HISTORY").alias("reason_code"), F.lit(3600).alias("ttl_seconds"))
    for cond, decision, score, code, ttl in reversed(cases):
        out = F.when(cond, F.struct(F.lit(decision).alias("decision"), F.lit(score).alias("score"), F.lit(code).alias("reason_code"),
                                    F.lit(ttl).alias("ttl_seconds"))).otherwise(out)
    return d.withColumn("_o", out).select(*queries.columns, "_o.*")
