"""Detectors that look at one row only. Each takes the payments frame and yields an array of findings.

All of them are projections: the payments table is scanned once and its wide text columns are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CANONICAL_ASSETS, UNTRUSTED_ORIGINS, ScreenConfig
from ..functions import patterns as P, tells as T, text as X
from ..functions.scalars import WS, col, let, number_of, redact, usd_value
from ..functions.urls import with_url_parts
from .checks import check, collect, first_of, none_of, or_clean, when

_PII_SCHEMA = "array<struct<pattern:string,verdict:string,severity:string,match:string,exempt:boolean>>"


# ---------------------------------------------------------------- secrets and personal data

def pii_hits(value) -> Column:
    """``array<struct<pattern, verdict, severity, match, exempt>>`` of one text."""
    value = col(value)
    found = []
    for pid, severity, verdict, rx in P.PII:
        exempt = F.lit(False)
        need = reduce(lambda a, b: a | b, [F.contains(value, F.lit(w)) for w in P.PII_NEEDS[pid]]) if pid in P.PII_NEEDS else None
        if pid == "generic_secret_param":
            every = F.regexp_extract_all(value, F.lit(rx), F.lit(0))
            real = F.get(F.filter(every, lambda m: ~m.rlike(P.ADDRESS_SHAPED_PARAM)), F.lit(0))
            match = F.coalesce(real, F.get(every, F.lit(0)))
            exempt = real.isNull()
        else:
            match = F.regexp_substr(value, F.lit(rx))
            if pid == "credit_card":
                digits = F.regexp_replace(match, "[^0-9]", "")
                match = F.when(F.length(digits).between(13, 19) & F.call_function("luhn_check", digits), match)
        match = match if need is None else F.when(need, match)
        found.append(F.struct(F.lit(pid).alias("pattern"), F.when(exempt, "allow").otherwise(verdict).alias("verdict"),
                              F.when(exempt, "info").otherwise(severity).alias("severity"), match.alias("match"),
                              exempt.alias("exempt")))
    def varied(phrase):
        words = F.split(phrase, WS + "+")
        return F.when(F.size(F.array_distinct(words)) >= F.greatest(F.lit(10), F.floor(F.size(words) * 0.8)), phrase)

    seed = let(F.regexp_substr(value, F.lit(P.SEED_PHRASE)), varied)
    found.append(F.struct(F.lit("seed_phrase").alias("pattern"), F.lit("block").alias("verdict"),
                          F.lit("critical").alias("severity"), seed.alias("match"), F.lit(False).alias("exempt")))
    may = (F.length(value) >= P.LONG_PII) | value.rlike(P.MAY_PII)
    hits = F.filter(F.array(*found).cast(_PII_SCHEMA), lambda h: h["match"].isNotNull())
    return F.when(F.coalesce(may, F.lit(False)), hits).otherwise(F.array().cast(_PII_SCHEMA))


def scan_pii(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Long table of the secrets and personal data in a text column of any table; matches are redacted."""
    d = df.select(*keep, F.explode(pii_hits(text)).alias("h"))
    return d.select(*keep, F.concat(F.lit("pii."), F.col("h.pattern"), F.when(F.col("h.exempt"), "_exempt").otherwise(""))
                    .alias("check_id"), F.col("h.verdict"), F.col("h.severity"), redact("h.match").alias("match"))


def payment_pii() -> Column:
    """Findings over resource URL, description, reason and every metadata value."""
    named = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("resource_url", "description", "reason")]
    meta = F.transform(F.coalesce(F.map_entries("metadata"), F.array().cast("array<struct<key:string,value:string>>")),
                       lambda e: F.struct(F.concat(F.lit("metadata."), e["key"]).alias("field"), e["value"].alias("value")))
    fields = F.filter(F.concat(F.array(*named), meta), lambda f: F.length(f["value"]) > 0)
    hits = F.flatten(F.transform(fields, lambda f, i: F.transform(pii_hits(f["value"]), lambda h, j: F.struct(
        i.alias("i"), j.alias("j"), f["field"].alias("field"), h.alias("h")))))
    def findings(hits):
        real = F.filter(hits, lambda x: ~x["h"]["exempt"])
        found = F.transform(real, lambda x, n: check("pii", n, F.concat(F.lit("pii."), x["h"]["pattern"]), x["h"]["verdict"],
                                                      x["h"]["severity"], {"field": x["field"], "match": redact(x["h"]["match"])}))
        spared = F.transform(F.filter(hits, lambda x: x["h"]["exempt"]), lambda x, n: check(
            "pii", n + 900, F.concat(F.lit("pii."), x["h"]["pattern"], F.lit("_exempt")), "allow", "info",
            {"field": x["field"], "pattern": x["h"]["pattern"]}))
        return F.concat(or_clean(found, check("pii", 0, "pii.clean", "allow", "info")), spared)

    return let(hits, findings)


# ---------------------------------------------------------------- price, asset

def overpayment(cfg: ScreenConfig = ScreenConfig(), usd="usd", expected="expected_price_usd") -> Column:
    usd, expected = col(usd), col(expected)
    ratio = F.when(expected > 0, usd / F.nullif(expected, F.lit(0.0)))
    facts = {"amount_usd": usd, "expected_usd": expected, "ratio": ratio}
    return first_of(
        (usd.isNull(), check("overpay", 0, "overpay.no_amount", "flag", "low")),
        (usd <= 0, check("overpay", 0, "overpay.non_positive", "block", "high", {"amount_usd": usd})),
        (usd > cfg.max_payment_usd, check("overpay", 0, "overpay.absolute_cap", "block", "high",
                                          {"amount_usd": usd, "max_usd": F.lit(cfg.max_payment_usd)})),
        (ratio >= cfg.overpay_block_multiple, check("overpay", 0, "overpay.block_multiple", "block", "high", facts)),
        (ratio >= cfg.overpay_flag_multiple, check("overpay", 0, "overpay.flag_multiple", "flag", "medium", facts)),
        check("overpay", 0, "overpay.clean", "allow", "info"))


def canonical_asset(network) -> Column:
    """Contract of the canonical token of a network (five fixed networks), null elsewhere."""
    table = F.create_map(*[F.lit(x) for kv in CANONICAL_ASSETS.items() for x in kv])
    return F.try_element_at(table, F.coalesce(col(network), F.lit("")))


def asset(allow_other: bool = False) -> Column:
    a, n = F.col("asset"), F.col("network")
    want = canonical_asset("network")
    verdict, severity = ("flag", "medium") if allow_other else ("block", "high")
    return first_of(
        (F.coalesce(a, F.lit("")) == "", check("asset", 0, "asset.not_declared", "allow", "info")),
        (want.isNull(), check("asset", 0, "asset.unknown_network", "flag", "low", {"asset": a, "network": n})),
        (F.lower(a) != F.lower(want), check("asset", 0, "asset.not_canonical_usdc", verdict, severity,
                                            {"asset": a, "expected": want, "network": n})),
        check("asset", 0, "asset.canonical", "allow", "info"))


# ---------------------------------------------------------------- injection, fast tier

def untrusted() -> Column:
    return F.coalesce(F.col("origin").isin(*UNTRUSTED_ORIGINS), F.lit(False))


def with_content_facts(df: DataFrame) -> DataFrame:
    """Columns the injection checks share: tells of content and offer, proximity, payee found in the content."""
    c, low, payee = F.col("content"), F.col("content_low"), F.lower("pay_to")
    d = df.withColumns({"content_low": F.lower("content"), "offer_low": F.lower("offer"), "has_content": F.coalesce(F.length("content") > 0, F.lit(False))})
    usable = F.col("has_content") & (F.length("pay_to") > 0)
    d = d.withColumns({"content_tells": T.find_tells("content"), "offer_tells": T.find_tells("offer"),
                       "payee_direct": F.coalesce(usable & F.contains(low, payee), F.lit(False))})
    return d.withColumns({"content_near": F.when(F.size("content_tells") > 0, T.nearest_address(c, "content_tells")),
                          "payee_hidden": F.when(usable & ~F.col("payee_direct"), F.contains(X.squeeze(low), payee)).otherwise(F.lit(False))})


def provenance(established: Column) -> Column:
    """Origin finding; ``established`` says the payee was pinned to this domain before. Needs ``has_content`` and ``content_clean``."""
    known = F.coalesce(established, F.lit(False))
    origin = F.coalesce(F.col("origin"), F.lit("unknown"))
    facts = {"origin": origin}
    return collect(
        F.when(untrusted() & F.col("has_content") & known & F.col("content_clean"), check(
            "injection", 0, "injection.untrusted_origin_mitigated", "allow", "info", facts))
        .when(untrusted(), check("injection", 0, "injection.untrusted_origin", "flag", "medium", facts))
        .when(origin == "unknown", check("injection", 0, "injection.unknown_origin", "flag", "low")))


def content_findings() -> Column:
    """Tells in the content, payee in the content, tells in the offer."""
    u, payee = untrusted(), F.lower("pay_to")
    score = T.tell_score("content_tells", "content_near")
    escalate = (u & (score >= 2)) | (score >= 3)
    tells = when(F.size("content_tells") > 0, check(
        "injection", 1, "injection.content_tells", F.when(escalate, "block").otherwise("flag"),
        F.when(escalate, "critical").otherwise("medium"),
        {"indicators": F.array_join(T.tell_ids("content_tells"), ","), "score": score,
         "proximity_tell": F.col("content_near.tell_id"), "proximity_distance": F.col("content_near.distance")}))
    hard = u | F.col("payee_hidden")
    planted = when(F.col("payee_direct") | F.col("payee_hidden"), check(
        "injection", 2, "injection.payto_from_content", F.when(hard, "block").otherwise("flag"),
        F.when(hard, "critical").otherwise("high"),
        {"pay_to": F.col("pay_to"), "obfuscated": F.col("payee_hidden")}, payee))
    oscore = T.tell_score("offer_tells")
    offer = when(F.size("offer_tells") > 0, check(
        "injection", 3, "injection.offer_tells", F.when(oscore >= 2, "block").otherwise("flag"),
        F.when(oscore >= 2, "critical").otherwise("medium"),
        {"indicators": F.array_join(T.tell_ids("offer_tells"), ","), "score": oscore}))
    return collect(tells, planted, offer)


def injection(established: Column | None = None) -> Column:
    known = F.lit(False) if established is None else established
    return or_clean(F.concat(provenance(known), content_findings()), check("injection", 0, "injection.clean", "allow", "info"))


def content_clean() -> Column:
    return (F.size("content_tells") == 0) & ~F.col("payee_direct") & ~F.col("payee_hidden")


def with_injection_facts(df: DataFrame) -> DataFrame:
    return with_content_facts(df).withColumn("content_clean", content_clean())


# ---------------------------------------------------------------- injection, deep tier

def _ids(text: str, low: str) -> str:
    return f"transform({T.tells_sql(text, low)}, h -> h.id)"


_EMBEDS = "coalesce(contains(s.low, _payee), false)"
_PAIR = "transform(filter({a}, t -> t IS NOT NULL), t -> named_struct('text', t, 'low', lower(t)))"
_READ = f"named_struct('text', s.text, 'tells', {_ids('s.text', 's.low')}, 'embeds', {_EMBEDS})"
_HIT = "r -> size(r.tells) > 0 OR r.embeds"


def with_deep_findings(df: DataFrame, gate: Column, name: str = "deep_checks") -> DataFrame:
    """Findings of the decoders for rows passing ``gate``. Python sees only rows with something to decode."""
    c, payee, u = F.col("content"), F.lower("pay_to"), untrusted()
    on = gate & (F.length(c) > 0)
    d = df.withColumns({
        "_payee": payee, "_on": on,
        "_plain": F.transform(F.when(on & c.rlike(P.MAY_BASE64) & c.rlike(P.BASE64_LONG_RUN), X.base64_blobs(c)), X.from_base64),
        "_hex": F.transform(F.when(on & c.rlike(P.MAY_HEX), X.hex_blobs(c)), X.from_hex),
        "_v": X.decode_variants(F.when(on & (F.contains(c, F.lit("%")) | F.contains(c, F.lit("&#")) | X.not_ascii(c)), c))})
    family = lambda n, v: f"named_struct('encoding', '{n}', 'text', {v}, 'low', lower({v}))"
    pairs = f"transform(filter(coalesce(_hex, array()), t -> t IS NOT NULL), t -> {family('hex', 't')})"
    d = d.withColumns({
        "_plain": F.expr(_PAIR.format(a="_plain")),
        "_named": F.expr(f"filter(concat({pairs}, array({family('percent(URL)', '_v.percent')}, {family('HTML-entity', '_v.entity')})), n -> n.text IS NOT NULL)"),
        "_sk": F.expr("named_struct('text', _v.skeleton, 'low', lower(_v.skeleton))"),
        "_tg": F.expr("named_struct('text', nullif(_v.tags, ''), 'low', lower(_v.tags))")})
    # base64: when nothing shows and the decoded text is itself base64, it is decoded once more
    d = d.withColumn("_once", F.expr(f"transform(_plain, s -> {_READ})"))
    inner = F.transform("_once", lambda o: F.struct(o.alias("a"), F.when(
        (F.size(o["tells"]) == 0) & ~o["embeds"] & F.trim(o["text"]).rlike(P.BASE64_WHOLE), X.from_base64(F.trim(o["text"]))).alias("t")))
    d = d.withColumn("_twice", inner)
    both = (f"transform(_twice, o -> CASE WHEN o.t IS NULL THEN named_struct('twice', false, 'r', o.a) ELSE named_struct('twice', true, 'r', "
            f"transform(array(named_struct('text', o.t, 'low', lower(o.t))), s -> {_READ})[0]) END)")
    raw = "transform(content_tells, h -> h.id)"
    looked = (f"transform(_named, s -> named_struct('encoding', s.encoding, 'text', s.text, 'tells', array_except({_ids('s.text', 's.low')}, {raw}), "
              f"'embeds', {_EMBEDS} AND NOT coalesce(contains(content_low, _payee), false)))")
    d = d.withColumns({
        "_b64": F.expr(f"get(filter({both}, o -> size(o.r.tells) > 0 OR o.r.embeds), 0)"),
        "_enc": F.expr(f"CASE WHEN _on THEN get(filter({looked}, {_HIT}), 0) END"),
        "_skt": F.expr(f"CASE WHEN _sk.text IS NOT NULL THEN {_ids('_sk.text', '_sk.low')} END"),
        "_tag": F.expr(f"CASE WHEN _tg.text IS NOT NULL THEN named_struct('tells', {_ids('_tg.text', '_tg.low')}, "
                       f"'embeds', coalesce(contains(_tg.low, _payee), false), 'address', _tg.text RLIKE {T.sql_text(P.ADDRESS_TOKEN)}) END")})
    preview = lambda t: F.substring(t, 1, 120)
    hard = lambda embeds: F.when(u | embeds, "block").otherwise("flag")
    b, twice, e, t = F.col("_b64.r"), F.col("_b64.twice"), F.col("_enc"), F.col("_tag")
    raw_visible = F.expr("size(filter(content_tells, h -> h.id <> 'invisible_chars'))")
    findings = collect(
        when(F.col("_b64").isNotNull(), check("deep", 0, "injection.b64_obfuscated", hard(b["embeds"]), "critical",
                                              {"decoded_preview": preview(b["text"]), "indicators": F.array_join(b["tells"], ","),
                                               "double_encoded": twice}, F.when(b["embeds"], payee))),
        when(e.isNotNull(), check("deep", 1, "injection.encoded_content", hard(e["embeds"]), "critical",
                                  {"encoding": e["encoding"], "decoded_preview": preview(e["text"]),
                                   "indicators": F.array_join(e["tells"], ",")}, F.when(e["embeds"], payee))),
        when((F.size(t["tells"]) > 0) | t["embeds"] | t["address"],
             check("deep", 2, "injection.tag_smuggling", "block", "critical",
                   {"decoded_preview": preview(F.col("_tg.text")), "indicators": F.array_join(t["tells"], ",")},
                   F.when(t["embeds"], payee))),
        when(F.size("_skt") > raw_visible, check(
            "deep", 3, "injection.unicode_obfuscated", F.when(u, "block").otherwise("flag"), "critical",
            {"indicators": F.array_join("_skt", ",")})))
    return d.withColumn(name, findings).drop("_payee", "_on", "_plain", "_hex", "_v", "_named", "_sk", "_tg", "_once", "_twice", "_b64", "_enc", "_skt", "_tag")


# ---------------------------------------------------------------- offers

_LEG = "struct<pay_to:string,scheme:string,network:string,asset:string,usd:double>"


def _is(v: Column, *types: str) -> Column:
    """Whether a variant holds one of the named kinds of value."""
    return _kind_in(F.schema_of_variant(v), *types)


def _kind_in(kind: Column, *types: str) -> Column:
    tests = {"string": kind == "STRING", "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"),
             "number": kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "null": kind == "VOID"}
    out = tests[types[0]]
    for t in types[1:]:
        out = out | tests[t]
    return F.coalesce(out, F.lit(False))


def _members(v: Column) -> Column:
    """The members of a JSON object as a map of variants; null for other values."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def _member(members: Column, *names: str) -> Column:
    """First member that is neither missing nor JSON null."""
    found = [F.try_element_at(members, F.lit(n)) for n in names]
    return F.coalesce(*[F.when(~F.is_variant_null(f), f) for f in found])


def _text(v: Column) -> Column:
    return let(v, lambda x: F.when(_is(x, "string"), F.nullif(F.try_variant_get(x, "$", "string"), F.lit(""))))


def _scalar(v: Column, number, string) -> Column:
    """``number`` of a JSON number as double, ``string`` of a JSON string, null for other values; the value and its kind are asked once."""
    def read(x):
        kind = x["kind"]
        return F.when(_kind_in(kind, "number"), number(F.try_variant_get(x["v"], "$", "double"))).when(
            kind == "STRING", string(F.try_variant_get(x["v"], "$", "string")))
    return let(v, lambda x: F.when(x.isNotNull(), let(F.struct(x.alias("v"), F.schema_of_variant(x).alias("kind")), read)))


def _number(v: Column) -> Column:
    """ECMAScript's Number() of a JSON scalar."""
    return _scalar(v, lambda d: d, number_of)


def _finite(c: Column) -> Column:
    return let(c, lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def offer_terms(leg: Column) -> Column:
    """Normalised terms of one offer object (variant): payee, scheme, network, asset, price in USD."""
    def terms(m):
        nested = F.try_variant_get(F.try_element_at(m, F.lit("extra")), "$.decimals", "variant")
        declared = F.coalesce(_member(m, "asset_decimals", "assetDecimals"), let(nested, lambda x: F.when(~F.is_variant_null(x), x)))
        decimals = let(declared, lambda x: F.when(x.isNull(), F.lit(6.0)).otherwise(_number(x)))
        atomic = _finite(_number(_member(m, "maxAmountRequired", "amountRequired", "amount")) / F.pow(F.lit(10.0), _finite(decimals)))
        price = _scalar(_member(m, "price", "price_usd", "priceUsd", "amount_usd", "amountUsd"), _finite,
                        lambda t: _finite(number_of(F.regexp_replace(t, rf"[$,]|{WS}", ""))))
        low = lambda *p: F.lower(_text(_member(m, *p)))
        return F.struct(low("payTo", "pay_to", "payee", "recipient").alias("pay_to"), low("scheme").alias("scheme"),
                        low("network", "chain", "chainId", "chain_id").alias("network"),
                        low("asset", "token", "currency").alias("asset"), F.coalesce(atomic, price).alias("usd")).cast(_LEG)

    return let(_members(leg), terms)


def with_offer_terms(df: DataFrame, offer: str = "offer", name: str = "legs", max_chars: int | None = None) -> DataFrame:
    """All legs of the offer JSON as ``array<struct<pay_to, scheme, network, asset, usd>>``; null when it is not JSON.

    With ``max_chars`` longer offers are not read.
    """
    text = F.col(offer)
    v = F.when((F.length(text) > 0) & (F.lit(True) if max_chars is None else F.length(text) <= max_chars), F.try_parse_json(text))
    arr = lambda x: F.filter(F.try_variant_get(x, "$", "array<variant>"), lambda e: let(
        F.schema_of_variant(e), lambda kind: _kind_in(kind, "object", "array")))

    def legs(o):
        filled = lambda m, k: let(arr(F.try_element_at(m, F.lit(k))), lambda x: F.when(F.size(x) > 0, x))
        inner = let(_members(o), lambda m: F.when(m.isNotNull(), F.coalesce(*[filled(m, k) for k in ("accepts", "offers", "items")], F.array(o))))
        return F.transform(F.coalesce(arr(o), inner), offer_terms)

    return df.withColumn(name, let(v, lambda o: F.when(o.isNotNull(), legs(o))))


def select_offer_leg(legs="legs") -> Column:
    """``struct<terms, legs, matched>``: the leg being settled by network and scheme, else network, else the first."""
    legs, net, scheme = col(legs), F.nullif(F.lower("network"), F.lit("")), F.nullif(F.lower("scheme"), F.lit(""))
    exact = F.get(F.filter(legs, lambda t: (t["network"] == net) & (t["scheme"] == scheme)), F.lit(0))
    by_net = F.get(F.filter(legs, lambda t: t["network"] == net), F.lit(0))
    leg = let(F.coalesce(exact, by_net), lambda m: F.struct(F.coalesce(m, F.get(legs, F.lit(0))).alias("terms"), F.size(legs).alias("legs"),
                                                            (m.isNotNull() | (F.size(legs) == 1)).alias("matched")))
    return F.when(F.size(legs) > 0, leg)


def offer_drift(leg="leg", usd="usd") -> Column:
    leg, usd = col(leg), col(usd)
    t, n = leg["terms"], leg["legs"]
    low = lambda c: F.nullif(F.lower(c), F.lit(""))
    differs = lambda a, b: a.isNotNull() & b.isNotNull() & (a != b)
    ratio = F.when((t["usd"] > 0) & (usd > 0), usd / t["usd"])
    findings = collect(
        when(differs(t["pay_to"], low("pay_to")), check("drift", 0, "drift.pay_to", "flag", "critical",
                                                        {"offer_pay_to": t["pay_to"], "payment_pay_to": low("pay_to")})),
        when(~leg["matched"] & (n > 1), check("drift", 1, "drift.no_matching_leg", "flag", "medium",
                                              {"legs": n, "payment_network": F.col("network"), "payment_scheme": F.col("scheme")})),
        when(differs(t["scheme"], low("scheme")), check(
            "drift", 2, "drift.scheme", "flag", F.when(low("scheme") == "upto", "high").otherwise("medium"),
            {"offer_scheme": t["scheme"], "payment_scheme": low("scheme")})),
        when(differs(t["network"], low("network")) & (n == 1), check(
            "drift", 3, "drift.network", "flag", "medium", {"offer_network": t["network"], "payment_network": low("network")})),
        when(differs(t["asset"], low("asset")), check("drift", 4, "drift.asset", "flag", "medium",
                                                      {"offer_asset": t["asset"], "payment_asset": low("asset")})),
        when((ratio >= 2) | (ratio <= 0.5), check("drift", 5, "drift.price", "flag", F.when(ratio >= 10, "high").otherwise("medium"),
                                                  {"offer_usd": t["usd"], "payment_usd": usd, "ratio": ratio})))
    clean = check("drift", 0, "drift.clean", "allow", "info")
    return F.when(leg.isNull(), none_of()).otherwise(let(findings, lambda f: or_clean(f, clean)))


def freshness(max_chars: int | None = None) -> Column:
    """Advice when the offer sells recency, with the validity field it publishes, if any. With ``max_chars`` longer texts are not read."""
    text = F.concat(F.coalesce("offer", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")), F.lit(" "),
                    F.coalesce("resource_url", F.lit("")))
    claim = F.regexp_substr(text, F.lit(P.FRESHNESS_CLAIM))
    claim = claim if max_chars is None else F.when(F.length(text) <= max_chars, claim)
    return collect(when(claim.isNotNull(), check("freshness", 0, "freshness.claim_advertised", "allow", "info",
                                                 {"claim": claim, "contract_field": F.regexp_substr(text, F.lit(P.FRESHNESS_FIELD))})))


# ---------------------------------------------------------------- URLs

def url_findings(scheme="url_scheme", host="url_host", userinfo="url_userinfo", url="resource_url") -> list[Column]:
    s, h, raw = col(scheme), col(host), col(url)
    given, ok = F.length(raw) > 0, col(scheme).isNotNull()
    ip = h.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}\z") | h.contains(":")
    return [
        when(given & ~ok, check("url", 0, "url.unparseable", "flag", "medium")),
        when(given & ok & (s != "https"), check("url", 1, "url.not_https", "flag", "medium", {"host": h})),
        when(given & ok & ip, check("url", 2, "url.ip_literal", "flag", "high")),
        when(given & ok & (h.startswith("xn--") | h.contains(".xn--")), check("url", 3, "url.punycode", "flag", "high")),
        when(given & ok & h.isin(*P.SHORTENERS), check("url", 4, "url.shortener", "flag", "medium")),
        when(given & ok & col(userinfo), check("url", 5, "url.userinfo", "block", "high"))]


def url_risk() -> Column:
    """Findings of an incoming request; needs the columns of ``with_url_parts``."""
    said = F.concat(F.coalesce("description", F.lit("")), F.lit(" "), F.coalesce("reason", F.lit("")))
    demand = when(said.rlike(P.CREDENTIAL_DEMAND), check("url", 6, "url.credential_demand", "block", "critical"))
    return let(collect(*url_findings(), demand), lambda f: or_clean(f, check("url", 0, "url.clean", "allow", "info")))


def check_url_risk(df: DataFrame, url: str = "url", *keep: str) -> DataFrame:
    """Long table of URL findings for any table with a URL column; clean URLs give ``url.clean``."""
    d = with_url_parts(df, url, "url_")
    found = or_clean(collect(*url_findings(url=url)), check("url", 0, "url.clean", "allow", "info"))
    return d.select(*keep, F.explode(found).alias("c")).select(*keep, F.col("c.id").alias("check_id"), F.col("c.verdict"), F.col("c.severity"))


def with_usd(df: DataFrame) -> DataFrame:
    return df.withColumn("usd", usd_value())


def find_tells(df: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Long table of the tells of a text column, with score and proximity, for any table."""
    d = df.select(*keep, F.col(text).alias("_t")).withColumn("_h", T.find_tells("_t"))
    d = d.withColumn("_n", T.nearest_address("_t", "_h")).withColumn("score", T.tell_score("_h", "_n"))
    # an inner explode would be turned into a filter on the size of the tells, which finds them all a second time
    d = d.select(*keep, "score", F.col("_n.distance").alias("distance"), F.explode_outer("_h").alias("h")).filter("h is not null")
    return d.select(*keep, F.col("h.id").alias("tell_id"), F.col("h.weight").alias("weight"), "score", "distance")
