"""Reading payment requests, offers and signed authorisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import ORIGINS, PHASES
from ..functions.scalars import number_text
from ..operators.rowlocal import _is
from ..schemas import conform

# Field clips of a request.
CLIPS = {"scheme": 100, "network": 100, "asset": 200, "pay_to": 200, "payer": 200, "resource_url": 2000, "description": 10_000,
         "reason": 10_000, "nonce": 500, "valid_until": 100}
UNSAFE_KEYS = ("__proto__", "constructor", "prototype")


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _str(v: Column, limit: int | None = None) -> Column:
    s = F.when(_is(v, "string"), F.try_variant_get(v, "$", "string"))
    return s if limit is None else F.substring(s, 1, limit)


def _num(v: Column) -> Column:
    n = F.when(_is(v, "number"), F.try_variant_get(v, "$", "double"))
    return F.when(F.abs(n) < float("inf"), n)


def _true(v: Column) -> Column:
    return F.coalesce((F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def coerce_payments(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(payments, rejects) of JSON requests: strings are clipped, mistyped fields dropped, odd origins read as unknown.

    Other columns of ``df`` (seq, scan_id, ms, direction, account_hash) are kept. A request without a payment object is rejected.
    """
    d = df.withColumn("_v", F.try_parse_json(raw)).withColumn("_p", _get(F.col("_v"), "$.payment"))
    ok = _is(F.col("_v"), "object") & _is(F.col("_p"), "object")
    v, p = F.col("_v"), F.col("_p")
    pget = lambda n: _get(p, f"$.{n}")
    amount = F.when(_is(pget("amount"), "string"), _str(pget("amount"), 100)).when(
        _is(pget("amount"), "number"), number_text(F.try_variant_get(pget("amount"), "$", "double")))
    entries = F.map_entries(F.when(_is(pget("metadata"), "object"), F.try_variant_get(pget("metadata"), "$", "map<string,variant>")))
    kept = F.filter(entries, lambda e: _is(e["value"], "string") & ~e["key"].isin(*UNSAFE_KEYS))
    clipped = F.transform(kept, lambda e: F.struct(F.substring(e["key"], 1, 200).alias("key"),
                                                   F.substring(F.try_variant_get(e["value"], "$", "string"), 1, 10_000).alias("value")))
    # clipping may make two keys equal; the later one wins
    last = F.filter(clipped, lambda e, i: ~F.exists(F.slice(clipped, i + 2, F.greatest(F.size(clipped) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"]))
    origin = _get(v, "$.context.origin")
    text = _str(origin)
    cols = {
        "agent_id": _str(_get(v, "$.agent_id"), 200), **{n: _str(pget(n), c) for n, c in CLIPS.items()}, "amount": amount,
        "amount_usd": _num(pget("amount_usd")), "asset_decimals": _num(pget("asset_decimals")),
        "metadata": F.when(F.size(last) > 0, F.map_from_entries(last)), "expected_price_usd": _num(_get(v, "$.expected_price_usd")),
        "origin": F.when(text.isin(*ORIGINS), text).when(origin.isNotNull(), "unknown"),
        "content": _str(_get(v, "$.context.content"), 200_000), "content_source_url": _str(_get(v, "$.context.content_source_url"), 2000),
        "phase": F.when(_str(_get(v, "$.context.phase")).isin(*PHASES), _str(_get(v, "$.context.phase"))),
        "offer": _str(_get(v, "$.context.offer"), 200_000),
        "force_deep": _true(_get(v, "$.policy.force_deep")), "skip_deep": _true(_get(v, "$.policy.skip_deep"))}
    good = d.filter(F.coalesce(ok, F.lit(False))).withColumns(cols).drop("_v", "_p", raw)
    return conform(good), d.filter(~F.coalesce(ok, F.lit(False))).select(*df.columns)


def read_payments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(payments, rejects) of JSON lines. ``seq, scan_id, ms, direction, account_hash`` come from the envelope's members of these names."""
    raw = spark.read.text(path).withColumnRenamed("value", "raw")
    v = F.try_parse_json("raw")
    env = raw.withColumns({"seq": F.try_variant_get(v, "$.seq", "bigint"), "scan_id": F.try_variant_get(v, "$.scan_id", "string"),
                           "ms": F.try_variant_get(v, "$.ms", "bigint"), "direction": F.try_variant_get(v, "$.direction", "string"),
                           "account_hash": F.try_variant_get(v, "$.account_hash", "string")})
    return coerce_payments(env)


def payments_from_offers(df: DataFrame, entry: str = "entry", request_url: str = "request_url") -> DataFrame:
    """Payment fields of HTTP-402 offer entries (JSON objects)."""
    v = F.try_parse_json(entry)
    s = lambda n: F.nullif(_str(_get(v, f"$.{n}")), F.lit(""))
    most = _get(v, "$.maxAmountRequired")
    amount = F.coalesce(s("maxAmountRequired"), s("amount"), F.when(_is(most, "number"), number_text(F.try_variant_get(most, "$", "double"))))
    return df.withColumns({"scheme": s("scheme"), "network": s("network"), "asset": s("asset"), "amount": amount,
                           "asset_decimals": _num(_get(v, "$.extra.decimals")), "pay_to": F.coalesce(s("payTo"), s("pay_to")),
                           "resource_url": F.coalesce(s("resource"), F.col(request_url)), "description": s("description")})


def payments_from_authorizations(df: DataFrame, typed: str = "typed") -> tuple[DataFrame, DataFrame]:
    """(payments, unrecognised) of typed-data payloads: transfer or receive with authorisation, and permit."""
    v = F.try_parse_json(typed)

    def s(path):
        x = _get(v, path)
        return F.when(_is(x, "string"), F.try_variant_get(x, "$", "string")).when(
            _is(x, "number"), F.try_variant_get(x, "$", "string")).otherwise("")

    kind = s("$.primaryType")
    transfer, permit = kind.isin("TransferWithAuthorization", "ReceiveWithAuthorization"), kind == "Permit"
    chain = s("$.domain.chainId")
    pick = lambda a, b: F.when(transfer, s(f"$.message.{a}")).otherwise(s(f"$.message.{b}"))
    d = df.withColumn("primary_type", kind)
    known = F.coalesce(transfer | permit, F.lit(False))
    contract = _get(v, "$.domain.verifyingContract")
    good = d.filter(known).withColumns({
        "network": F.when(chain != "", F.concat(F.lit("eip155:"), chain)).otherwise(""),
        "asset": F.coalesce(_str(contract), F.lit("")), "pay_to": pick("to", "spender"), "payer": pick("from", "owner"),
        "amount": s("$.message.value"), "nonce": s("$.message.nonce")})
    return good, d.filter(~known)
