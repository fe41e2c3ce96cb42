"""Findings: one struct per check, one array per detector, one explode at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SEVERITY_SCORE
from ..functions.scalars import let, severity_score, verdict_name, verdict_rank
from ..schemas import CHECK, CHECKS

# order of the detectors inside one scan
SECTIONS = {name: i * 1000 for i, name in enumerate((
    "pii", "replay", "overpay", "injection", "drift", "freshness", "deep", "tier", "url", "asset", "badlist",
    "poison", "poison_content", "pin", "directory", "rating", "velocity", "reputation", "history", "delivery", "custom"))}


def check(section: str, offset, id_, verdict, severity, details: dict | None = None, implicated=None) -> Column:
    """A finding struct. Text arguments are literals, columns pass through."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    pairs = [x for k, v in (details or {}).items() for x in (F.lit(k), lit(v).cast("string"))]
    dmap = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return F.struct((F.lit(SECTIONS[section]) + lit(offset)).cast("int").alias("ord"), lit(id_).alias("id"),
                    lit(verdict).alias("verdict"), lit(severity).alias("severity"), dmap.alias("details"),
                    (F.lit(None) if implicated is None else lit(implicated)).cast("string").alias("implicated_address")).cast(CHECK)


def none_of() -> Column:
    return F.array().cast(CHECKS)


def collect(*maybe: Column) -> Column:
    """Array of the findings that are present."""
    return F.coalesce(F.array_compact(F.array(*maybe)), none_of()).cast(CHECKS)


def when(cond: Column, finding: Column) -> Column:
    return F.when(cond, finding)


def first_of(*branches: tuple) -> Column:
    """One finding: the first branch whose condition holds; the last branch is the default."""
    out = branches[-1]
    for cond, finding in reversed(branches[:-1]):
        out = F.when(cond, finding).otherwise(out)
    return F.array(out).cast(CHECKS)


def or_clean(findings: Column, clean: Column) -> Column:
    return F.when(F.size(findings) > 0, findings).otherwise(F.array(clean).cast(CHECKS))


def any_block(findings: Column) -> Column:
    return F.exists(findings, lambda c: c["verdict"] == "block")


def explode_checks(df: DataFrame, checks: str = "checks", key: str = "scan_id", *keep: str) -> DataFrame:
    """Long table of findings with their position inside the scan."""
    d = df.select(key, *keep, F.explode(F.col(checks)).alias("c"))
    return d.select(key, *keep, F.col("c.ord").alias("ordinal"), F.col("c.id").alias("check_id"), F.col("c.verdict"),
                    F.col("c.severity"), F.col("c.details"), F.col("c.implicated_address"))


def aggregate_verdicts(checks: DataFrame, key: str = "scan_id") -> DataFrame:
    """Worst verdict, risk score and fired checks per scan from the long table."""
    bad = F.col("verdict") != "allow"
    g = checks.groupBy(key).agg(
        F.max(verdict_rank("verdict")).alias("_rank"), F.max(severity_score("severity")).alias("_score"),
        F.count_if(bad).alias("_bad"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("ordinal", "check_id")))).alias("_fired"))
    return g.select(key, verdict_name("_rank").alias("verdict"), risk_of("_score", "_bad").alias("risk_score"),
                    F.transform("_fired", lambda f: f["check_id"]).alias("fired"))


def risk_of(score, bad) -> Column:
    s, n = (F.col(c) if isinstance(c, str) else c for c in (score, bad))
    return F.when(n > 1, F.least(F.lit(100), s + (n - 1) * 5)).otherwise(s).cast("int")


def fold_verdict(findings: Column) -> dict[str, Column]:
    """The same fold over an array column, without a shuffle: verdict, risk_score, fired. The worst of few values is the first one held."""
    has = lambda part, value: F.coalesce(F.array_contains(findings[part], value), F.lit(False))
    score = F.lit(0)
    for severity, points in sorted(SEVERITY_SCORE.items(), key=lambda x: x[1]):
        score = F.when(has("severity", severity), points).otherwise(score)
    bad = F.filter(findings, lambda c: c["verdict"] != "allow")
    fired = F.sort_array(F.transform(bad, lambda c: F.struct(c["ord"].alias("ord"), c["id"].alias("id"))))
    number = F.size(F.filter(findings["verdict"], lambda v: v != "allow"))
    risk = F.when(findings.isNotNull(), let(F.struct(score.alias("s"), number.alias("n")), lambda x: risk_of(x["s"], x["n"])))
    return {"verdict": F.when(has("verdict", "block"), "block").when(has("verdict", "flag"), "flag").otherwise("allow"),
            "risk_score": risk, "fired": fired["id"]}


def in_order(findings: Column) -> Column:
    """Findings by ``ord``, those of one ``ord`` as they stand. Places are sorted, not findings, so no comparison is written in SQL."""
    places = lambda f: F.sort_array(F.transform(f["ord"], lambda o, i: F.struct(o.alias("o"), i.alias("i"))))
    return let(findings, lambda f: F.transform(places(f), lambda p: F.get(f, p["i"]))).cast(CHECKS)
