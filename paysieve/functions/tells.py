"""Injection tells: weighted phrases in text, their offsets and the distance to address-like tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import patterns as P
from .scalars import col

TELL_ARRAY = "array<struct<id:string,weight:int,idx:int>>"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t") + "'"


def tells_sql(text: str, low: str) -> str:
    """SQL of ``array<struct<id, weight, idx>>`` of the tells present, first match each; idx counts UTF-16 units from 1.

    ``low`` is the lower-cased text. A pattern runs only where the words it needs occur, which is far cheaper to test.
    """
    parts = []
    for tid, weight, rx in P.TELLS:
        find = f"regexp_instr({text}, {sql_text(rx)})"
        if tid in P.TELL_NEEDS:
            need = " AND ".join("(" + " OR ".join(f"contains({low}, {sql_text(w)})" for w in group) + ")" for group in P.TELL_NEEDS[tid])
        else:
            need = f"octet_length({text}) > length({text})"
        parts.append(f"named_struct('id', '{tid}', 'weight', {weight}, 'idx', CASE WHEN {need} THEN {find} ELSE 0 END)")
    return f"filter(array({', '.join(parts)}), h -> h.idx > 0)"


def find_tells(text: str) -> Column:
    """Tells of a text column. The lower-cased text is bound to a variable: as a column of its own the optimizer would write it out anew
    for each of the words that are looked for in it."""
    once = f"transform(array(named_struct('text', {text}, 'low', lower({text}))), s -> {tells_sql('s.text', 's.low')})"
    return F.coalesce(F.when(F.length(text) > 0, F.expr(once)[0]), F.array().cast(TELL_ARRAY))


def once(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed before anything that follows: a later filter on them would otherwise be moved below
    the projection and compute them a second time."""
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))


def tell_ids(tells) -> Column:
    return F.transform(col(tells), lambda h: h["id"])


def tell_weight(tells) -> Column:
    return F.aggregate(col(tells), F.lit(0), lambda a, h: a + h["weight"])


def nearest_address(text, tells) -> Column:
    """``struct<distance, tell_id>`` of the tell nearest to an address-like token within 300 units, else null.

    Offsets of all tokens come from the gaps between them, so the text is scanned once and nothing is quadratic.
    """
    text, tells = col(text), col(tells)
    usable = F.filter(tells, lambda h: ~h["id"].isin(*P.PROXIMITY_EXCLUDED))
    tokens = F.regexp_extract_all(text, F.lit(P.ADDRESS_TOKEN), F.lit(0))
    gaps = F.split(text, P.ADDRESS_TOKEN, -1)
    pairs = F.arrays_zip(gaps.alias("gap"), tokens.alias("token"))
    units = lambda s: (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")
    start = F.struct(F.lit(0).alias("pos"), F.lit(None).cast("int").alias("d"), F.lit(None).cast("string").alias("id"))

    def step(acc, pair):
        at = acc["pos"] + units(pair["gap"])
        best = F.array_min(F.transform(usable, lambda h, i: F.struct(
            F.abs(h["idx"] - 1 - at).alias("d"), i.alias("i"), h["id"].alias("id"))))
        better = (best["d"] <= P.PROXIMITY_CHARS) & (acc["d"].isNull() | (best["d"] < acc["d"]))
        return F.struct((at + F.coalesce(F.length(pair["token"]), F.lit(0))).alias("pos"),
                        F.when(better & pair["token"].isNotNull(), best["d"]).otherwise(acc["d"]).alias("d"),
                        F.when(better & pair["token"].isNotNull(), best["id"]).otherwise(acc["id"]).alias("id"))

    folded = F.aggregate(pairs, start, step, lambda a: F.when(
        a["d"].isNotNull(), F.struct(a["d"].alias("distance"), a["id"].alias("tell_id"))))
    return F.when((F.size(usable) > 0) & (F.contains(text, F.lit("0x")) | text.rlike(P.MAY_HEX)), folded)


def tell_score(tells, proximity=None) -> Column:
    s = tell_weight(tells)
    return s if proximity is None else s + F.when(col(proximity).isNotNull(), 2).otherwise(0)


def fresh_tells(raw, decoded) -> Column:
    """Tells of the decoded text that the raw text does not show."""
    return F.array_except(tell_ids(decoded), tell_ids(raw))
