"""Exported ledger snapshots: one JSON document of maps and lists, read in parallel.

The text source cuts the document at every comma, so its files are split like any other text. Two passes follow. The first tells of each
split what it does to a reader who enters it outside or inside a string (strings toggled, brackets opened less closed); running sums over the
splits, one narrow row each, give the state at the start of every split. The second walks each split from that state and emits the entries of
the members. Entries that a split cuts are put together again from their pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.screen import Ledgers
from ..session import Workspace

_REPORT = "struct<address:string,category:string,reason:string,reporter_agent_id:string,evidence_url:string,reported_at:string>"
# exported snapshot: one JSON object of maps; name -> type of the member
SNAPSHOT = {
    "nonces": "map<string,struct<first_seen:string,times_seen:bigint,scan_id:string>>",
    "reports": f"array<{_REPORT}>",
    "disputes": "map<string,array<struct<address:string,statement:string,signature:string,disputed_at:string>>>",
    "keys": "map<string,struct<agent_id:string,created_at:string,plan:string,plan_expires_at:string,first_party:boolean,calls_used:bigint>>",
    "revoked": "map<string,struct<revoked_at:string,reason:string,grace_until:string,successor:string>>",
    "scan_index": "map<string,struct<commitment:string,pay_to:string,domain:string,verdict:string,key_hash:string,at:string,outcome:string>>",
    "outcomes": "map<string,struct<delivered:bigint,not_delivered:bigint,partial:bigint,wrong_content:bigint,receiptless:bigint,"
                "reporters:array<string>,first_at:string,last_at:string>>",
    "outcomes_by_domain": "map<string,struct<delivered:bigint,not_delivered:bigint,partial:bigint,wrong_content:bigint,receiptless:bigint,"
                          "reporters:array<string>,pay_tos:array<string>,first_at:string,last_at:string>>",
    "scan_counts": "map<string,struct<scans:bigint,first_at:string,last_at:string>>",
    "injection_incidents": "map<string,array<struct<address:string,check_id:string,origin:string,observer:string,scan_id:string,at:string>>>",
    "cumulative_spend": "map<string,struct<usd:double,scans:bigint,first_at:string,last_at:string>>",
    "velocity": "map<string,array<struct<t:bigint,usd:double>>>",
    "counterparties": "map<string,array<string>>",
    "pins": "map<string,struct<pay_to:string,first_seen:string,times_seen:bigint,cdp_status:string>>",
    "scout_scores": "map<string,struct<score:double,level:string,flags:array<string>,checked_at:string>>",
    "uptime_ranges": "array<struct<from:string,to:string>>",
}

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\]]', re.S)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)


def _split_effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per split: strings toggled (mod 2), and the change of depth for a reader who enters it outside and inside a string."""
    split, flips, change = None, 0, [0, 0]
    row = lambda: pd.DataFrame([(*split, flips, *change)], columns=["f", "o", "flips", "outside", "inside"])
    for b in batches:
        for value, f, o in zip(b["value"], b["f"], b["o"]):
            if (f, o) != split:
                if split is not None:
                    yield row()
                split, flips, change = (f, o), 0, [0, 0]
            parts = value.replace("\\\\", "").replace('\\"', "").split('"')
            for j, p in enumerate(parts):
                change[(flips + j) & 1] += p.count("{") + p.count("[") - p.count("}") - p.count("]")
            flips = (flips + len(parts) - 1) & 1
    if split is not None:
        yield row()


class _Walker:
    """Walks the comma-separated pieces of one split from the state at its start."""

    def __init__(self, f: str, o: int, in_string: bool, depth: int):
        self.f, self.o, self.in_string, self.depth = f, o, in_string, depth
        self.name, self.last_key, self.n, self.i = None, "", 0, 0
        self.head, self.parts, self.rows = depth > 2 or in_string and depth >= 2, [], []

    def _entry(self, text: str, tail: bool = False) -> None:
        whole = "".join(self.parts) + text
        counts = not self.head and bool(whole.strip())
        self.rows.append((self.f, self.o, self.i, self.name, self.n if counts else None, self.head, tail, whole))
        self.n, self.i, self.head, self.parts = self.n + counts, self.i + 1, False, []

    def feed(self, piece: str) -> None:
        at = start = 0
        if self.in_string:
            end = _STRING_END.match(piece)
            if end:
                at, self.in_string = end.end(), False
                if self.depth == 1:
                    self.last_key = ""
        if not self.in_string:
            for m in _TOKEN.finditer(piece, at):
                c = piece[m.start()]
                if c == '"':
                    if not m.group(1):
                        self.in_string = True
                    elif self.depth == 1:
                        self.last_key = json.loads(m.group(), strict=False)
                elif c in "{[":
                    self.depth += 1
                    if self.depth == 2:
                        self.name, self.n, start = self.last_key, 0, m.end()
                else:
                    if self.depth == 2:
                        self._entry(piece[start:m.start()])
                    self.depth -= 1
        if self.depth == 2 and not self.in_string:
            self._entry(piece[start:])
        elif self.depth >= 2:
            self.parts.append(piece[start:] + ",")

    def close(self) -> None:
        if self.parts:
            self._entry("", True)


_PIECES = "f string, o bigint, i bigint, name string, n bigint, head boolean, tail boolean, text string"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _PIECES.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"n": "Int64"})
    w = None
    for b in batches:
        for value, f, o, in_string, depth in zip(b["value"], b["f"], b["o"], b["in_string"], b["depth"]):
            if w is None or (f, o) != (w.f, w.o):
                if w is not None:
                    w.close()
                    yield frame(w.rows)
                w = _Walker(f, o, bool(in_string), int(depth))
            w.feed(value)
        if w is not None and w.rows:
            yield frame(w.rows)
            w.rows = []
    if w is not None:
        w.close()
        yield frame(w.rows)


def snapshot_entries(spark: SparkSession, path: str, workspace: Workspace | None = None) -> DataFrame:
    """(name, pos, text): every entry of the members that ``SNAPSHOT`` knows, as JSON text, with its place in the member.

    ``path`` is one document: a file, or part files that make it up in order of their names and are cut between entries. One entry (a key with
    its value, or an element of a list) is held in memory at a time. A document whose strings or brackets do not close has no entries.
    """
    ws = workspace or Workspace(spark)
    raw = spark.read.option("lineSep", ",").text(path).select(
        "value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("r"))
    effects = ws.materialize(raw.select("value", "f", "o").mapInPandas(_split_effects, "f string, o bigint, flips int, outside bigint, inside bigint"), "splits")
    before, everything = W.orderBy("f", "o").rowsBetween(W.unboundedPreceding, -1), W.orderBy("f", "o").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    entered = effects.withColumn("in_string", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    change = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    states = entered.select("f", "o", "in_string", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"),
                            ((F.sum(change).over(everything) == 0) & (F.sum("flips").over(everything) % 2 == 0)).alias("closed"))
    states = ws.materialize(states.filter("closed").drop("closed"), "states")
    walked = raw.join(states, ["f", "o"]).sortWithinPartitions("f", "o", "r").select("value", "f", "o", "in_string", "depth").mapInPandas(_walk, _PIECES)
    pieces = ws.materialize(walked, "pieces")

    # entries that go on into later splits: the pieces of one form a run that starts with a piece that continues nothing
    cut = pieces.filter("head or tail")
    runs = cut.select("f", "o", "i", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(W.orderBy("f", "o", "i")).alias("run"))
    part = F.struct("f", "o", "i", "name", "n", "text")
    joined = cut.join(runs, ["f", "o", "i"]).groupBy("run").agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = joined.select(F.col("p")[0].alias("h"), F.concat_ws("", F.transform("p", lambda x: x["text"])).alias("whole")).select(
        "h.f", "h.o", "h.name", "h.n", F.col("whole").alias("text"))
    entries = pieces.filter("not head and not tail").select("f", "o", "name", "n", "text").unionByName(joined)

    # the member of entries that stand in a split before its first member's name
    last = pieces.groupBy("f", "o").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("i"))).alias("name"))
    given = last.select("f", "o", F.last("name", True).over(before).alias("given"))
    named = entries.join(given, ["f", "o"]).select("f", "o", F.coalesce("name", "given").alias("name"), "n", "text")
    named = ws.materialize(named.filter(F.col("n").isNotNull() & F.col("name").isin(list(SNAPSHOT))), "named")
    earlier = named.groupBy("name", "f", "o").agg(F.count("*").alias("k")).select(
        "name", "f", "o", F.coalesce(F.sum("k").over(W.partitionBy("name").orderBy("f", "o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("k"))
    placed = named.join(earlier, ["name", "f", "o"]).select("name", (F.col("k") + F.col("n")).alias("pos"), "text")
    placed.write.partitionBy("name").parquet(f"{ws.path}/entries")
    return spark.read.schema("pos bigint, text string, name string").parquet(f"{ws.path}/entries")


def load_snapshot(spark: SparkSession, path: str, workspace: Workspace | None = None) -> dict[str, DataFrame]:
    """Tables of an exported JSON snapshot: map keys become ``key``, places in a member or in a key's list ``pos``, ISO times stay text.

    Members that are absent, and all members of a document that does not close, are empty tables; entries of another shape are left out.
    """
    entries = snapshot_entries(spark, path, workspace)
    out = {}
    for name, kind in SNAPSHOT.items():
        e, listed = entries.filter(F.col("name") == name), kind.startswith("array")
        value = F.from_json(F.concat(F.lit("[" if listed else "{"), "text", F.lit("]" if listed else "}")), kind)
        if listed:
            out[name] = e.select("pos", F.explode(value).alias("e")).select("pos", "e.*")
        elif kind.startswith("map<string,array"):
            d = e.select(F.explode(value).alias("key", "l")).select("key", F.posexplode("l").alias("pos", "e"))
            out[name] = d.select("key", "pos", "e.*") if "struct" in kind else d.withColumnRenamed("e", "value")
        else:
            out[name] = e.select("pos", F.explode(value).alias("key", "v")).select("pos", "key", "v.*")
    return out


def _ms(c: str) -> Column:
    return F.unix_millis(F.try_to_timestamp(F.col(c)))


def snapshot_ledgers(tables: dict[str, DataFrame]) -> Ledgers:
    """The tables of ``load_snapshot`` as history for ``screen``.

    Known payees carry no time in a snapshot: they count from time 0, in the order of their list. Outcomes are exported as totals, not as the
    reports that ``screen`` reads as of each row, so they are not part of the result.
    """
    t, none = tables, F.lit(-1).cast("bigint")
    spend = F.regexp_extract("key", r"(?s)^(.*)\|([^|]*)$", 1), F.regexp_extract("key", r"(?s)^(.*)\|([^|]*)$", 2)
    return Ledgers(
        pins=t["pins"].select(F.col("key").alias("domain"), "pay_to", _ms("first_seen").alias("ms"), none.alias("seq")),
        counterparties=t["counterparties"].select(F.col("key").alias("agent_key"), F.col("value").alias("pay_to"), F.lit(0).cast("bigint").alias("ms"),
                                                  F.col("pos").cast("bigint").alias("seq")),
        nonces=t["nonces"].select(F.col("key").alias("nonce_key"), _ms("first_seen").alias("ms"), "scan_id", F.col("times_seen").alias("weight")),
        velocity_events=t["velocity"].select(F.col("key").alias("agent_key"), F.col("t").alias("ms"), "usd"),
        spend=t["cumulative_spend"].select(spend[0].alias("agent_key"), spend[1].alias("pay_to_lc"), "usd", "scans", _ms("first_at").alias("first_ms"),
                                           _ms("last_at").alias("last_ms")),
        reports=t["reports"].select("address", "category", F.col("reporter_agent_id").alias("reporter"), _ms("reported_at").alias("reported_ms")),
        incidents=t["injection_incidents"].select("address", "observer", "check_id", "origin", "scan_id", _ms("at").alias("ms")),
        ratings=t["scout_scores"].select(F.col("key").alias("domain"), "level", "score", _ms("checked_at").alias("checked_ms")),
        accounts=t["keys"].select(F.col("key").alias("account_hash"), "plan", _ms("plan_expires_at").alias("plan_expires_ms"), "first_party"),
        scan_index=t["scan_index"].select(F.col("key").alias("scan_id"), "commitment", "pay_to", "domain", "verdict",
                                          F.col("key_hash").alias("account_hash"), _ms("at").alias("ms")),
        scan_counts=t["scan_counts"].select(F.col("key").alias("pay_to"), "scans", _ms("first_at").alias("first_ms"), _ms("last_at").alias("last_ms")))
