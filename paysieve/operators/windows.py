"""Ordered history per key, written so that one hot key never lands in one task.

A key's rows are cut into time buckets; a unit of time (a day, an hour) that holds too many rows of a key is cut into runs of about
equal counts (``crowded_units``). Running values are the sum of what happened inside the bucket and of a carry from the bucket totals,
which are pre-aggregated before they are shuffled. Sliding windows are running sums over
arrivals and expiries, so they need no growing frames: every frame here starts unbounded and costs O(n).
Rows are ordered by (ms, seq); seq is unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..config import DAY_MS, HOUR_MS, MINUTE_MS
from ..functions.scalars import col
from ..session import Workspace

MONEY = "decimal(38,12)"


def money(c) -> Column:
    """Exact fixed-point value for sums that may be taken in any order; beyond ±1e24 it is clamped, far over every limit."""
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(-1e24)), F.lit(1e24))).cast(MONEY)


def spread_null(key, seq="seq") -> Column:
    """A key that is never null: rows without one get a key of their own instead of sharing a group."""
    return F.coalesce(col(key), F.concat(F.lit("\u0000"), col(seq).cast("string")))


#: Rows of a key in one unit of time above which it is cut, and the share of all rows (one in so many) that no uncut unit exceeds.
BUCKET_ROWS, BUCKET_SHARE = 200_000, 1000
#: Cells by which a unit is counted, and room for its parts in the numbers of buckets.
CELLS, PARTS = 3600, 4096


def crowded_units(events: DataFrame, keys: list[str], at: str, unit_ms: int, target: int | None = None) -> DataFrame:
    """Where to cut the crowded units of keys: keys, ``_u`` (the unit) and ``_starts`` (its cells at which a part begins).

    Crowded is a unit with more than ``target`` rows and more than a thousandth of all; there are fewer than a thousand, which bounds
    the broadcast in ``with_bucket``. Counts are pre-aggregated by cell; a unit has 3600 of them, and a part ends with one.
    """
    target = target or BUCKET_ROWS
    cells = events.groupBy(*keys, F.floor(F.col(at) / unit_ms).alias("_u"), F.floor(F.pmod(F.col(at), F.lit(unit_ms)) * CELLS / unit_ms).cast("int").alias("_cell")).agg(F.count("*").alias("_n"))
    units = cells.groupBy(*keys, "_u").agg(F.sum("_n").alias("_all"))
    share = units.agg((F.coalesce(F.sum("_all"), F.lit(0)) / BUCKET_SHARE).alias("n")).scalar()
    crowded = units.filter(F.col("_all") > F.greatest(F.lit(float(target)), share))
    before = W.partitionBy(*keys, "_u").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.greatest(F.lit(float(target)), F.col("_all") / (PARTS - 2)))
    cuts = cells.join(F.broadcast(crowded), [*keys, "_u"]).withColumn("_part", part).groupBy(*keys, "_u", "_part").agg(F.min("_cell").alias("_from"))
    return cuts.groupBy(*keys, "_u").agg(F.array_sort(F.collect_list("_from")).alias("_starts"))


def with_bucket(d: DataFrame, crowded: DataFrame, keys: list[str], at: str, unit_ms: int) -> DataFrame:
    """Adds ``_b``, the number of the bucket of a time: it ascends with time, and equal times of a key have one bucket."""
    cell = F.floor(F.pmod(F.col(at), F.lit(unit_ms)) * CELLS / unit_ms).cast("int")
    d = d.withColumns({"_u": F.floor(F.col(at) / unit_ms), "_cell": cell}).join(F.broadcast(crowded), [*keys, "_u"], "left")
    part = F.coalesce(F.size(F.filter("_starts", lambda s: s <= F.col("_cell"))), F.lit(0))
    return d.withColumn("_b", F.col("_u") * PARTS + F.greatest(part, F.lit(0))).drop("_u", "_cell", "_starts")


def running_totals(rows: DataFrame, keys: list[str], measures: dict[str, Column], *, base: DataFrame | None = None,
                   order: tuple = ("ms", "seq"), bucket: Column | None = None, unit_ms: int | None = None, inclusive: bool = True) -> DataFrame:
    """Adds running sums of ``measures`` per key in ``order``.

    ``base`` holds the same rows before other columns were added; the bucket totals are read from it, so that a chain
    of such steps reads the stored table twice per step and does not recompute the steps before it. With ``unit_ms`` the buckets are
    units of that time, of which crowded ones are cut.
    """
    bucket = F.floor(F.col(order[0]) / HOUR_MS) if bucket is None else bucket
    names, given = list(measures), base if base is not None else rows
    crowded = None if unit_ms is None else crowded_units(given, keys, order[0], unit_ms)

    def prepared(d):
        d = d.withColumn("_b", bucket) if crowded is None else with_bucket(d, crowded, keys, order[0], unit_ms)
        return d.withColumns({f"_m_{n}": c for n, c in measures.items()})

    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = prepared(base if base is not None else rows).groupBy(*keys, "_b").agg(
        *[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in names])
    carry = totals.select(*keys, "_b", *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in names])
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    d = prepared(rows).join(carry, [*keys, "_b"], "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0).cast(dict(d.dtypes)[f"_m_{n}"]))
    d = d.withColumns({n: zero(F.col(f"_c_{n}"), n) + zero(F.sum(f"_m_{n}").over(inside), n) for n in names})
    return d.drop("_b", *[f"_m_{n}" for n in names], *[f"_c_{n}" for n in names])


def previous_value(rows: DataFrame, keys: list[str], value: str, name: str, *, order: tuple = ("ms", "seq"),
                   bucket: Column | None = None) -> DataFrame:
    """The value of the row before, across buckets: lag inside the bucket, else the last value of an earlier bucket."""
    bucket = F.floor(F.col(order[0]) / HOUR_MS) if bucket is None else bucket
    d = rows.withColumn("_b", bucket)
    last = d.groupBy(*keys, "_b").agg(F.max_by(F.col(value), F.struct(*order)).alias("_l"))
    before = W.partitionBy(*keys).orderBy("_b")
    last = last.select(*keys, "_b", F.lag("_l").over(before).alias("_p"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    d = d.join(last, [*keys, "_b"], "left")
    first = F.row_number().over(inside) == 1
    return d.withColumn(name, F.when(first, F.col("_p")).otherwise(F.lag(value).over(inside))).drop("_b", "_p")


# ---------------------------------------------------------------- replay

def replay_counts(rows: DataFrame, *, base: DataFrame | None = None, ttl_hours: int | None = None,
                  workspace: Workspace | None = None, key: str = "nonce_key") -> DataFrame:
    """Adds ``nonce_seen`` (1 on a first sighting), ``nonce_first_ms`` and ``nonce_first_scan``.

    A sighting expires ``ttl_hours`` after the *first* one of its run, not after the last. Keys that live shorter than
    that need only a running count. The longer ones get the start of each run by one ordered pass.
    """
    base = rows if base is None else base
    weight = F.coalesce(F.col("weight"), F.lit(1)).cast("bigint") if "weight" in base.columns else F.lit(1).cast("bigint")
    first = base.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.struct("ms", "seq", "scan_id")).alias("_f"), F.max("ms").alias("_last"))
    runs = None
    if ttl_hours is not None:
        ttl = ttl_hours * HOUR_MS
        runs = _run_starts(base, first, key, ttl, workspace)
    d = rows.withColumn("_k", spread_null(key))
    b = base.withColumn("_k", spread_null(key))
    if runs is None:
        d = running_totals(d, ["_k"], {"nonce_seen": weight}, base=b)
        d = d.join(first.select(key, F.col("_f.ms").alias("nonce_first_ms"), F.col("_f.scan_id").alias("nonce_first_scan")), key, "left")
    else:
        flag = runs.select(F.col("seq").alias("_s"), F.col(key).alias("_rk"), F.lit(1).alias("_start"))
        mark = lambda x: x.join(flag, (x["seq"] == flag["_s"]) & (x[key] == flag["_rk"]), "left").drop("_s", "_rk")
        d = workspace.materialize(running_totals(mark(d), ["_k"], {"_run": F.coalesce(F.col("_start"), F.lit(0))}), "replay-runs")
        d = running_totals(d, ["_k", "_run"], {"nonce_seen": weight})
        start = runs.withColumn("_run", F.row_number().over(W.partitionBy(key).orderBy("ms", "seq")).cast("bigint"))
        d = d.join(start.select(key, "_run", F.col("ms").alias("nonce_first_ms"), F.col("scan_id").alias("nonce_first_scan")),
                   [key, "_run"], "left").drop("_run", "_start")
    return d.drop("_k").withColumn("nonce_seen", F.when(F.col(key).isNotNull(), F.col("nonce_seen")))


def sorted_fold(d: DataFrame, keys: list[str], order: list[str], values: list[str], fold, out: str) -> DataFrame:
    """One pass over each key's rows in order: ``fold()`` gives a function of (is a new key, value columns of the row) -> value or None.

    Returns the key columns, the value columns and ``out`` (boolean) of the rows where the value is not None. A key's rows stream
    through one task whose memory is the fold's state alone, so an unbroken key bounds the time, never the memory.
    """
    cols = [*keys, *values]
    sorted_rows = d.repartition(*keys).sortWithinPartitions(*keys, *order).select(*cols)
    schema = T.StructType([*sorted_rows.schema, T.StructField(out, T.BooleanType())])
    n = len(keys)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        step, last = fold(), None
        for batch in batches:
            lists = [c.to_pylist() for c in batch.columns]
            got = []
            for row in zip(*lists):
                got.append(step(row[:n] != last, *row[n:]))
                last = row[:n]
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.bool_())], names=[*cols, out])
            yield made.filter(pc.is_valid(made.column(len(cols)))) if any(g is None for g in got) else made

    return sorted_rows.mapInArrow(run, schema)


def _run_starts(base, first, key, ttl, workspace):
    """First rows of all runs of keys that outlive the TTL, in one pass over those keys; None when no key does."""
    if workspace is None:
        workspace = Workspace(base.sparkSession)
    long = workspace.materialize(first.filter(F.col("_last") - F.col("_f.ms") > ttl).select(key), "replay-long")
    if long.isEmpty():
        return None

    def fold():
        start = None

        def step(new, ms, seq, scan_id):
            nonlocal start
            if new or ms > start + ttl:
                start = ms
                return True
            return None
        return step

    starts = sorted_fold(base.join(long, key, "left_semi"), [key], ["ms", "seq", "scan_id"], ["ms", "seq", "scan_id"], fold, "_start").drop("_start")
    short = first.join(long, key, "left_anti").select(key, F.col("_f.ms").alias("ms"), F.col("_f.seq").alias("seq"), F.col("_f.scan_id").alias("scan_id"))
    return workspace.materialize(short.unionByName(starts), "replay-starts")


# ---------------------------------------------------------------- velocity

def velocity(rows: DataFrame, *, key: str = "agent_key", amount: str = "usd", member: Column | None = None) -> DataFrame:
    """Adds ``per_minute`` (rows of the key in the last minute, this one included) and ``hour_usd`` (last hour).

    Every member row contributes its arrival and two expiries; one shuffle on (key, hour) and two running sums give both
    windows. What was still alive at the start of an hour equals the expiries in it that began earlier.
    """
    member = (F.lit(True) if member is None else member) & F.col(key).isNotNull()
    usd = F.coalesce(money(amount), F.lit(0).cast(MONEY))
    payload = rows.columns
    zero = F.lit(0).cast(MONEY)

    def event(kind, at, n, value, origin):
        crossed = F.floor(at / HOUR_MS) > F.floor(origin / HOUR_MS)
        return F.struct(F.lit(kind).alias("_kind"), at.alias("_at"), F.lit(n).cast("bigint").alias("_n"), value.cast(MONEY).alias("_usd"),
                        F.when(crossed & (F.lit(n) < 0), 1).otherwise(0).cast("bigint").alias("_old_n"),
                        F.when(crossed & F.lit(kind == 1), -value).otherwise(zero).cast(MONEY).alias("_old_usd"))

    ms = F.col("ms")
    arrival = event(2, ms, 1, usd, ms)
    expiries = [event(0, ms + MINUTE_MS, -1, zero, ms), event(1, ms + HOUR_MS, 0, -usd, ms)]
    d = rows.withColumn("_in", member).withColumn("_k", F.when(F.col("_in"), F.col(key)))
    d = d.withColumn("_k", spread_null("_k"))
    d = d.withColumn("_e", F.explode(F.when(F.col("_in"), F.array(arrival, *expiries)).otherwise(F.array(arrival))))
    own = F.col("_e._kind") == 2
    d = d.select("_k", "_in", F.col("seq").alias("_seq"), F.col("_e.*"), F.floor(F.col("_e._at") / HOUR_MS).alias("_b"),
                 *[F.when(own, F.col(c)).alias(c) for c in payload])
    part = W.partitionBy("_k", "_b")
    upto = part.orderBy("_at", "_kind", "_seq").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_pm", F.sum("_n").over(upto) + F.sum("_old_n").over(part))
    d = d.withColumn("_hu", F.sum("_usd").over(upto) + F.sum("_old_usd").over(part))
    d = d.filter(F.col("_kind") == 2)
    return d.select(*payload, F.when(F.col("_in"), F.col("_pm")).alias("per_minute"),
                    F.when(F.col("_in"), F.col("_hu").cast("double")).alias("hour_usd"))


def prior_spend(rows: DataFrame, *, base: DataFrame | None = None, keys=("agent_key", "pay_to_lc"), amount: str = "usd",
                name: str = "prior_usd", bucket_ms: int = HOUR_MS) -> DataFrame:
    """Adds the USD scanned before this row for its (agent, payee) pair; blocked rows count, non-positive amounts do not."""
    pair = F.when(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull(), F.concat_ws("|", *keys))
    add = lambda d: d.withColumn("_pair", spread_null(pair))
    spent = F.when(F.col(amount) > 0, money(amount)).otherwise(F.lit(0).cast(MONEY))
    d = running_totals(add(rows), ["_pair"], {name: spent}, base=None if base is None else add(base), inclusive=False,
                       bucket=F.floor(F.col("ms") / bucket_ms))
    return d.withColumn(name, F.col(name).cast("double")).drop("_pair")


# ---------------------------------------------------------------- rate limiter

def rate_limit(rows: DataFrame, key: str, limit: int, window_ms: int, workspace: Workspace | None = None) -> DataFrame:
    """Adds ``allowed``: a hit passes when fewer than ``limit`` *allowed* hits lie in the window before it.

    A window lies in two neighbouring blocks of its length. Where two together hold at most ``limit`` hits, all hits of the second
    pass whatever came before, so the key's chain of blocks is cut there. Chains that cannot reach the limit pass whole; the others
    are folded in one job, with the times of at most ``limit`` hits as state. One unbroken busy chain is one task's work.
    """
    base = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), "ms", "seq", F.floor(F.col("ms") / window_ms).alias("_blk"))
    counts = base.groupBy("_k", "_blk").agg(F.count("*").alias("_n"))
    order = W.partitionBy("_k").orderBy("_blk")
    joined = (F.col("_blk") - F.lag("_blk").over(order) <= 1) & (F.lag("_n").over(order) + F.col("_n") > limit)
    counts = counts.withColumn("_cut", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("_chain", F.sum("_cut").over(order))
    counts = counts.withColumn("_busy", F.sum("_n").over(W.partitionBy("_k", "_chain")) > limit)
    hits = base.join(counts.select("_k", "_blk", "_chain", "_busy"), ["_k", "_blk"])

    def fold():
        from collections import deque
        passed = deque()

        def step(new, ms, seq):
            if new:
                passed.clear()
            while passed and passed[0] <= ms - window_ms:
                passed.popleft()
            if len(passed) < limit:
                passed.append(ms)
                return True
            return False
        return step

    done = sorted_fold(hits.filter("_busy"), ["_k", "_chain"], ["ms", "seq"], ["ms", "seq"], fold, "allowed").select("seq", "allowed")
    verdicts = hits.filter(~F.col("_busy")).select("seq", F.lit(True).alias("allowed")).unionByName(done)
    return rows.join(verdicts, "seq", "left")


# ---------------------------------------------------------------- ranges, rings, renewals, metering

def uptime_ranges(beats: DataFrame, gap_s: int = 120, *, keys: tuple = (), at: str = "at_ms", keep_days: int | None = None,
                  as_of=None, max_ranges: int | None = None) -> DataFrame:
    """Contiguous ranges of heartbeats: a gap above ``gap_s`` opens a new one."""
    ks = list(keys) or ["_all"]
    d = beats if keys else beats.withColumn("_all", F.lit(0))
    d = d.select(*ks, F.col(at).cast("bigint").alias("ms")).distinct()
    bucket = F.floor(F.col("ms") / HOUR_MS)
    d = previous_value(d, ks, "ms", "_prev", order=("ms",), bucket=bucket)
    d = d.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("ms") - F.col("_prev") > gap_s * 1000), 1).otherwise(0).cast("bigint"))
    d = running_totals(d, ks, {"range_no": F.col("_new")}, order=("ms",), bucket=bucket)
    out = d.groupBy(*ks, "range_no").agg(F.min("ms").alias("from_ms"), F.max("ms").alias("to_ms"), F.count("*").alias("beats"))
    if keep_days is not None:
        out = out.filter(F.col("to_ms") >= F.lit(as_of) - keep_days * DAY_MS)
    if max_ranges is not None:
        out = newest_n(out, ks, max_ranges, "from_ms")
    return out if keys else out.drop("_all")


def newest_n(df: DataFrame, keys: list[str], n: int, *order: str) -> DataFrame:
    """The ``n`` newest rows per key. The rank filter is applied before the shuffle as well, so hot keys stay small."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def recent_ring(df: DataFrame, keys: list[str], n: int = 50, recent: int = 20, order: tuple = ("decided_ms", "scan_id")) -> DataFrame:
    """The newest ``n`` rows per key with ``ring_no`` and whether they belong to the newest ``recent``."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return (df.withColumn("ring_no", F.row_number().over(w)).filter(F.col("ring_no") <= n)
            .withColumn("is_recent", F.col("ring_no") <= recent))


def plan_expiry(purchases: DataFrame, plans: DataFrame) -> DataFrame:
    """Expiry after each purchase: the same plan extends from its current expiry, another plan starts afresh.

    Within a run of one plan, expiry(n) = (n+1)*d + max over m<=n of (t(m) - m*d): a running maximum, no fold.
    """
    d = purchases.join(plans.select("plan_id", "duration_days"), "plan_id")
    d = previous_value(d, ["account_hash"], "plan_id", "_before", order=("ms", "seq"), bucket=F.floor(F.col("ms") / (30 * DAY_MS)))
    d = d.withColumn("_new", F.when(F.col("_before").eqNullSafe(F.col("plan_id")), 0).otherwise(1).cast("bigint"))
    d = running_totals(d, ["account_hash"], {"_run": F.col("_new")}, bucket=F.floor(F.col("ms") / (30 * DAY_MS)))
    w = W.partitionBy("account_hash", "_run").orderBy("ms", "seq")
    days = F.col("duration_days").cast("bigint") * DAY_MS
    d = d.withColumn("_i", F.row_number().over(w).cast("bigint"))
    start = F.max(F.col("ms") - F.col("_i") * days).over(w.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("expires_ms", (F.col("_i") + 1) * days + start).drop("_before", "_new", "_run", "_i")


def meter_calls(calls: DataFrame, prices: DataFrame, free: int = 100, default_price: float = 0.01) -> DataFrame:
    """Charges per call: the first ``free`` calls of an account cost nothing, later ones the price active at that time.

    ``prices`` holds ``account_hash, from_ms, until_ms, price_per_scan`` without overlaps.
    """
    known = calls.filter(F.col("account_hash").isNotNull())
    one = running_totals(known, ["account_hash"], {"call_no": F.lit(1).cast("bigint")})
    # as-of price: intervals become change points on the account's own time line
    marks = prices.select("account_hash", F.explode(F.array(
        F.struct(F.col("from_ms").alias("ms"), F.col("price_per_scan").alias("p")),
        F.struct(F.col("until_ms").alias("ms"), F.lit(None).cast("double").alias("p")))).alias("m")).select(
        "account_hash", F.col("m.ms").alias("ms"), F.struct(F.col("m.p").alias("p")).alias("_mark"), F.col("m.p").isNotNull().alias("_on"))
    priced = asof_last(one, marks, ["account_hash"], "_mark", order=("ms",), tie=F.col("_on").cast("int"))
    price = F.coalesce(F.col("_mark.p"), F.lit(default_price))
    charge = F.when(F.col("call_no") <= free, F.lit(0)).otherwise(price).cast("decimal(18,6)")
    return priced.withColumn("charge", charge).drop("_mark")


def asof_last(rows: DataFrame, events: DataFrame, keys: list[str], value: str, *, order: tuple = ("ms",), strict: bool = False,
              tie: Column | None = None, bucket_ms: int = DAY_MS) -> DataFrame:
    """Adds the latest event ``value`` (a struct) of the same key at or before each row (before it when ``strict``).

    Rows and events share one time line cut into buckets, crowded ones more finely; the last event of earlier buckets is carried in, so
    neither many rows nor many events of one key meet in one task.
    """
    t, more = order[0], list(order[1:])
    line = rows.select(*keys, t).unionByName(events.select(*(F.col(c).cast(rows.schema[c].dataType).alias(c) for c in (*keys, t))))
    crowded = crowded_units(line, keys, t, bucket_ms)
    cut = lambda d: with_bucket(d, crowded, keys, t, bucket_ms)
    kind = events.schema[value].dataType
    cols = rows.columns
    left = rows.select(*cols, F.lit(None).cast(kind).alias("_ev"), F.lit(0).alias("_side"), F.lit(0).alias("_tie"))
    right = events.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) if c in keys or c in order else F.lit(None).cast(rows.schema[c].dataType).alias(c)
                            for c in cols],
                          F.col(value).alias("_ev"), F.lit(1 if strict else -1).alias("_side"), (F.lit(0) if tie is None else tie).alias("_tie"))
    both = cut(left.unionByName(right))
    ends = cut(right).groupBy(*keys, "_b").agg(F.max_by("_ev", F.struct(*order, "_tie")).alias("_l"))
    starts = cut(rows.select(*keys, t)).select(*keys, "_b").distinct().withColumn("_l", F.lit(None).cast(kind))
    per = ends.unionByName(starts).groupBy(*keys, "_b").agg(F.first("_l", ignorenulls=True).alias("_l"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = per.select(*keys, "_b", F.last("_l", ignorenulls=True).over(before).alias("_carry"))
    inside = W.partitionBy(*keys, "_b").orderBy(t, *more, "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    d = both.join(carry, [*keys, "_b"], "left")
    d = d.withColumn("_got", F.coalesce(F.last("_ev", ignorenulls=True).over(inside), F.col("_carry")))
    return d.filter(F.col("_side") == 0).select(*cols, F.col("_got").alias(value))


def first_rows(d: DataFrame, n: int, bucket_ms: int, time: str, *order: str, newest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the first ``n`` rows by time and ``order``, the others), or the newest ones.

    Counts per time bucket tell in which bucket the cut falls; only that bucket's rows are ranked, so no task sees all rows.
    """
    bucket = F.floor(F.col(time) / bucket_ms)
    b = d.withColumn("_b", -bucket if newest else bucket)
    upto = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    counts = b.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    j = b.join(counts, "_b")
    edge = j.filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") > n))
    by = [F.desc(c) if newest else F.asc(c) for c in (time, *order)]
    edge = edge.withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy(*by)))
    inside = F.col("_before") + F.col("_n") <= n
    keep = lambda x: x.select(*d.columns)
    return (keep(j.filter(inside)).unionByName(keep(edge.filter(F.col("_r") <= F.lit(n) - F.col("_before")))),
            keep(j.filter(F.col("_before") >= n)).unionByName(keep(edge.filter(F.col("_r") > F.lit(n) - F.col("_before")))))
