"""Stateful streaming operators on ``transformWithStateInPandas``, in event time.

Rows may arrive in any order within the watermark's delay. Each operator keeps them in a buffer in map state and takes a time bucket of them
in (ms, seq) order once the watermark has passed its end, so its result is that of the batch operator over the same rows. A row
older than the watermark on arrival is not merged into anything: it comes out at once with ``late`` set and nothing else but its key and
``seq``. State that time has made useless is removed by timers, so an idle key holds none.

The watermark moves with the data. A source that falls idle sends a row that only carries time (``time_mark``) to let the last rows out.
"""

from __future__ import annotations

import io
import pickle
import sys
import zlib

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # executors need no copy of this package
HOUR, MINUTE = 3_600_000, 60_000
WEEK = 7 * 24 * HOUR
#: Groups that the keys of an operator with many keys are dealt to, and state values that the keys of a group share.
SHARDS, PAGES = 256, 64


def rocksdb(spark) -> None:
    """State store these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def time_mark(df: DataFrame, at_ms: int, **fixed) -> DataFrame:
    """One row with the columns of ``df`` that only moves the watermark: no ``seq``, empty texts, and what ``fixed`` says."""
    def value(name, kind):
        if name in fixed:
            return F.lit(fixed[name])
        return F.lit(at_ms) if name == "ms" else F.lit("") if kind == "string" else F.lit(None)

    return df.sparkSession.range(1).select(*(value(n, k).cast(k).alias(n) for n, k in df.dtypes))


def on_time(df: DataFrame) -> DataFrame:
    """The results of an operator without its late rows."""
    return df.filter("not late").drop("late")


def late_rows(df: DataFrame) -> DataFrame:
    """The side output: what came after the watermark had passed it."""
    return df.filter("late").drop("late")


def _unpack(data: bytes) -> list[tuple]:
    out, f = [], io.BytesIO(data)
    while f.tell() < len(data):
        out += pickle.load(f)
    return out


class _Timed(StatefulProcessor):
    """Rows in event-time order: a buffer by time bucket, released by timers.

    ``fold`` takes the sorted rows of a bucket, ``settle`` is told that every row before ``horizon`` has been taken. Both give result
    rows. A bucket is one state value, so a micro-batch rewrites only the buckets it adds to, and memory holds one bucket of one key.
    """

    columns: tuple[str, ...] = ()
    result: tuple[str, ...] = ()

    def __init__(self, size: int = MINUTE):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getMapState("buffer", "bucket bigint", "rows binary")
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def fold(self, key, bucket, rows) -> list[tuple]:
        raise NotImplementedError

    def settle(self, key, horizon) -> list[tuple]:
        return []

    def late(self, key, ms, seq) -> tuple:
        """What is told of a late row; what follows is null."""
        return (seq, *key)

    def expire(self, at: int) -> None:
        """Asks to be called once every row up to ``at`` has been taken."""
        self.handle.registerTimer((at // self.size + 1) * self.size)

    def _frame(self, rows, late=False) -> pd.DataFrame:
        width = len(self.result)
        return pd.DataFrame([(*r, *(None,) * (width - len(r)), late) for r in rows], columns=[*self.result, "late"], dtype=object)

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        for d in rows:
            d = d[d["seq"].notna()]
            old = d["ms"] < mark
            yield self._frame([self.late(key, int(ms), int(seq)) for ms, seq in zip(d["ms"][old], d["seq"][old])], True)
            d = d[~old]
            for bucket, part in d.groupby(d["ms"] // self.size):
                at = (int(bucket),)
                held = self.buffer.getValue(at)[0] if self.buffer.containsKey(at) else b""
                if not held:
                    self.handle.registerTimer((at[0] + 1) * self.size)
                fresh = list(part[["ms", "seq", *self.columns]].itertuples(index=False, name=None))
                self.buffer.updateValue(at, (bytes(held) + pickle.dumps(fresh),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        for bucket in sorted(b for (b,) in list(self.buffer.keys()) if (b + 1) * self.size <= mark):
            rows = sorted(_unpack(bytes(self.buffer.getValue((bucket,))[0])), key=lambda r: r[:2])
            self.buffer.removeKey((bucket,))
            yield self._frame(self.fold(key, bucket, rows))
        yield self._frame(self.settle(key, mark // self.size * self.size))

    def close(self) -> None:
        pass


class _Sharded(_Timed):
    """The same for operators with many keys: a group is a shard of keys and a state value a page of them, so a key costs no group, timer or
    call to the state store of its own.

    Rows wait in segments of a week. A segment is taken up to the watermark and what is left is written back, so memory holds what a shard
    has waiting of one week, and its pages in use. ``step`` takes the sorted rows of a key and its state, and gives result rows, the new state (None to forget the key) and a
    time once which has passed ``lapse`` is asked about the key, if any.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.done = handle, None
        self.buffer = handle.getMapState("buffer", "segment bigint", "rows binary")
        self.ends = handle.getMapState("ends", "segment bigint", "rows binary")
        self.states = handle.getMapState("states", "page bigint", "state binary")

    def step(self, key, rows, state) -> tuple:
        raise NotImplementedError

    def lapse(self, key, state, horizon) -> tuple:
        return [], state

    def due(self, at: int, mark: int) -> bool:
        return (at // self.size + 1) * self.size <= mark

    def wake(self, at: int) -> int:
        return (at // self.size + 1) * self.size

    def _put(self, held, rows, mark) -> None:
        by: dict = {}
        for r in rows:
            by.setdefault(r[0] // WEEK, []).append(r)
        for segment, part in by.items():
            old = held.getValue((segment,))
            held.updateValue((segment,), ((bytes(old[0]) if old else b"") + pickle.dumps(part),))
            at = self.wake(min(r[0] for r in part))
            if at > mark:
                self.handle.registerTimer(at)

    def _take(self, held, mark):
        for segment in sorted(s for (s,) in list(held.keys()) if s * WEEK <= mark):
            rows = sorted(_unpack(bytes(held.getValue((segment,))[0])), key=lambda r: (r[0], r[1] if held is self.buffer else 0))
            n = sum(self.due(r[0], mark) for r in rows)
            if n == len(rows):
                held.removeKey((segment,))
            elif n:
                held.updateValue((segment,), (pickle.dumps(rows[n:]),))
                self.handle.registerTimer(self.wake(rows[n][0]))
            if n:
                yield rows[:n]

    def _pages(self, keys):
        """Each page that ``keys`` are on: its keys among them, and its states by key, which are written back if they have changed."""
        by: dict = {}
        for key in keys:
            by.setdefault(zlib.crc32(repr(key).encode()) % PAGES, []).append(key)
        for page, some in by.items():
            held = self.states.getValue((page,))
            states = pickle.loads(bytes(held[0])) if held else {}
            before = dict(states)
            yield some, states
            if not states and held:
                self.states.removeKey((page,))
            elif states != before:
                self.states.updateValue((page,), (pickle.dumps(states),))

    @staticmethod
    def _keep(states, key, new) -> None:
        if new is None:
            states.pop(key, None)
        else:
            states[key] = new

    def _steps(self, rows, mark) -> list[tuple]:
        """Result rows of ``rows`` (ms, seq, key, columns), in the order given."""
        by, out, ends = {}, [], []
        for ms, seq, key, *more in rows:
            by.setdefault(key, []).append((ms, seq, *more))
        for some, states in self._pages(by):
            for key in some:
                got, new, until = self.step(key, by[key], states.get(key))
                self._keep(states, key, new)
                out += got
                ends += [(at, key) for at in until]
        self._put(self.ends, ends, mark)
        return out

    def handleInputRows(self, key, rows, timerValues):
        mark, width = timerValues.getCurrentWatermarkInMs(), len(self.keys)
        for d in rows:
            d = d[d["seq"].notna() & d["ms"].notna()]
            got = [(int(r[0]), int(r[1]), r[2:2 + width], *r[2 + width:])
                   for r in d[["ms", "seq", *self.keys, *self.columns]].itertuples(index=False, name=None)]
            yield self._frame([self.late(k, ms, seq) for ms, seq, k, *_ in got if ms < mark], True)
            self._put(self.buffer, [r for r in got if r[0] >= mark], mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, mark):         # the first timer of a shard has taken all that is due
            return
        self.done = (key, mark)
        for rows in self._take(self.buffer, mark):
            yield self._frame(self._steps(rows, mark))
        yield from self._lapses(mark)

    def _lapses(self, mark):
        for rows in self._take(self.ends, mark):
            out = []
            for some, states in self._pages(dict.fromkeys(r[1] for r in rows)):
                for key in some:
                    if key in states:
                        got, new = self.lapse(key, states[key], mark // self.size * self.size)
                        self._keep(states, key, new)
                        out += got
            yield self._frame(out)


def _number(x) -> float:
    return 0.0 if x is None or x != x else float(x)


class _Replay(_Sharded):
    """First sighting and count of a nonce; a sighting expires ``ttl`` after the first one, reuse does not renew it."""

    keys, result = ("nonce_key",), ("seq", "nonce_key", "nonce_seen", "nonce_first_ms")

    def __init__(self, ttl_ms):
        super().__init__()
        self.ttl = ttl_ms

    def step(self, key, rows, state):
        first, times = state or (None, 0)
        before, out = first, []
        for ms, seq in rows:
            if first is None or (self.ttl is not None and ms - first > self.ttl):
                first, times = ms, 0
            times += 1
            out.append((seq, key[0], times, first))
        return out, (first, times), [first + self.ttl] if self.ttl is not None and first != before else []

    def lapse(self, key, state, horizon):
        return [], None if horizon > state[0] + self.ttl else state


class _Velocity(_Timed):
    """Rows in the last minute and USD in the last hour, this row included.

    A minute is a bucket, kept as its rows and their sum. A row needs the sums of the 59 minutes before its own, and single rows of three
    minutes only: its own, the one before it, and the one an hour before it.
    """

    columns, result = ("usd",), ("seq", "agent_key", "per_minute", "hour_usd")
    minutes = HOUR // MINUTE

    def open(self, handle):
        self.sums = handle.getMapState("sums", "bucket bigint", "usd double")
        self.past = handle.getMapState("past", "bucket bigint", "rows binary")

    def _rows(self, bucket: int) -> np.ndarray:
        data = bytes(self.past.getValue((bucket,))[0]) if self.past.containsKey((bucket,)) else b""
        return np.frombuffer(data, np.float64).reshape(2, -1)

    def fold(self, key, bucket, rows):
        ms, usd = np.array([r[0] for r in rows], np.int64), np.array([_number(r[2]) for r in rows])
        inside = sum(s for (b,), (s,) in self.sums.iterator() if bucket - self.minutes < b < bucket)
        far, near = self._rows(bucket - self.minutes), self._rows(bucket - 1)
        upto = np.concatenate([[0.0], np.cumsum(far[1])])
        edge = upto[-1] - upto[np.searchsorted(far[0], ms - HOUR, "right")]
        minute = near.shape[1] - np.searchsorted(near[0], ms - MINUTE, "right") + np.arange(1, len(rows) + 1)
        hour = edge + inside + np.cumsum(usd)
        self.past.updateValue((bucket,), (np.stack([ms.astype(np.float64), usd]).tobytes(),))
        self.sums.updateValue((bucket,), (float(usd.sum()),))
        self._forget(bucket - self.minutes)
        self.expire((bucket + 1) * MINUTE + HOUR)
        return [(int(r[1]), key[0], int(n), round(float(h), 9)) for r, n, h in zip(rows, minute, hour)]

    def _forget(self, before: int) -> None:
        for (b,) in list(self.sums.keys()):
            if b < before:
                self.sums.removeKey((b,))
                self.past.removeKey((b,))

    def settle(self, key, horizon):
        self._forget(horizon // MINUTE - self.minutes)
        return []


class _Pins(_Sharded):
    """First payee of a domain; a row of kind ``clear`` forgets it; blocked rows never set it."""

    keys, columns, result = ("domain",), ("pay_to", "kind"), ("seq", "domain", "check_id", "times_seen")

    def step(self, key, rows, pin):
        out = []
        for ms, seq, payee, kind in rows:
            if kind == "clear":
                pin = None
            elif pin is None:
                out.append((seq, key[0], "pin.created", 1))
                if kind != "blocked":
                    pin = (payee, ms, 1)
            elif pin[0] == payee:
                pin = (pin[0], pin[1], pin[2] + 1)
                out.append((seq, key[0], "pin.match", pin[2]))
            else:
                out.append((seq, key[0], "pin.mismatch", pin[2]))
        return out, pin, []


class _Spend(_Sharded):
    """Spend of a pair before each row, and whether it unlocks the deep tier."""

    keys, columns, result = ("agent_key", "pay_to"), ("usd",), ("seq", "agent_key", "pay_to", "prior_usd", "unlocked")

    def __init__(self, threshold):
        super().__init__()
        self.threshold = threshold

    def step(self, key, rows, total):
        total, out = total or 0.0, []
        for ms, seq, usd in rows:
            usd = _number(usd)
            out.append((seq, *key, round(total, 9), bool(usd < self.threshold <= total + usd)))
            total += max(usd, 0.0)
        return out, total, []


class _RateLimit(_Timed):
    """Sliding log of allowed hits only, at most ``limit`` of them."""

    result = ("seq", "key", "allowed")

    def __init__(self, limit, window_ms):
        super().__init__()
        self.limit, self.window = limit, window_ms

    def open(self, handle):
        self.hits = handle.getListState("hits", "ms bigint")

    def fold(self, key, bucket, rows):
        hits, lo, out = [int(h[0]) for h in self.hits.get()], 0, []
        for ms, seq in rows:
            while lo < len(hits) and ms - hits[lo] >= self.window:
                lo += 1
            ok = len(hits) - lo < self.limit
            if ok:
                hits.append(int(ms))
            out.append((int(seq), key[0], ok))
        if hits[lo:]:
            self.hits.put([(h,) for h in hits[lo:]])
            self.expire(hits[-1] + self.window - 1)
        else:
            self.hits.clear()
        return out

    def settle(self, key, horizon):
        hits = [int(h[0]) for h in self.hits.get()]
        if hits and horizon - hits[-1] >= self.window:
            self.hits.clear()
        return []


class _Provenance(_Timed):
    """What the agent read or noted since its last payment; used once, readings lapse after ``ttl``."""

    columns, result = ("kind",), ("seq", "agent_key", "origin", "observation_seq")

    def __init__(self, ttl_ms, default):
        super().__init__()
        self.ttl, self.default = ttl_ms, default

    def open(self, handle):
        self.last = handle.getValueState("last", "ms bigint, seq bigint, kind string")

    @staticmethod
    def _is_note(last) -> bool:
        return last[2] in ("planning", "user_instruction")

    def fold(self, key, bucket, rows):
        last, out = tuple(self.last.get()) if self.last.exists() else None, []
        for ms, seq, kind in rows:
            if kind != "payment":
                last = (int(ms), int(seq), kind)
                continue
            note = last is not None and self._is_note(last)
            use = last is not None and (note or ms - last[0] <= self.ttl)
            out.append((int(seq), key[0], last[2] if use else self.default, last[1] if use and not note else None))
            last = None
        if last is None:
            self.last.clear()
        else:
            self.last.update(last)
            if not self._is_note(last):
                self.expire(last[0] + self.ttl)
        return out

    def settle(self, key, horizon):
        if self.last.exists() and not self._is_note(last := self.last.get()) and horizon > last[0] + self.ttl:
            self.last.clear()
        return []


class _Sessions(_Sharded):
    """Ranges of beats no more than ``gap`` apart. A range comes out when time has passed its last beat by more than the gap, or at a row
    of kind ``close``; equal times are one beat."""

    columns = ("kind",)

    def __init__(self, gap_ms, keys):
        super().__init__()
        self.gap, self.keys, self.result = gap_ms, tuple(keys), (*keys, "from_ms", "to_ms", "beats")

    def late(self, key, ms, seq):
        return (*key, ms, ms, 1)

    def step(self, key, rows, cur):
        out = []
        for ms, _, kind in rows:
            if cur is not None and (kind == "close" or ms - cur[1] > self.gap):
                out.append((*key, *cur))
                cur = None
            if kind != "close":
                cur = (ms, ms, 1) if cur is None else (cur[0], ms, cur[2] + (ms > cur[1]))
        return out, cur, [] if cur is None else [cur[1] + self.gap]

    def lapse(self, key, cur, horizon):
        return ([(*key, *cur)], None) if horizon > cur[1] + self.gap else ([], cur)


class _Approvals(_Sharded):
    """Approval life cycle: opened, decided or expired by an event-time timer, dropped a day after creation. Events count as they arrive."""

    keys, columns, result = ("approval_id",), ("kind", "expires_ms"), ("approval_id", "status", "ms")

    def __init__(self, keep_ms):
        super().__init__()
        self.keep = keep_ms

    def due(self, at, mark):
        return at < mark

    def wake(self, at):
        return at

    def _frame(self, rows, late=False):
        return super()._frame(rows).drop(columns="late")

    def step(self, key, rows, cur):
        out, ends = [], []
        for ms, _, kind, expires in rows:
            if kind == "open" and cur is None:
                cur = (ms, int(expires), "pending")
                ends += [cur[1], ms + self.keep]
                out.append((key[0], "pending", ms))
            elif kind in ("approve", "deny") and cur is not None and cur[2] == "pending":
                status = "expired" if ms >= cur[1] else "approved" if kind == "approve" else "denied"
                cur = (cur[0], cur[1], status)
                out.append((key[0], status, ms))
        return out, cur, ends

    def handleInputRows(self, key, rows, timerValues):
        parts = [d[["ms", "seq", "approval_id", "kind", "expires_ms"]] for d in rows]
        d = pd.concat(parts, ignore_index=True).sort_values(["ms", "seq"], kind="stable")      # one micro-batch of a shard
        yield self._frame(self._steps([(int(ms), seq, (one,), kind, expires) for ms, seq, one, kind, expires in d.itertuples(index=False, name=None)],
                                      -1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        if self.done != (key, mark):
            self.done = (key, mark)
            yield from self._lapses(mark)

    def _lapses(self, mark):
        for rows in self._take(self.ends, mark):
            out, times = [], {}
            for at, key in rows:
                times.setdefault(key, []).append(at)
            for some, states in self._pages(times):
                for key in some:
                    for at in times[key]:
                        if key not in states:
                            break
                        created, expires, status = states[key]
                        if status == "pending" and at >= expires:
                            status = "expired"
                            out.append((key[0], "expired", expires))
                        self._keep(states, key, None if at >= created + self.keep else (created, expires, status))
            yield self._frame(out)


def _run(df: DataFrame, keys: list[str], processor, schema: str) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def _in_time(df: DataFrame, keys: list[str], processor: _Timed, schema: str, delay: str) -> DataFrame:
    # without the event-time column the late rows reach the processor; with it Spark would drop them unseen
    rows = df.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", delay).select(*keys, "ms", "seq", *processor.columns)
    return _run(rows, keys, processor, schema + ", late boolean")


def _by_shards(rows: DataFrame, processor: _Sharded, schema: str) -> DataFrame:
    keys = [F.col(k).cast("string").alias(k) for k in processor.keys]
    rest = [c for c in rows.columns if c not in processor.keys]
    return _run(rows.select(F.pmod(F.xxhash64(*processor.keys), F.lit(SHARDS)).alias("shard"), *keys, *rest), ["shard"], processor, schema)


def _in_time_sharded(df: DataFrame, processor: _Sharded, schema: str, delay: str) -> DataFrame:
    rows = df.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", delay).select(*processor.keys, "ms", "seq", *processor.columns)
    return _by_shards(rows, processor, schema + ", late boolean")


def stream_replay(df: DataFrame, ttl_hours: int | None = 24, delay: str = "0 seconds") -> DataFrame:
    """``seq, nonce_key, nonce_seen, nonce_first_ms, late`` of rows with a nonce."""
    d = df.filter("nonce_key is not null")
    return _in_time_sharded(d, _Replay(None if ttl_hours is None else ttl_hours * HOUR), "seq bigint, nonce_key string, nonce_seen bigint, nonce_first_ms bigint", delay)


def stream_dedup(df: DataFrame, delay: str = "24 hours") -> DataFrame:
    """First sightings only, by Spark's own deduplication within the watermark (needs event time ``ts``)."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["nonce_key"])


def stream_velocity(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    d = df.filter("direction = 'outgoing' and agent_key is not null")
    return _in_time(d, ["agent_key"], _Velocity(), "seq bigint, agent_key string, per_minute bigint, hour_usd double", delay)


def velocity_dashboard(df: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Hourly spend per agent every minute, as windowed aggregates over event time ``ts``."""
    return df.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour", "1 minute"), "agent_key").agg(
        F.count("*").alias("n"), F.sum("usd").alias("usd"))


def stream_pins(df: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Pin status per row; ``kind`` is payment, blocked or clear."""
    return _in_time_sharded(df.filter("domain is not null"), _Pins(), "seq bigint, domain string, check_id string, times_seen bigint", delay)


def stream_spend(df: DataFrame, threshold: float = 0.005, delay: str = "0 seconds") -> DataFrame:
    d = df.filter("agent_key is not null and pay_to is not null")
    return _in_time_sharded(d, _Spend(threshold), "seq bigint, agent_key string, pay_to string, prior_usd double, unlocked boolean", delay)


def stream_rate_limit(df: DataFrame, key: str, limit: int, window_ms: int, delay: str = "0 seconds") -> DataFrame:
    d = df.filter(F.col(key).isNotNull()).withColumn("key", F.col(key).cast("string"))
    return _in_time(d, ["key"], _RateLimit(limit, window_ms), "seq bigint, key string, allowed boolean", delay)


def stream_provenance(events: DataFrame, ttl_ms: int = 5 * MINUTE, default: str = "unknown", delay: str = "0 seconds") -> DataFrame:
    """``events``: observations, notes and payments of agents in one stream, ``kind`` tells which (``payment`` for the latter)."""
    d = events.filter("agent_key is not null")
    return _in_time(d, ["agent_key"], _Provenance(ttl_ms, default), "seq bigint, agent_key string, origin string, observation_seq bigint", delay)


def stream_approvals(events: DataFrame, delay: str = "0 seconds", keep_ms: int = 24 * HOUR) -> DataFrame:
    """Status changes of approvals; ``kind`` is open, approve or deny; event time ``ts``."""
    d = events.withWatermark("ts", delay).select("approval_id", "ts", "ms", "seq", "kind", "expires_ms")
    return _by_shards(d, _Approvals(keep_ms), "approval_id string, status string, ms bigint")


def stream_uptime(beats: DataFrame, gap_s: int = 120, delay: str = "5 minutes", keys: tuple = ("service",)) -> DataFrame:
    """Uptime ranges of heartbeats (``ms``, ``seq``, ``kind``, keys): keys, from_ms, to_ms, beats, late. A gap of exactly ``gap_s`` stays
    in one range as in the batch form; a row of kind ``close`` ends its key's range at once."""
    kinds = dict(beats.dtypes)
    schema = "".join(f"{k} string, " for k in keys) + "from_ms bigint, to_ms bigint, beats bigint"
    out = _in_time_sharded(beats, _Sessions(gap_s * 1000, keys), schema, delay)
    return out.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
