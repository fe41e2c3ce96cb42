"""Shards of near-equal counts by balanced label propagation, with DataFrame functions only.

Documents start in shards dealt evenly. In each round every linked document asks for the shard that most of its neighbours are in;
the flows between pairs of shards are cut to what the capacities allow, and that many of the askers move. The links of a group
(here: of equal texts) join all its members; they are never written out: a member's neighbours are the group's counts by shard,
at most one row per group and shard, aggregated before the shuffle. A last pass evens the counts, moving documents without links first.

Only the counts of documents by shard (and pair of shards) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, workspace

#: Rows that one task ranks.
BUCKET_ROWS = 100_000
#: Rounds in which members may ask for a full shard, since others may leave it.
FREE_ROUNDS = 2


def with_rank(rows: DataFrame, keys: list[str], total: int, name: str = "rank") -> DataFrame:
    """Numbers the rows of each key from 0 without gaps, also where one key holds all rows.

    Rows are ranked inside (key, hash bucket); a running sum of the counts of buckets shifts the ranks. Needs the unique column ``row``.
    """
    buckets = max(1, -(-total // BUCKET_ROWS)) * 4
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("row")) - 1
    return dealt.withColumn("_local", local).join(starts, [*keys, "_bucket"]).withColumn(name, (F.col("_start") + F.col("_local")).cast("long")).drop("_bucket", "_local", "_start")


def flows(wanted: dict[tuple[int, int], int], counts: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """How many may move between each pair of shards: cut inflows in proportion until no shard exceeds its capacity."""
    x, shards = dict(wanted), range(len(counts))
    while True:
        cut = False
        for j in shards:
            into = sum(n for (_, b), n in x.items() if b == j)
            over = counts[j] + into - sum(n for (a, _), n in x.items() if a == j) - capacity[j]
            if over > 0 and into > 0:
                left, cut = max(0, into - over), True
                for k in [k for k in x if k[1] == j]:
                    x[k] = x[k] * left // into
        if not cut:
            return x


def evening(counts: dict[tuple[int, int], int], target: list[int]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Which shards the first members of (shard, class) go to: lists of (shard, how many); class 0, without links, goes first."""
    held = [sum(n for (s, _), n in counts.items() if s == i) for i in range(len(target))]
    needs = [[i, t - h] for i, (t, h) in enumerate(zip(target, held)) if t > h]
    moves: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, (t, h) in enumerate(zip(target, held)):
        extra = h - t
        for c in (0, 1):
            free = counts.get((i, c), 0)
            while extra > 0 and free > 0:
                n = min(extra, free, needs[-1][1])
                moves.setdefault((i, c), []).append((needs[-1][0], n))
                extra, free, needs[-1][1] = extra - n, free - n, needs[-1][1] - n
                if not needs[-1][1]:
                    needs.pop()
    return moves


def _case(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    out = other
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 6, group: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows of every row.

    Law ``rows``: the counts of any two shards differ by one at most. ``group`` links the rows that share its value (equal texts
    unless given; null links nothing). A null text has no bytes (size 1, CRC 0) and equals the empty text. Repeated rows and null
    ids are rows like others. ``grown_shard`` is null under this law.
    """
    ws = workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = ws.materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                                      (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                                      (F.unhex(F.md5(text.cast("binary"))) if group is None else group).alias("grp")), "rows")
    total = base.count()
    groups = ws.materialize(base.filter("grp is not null").groupBy("grp").agg(F.count("*").alias("group_rows")).filter("group_rows > 1"), "groups")
    linked = ws.materialize(join_groups(base.select("row", "grp"), groups, ["grp"], "group_rows", total), "linked")
    at = F.pmod(F.xxhash64("row", F.lit(17)), F.lit(shards)).cast("int")
    place = ws.materialize(linked.filter("group_rows is not null").withColumn("shard", at), "start")
    moving = place.count()
    rest = linked.filter("group_rows is null").withColumn("shard", at)
    # documents without links take the seats that are left in the end, so a shard has room for its whole share of linked ones
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    per = lambda df, *by: {tuple(r)[:-1]: r[-1] for r in df.groupBy(*by).count().collect()}  # noqa: E731  at most shards x shards rows
    held = per(place, "shard") if moving else {}
    for k in range(rounds if moving else 0):
        # cut flows leave a few seats, so a shard counts as full a little earlier
        full = [s for s in range(shards) if held.get((s,), 0) >= capacity[s] - shards - capacity[s] // 50]
        open_ = F.lit(True) if k < FREE_ROUNDS else ~F.col("shard").isin(full)         # later rounds gather the rest of large groups elsewhere
        counted = place.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        # most neighbours first; of equals, a shard that differs from group to group
        best = F.max(F.when(open_, F.struct(F.col("n"), F.xxhash64("grp", "shard").alias("t"), F.col("shard").alias("to"))))
        wish = counted.groupBy("grp").agg(best.alias("w"), F.sum("n").alias("members")).select("grp", "members", F.col("w.to").alias("wish"))
        asked = join_groups(place, ws.materialize(wish, f"wish-{k}"), ["grp"], "members", total).drop("members")
        stays = F.col("wish").isNull() | (F.col("shard").isin(full) if k >= FREE_ROUNDS else F.lit(False))
        stored = ws.materialize(asked.withColumn("to", F.when(stays, F.col("shard")).otherwise(F.col("wish"))).drop("wish"), f"asked-{k}")
        pairs = per(stored, "shard", "to")
        wanted = {p: n for p, n in pairs.items() if p[0] != p[1]}
        if not wanted and k < FREE_ROUNDS:
            continue
        if not wanted:
            break
        allowed = flows(wanted, [sum(n for (a, _), n in pairs.items() if a == s) for s in range(shards)], capacity)
        quota = _case([((F.col("shard") == a) & (F.col("to") == b), F.lit(n)) for (a, b), n in sorted(allowed.items())], F.lit(0))
        ranked = with_rank(stored, ["shard", "to"], moving)
        place = ws.materialize(ranked.select("row", "grp", "group_rows", F.when(F.col("rank") < quota, F.col("to")).otherwise(F.col("shard")).alias("shard")), f"round-{k}")
        held = per(place, "shard")
    every = place.unionByName(rest.select(place.columns)).withColumn("class", F.col("group_rows").isNotNull().cast("int"))
    ranked = ws.materialize(with_rank(every, ["shard", "class"], total), "ranked")
    counts = {(r[0], r[1]): r[2] for r in ranked.groupBy("shard", "class").count().collect()}
    tests = []
    for (s, c), moves in sorted(evening(counts, capacity).items()):
        upto = 0
        for to, n in moves:
            upto += n
            tests.append(((F.col("shard") == s) & (F.col("class") == c) & (F.col("rank") < upto), F.lit(to)))
    final = ranked.select("row", "group_rows", _case(tests, F.col("shard")).cast("int").alias("shard"))
    slots = ws.materialize(with_rank(final, ["shard"], total, "slot"), "slots")
    return base.drop("grp").join(slots, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                                                      F.coalesce("group_rows", F.lit(1)).alias("group_rows"))
