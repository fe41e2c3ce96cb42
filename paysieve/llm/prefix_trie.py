"""The trie of conversations by common first turns, from sorted sequences and range minima.

A conversation is a sequence of turn names (16 bytes of a SHA-256 each). Sorted, the members of any prefix are one interval, and the
longest common prefixes (LCPs) of neighbours say which: an interval of a prefix of d turns ends where an LCP falls below d. Each
candidate prefix finds its ends on its own, by binary search over a sparse table of range minima; there is no stack and no order among
them. What a node tells follows from its interval and prefix sums over the sorted order:

* the copies it saves: each member but the first shares ``LCP`` turns with its neighbour, of which those above the node do not count;
* its leaves: members that the next one does not extend;
* its children: members at which the next turn is new, counted at the node that their parent's search finds;
* its smallest member: a range minimum of the ids.

Spark sorts the sequences into chunks of bounded size. A chunk knows the last sequence of the chunk before it and the first of the one
after it. Prefixes whose interval ends inside the chunk are done there; the few that go on (prefixes of a chunk's first or last
sequence) give sums, which are added up by the prefix. No conversation's text is gathered: a turn is 20 bytes from the start.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import digest_pieces, workspace

NAME = 16
#: Turns and conversations of a chunk; a longer conversation is a chunk of its own.
CHUNK_TURNS, CHUNK_ROWS = 200_000, 50_000
#: Nodes of an output batch.
BATCH = 50_000
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NOBODY = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, names, lens: the turns of each conversation in order, 16 and 4 bytes a turn.

    Turns are ordered by ``turn`` (null first), then by role, then by name; a task streams them, so it holds one conversation's 20 bytes
    a turn and no text. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, NAME)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), name.alias("name"), F.length(text).alias("n"))
    rows = rows.filter("conv_id is not null")
    dealt = rows.repartition(parts, "conv_id") if parts else rows.repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "name")

    def bundle(batches):
        now, names, lens = None, [], []
        for b in batches:
            ids = b.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]]) if len(ids) else np.zeros(1, np.int64)
            flat, sizes, out = b"".join(b.column(1).to_pylist()), b.column(2).to_numpy().astype("<i4").tobytes(), []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if names and int(ids[lo]) != now:
                    out.append((now, b"".join(names), b"".join(lens)))
                    names, lens = [], []
                now = int(ids[lo])
                names.append(flat[NAME * lo:NAME * hi])
                lens.append(sizes[4 * lo:4 * hi])
            if out:
                yield _sequence_batch(out)
        if names:
            yield _sequence_batch([(now, b"".join(names), b"".join(lens))])

    return dealt.select("conv_id", "name", "n").mapInArrow(bundle, "conv_id long, names binary, lens binary")


def _sequence_batch(rows) -> pa.RecordBatch:
    ids, names, lens = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(lens, pa.binary())], names=["conv_id", "names", "lens"])


def rebuilt(seqs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % ``group`` in place of its own, h = crc32(c) % ``most``.

    ``seqs`` should be a stored table. A conversation that has fewer turns gives what it has, one that is absent none.
    """
    c = F.col("conv_id")
    h = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(most))
    heads = seqs.filter(F.col("conv_id") % group == 0).select(c.alias("base"), F.substring("names", 1, NAME * most).alias("head"), F.substring("lens", 1, 4 * most).alias("hlens"))
    joined = seqs.withColumn("base", c - c % group).withColumn("h", h.cast("int")).join(heads, "base", "left")
    none = F.lit(b"")
    part = lambda head, own, size: F.concat(F.coalesce(F.substr(head, F.lit(1), F.col("h") * size), none), F.substr(own, F.col("h") * size + 1))
    return joined.select("conv_id", part(F.col("head"), F.col("names"), NAME).alias("names"), part(F.col("hlens"), F.col("lens"), 4).alias("lens"))


# ---- chunks of the sorted order --------------------------------------------------------------------------------------


def _chunks(turns: int, rows: int):
    """Sorted sequences to rows of (part, chunk, ids, counts, names, lens, first, last)."""
    def bundle(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            ids, names, lens = zip(*held)
            counts = np.array([len(n) // NAME for n in names], np.int32)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "chunk": pa.array([made], pa.int64()), "ids": [np.array(ids, np.int64).tobytes()], "counts": [counts.tobytes()],
                                               "names": [b"".join(names)], "lens": [b"".join(lens)], "first": pa.array([names[0]], pa.binary()), "last": pa.array([names[-1]], pa.binary())})

        for b in batches:
            for one in zip(*(b.column(k).to_pylist() for k in range(3))):
                n = len(one[1]) // NAME
                if held and (size + n > turns or len(held) >= rows):
                    yield row()
                    made, held, size = made + 1, [], 0
                held.append(one)
                size += n
        if held:
            yield row()

    return bundle


def _turns(names: bytes) -> np.ndarray:
    return np.frombuffer(names, "<u8").reshape(-1, 2)


def common_prefix(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences share from the start; -1 without one of them."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // NAME
    differ = np.flatnonzero((_turns(a[:NAME * n]) != _turns(b[:NAME * n])).any(axis=1))
    return int(differ[0]) if len(differ) else n


class RangeMin:
    """Minima of ranges: level k holds those of 2^k values from each place."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-step], low[step:]))

    def minimum(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of the values at lo ... hi, both included."""
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][lo[at]], self.levels[k][hi[at] - (1 << int(k)) + 1])
        return out

    def rightmost(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far each place can go to the right while all values from the one after it are at least ``least``."""
        pos, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(pos + (1 << k) < n)
            can = can[self.levels[k][pos[can] + 1] >= least[can]]
            pos[can] += 1 << k
        return pos

    def leftmost(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The least place from which all values after it, up to the given place, are at least ``least``."""
        pos = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            can = np.flatnonzero(pos - (1 << k) >= 0)
            can = can[self.levels[k][pos[can] - (1 << k) + 1] >= least[can]]
            pos[can] -= 1 << k
        return pos


class Chunk:
    """The nodes that begin in a chunk (candidates, closed to the left), and the prefixes that come from the chunk before it."""

    def __init__(self, ids: bytes, counts: bytes, names: bytes, lens: bytes, before: bytes | None, after: bytes | None):
        self.ids, self.count = np.frombuffer(ids, np.int64), np.frombuffer(counts, np.int32).astype(np.int64)
        self.names, n = names, len(self.ids)
        turns, off = _turns(names), np.concatenate([[0], np.cumsum(self.count)])
        self.off = off
        self.lcp = np.empty(n + 1, np.int64)
        self.lcp[0] = common_prefix(before, names[:NAME * off[1]])
        self.lcp[n] = common_prefix(names[NAME * off[n - 1]:], after)
        both = np.minimum(self.count[:-1], self.count[1:])
        inside = np.arange(int(both.sum())) - np.repeat(np.cumsum(both) - both, both)
        a, b = np.repeat(off[:-2], both) + inside, np.repeat(off[1:-1], both) + inside
        reach = np.where((turns[a] == turns[b]).all(axis=1), np.repeat(both, both), inside)
        self.lcp[1:n] = 0
        np.minimum.at(mins := both.copy(), np.repeat(np.arange(n - 1), both), reach)
        self.lcp[1:n] = mins
        sums = np.concatenate([[0], np.cumsum(np.frombuffer(lens, "<i4").astype(np.int64))])
        self.chars = lambda i, d: sums[off[i] + np.maximum(d, 0)] - sums[off[i]]          # of the first d turns of sequence i
        # candidates: prefixes that no sequence before has, at the sequence where each begins
        new = self.count - self.lcp[:n]
        self.base = np.concatenate([[0], np.cumsum(new)])
        self.at = np.repeat(np.arange(n), new)
        self.depth = np.arange(int(new.sum())) - np.repeat(self.base[:-1], new) + np.repeat(self.lcp[:n] + 1, new)
        self.table = RangeMin(np.concatenate([[np.iinfo(np.int64).max], self.lcp[1:n]]))    # the first sequence's own place is never asked
        self.left = int(self.lcp[0]) + 1                                                    # prefixes 0 ... lcp[0] of the first sequence are open
        first, depth = np.concatenate([np.zeros(self.left, np.int64), self.at]), np.concatenate([np.arange(self.left), self.depth])
        self._sums(first, depth)

    def _sums(self, first: np.ndarray, depth: np.ndarray) -> None:
        """What each prefix has in this chunk; open ones come first, then the candidates."""
        n, left = len(self.ids), self.left
        last = self.table.rightmost(first, depth)
        self.last, self.first, self.all_depth = last, first, depth
        self.n = last - first + 1
        self.least = RangeMin(self.ids).minimum(first, last)
        leaf = np.concatenate([[0], np.cumsum(self.lcp[1:] < self.count)])
        self.leaves = leaf[last + 1] - leaf[first]
        i = np.arange(n)
        shared = np.concatenate([[0], np.cumsum(self.chars(i, self.lcp[:n]))])
        begin = first + (np.arange(len(first)) >= left)                           # a candidate's first member shares with nobody
        self.saved = shared[last + 1] - shared[begin] - (last + 1 - begin) * self.chars(first, depth - 1)
        # the parent of a candidate: the prefix one turn shorter, from wherever it begins
        up = self.depth - 1
        at = self.table.leftmost(self.at, up)
        self.parent = np.where((at == 0) & (up < left), up, left + self.base[at] + up - (self.lcp[at] + 1))
        self.parent[self.depth == 0] = -1
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(first))
        self.open_right = (last == n - 1) & (depth <= self.lcp[n])
        same = np.concatenate([[False], (self.lcp[1:n] == self.count[1:]) & (self.count[1:] == self.count[:-1])])
        starts = np.flatnonzero(~same)
        self.run_end = np.concatenate([starts[1:], [n]])[np.cumsum(~same) - 1]    # where the equal sequences from here end

    def names_of(self, entry: int) -> bytes:
        """The key of a prefix."""
        i, d = int(self.first[entry]), int(self.all_depth[entry])
        return self.names[NAME * self.off[i]:NAME * (self.off[i] + d)]

    def ends(self, entry: int) -> np.ndarray:
        """The ids of the members in this chunk that end at the prefix, ascending."""
        i = int(self.first[entry])
        return self.ids[i:self.run_end[i]] if self.count[i] == self.all_depth[entry] else self.ids[:0]

    def open(self) -> np.ndarray:
        return np.concatenate([np.arange(self.left), self.left + np.flatnonzero(self.open_right[self.left:])])


def _keys(chunk: Chunk, entries: np.ndarray) -> list[tuple[bytes, bytes | None]]:
    """The digests of prefixes and of their parents. All are prefixes of the first or of the last sequence."""
    digests: dict[int, list[bytes]] = {}
    for i in {0, len(chunk.ids) - 1}:
        deepest = max((int(chunk.all_depth[e]) for e in entries), default=0)
        h, own = hashlib.sha256(), []
        lo, n = int(chunk.off[i]), int(chunk.count[i])
        for d in range(min(deepest, n) + 1):
            own.append(h.copy().digest()[:NAME])
            h.update(chunk.names[NAME * (lo + d):NAME * (lo + d + 1)])
        digests[i] = own
    out = []
    for e in entries:
        own = digests[0 if e < chunk.left else len(chunk.ids) - 1]
        d = int(chunk.all_depth[e])
        out.append((own[d], own[d - 1] if d else None))
    return out


OPEN = "seq long, entry long, depth long, key binary, up binary, n long, least long, leaves long, saved long, children long, ends binary"


def _open(row) -> pa.RecordBatch | None:
    """The sums of the prefixes that go on in a neighbouring chunk."""
    chunk = Chunk(*(row[c] for c in ("ids", "counts", "names", "lens", "before", "after")))
    at = chunk.open()
    if not len(at):
        return None
    keys = _keys(chunk, at)
    long = lambda x: pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_pydict({
        "seq": long([row["seq"]] * len(at)), "entry": long(at), "depth": long(chunk.all_depth[at]), "key": pa.array([k for k, _ in keys], pa.binary()), "up": pa.array([u for _, u in keys], pa.binary()),
        **{c: long(v[at]) for c, v in (("n", chunk.n), ("least", chunk.least), ("leaves", chunk.leaves), ("saved", chunk.saved), ("children", chunk.children))},
        "ends": pa.array([x.tobytes() if len(x) else None for x in map(chunk.ends, at)], pa.binary())})


def _closed(row):
    """The nodes that begin and end in a chunk; ``told`` gives the smallest members of the open ones."""
    chunk = Chunk(*(row[c] for c in ("ids", "counts", "names", "lens", "before", "after")))
    least = chunk.least.copy()
    for entry in row["told"] or ():
        least[entry["entry"]] = entry["least"]
    mine = chunk.left + np.flatnonzero(~chunk.open_right[chunk.left:])
    for lo in range(0, len(mine), BATCH):
        at = mine[lo:lo + BATCH]
        parent = chunk.parent[at - chunk.left]
        ended = chunk.count[chunk.first[at]] == chunk.all_depth[at]
        digests = [hashlib.sha256(",".join(map(str, chunk.ends(e).tolist())).encode()).hexdigest() if x else _NOBODY for e, x in zip(at.tolist(), ended.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(chunk.least[at]), pa.array(chunk.all_depth[at]), pa.array(least[np.maximum(parent, 0)], mask=parent < 0), pa.array(chunk.n[at]),
                                          pa.array(chunk.children[at]), pa.array(chunk.leaves[at]), pa.array(chunk.saved[at]), pa.array(digests, pa.string())],
                                         names=[c.split()[0] for c in NODES.split(", ")])


def _rowwise(fn):
    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                yield from fn(b.slice(k, 1).to_pylist()[0])
    return run


def trie_nodes(seqs: DataFrame, chunk_turns: int = CHUNK_TURNS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per node of the trie of ``seqs`` (a stored table of conv_id, names, lens with unique ids): conv_id, the smallest member;
    depth; parent_conv_id, the parent's conv_id (the root's is null); n_convs, members; n_children; n_leaves, nodes without children at
    or below it; saved_tokens, the code points of each node's last text times its members but one, summed at and below it; ends_sha256,
    of the members that end there, their ids ascending, decimal and comma-joined. The root has no turns and all conversations. No
    conversations: no nodes.
    """
    spark = seqs.sparkSession
    ws = workspace(spark)
    size = seqs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("names")), F.lit(0)).alias("b")).first()
    wanted = max(-(-size["n"] // chunk_rows), -(-size["b"] // (NAME * chunk_turns)), min(spark.sparkContext.defaultParallelism, -(-size["n"] // 1000)), 1)
    order = seqs.select("conv_id", "names", "lens").repartitionByRange(wanted, "names", "conv_id").sortWithinPartitions("names", "conv_id")
    schema = "part long, chunk long, ids binary, counts binary, names binary, lens binary, first binary, last binary"
    chunks = ws.materialize(order.mapInArrow(_chunks(chunk_turns, chunk_rows), schema), "chunks")
    # one narrow line a chunk is numbered; neighbours then meet by number
    numbered = ws.materialize(chunks.select("part", "chunk").withColumn("seq", F.row_number().over(Window.orderBy("part", "chunk")).cast("long")), "numbers")
    ends = chunks.select("part", "chunk", "first", "last").join(numbered, ["part", "chunk"]).select("seq", "first", "last")
    before = ends.select((F.col("seq") + 1).alias("seq"), F.col("last").alias("before"))
    after = ends.select((F.col("seq") - 1).alias("seq"), F.col("first").alias("after"))
    near = numbered.join(before, "seq", "left").join(after, "seq", "left")
    known = ws.materialize(chunks.drop("first", "last").join(near, ["part", "chunk"]).drop("part", "chunk"), "neighbours")
    opened = ws.materialize(known.mapInArrow(_rowwise(lambda row: (b for b in [_open(row)] if b is not None)), OPEN), "open")
    whole = ws.materialize(opened.groupBy("key").agg(F.first("depth").alias("depth"), F.first("up").alias("up"), F.min("least").alias("least"), *(F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children"))), "whole")
    told = opened.select("seq", "entry", "key").join(whole.select("key", "least"), "key").groupBy("seq").agg(F.collect_list(F.struct("entry", "least")).alias("told"))
    closed = known.join(ws.materialize(told, "told"), "seq", "left").mapInArrow(_rowwise(_closed), NODES)
    lists = digest_pieces(opened.filter("ends is not null").select("key", "seq", "ends"), "key binary", "seq", "ends", b",", max(1, wanted // 8), "ends_sha256",
                          lambda x: ",".join(map(str, np.frombuffer(x, np.int64).tolist())).encode())
    parents = whole.select(F.col("key").alias("up"), F.col("least").alias("parent_conv_id"))
    spread = whole.join(parents, "up", "left").join(lists, "key", "left")
    spread = spread.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                           F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"))
    return closed.unionByName(spread)


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """The nodes (see ``trie_nodes``) of all conversations, each rebuilt with the first turns of its group's first (see ``rebuilt``).

    Null roles and texts are empty, and two turns are one when role and text are equal. Turns are ordered by ``turn``, null first, ties
    by role and then by the turn's SHA-256; repeated rows are turns each. Rows without a conv_id belong to no conversation and are left
    out; a conversation that is left without turns is a member of the root alone. Other columns are not read. An empty table has no
    nodes. Long texts are only hashed; a conversation is 20 bytes a turn, in one task.
    """
    ws = workspace(conversations.sparkSession)
    stored = ws.materialize(sequences(conversations), "sequences")
    return trie_nodes(ws.materialize(rebuilt(stored, group, most), "rebuilt"))
