"""Near-duplicate documents by a size-aware heavy-light join on sets of word shingles.

Equal sets are one class first. Of the classes, small (light) sets enumerate the subsets that a partner of each possible size
must share, of a size that the pair of sizes fixes; a shared subset is a link. Large (heavy) sets go to inverted lists: each is
filed under its rarest shingles, as many as any partner must share one of; shingles of one set only are never filed. The boundary
is the size at which the estimated cost of both is least. How many sets hold a shingle is found by an exchange of 5-byte hashes
over all documents.

No list is turned into pairs. Each member is first compared with one pivot of its lists; links merge components. Lists that still
hold several components are cut into tiles of their minor members against all members, tested as a matrix product inside a task,
and only links between components come out. So copies of one text cost one comparison each, and no link between components is missed.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, Sent, Words, back, blocks, join_groups, mix, owner_count, unpack, window_hashes, with_replies, workspace
from .components import components

#: Members and hashes on one side of a tile, columns multiplied at once.
TILE, TILE_VALUES, COLUMNS = 400, 2_000_000, 8192
#: Sizes that may be light at all, and the cost of filing a set once against that of one subset.
LIGHT_MOST, FILE_COST = 24, 4


def overlap(a: int, b: int, percent: int) -> int:
    """Shared shingles that sets of these sizes need: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partners(a: int, percent: int) -> range:
    return range(-(-a * percent // 100), a * 100 // percent + 1)


def filed(a: int, percent: int) -> int:
    """Shingles that a set is filed under: any partner holds one of them among its own."""
    return a - -(-a * percent // 100) + 1


def subsets_of(a: int, percent: int) -> int:
    return sum(comb(a, overlap(a, b, percent)) for b in partners(a, percent) if overlap(a, b, percent) <= a)


def boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest light size: enumerating costs the subsets, filing costs ``FILE_COST`` a shingle and a comparison of the size."""
    cost = lambda x: sum(n * (subsets_of(a, percent) if a <= x else FILE_COST * filed(a, percent) + a) for a, n in sizes.items())
    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


class _Sets:
    """The distinct shingles of each document of a block, ascending: ``values[cuts[i]:cuts[i + 1]]``."""

    def __init__(self, row, shingle: int):
        self.ids, self.texts = unpack(row.ids, row.ends, row.body)
        w = Words([t.translate(LOWER) for t in self.texts])
        h = w.keys()
        at = w.windows(shingle)
        grams, counts = window_hashes(h, at, shingle), np.maximum(0, w.per_doc - shingle + 1)
        ends, parts = np.concatenate([[0], np.cumsum(counts)]), []
        for k, n in enumerate(w.per_doc):
            if n >= shingle:
                part = np.sort(grams[ends[k]:ends[k + 1]])
                parts.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
            elif n:                                                # the whole of a short text is one shingle
                parts.append(window_hashes(h, w.first[k:k + 1], int(n), int(n)))
            else:
                parts.append(np.zeros(0, np.uint64))
        self.parts = parts
        self.sizes = np.array([len(p) for p in parts], np.int64)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        add = lambda salt: np.array([int(mix(p ^ np.uint64(salt)).sum(dtype=np.uint64)) for p in self.parts], np.uint64).view(np.int64)
        return add(0x5851F42D4C957F2D), add(0x14057B7EF767814F)


def _counted(sent: Sent, counts: np.ndarray):
    for k, (owner, body, _) in enumerate(sent.messages()):
        yield owner, body, counts[sent.cuts[k]:sent.cuts[k + 1]].astype("<u4").tobytes()


def _frequencies(g: pa.Table) -> pa.Table:
    """One byte per value of each message: 0 for a shingle of one set, else a step of the logarithm of how many hold it."""
    values, counts, sizes = [], [], []
    for body, c in zip(g.column("body"), g.column("counts")):
        raw = np.frombuffer(body.as_py(), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        values.append(wide.view("<u8").ravel())
        counts.append(np.frombuffer(c.as_py(), "<u4"))
        sizes.append(len(raw))
    _, which = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts))
    step = np.where(total <= 1, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 2))))).astype(np.uint8)
    bits = [x.tobytes() for x in np.split(step[which], np.cumsum(sizes)[:-1])]
    return pa.table({"owner": g.column("owner"), "block": g.column("block"), "steps": pa.array(bits, pa.binary())})


def _reps(right: pd.DataFrame) -> tuple[list[int], list[int]]:
    rows = right[right["idx"].notna()]
    return list(map(int, rows["idx"])), list(map(int, rows["cls"]))


def _tile(g: pa.Table, percent: int) -> pa.Table:
    """The links between components among side 0 and side 1 of a tile, as a forest of component pairs."""
    side, comp = g.column("side").to_numpy(), g.column("comp").to_numpy()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in g.column("shingles")]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        sizes = np.array([len(s) for s in sets], np.int64)
        gather = lambda which: np.concatenate([sets[i] for i in which])
        lv, rv = gather(left), gather(right)
        common = np.intersect1d(lv, rv)
        shared = np.zeros((len(left), len(right)), np.float32)
        for a in range(0, len(common), COLUMNS):
            part = common[a:a + COLUMNS]
            both = []
            for values, rows in ((lv, np.repeat(np.arange(len(left)), sizes[left])), (rv, np.repeat(np.arange(len(right)), sizes[right]))):
                at = np.minimum(np.searchsorted(part, values), len(part) - 1)
                hit = part[at] == values
                m = np.zeros((rows[-1] + 1 if len(rows) else 0, len(part)), np.float32)
                m[rows[hit], at[hit]] = 1
                both.append(m)
            shared[:both[0].shape[0], :both[1].shape[0]] += both[0] @ both[1].T
        n = shared.astype(np.int64)
        linked = (100 * n >= percent * (sizes[left][:, None] + sizes[right][None, :] - n)) & (n > 0)
        i, j = np.nonzero(linked & (comp[left][:, None] != comp[right][None, :]))
        root: dict[int, int] = {}

        def find(v):
            while root.setdefault(v, v) != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for a, b in set(zip(comp[left[i]].tolist(), comp[right[j]].tolist())):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _tiles(sides: DataFrame, sets: DataFrame, ws, percent: int, label: str) -> DataFrame:
    """(grp, side, cls, comp), each member once a side, to edges between components: every left member against every right one.

    A side is cut into chunks by a hash of the member, as many as its rows and hashes need.
    """
    sides = ws.materialize(sides, f"{label}-sides")
    need = lambda s: F.greatest(F.ceil(F.sum((F.col("side") == s).cast("int")) / TILE), F.ceil(F.sum(F.when(F.col("side") == s, F.col("n"))) / TILE_VALUES)).cast("int")
    load = sides.join(sets.select("cls", "n"), "cls").groupBy("grp").agg(need(0).alias("k0"), need(1).alias("k1")).filter("k0 > 0 and k1 > 0")
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("side") == 0, F.col("k0")).otherwise(F.col("k1"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("k1")).otherwise(F.col("k0")) - 1))
    dealt = sides.join(load, "grp").select("grp", "side", "cls", "comp", own.alias("own"), other.alias("other"))
    dealt = dealt.select("grp", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("c0"),
                         F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("c1"), "side", "cls", "comp")
    rows = dealt.join(sets.select("cls", "shingles"), "cls").select("grp", "c0", "c1", "side", "comp", "shingles")
    found = rows.groupBy("grp", "c0", "c1").applyInArrow(lambda g: _tile(g, percent), "a long, b long")
    return ws.materialize(found, f"{label}-links")


def _relabel(member: DataFrame, edges: DataFrame, ws, label: str) -> DataFrame:
    """Components of (cls, comp) after links between components."""
    comps = components(edges, ws)
    joined = member.join(comps.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return ws.materialize(joined.select("cls", F.coalesce("to", "comp").alias("comp")), label)


def ngram_join(docs: DataFrame, shingle: int = 4, percent: int = 85, pivots: int = 2, digests: bool = False) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept of every row; with ``digests`` also text_sha256.

    Words are runs of anything but the six ASCII blanks, A-Z in lower case; a set holds the distinct runs of ``shingle`` words, of a
    shorter text the whole of it. Sets link when 100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id
    reachable by links (null ids stand last), ``class_id`` a number shared by rows with equal sets. A row without words has no
    shingles, no class and itself as component. Repeated rows have equal sets. Of each component exactly one row is ``kept``: of the
    smallest doc_id, and of several rows with that id, or where all ids are null, the one with the smallest digest where digests are
    asked for; a row without words is kept. An empty table gives an empty result.
    """
    if not 50 < percent <= 100 or shingle < 1:
        raise ValueError("percent must be over 50 and at most 100, shingle at least 1")
    ws = workspace(docs.sparkSession)
    stored = ws.materialize(blocks(docs), "blocks")

    def prints(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples(index=False):
                s = _Sets(row, shingle)
                a, b = s.fingerprints()
                made = {"block": np.full(len(s.ids), row.block), "idx": np.arange(len(s.ids), dtype=np.int32), "doc_id": s.ids, "n": s.sizes, "fa": a, "fb": b}
                yield pa.RecordBatch.from_pydict(made | {c: pa.array([hashlib.sha256(t).digest() for t in s.texts], pa.binary()) for c in digest})

    digest = ["text_sha256"] if digests else []
    seen = stored.select("block", "ids", "ends", "body").mapInArrow(prints, "block long, idx int, doc_id long, n long, fa long, fb long" + "".join(f", {c} binary" for c in digest))
    seen = ws.materialize(seen.withColumn("row", F.monotonically_increasing_id()), "sets")
    total = seen.count()
    keys = ["fa", "fb", "n"]
    first = F.min(F.struct("row", "block", "idx"))
    classes = ws.materialize(seen.filter("n > 0").groupBy(*keys).agg(first.alias("f"), F.min(F.struct("doc_id", *digest, "row")).alias("least"), F.count("*").alias("members"))
                             .select(*keys, F.col("f.row").alias("cls"), F.col("f.block").alias("block"), F.col("f.idx").alias("idx"), "least", "members"), "classes")
    sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()}       # at most LIGHT_MOST rows
    light = boundary(sizes, percent)
    values = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    owners = owner_count(values)
    reps = classes.select("block", "idx", F.col("cls").cast("string").alias("cls"))       # text: pandas turns nullable longs into doubles

    def sent_of(s: _Sets, idx: list[int]) -> tuple[Sent, np.ndarray]:
        sent = Sent(np.concatenate([s.parts[i] for i in idx] or [np.zeros(0, np.uint64)]), owners)
        return sent, np.bincount(sent.which, minlength=len(sent.keys))

    def send(row, right):
        idx, _ = _reps(right)
        if idx:
            s = _Sets(row, shingle)
            got = list(_counted(*sent_of(s, idx)))
            yield pd.DataFrame({"owner": [o for o, _, _ in got], "block": row.block, "body": [b for _, b, _ in got], "counts": [c for _, _, c in got]})

    def post(row, right):
        idx, names = _reps(right)
        if not idx:
            return
        s = _Sets(row, shingle)
        sent, _ = sent_of(s, idx)
        told = right[right["owner"].notna()]
        replies = dict(zip(told["owner"].astype(int), told["steps"]))
        steps = np.concatenate([np.frombuffer(replies[int(o)], np.uint8) for o in sent.owners] or [np.zeros(0, np.uint8)])[sent.which]
        ends = np.concatenate([[0], np.cumsum(s.sizes[idx])])
        keys, owner_of, kept = [], [], []
        for k, (i, cls) in enumerate(zip(idx, names)):
            h, step = s.parts[i], steps[ends[k]:ends[k + 1]]
            a, common = len(h), h[step > 0]
            own: list[int] = []
            if a <= light:
                for b in partners(a, percent):
                    need = overlap(a, b, percent)
                    if b <= light and need <= min(a, b, len(common)):
                        tag = np.uint64(min(a, b) * 1_000_003 + max(a, b))
                        own += [int(mix(mix(common[list(c)] + tag).sum(dtype=np.uint64, keepdims=True))[0]) for c in combinations(range(len(common)), need)]
            if a > light or a * 100 >= (light + 1) * percent:
                order = np.lexsort((h, step))[:filed(a, percent)]
                own += h[order][step[order] > 0].tolist()
            if own:
                keys += own
                owner_of += [cls] * len(own)
                kept.append((cls, a, h.tobytes()))
        if kept:
            blank = [None] * len(keys)
            yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "cls": owner_of, "n": np.full(len(keys), -1, np.int64), "shingles": blank})
            yield pd.DataFrame({"key": np.zeros(len(kept), np.int64), "cls": [c for c, _, _ in kept], "n": [n for _, n, _ in kept], "shingles": [b for _, _, b in kept]})

    messages = with_replies(stored, reps, send, "owner long, block long, body binary, counts binary")
    steps = messages.groupBy("owner").applyInArrow(_frequencies, "owner long, block long, steps binary")
    both = reps.unionByName(ws.materialize(steps, "steps"), allowMissingColumns=True)
    posted = ws.materialize(with_replies(stored, both, post, "key long, cls long, n long, shingles binary"), "posted")
    sets = posted.filter("n >= 0").select("cls", "n", "shingles")
    lists = posted.filter("n < 0").select("key", "cls")
    member = ws.materialize(sets.select("cls", F.col("cls").alias("comp")), "member")
    for k in range(pivots):
        inside = lists.join(member, "cls")
        pivot = F.min(F.struct(F.xxhash64("cls", F.lit(k)).alias("h"), "cls", "comp")) if k else F.min(F.struct("cls", "comp"))
        heads = inside.groupBy("key").agg(pivot.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", F.col("p.cls").alias("grp"), F.col("p.comp").alias("pcomp"))
        pairs = inside.join(heads, "key").filter("comp <> pcomp").select("grp", "cls", "comp").distinct()
        own = heads.select("grp", F.lit(0).alias("side"), F.col("grp").alias("cls"), F.col("pcomp").alias("comp")).distinct()
        links = _tiles(pairs.select("grp", F.lit(1).alias("side"), "cls", "comp").unionByName(own), sets, ws, percent, f"pivot-{k}")
        member = _relabel(member, links, ws, f"member-{k}")
    inside = lists.join(member, "cls")
    shares = inside.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("key").agg(F.max(F.struct("c", (-F.col("comp")).alias("m"))).alias("top"), F.count("*").alias("comps")).filter("comps > 1")
    mixed = mixed.select("key", (-F.col("top.m")).alias("grp"))
    all_members = inside.join(mixed, "key").select("grp", "cls", "comp").distinct()
    both_sides = all_members.withColumn("side", F.explode(F.when(F.col("comp") == F.col("grp"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))))
    links = _tiles(both_sides.select("grp", "side", "cls", "comp"), sets, ws, percent, "rest")
    member = _relabel(member, links, ws, "members")
    named = classes.join(member, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = named.groupBy("comp").agg(F.min("least").alias("first")).select("comp", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("keep_row"))
    final = ws.materialize(named.join(least, "comp").select(*keys, "members", F.col("cls").alias("class_id"), "component_id", "keep_row"), "named")
    out = join_groups(seen.select("doc_id", "row", *digest, *keys), final, keys, "members", total)
    component = F.coalesce("component_id", "doc_id")
    return back(out.select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.when(component != F.lit(int(NO_ID)), component).alias("component_id"),
                           (F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"), *digest))


def keep_documents(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """The documents of which ``kept`` is told, with their columns, whatever these are called: one row of each component, and the rows
    without words (null and empty texts among them). An empty table gives an empty result.

    Rows are told apart by id and text, so neither rows without an id nor the rows of a repeated id share a verdict. Rows that are
    equal in both are one component: where one of them stays, the others go.
    """
    ws = workspace(docs.sparkSession)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))
    told = ngram_join(docs, shingle, percent, digests=True).groupBy(own.alias("id"), F.col("text_sha256").alias("sha"))
    told = told.agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("k")).filter("k < n")
    told = ws.materialize(told.select("id", "sha", (F.col("k") > 0).alias("one")), "near-copies")
    by, sha = ["id", "sha"], F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = docs.select(F.struct("*").alias("given"), own.alias("id"), sha.alias("sha"))
    stay, one = rows.join(told, by, "left_anti"), told.filter("one")
    if not one.isEmpty():
        stay = stay.unionByName(rows.join(one, by, "left_semi").dropDuplicates(by).select(*stay.columns))
    return stay.select("given.*")
