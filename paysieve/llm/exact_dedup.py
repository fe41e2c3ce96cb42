"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Every block of fingerprints sends each owner of a hash range the sorted distinct fingerprints of that range, their gaps in
Golomb-Rice code. The owner answers each message with a bitmap of the fingerprints that occur more than once anywhere. Only the
suspects' texts are shuffled; they are grouped by the text itself, which compares bytes. A group of any size sends one entry per
block, and its texts are aggregated before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWNER_VALUES, docs_of, join_groups, with_replies, workspace

#: Fingerprints in one block of the exchange.
BLOCK_PRINTS = 500_000


# ---- Golomb-Rice code of sorted distinct 64-bit numbers --------------------------------------------------------------


def golomb_encode(values: np.ndarray, low: int = 0) -> tuple[bytes, int]:
    """Gaps of ascending distinct numbers from ``low``: quotients in unary, then remainders of ``k`` bits; returns the code and k."""
    n = len(values)
    gaps = np.diff(np.concatenate([[np.uint64(low)], values.astype(np.uint64)]))
    mean = (int(values[-1]) - low) // n if n else 1
    k = min(63, max(0, (mean * 7 // 10).bit_length() - 1 + (mean * 7 // 10 > 0)))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    bits = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, bits])).tobytes(), k


def golomb_decode(code: bytes, k: int, n: int, low: int = 0) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ones = np.flatnonzero(bits)[:n]
    quotients = np.diff(np.concatenate([[-1], ones])) - 1
    at = int(ones[-1]) + 1 if n else 0
    rest = bits[at:at + n * k].reshape(n, k).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


# ---- the exchange ----------------------------------------------------------------------------------------------------


def _print_blocks(batches):
    """(row, doc_id, fp) to blocks of fingerprints."""
    base, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def row():
        r = np.concatenate([h[0] for h in held])
        f = np.concatenate([h[1] for h in held])
        return pa.RecordBatch.from_pydict({"block": [base + made], "n": [len(r)], "rows": [r.tobytes()], "fps": [f.tobytes()]})

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size >= BLOCK_PRINTS:
            yield row()
            made, held, size = made + 1, [], 0
    if size:
        yield row()


def suspects(prints: DataFrame, ws, total: int) -> DataFrame:
    """``row`` of every row of ``prints`` (row long, fp long) whose fingerprint occurs more than once."""
    owners = max(1, -(-total // OWNER_VALUES))
    stored = ws.materialize(prints.select("row", "fp").mapInArrow(_print_blocks, "block long, n long, rows binary, fps binary"), "prints")
    span = 2**64 // owners + 1

    def split(fps: bytes):
        values, counts = np.unique(np.frombuffer(fps, np.int64).view(np.uint64), return_counts=True)
        cuts = np.searchsorted(values, np.array([o * span for o in range(1, owners)], np.uint64)) if owners > 1 else []
        return values, counts, [0, *map(int, cuts), len(values)]

    def send(batches):
        for b in batches:
            for block, fps in zip(b.column(0).to_pylist(), b.column(1)):
                values, counts, cuts = split(fps.as_py())
                for o in range(owners):
                    part = slice(cuts[o], cuts[o + 1])
                    if n := part.stop - part.start:
                        code, k = golomb_encode(values[part], o * span)
                        yield pa.RecordBatch.from_pydict({"owner": pa.array([o], pa.int64()), "block": [block], "n": [n], "k": pa.array([k], pa.int32()),
                                                          "code": [code], "many": [np.packbits(counts[part] > 1).tobytes()]})

    def decide(g: pa.Table) -> pa.Table:
        low, sizes = g.column("owner")[0].as_py() * span, g.column("n").to_pylist()
        values = np.concatenate([golomb_decode(c.as_py(), k, n, low) for c, k, n in zip(g.column("code"), g.column("k").to_pylist(), sizes)])
        many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=n) for m, n in zip(g.column("many"), sizes)]).astype(bool)
        _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[which[many]] = True
        bits = [np.packbits(f).tobytes() for f in np.split(shared[which], np.cumsum(sizes)[:-1])]
        return pa.table({"owner": g.column("owner"), "block": g.column("block"), "bits": pa.array(bits, pa.binary())})

    def mark(row, replies: pd.DataFrame):
        values, _, cuts = split(row.fps)
        flags = np.zeros(len(values), bool)
        for o, bits in zip(replies["owner"], replies["bits"]):
            n = cuts[o + 1] - cuts[o]
            flags[cuts[o]:cuts[o + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        own = np.frombuffer(row.fps, np.int64).view(np.uint64)
        yield pd.DataFrame({"row": np.frombuffer(row.rows, np.int64)[flags[np.searchsorted(values, own)]]})

    messages = stored.select("block", "fps").mapInArrow(send, "owner long, block long, n long, k int, code binary, many binary")
    replies = messages.groupBy("owner").applyInArrow(decide, "owner long, block long, bits binary")
    return with_replies(stored, replies, mark, "row long")


def normal(text):
    """Lower case of A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, fp.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays
    (null ids lose); of repeated rows with that id exactly one is kept. An empty table gives an empty result.
    """
    ws = workspace(docs.sparkSession)
    text = normal(F.col("text"))
    prints = ws.materialize(docs_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("fp"),
                                                 F.sha2(text, 256).alias("text_sha256")), "fingerprints")
    total = prints.count()
    found = ws.materialize(suspects(prints, ws, total), "suspects")
    named = ws.materialize(prints.join(found, "row", "left_semi"), "named")
    ids = named.select("doc_id").filter("doc_id is not null").distinct()
    base = docs_of(docs)
    # the suspects grow with the input, so the plan is the same at every size
    texts = base.join(ids.hint("merge"), "doc_id", "left_semi").unionByName(base.filter("doc_id is null"))
    # grouping by the text compares its bytes; the count of different texts guards the narrow key used afterwards
    verified = texts.select(normal(F.col("text")).alias("t")).groupBy("t").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
    groups = verified.select(F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("text_sha256")).groupBy("fp", "text_sha256").agg(F.count("*").alias("n_texts"))
    keep = F.max_by(F.struct("doc_id", "row"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "row"))
    sizes = named.groupBy("fp", "text_sha256").agg(F.count("*").alias("group_size"), keep.alias("keep"))
    groups = ws.materialize(groups.withColumn("n_texts", F.when(F.col("n_texts") == 1, 1).otherwise(F.raise_error(F.lit("two texts with one SHA-256"))))
                            .join(sizes, ["fp", "text_sha256"]).filter("n_texts = 1")
                            .select("fp", "text_sha256", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row")), "groups")
    own = F.col("group_size").isNull()
    return (join_groups(prints, groups, ["fp", "text_sha256"], "group_size", total)
            .select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (own | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256", "fp"))


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns, whatever these are called.

    Of equal texts (null counts as empty) the row with the largest doc_id stays, null ids last; of rows repeated with one id and one
    text, one stays. An empty table gives an empty result.
    """
    ws = workspace(docs.sparkSession)
    verdict = ws.materialize(exact_dedup(docs), "verdict").filter("kept").select("doc_id", "fp")
    rows = docs.select(F.struct("*").alias("given"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(normal(F.coalesce("text", F.lit("")))).alias("fp"))
    same = lambda a, b, *cs: [a[c].eqNullSafe(b[c]) for c in cs]
    stay = rows.join(verdict, same(rows, verdict, "doc_id", "fp"), "left_semi")
    repeated = ws.materialize(docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    once = stay.join(repeated, same(stay, repeated, "doc_id"), "left_anti")
    again = stay.join(repeated, same(stay, repeated, "doc_id"), "left_semi").dropDuplicates(["doc_id", "fp"])
    return once.unionByName(again).select("given.*")
