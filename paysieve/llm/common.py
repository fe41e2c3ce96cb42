"""Helpers shared by the corpus operators: shared tables, document blocks, word hashes and the hash exchange.

Conventions of all operators here: a null text counts as empty; only the columns an operator names are read, so extra columns
cannot clash; a null ``doc_id`` stands after every other id; repeated rows are separate rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Workspace

#: What a null doc_id is inside numpy arrays.
NO_ID = np.int64(2**63 - 1)
#: Bytes of text in a block of documents; a longer document has a block of its own.
BLOCK_BYTES = 1_000_000
#: Values that one owner of a hash range should get.
OWNER_VALUES = 1_000_000
BLOCK_SCHEMA = "block long, n_docs int, n_bytes long, ids binary, ends binary, body binary"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> Workspace:
    return Workspace(spark)


def docs_of(docs: DataFrame, *more: str) -> DataFrame:
    """The id and the text; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def back(df: DataFrame) -> DataFrame:
    """Null ids again in place of ``NO_ID``."""
    return df.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(int(NO_ID)), F.col("doc_id")))


# ---- blocks of documents -------------------------------------------------------------------------------------------


def blocks(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """Documents bundled in rows of about ``limit`` bytes of compressed text, numbered by task.

    A written table of them gives a later step the documents of a block together, and what is known of the block
    can be joined to it by its number without moving rows of single documents.
    """
    def bundle(batches):
        made, held, size, base = 0, [], 0, TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1)

        def row():
            texts = [x for _, x in held]
            return pa.RecordBatch.from_pydict({
                "block": pa.array([base + made], pa.int64()), "n_docs": pa.array([len(held)], pa.int32()), "n_bytes": pa.array([size], pa.int64()),
                "ids": [np.array([i for i, _ in held], np.int64).tobytes()],
                "ends": [np.cumsum([len(x) for x in texts], dtype=np.int64).tobytes()], "body": [pack.compress(b"".join(texts))]})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, text in zip(ids, batch.column(1)):
                data = text.as_py().encode()
                if held and size + len(data) > limit:
                    yield row()
                    made, held, size = made + 1, [], 0
                held.append((NO_ID if i is None else i, data))
                size += len(data)
        if held:
            yield row()

    return docs_of(docs).mapInArrow(bundle, BLOCK_SCHEMA)


def unpack(ids: bytes, ends: bytes, body: bytes) -> tuple[np.ndarray, list[bytes]]:
    at, data = np.frombuffer(ends, np.int64), zstandard.ZstdDecompressor().decompress(body)
    return np.frombuffer(ids, np.int64), [data[a:b] for a, b in zip([0, *at[:-1]], at)]


# ---- words -----------------------------------------------------------------------------------------------------------

#: The bytes of ``[\x20\x09-\x0D]``; no byte of a longer UTF-8 character is among them.
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BASE = 0x9E3779B97F4A7C15
_MASK = 2**64 - 1
_powers: list[np.ndarray] = []
#: Which bits of eight bytes a word's last few fill.
_TAILS = np.array([2**(8 * k) - 1 for k in range(9)], np.uint64)


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``n``."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some documents as arrays: byte ranges ``starts`` / ``ends`` in ``data``, ``per_doc`` words a document."""

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES):
        self.data = b"\n".join([*texts, b""]) if texts else b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        sep = separators[buf]
        edges = np.flatnonzero(np.concatenate([[not sep[0]], sep[1:] != sep[:-1]]))
        self.starts, self.ends = edges[0::2], edges[1::2]
        at = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.after = np.searchsorted(self.starts, at)              # words before the end of each document
        self.first = np.concatenate([[0], self.after[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        self.per_doc = self.after - self.first
        self.buf = buf

    def keys(self, chunk: int = 1 << 16) -> np.ndarray:
        """A 64-bit key of each word, ``chunk`` words at a time. Equal keys are taken for equal words, so no structure of the bytes may
        bring two words together: up to 32 bytes go through the mixer eight at a time, longer words through a cryptographic hash."""
        out = np.empty(len(self.starts), np.uint64)
        rows = np.lib.stride_tricks.as_strided(np.concatenate([self.buf, np.zeros(8, np.uint8)]), (len(self.buf) + 1, 8), (1, 1))
        for lo in range(0, len(out), chunk):
            starts, size = self.starts[lo:lo + chunk], (self.ends - self.starts)[lo:lo + chunk]
            h = mix(size.astype(np.uint64) + np.uint64(_BASE))
            for k in range(0, 32, 8):
                at = np.flatnonzero(size > k)
                if not len(at):
                    break
                lane = rows[starts[at] + k].view("<u8").ravel() & _TAILS[np.minimum(size[at] - k, 8)]
                h[at] = mix((h[at] ^ lane) + np.uint64(_BASE))
            for i in np.flatnonzero(size > 32):
                word = self.data[starts[i]:starts[i] + size[i]]
                h[i] = np.uint64(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"))
            out[lo:lo + chunk] = h
        return out

    def hashes(self, chunk: int = 1 << 18) -> np.ndarray:
        """A cheaper 64-bit hash of each word, in pieces of ``chunk`` bytes, for features alone: texts can be built whose hashes meet."""
        out, i, n = np.empty(len(self.starts), np.uint64), 0, len(self.starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + chunk, "right")))
            lo, hi = int(self.starts[i]), int(self.ends[j - 1])
            p, q = _power_tables(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.buf[lo:hi].astype(np.uint64) + np.uint64(1)) * p[:hi - lo], out=sums[1:])
            a, b = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = mix((sums[b] - sums[a]) * q[a])
            i = j
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)

    def windows(self, n: int) -> np.ndarray:
        """The positions where ``n`` consecutive words of one document start."""
        return np.flatnonzero(np.arange(len(self.starts)) + n <= np.repeat(self.after, self.per_doc))


def window_hashes(words: np.ndarray, at: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``n`` word hashes from each position."""
    h = np.full(len(at), (salt * 2 + 1) & _MASK, np.uint64)
    step = np.uint64((0xD6E8FEB86659FD93 + 2 * salt) & _MASK)
    for k in range(n):
        h *= step
        h += words[at + k]
    return mix(h)


# ---- which 64-bit values does more than one block, or one block more than once, hold? --------------------------------


class Sent:
    """The distinct values of a block in the order in which they are sent: by owner, then by their upper 40 bits.

    A message holds 5 bytes a value; with the owner's number that is 40 bits and the logarithm of the number of owners, so the
    chance that two different values are taken for one stays the same at any size. It can only report too many values as shared.
    """

    def __init__(self, values: np.ndarray, owners: int):
        key = ((values % np.uint64(owners)) << np.uint64(40)) | (values >> np.uint64(24))
        self.keys, self.which, counts = np.unique(key, return_inverse=True, return_counts=True)
        self.many = counts > 1
        owner = (self.keys >> np.uint64(40)).astype(np.int64)
        self.owners, at = np.unique(owner, return_index=True)
        self.cuts = [*at, len(self.keys)]

    def messages(self):
        for k, o in enumerate(self.owners):
            part = slice(self.cuts[k], self.cuts[k + 1])
            low = (self.keys[part] & np.uint64(2**40 - 1)).astype("<u8")
            yield int(o), low.view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), np.packbits(self.many[part]).tobytes()

    def answer(self, replies: dict[int, bytes]) -> np.ndarray:
        """One flag per value as given to the constructor."""
        flags = np.zeros(len(self.keys), bool)
        for k, o in enumerate(self.owners):
            part = slice(self.cuts[k], self.cuts[k + 1])
            flags[part] = np.unpackbits(np.frombuffer(replies[int(o)], np.uint8), count=part.stop - part.start)
        return flags[self.which]


def owner_count(values: int) -> int:
    return int(min(max(1, -(-values // OWNER_VALUES)), 2**24 - 1))


def shared_replies(messages: DataFrame) -> DataFrame:
    """(owner, block, body, many) to (owner, block, bits): one bit per value of the message, set where the value is shared."""
    def decide(group: pa.Table) -> pa.Table:
        owner, block = group.column("owner"), group.column("block")
        values, many, sizes = [], [], []
        for body, m in zip(group.column("body"), group.column("many")):
            raw = np.frombuffer(body.as_py(), np.uint8).reshape(-1, 5)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :5] = raw
            values.append(wide.view("<u8").ravel())
            many.append(np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(raw)).astype(bool))
            sizes.append(len(raw))
        distinct, which, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = counts > 1
        shared[which[np.concatenate(many)]] = True
        flags = np.split(shared[which], np.cumsum(sizes)[:-1])
        return pa.table({"owner": owner, "block": block, "bits": [np.packbits(f).tobytes() for f in flags]},
                        schema=pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())]))

    return messages.groupBy("owner").applyInArrow(decide, "owner long, block long, bits binary")


def with_replies(stored: DataFrame, replies: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(block row, replies of the block)`` yields frames; a block and its replies meet by the number of the block."""
    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        got = [x for row in left.itertuples(index=False) for x in fn(row, right)]
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return stored.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(one, schema)


# ---- joins with hot keys ---------------------------------------------------------------------------------------------


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one line per group when a few groups may hold most of the rows.

    At most 1000 groups can hold a thousandth of all ``total`` rows each: those are broadcast, a proven bound. Of the others
    no key holds more than a thousandth, so they are joined by an ordinary shuffle. ``rows`` should be a stored table.
    """
    least = max(1, total // 1000)
    hot = groups.filter(F.col(size) > least)
    cold = groups.filter(F.col(size) <= least)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    apart = [c for c in groups.columns if c not in keys]
    first = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot is null").drop("_hot", *apart).join(cold, keys, "left")
    return first.unionByName(rest)


def digest_pieces(pieces: DataFrame, key: str, order: str, body: str, sep: bytes, parts: int, name: str, shown=bytes) -> DataFrame:
    """``key`` (declared as "name type") and ``name``: the SHA-256 of a key's pieces in their order, each ``shown`` as bytes, ``sep`` between.

    The pieces of a key stream through one task, whose state is the hash; so what is hashed is never whole in memory.
    """
    of = key.split()[0]

    def run(batches):
        now, h = None, None
        for b in batches:
            done = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if h is None or k != now:
                    done += [] if h is None else [(now, h.hexdigest())]
                    now, h = k, hashlib.sha256()
                else:
                    h.update(sep)
                h.update(shown(x.as_py()))
            if done:
                yield _digests(done, b.column(0).type)
            kind = b.column(0).type
        if h is not None:
            yield _digests([(now, h.hexdigest())], kind)

    def _digests(rows, kind):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([d for _, d in rows], pa.string())], names=[of, name])

    return pieces.repartition(parts, of).sortWithinPartitions(of, order).select(of, body).mapInArrow(run, f"{key}, {name} string")
