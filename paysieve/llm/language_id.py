"""Language identification with bit-sliced Bloom filters of character trigrams.

One array of positions holds, at each position, a bit per language; the AND of the words at a trigram's positions has the bits of
all languages whose filter contains it. A document's count per language is corrected for the false positives that the filter's
fill predicts, and the language with the most trigrams left decides.

What a filter contains is learned from all labelled training rows: trigrams are counted per language on the executors, and a trigram
belongs to each language in which its relative frequency is at least ``SHARE`` of the highest that is sure. Sure is what is left of
a frequency when the label had ``PRIOR`` more trigrams, all of them others: so a label with little text strikes nothing from the
filters of a large one. All such trigrams are kept, and the filters are sized by them: the model grows with the distinct
trigrams of the largest language, not with the number of rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, workspace

#: Hash functions, least positions of the filters, and positions per trigram of the largest filter.
HASHES, POSITIONS, SPREAD = 3, 1 << 19, 16
#: A trigram belongs to a language that uses it at least half as often as any other surely does.
SHARE = 0.5
#: Trigrams that a label's text is thought to lack, when others are held against it.
PRIOR = 100_000
#: Entries that a task holds before it hands on its counts.
HELD = 1_000_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of the lower-cased letters, each run of other characters being one blank, and the number of trigrams per text.

    A trigram's middle is a letter, so none reaches over a blank; a text of letters has one for each letter.
    """
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    sums = np.concatenate([[0], np.cumsum(letter)])
    per_text = np.diff(sums[np.concatenate([[0], np.cumsum([len(t) for t in low])])]) if low else np.zeros(0, np.int64)
    wide = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    mid = np.flatnonzero(letter)
    return (wide[mid - 1] << np.uint64(42)) | (wide[mid] << np.uint64(21)) | wide[mid + 1], per_text


def _pieces(texts: list[str], limit: int = 500_000):
    """Ranges of texts of about ``limit`` characters."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, text) to (lang, gram, n), summed over each task in part."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def hand_on():
            for lang, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], schema=schema)

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in _pieces(own):
                    g, n = np.unique(grams(own[a:b])[0], return_counts=True)
                    if lang in held:
                        g, which = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                        n = np.bincount(which, np.concatenate([held[lang][1], n]), len(g)).astype(np.int64)
                    held[lang] = g, n
            if sum(len(g) for g, _ in held.values()) > HELD:
                yield from hand_on()
                held = {}
        yield from hand_on()

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters: ``slices[word][position]`` has the bits of 64 languages, or of all in a shorter word."""

    def __init__(self, languages: list[str], members: dict[str, np.ndarray], positions: int | None = None, texts: np.ndarray | None = None, usual: np.ndarray | None = None):
        self.languages, self.positions = languages, positions or max(POSITIONS, SPREAD * max(map(len, members.values())))
        self.texts = np.zeros(len(languages)) if texts is None else texts       # trigrams that each was learned from
        self.usual = np.ones(len(languages)) if usual is None else usual        # the score to be expected of its texts
        self.bits = next(b for b in (8, 16, 32, 64) if len(languages) <= b or b == 64)
        self.slices = np.zeros((max(1, -(-len(languages) // self.bits)), self.positions), f"u{self.bits // 8}")
        kind, fill = self.slices.dtype.type, []
        for k, lang in enumerate(languages):
            part = self.slices[k // self.bits]
            own = np.unique(np.concatenate(self._at(members[lang])))
            part[own] |= kind(1 << k % self.bits)
            fill.append(len(own) / self.positions)
        self.false = np.array([f ** HASHES for f in fill])

    def _at(self, g: np.ndarray):
        h = mix(g)
        first, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        return [((first + np.uint64(k) * step) % np.uint64(self.positions)).astype(np.int64) for k in range(HASHES)]

    def hits(self, g: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Texts x languages: trigrams whose mask has the language, less the expected false positives."""
        at, ends = self._at(g), np.concatenate([[0], np.cumsum(per_text)])
        out = np.empty((len(per_text), len(self.languages)))
        for w, part in enumerate(self.slices):
            mask = part[at[0]]
            for a in at[1:]:
                mask &= part[a]
            for k in range(self.bits * w, min(self.bits * (w + 1), len(self.languages))):
                sums = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(k - self.bits * w)) & mask.dtype.type(1), dtype=np.int64)])
                found, f = np.diff(sums[ends]), self.false[k]
                out[:, k] = np.clip((found - per_text * f) / max(1e-9, 1 - f), 0, None)
        return out


    def best(self, hits: np.ndarray) -> np.ndarray:
        """The language with the most hits; of equal ones that learned from the most text, then the first by name."""
        order = np.lexsort((np.arange(len(self.languages)), -self.texts))
        return order[hits[:, order].round(6).argmax(axis=1)]


def learn(rows: DataFrame, share: float = SHARE) -> Filters | None:
    """Filters from labelled rows (lang, text); rows without a language or text are left out. None where nothing is left.

    The score to be expected of a language's texts is the share of its training trigrams that its filter holds, less those that
    occur once: without the row that has them they would not be in it.
    """
    ws = workspace(rows.sparkSession)
    counts = ws.materialize(count_grams(rows.filter("lang is not null and text is not null")), "trigrams")
    part = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("all")), "lang").withColumn("p", F.col("n") / F.col("all"))
    most = part.groupBy("gram").agg(F.max(F.col("n") / (F.col("all") + F.lit(PRIOR))).alias("most"))
    own = part.join(most, "gram").filter(F.col("p") >= F.lit(share) * F.col("most"))
    own = ws.materialize(own.select("lang", "gram", "n", "all"), "members")
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    known = {r["lang"]: r for r in own.groupBy("lang").agg(F.max("all").alias("all"), again.alias("again")).collect()}       # a row a language
    languages = sorted(known)
    got = own.select("lang", "gram").toArrow()                     # the model itself: distinct trigrams, 8 bytes each and the label
    names = got.column("lang").combine_chunks().dictionary_encode()
    which, grams_of = names.indices.to_numpy(), got.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(which, kind="stable")
    parts = np.split(grams_of[order], np.cumsum(np.bincount(which, minlength=len(languages)))[:-1]) if languages else []
    members = dict(zip(names.dictionary.to_pylist(), parts))
    texts = np.array([known[k]["all"] for k in languages], float)
    return Filters(languages, members, texts=texts, usual=np.array([known[k]["again"] for k in languages]) / texts) if languages else None


def identify(docs: DataFrame, model: Filters | None, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, usual of every row; with ``carry`` the whole row as struct ``given`` instead of doc_id.

    ``und`` with score 0 for a null text, one without a letter, or without a model. The score is the share of the text's trigrams
    that the winner's filter holds, corrected for false positives; of equal languages the one learned from more text wins.
    ``usual`` is the score to be expected of a text in the language told.
    """
    names = np.array(model.languages if model else ["und"], object)
    given = docs.select(F.struct(*(F.col(c) for c in (docs.columns if carry else ["doc_id", "text"]))).alias("given"))

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            texts = [t or "" for t in rows.field("text").to_pylist()]
            langs, scores, usual = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in _pieces(texts) if model else ():
                g, n = grams(texts[a:b])
                hits = model.hits(g, n)
                best = model.best(hits)
                langs[a:b], usual[a:b] = np.where(n > 0, names[best], "und"), np.where(n > 0, model.usual[best], 0)
                scores[a:b] = np.clip(hits[np.arange(b - a), best] / np.maximum(n, 1), 0, 1)
            yield pa.RecordBatch.from_arrays([rows if carry else rows.field("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(usual)], names=["given" if carry else "doc_id", "lang_pred", "score", "usual"])

    first = T.StructField("given", given.schema[0].dataType) if carry else T.StructField("doc_id", docs.schema["doc_id"].dataType)
    return given.mapInArrow(run, T.StructType([first, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("usual", T.DoubleType())]))


def is_held_out(doc_id, modulus: int = 3, rest: int = 1):
    """Rows whose label is never learned: the CRC-32 of the id as text has this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))
