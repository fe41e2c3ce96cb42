"""Invisible characters, skeletons and encoded payloads."""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

from . import patterns as P
from .scalars import WS, col

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # executors need no copy of this package
VARIANTS = T.StructType([T.StructField(n, T.StringType()) for n in ("percent", "entity", "tags", "skeleton")])

_FOLD = str.maketrans(P.CONFUSABLES)
_STRIP = re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), P.INVISIBLE))
_PERCENT = re.compile("%([0-9a-fA-F]{2})")
_ENTITY_ANY = re.compile("&#x?[0-9a-fA-F]+;")
_ENTITY_HEX = re.compile("&#x([0-9a-fA-F]+);", re.IGNORECASE)
_ENTITY_DEC = re.compile("&#([0-9]+);")
_TAGS = re.compile("[\U000e0000-\U000e007f]")
_FOLDS = frozenset(P.CONFUSABLES)
_INERT = frozenset(c for c in map(chr, range(0x250)) if unicodedata.is_normalized("NFKC", c) and not _STRIP.match(c) and c not in _FOLDS)
#: Bytes of text that a worker turns into Python strings at a time.
SLICE_BYTES = 4 << 20


def fold_skeleton(text: str) -> str:
    """NFKC, invisible characters removed, look-alike letters folded to Latin."""
    return _STRIP.sub("", unicodedata.normalize("NFKC", text)).translate(_FOLD)


def _code_point(digits: str, base: int) -> str:
    digits = digits.lstrip("0") or "0"                              # padding does not change the character
    n = int(digits, base) if len(digits) < 12 else 0x110000
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else ""


def _folds(text: str) -> bool:
    """Whether a text that is not ASCII differs from its skeleton; most texts are told apart by the few characters they use."""
    return not _INERT.issuperset(text) and (any(c in _FOLDS or _STRIP.match(c) for c in set(text)) or not unicodedata.is_normalized("NFKC", text))


def _variants(text: str | None):
    if text is None:
        return None, None, None, None
    percent = entity = tags = skeleton = None
    if "%" in text and _PERCENT.search(text):
        percent = _PERCENT.sub(lambda m: chr(int(m[1], 16)), text)
    if "&#" in text and _ENTITY_ANY.search(text):
        entity = _ENTITY_DEC.sub(lambda m: _code_point(m[1], 10), _ENTITY_HEX.sub(lambda m: _code_point(m[1], 16), text))
    if not text.isascii():
        if _TAGS.search(text):
            tags = "".join(chr(ord(c) - 0xE0000) for c in text if 0xE0020 <= ord(c) <= 0xE007F) or None
        if _folds(text):
            folded = fold_skeleton(text)
            skeleton = folded if folded != text else None
    return percent, entity, tags, skeleton


def _by_slices(texts: pa.Array, kind: pa.DataType, read) -> pa.Array:
    """``read`` of every text, a bounded number of bytes held as Python strings at a time: a text that is not ASCII takes up to four bytes
    a character there."""
    if not len(texts):
        return pa.array([], kind)
    size = texts.nbytes // len(texts) + 1
    step = max(1, SLICE_BYTES // size)
    return pa.concat_arrays([pa.array([read(t.as_py()) for t in texts.slice(at, step)], kind) for at in range(0, len(texts), step)])


@F.arrow_udf(VARIANTS)
def decode_variants(texts: pa.Array) -> pa.Array:
    """Percent, entity, tag and skeleton readings of each text; null where a reading does not apply."""
    kind = pa.struct([(n, pa.string()) for n in VARIANTS.names])
    return _by_slices(texts, kind, lambda t: dict(zip(VARIANTS.names, _variants(t))))


@F.arrow_udf(T.StringType())
def _skeleton_udf(texts: pa.Array) -> pa.Array:
    return _by_slices(texts, pa.string(), lambda t: None if t is None else fold_skeleton(t) if not t.isascii() and _folds(t) else t)


def not_ascii(text) -> Column:
    """Whether a text holds anything beyond ASCII, by comparing two lengths instead of matching."""
    return F.octet_length(col(text)) > F.length(col(text))


def strip_invisible(text) -> Column:
    return F.when(not_ascii(text), F.regexp_replace(col(text), P.INVISIBLE, "")).otherwise(col(text))


def squeeze(text) -> Column:
    """Text without white space and invisible characters. Blanks and line ends go first, byte-wise; few texts need the rest."""
    t = F.replace(F.replace(col(text), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    rest = rf"[\t\r\x0b\f]|{P.INVISIBLE}|{WS}"
    return F.when(not_ascii(text) | t.rlike(r"[\t\r\x0b\f]"), F.regexp_replace(t, rest, "")).otherwise(t)


def with_skeleton(df, text: str, name: str = "skeleton"):
    """Skeleton of a text column. ASCII rows are their own skeleton and never reach Python."""
    plain = ~F.col(text).rlike(r"[^\x00-\x7f]")
    folded = df.withColumn("_fold", _skeleton_udf(F.when(~plain, F.col(text))))
    return folded.withColumn(name, F.when(plain, F.col(text)).otherwise(F.col("_fold"))).drop("_fold")


def printable(text) -> Column:
    return F.when(col(text).rlike(P.PRINTABLE), col(text))


def from_base64(blob) -> Column:
    """Printable text of a base64 blob (either alphabet, padding optional, a dangling character ignored), else null."""
    body = F.translate(F.regexp_replace(col(blob), "=+$", ""), "-_", "+/")
    whole = F.when(F.length(body) % 4 == 1, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("="))
    return printable(F.unbase64(padded).cast("string"))


def from_hex(blob) -> Column:
    return printable(F.unhex(F.regexp_replace(col(blob), "^0x", "")).cast("string"))


def _first(found: Column, n: int | None) -> Column:
    return found if n is None else F.slice(found, 1, n)


def base64_blobs(text, n: int | None = None) -> Column:
    """All base64-looking blobs, or the first ``n``; wrapped lines are joined before looking."""
    joined = F.regexp_replace(col(text), P.BASE64_JOINT, "")
    return _first(F.regexp_extract_all(joined, F.lit(P.BASE64_BLOB_RUN), F.lit(0)), n)


def hex_blobs(text, n: int | None = None) -> Column:
    return _first(F.regexp_extract_all(col(text), F.lit(P.HEX_BLOB), F.lit(0)), n)


def first_blobs(text, n: int | None = P.MAX_BLOBS) -> Column:
    """The first blobs of a text, as many as the screened protocol reads unless told otherwise."""
    return base64_blobs(text, n)
