"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact join, with DataFrame functions only.

A listed URL sets one bit in each of the eight words of one block, chosen by its hash; blocks are built by ``bit_or`` and are joined to
the URLs by their number, so one look-up reads one row. What the filter lets pass goes on to a hash join on the canonical URL itself,
which removes the false positives. The filter has at most ``max_blocks`` blocks, so its broadcast is bounded however long the list is;
a longer list lets more URLs pass to the join, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, workspace

WORDS = 8
#: Bits of the filter for a listed URL, and the most blocks of 512 bits: about 9 MB of bits.
BITS_PER_URL, MAX_BLOCKS = 12, 1 << 17
#: Parameters that tell where a visitor came from, not what is shown.
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref)(=|$)"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def lower_ascii(text) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null and without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url) -> Column:
    """From the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url) -> Column:
    """What is left of a URL when scheme, default port, ``www.``, closing slashes, tracking parameters, the order of the others and the
    fragment do not count; null for null and without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    query = F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(kept, "&")
    whole = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says. A rule is (``allow`` or ``block``, host and path in one text); it fits its host and
    all subdomains of it if the path starts with the rule's. Of one text with both words, ``block`` counts."""
    text = action = F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        text, action = F.when(fits, rule).otherwise(text), F.when(fits, says).otherwise(action)
    return text, action


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def masks(key: Column) -> list[Column]:
    """One bit for each word of the block."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit(k)) for k in range(WORDS)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The blocks of the filter of column ``key`` that are not empty: block, w0 ... w7."""
    marked = keys.select(block_of(F.col("key"), n_blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(masks(F.col("key")))))
    return marked.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)))


def n_blocks_for(n_urls: int, max_blocks: int = MAX_BLOCKS) -> int:
    return min(max_blocks, max(1, -(-n_urls * BITS_PER_URL // (64 * WORDS))))


def maybe_listed(rows: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Rows with a column ``key``, and whether the filter lets them pass as ``maybe``. Few of those not listed do."""
    joined = rows.withColumn("block", block_of(F.col("key"), n_blocks)).join(F.broadcast(blocks), "block", "left")
    passes = F.col("key").isNotNull()
    for k, m in enumerate(masks(F.col("key"))):
        passes = passes & (F.col(f"w{k}").bitwiseAND(m) == m)
    return joined.select(*rows.columns, F.coalesce(passes, F.lit(False)).alias("maybe"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] | None = None, key: str = "page_id", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """One row per row of ``pages``: its key, host, path, rule, verdict, canonical, listed.

    ``verdict`` is that of the longest rule that fits (see ``rule_for``); without one a URL whose canonical form ``listed`` (column url)
    has is blocked, and any other allowed; ``listed`` says whether it was looked up and found. A null url, and one without ``://``, has an
    empty host and path, fits no rule and is on no list, so it is allowed; so does such a row of the list list nothing. Repeated rows are
    judged each, also if one URL makes up most of them; an empty list blocks nothing; no pages, no rows. Other columns are not read.
    """
    ws = workspace(pages.sparkSession)
    wanted = ws.materialize(listed.select(canonical(F.col("url")).alias("key")).filter("key is not null").distinct(), "listed")
    n_blocks = n_blocks_for(wanted.count(), max_blocks)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("key"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules or [])
    rows = rows.withColumns({"rule": rule, "says": says})
    told = rows.filter("says is not null").withColumn("listed", F.lit(False))
    asked = ws.materialize(maybe_listed(rows.filter("says is null"), bloom_blocks(wanted, n_blocks), n_blocks), "asked")
    passed = asked.filter("maybe").drop("maybe")
    total = passed.count()
    found = ws.materialize(passed.groupBy("key").agg(F.count("*").alias("n")).join(wanted, "key", "left_semi"), "found")
    judged = join_groups(passed, found, ["key"], "n", total).withColumn("listed", F.col("n").isNotNull()).drop("n")
    out = told.unionByName(asked.filter("not maybe").drop("maybe").withColumn("listed", F.lit(False))).unionByName(judged)
    verdict = F.coalesce("says", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.col("key").alias("canonical"), "listed")


#: At least one in this many characters of a page is a mark that prose hardly uses.
JUNK_SHARE = 25


def junk_pages(pages: DataFrame) -> DataFrame:
    """The URLs of pages whose HTML is crowded with marks, as a list for ``filter_urls``; a null page is none."""
    marks = F.length("html") - F.length(F.translate("html", "%#*$", ""))
    return pages.filter((F.length("html") > 0) & (marks * JUNK_SHARE >= F.length("html"))).select("url")
