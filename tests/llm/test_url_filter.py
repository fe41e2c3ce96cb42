"""The URL filter against a plain version."""

import re

from pyspark.sql import functions as F

from paysieve.llm.queries import _RULES
from paysieve.llm.url_filter import bloom_blocks, filter_urls, junk_pages, maybe_listed, n_blocks_for

URLS = ["https://www.A.example.org/es/1", "http://example.org/es/", "https://x.example.org/en/12?a=1", "https://m.b.com/fr/9", "https://b.com/de", "https://b.com/de/",
        "https://notexample.org/es/1", "https://a.net/Path/?utm_source=f&b=2&a=1#top", "http://www.a.net:80/Path?a=1&b=2&ref=x", "https://a.net/path", "//a.net/x", "", None,
        "https://", "ftp://A.NET", "https://org", "https://user@h.org/", "javascript:alert(1)", "https://a.net/x?u=http://b.org/y", "https://a.net#f", "https://a.net?q",
        "https://é.net/ä?ß=1&&", "x://y://z.org/p", "https://a.net/" + "long/" * 30_000, "https://h.example.org/en/1\nx"]
LISTED = ["https://a.net/Path?b=2&a=1", "http://a.net/x/?u=http://b.org/y", None, "nothing", "https://www.example.org/es", "https://é.net/ä?ß=1", "https://A.net"]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2], m[3] or "") if m else ("", "", "")


def plain_canonical(url):
    if "://" not in (url or ""):
        return None
    host, path, query = parts(url)
    host = re.sub(r"^www\.", "", re.sub(r":(80|443)$", "", host))
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[a-z]+|fbclid|gclid|ref)(=|$)", p))
    return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def plain(url, listed):
    host, path, _ = parts(url)
    best = max(((len(r), s, r) for s, r in _RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])]
                if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    if best:
        return host, path, best[2], best[1], plain_canonical(url), False
    on = plain_canonical(url) is not None and plain_canonical(url) in listed
    return host, path, None, "block" if on else "allow", plain_canonical(url), on


def pages_of(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return df.select("*", *(F.lit(1).alias(c) for c in ("id", "key", "host", "block", "w0", "maybe", "n", "says", "listed", "html")))


def test_against_a_plain_version(spark):
    urls = URLS * 2 + ["https://a.net/Path?b=2&a=1"] * 500                      # one URL that makes up most rows
    listed = {plain_canonical(u) for u in LISTED} - {None}
    for blocks in (1 << 17, 1):
        got = filter_urls(pages_of(spark, urls), pages_of(spark, LISTED), _RULES, max_blocks=blocks).collect()
        assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict, r.canonical, r.listed)) for r in got) == sorted(repr((k, *plain(u, listed))) for k, u in enumerate(urls))


def test_empty_tables(spark):
    none, some = pages_of(spark, URLS).limit(0), pages_of(spark, URLS)
    assert filter_urls(none, some, _RULES).count() == 0
    assert {r.verdict for r in filter_urls(some, none).collect()} == {"allow"}
    assert junk_pages(spark.createDataFrame([("u", None), ("v", ""), ("w", "words %%%%"), ("x", "plain words only")], "url string, html string")).collect() == [("w",)]


def test_filter_never_loses_a_listed_url_and_passes_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("h.net/"), "id").alias("key"))
    listed, n = keys.filter("key < 'h.net/15'"), n_blocks_for(6000)
    seen = maybe_listed(keys, bloom_blocks(listed, n), n).groupBy((F.col("key") < "h.net/15").alias("on"), "maybe").count().collect()
    share = {(r.on, r.maybe): r["count"] for r in seen}
    assert (True, False) not in share and share[False, True] <= 0.02 * (share[False, True] + share[False, False])


def test_main_path_is_native(spark):
    plan = filter_urls(pages_of(spark, URLS), pages_of(spark, LISTED), _RULES)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


