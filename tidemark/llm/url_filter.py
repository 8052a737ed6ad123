"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A list entry is a (host, path) rule that holds for the host, its subdomains and every path that starts with its
path, or a whole canonical URL. Hosts are compared in lower case. A URL is expanded into the few keys under which a list could hold it; each key
probes one 64-bit block of the filter, and what passes is joined exactly with the list. So the list's strings meet
only the keys that the filter lets through.

Null and malformed URLs have empty host and path and match nothing. Repeated rows give repeated results. An empty
list allows everything. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, PROBES = 16, 4
#: A filter or list of at most so many rows (16 bytes a block; some hundred bytes an entry) may be broadcast.
BROADCAST_ROWS = 100_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case, without scheme, ``www.``, query, fragment, ``index.html`` and a closing slash."""
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """PROBES bits of one 64-bit block, from a hash that doesn't depend on the block's."""
    h = F.xxhash64(F.lit("bits"), key)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(h, 6 * i), F.lit(64)).cast("int"))
    out = one(0)
    for i in range(1, PROBES):
        out = out.bitwiseOR(one(i))
    return out


def bloom(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The blocked filter of column ``key``: (block, bits), at most one row a block."""
    blocks = max(1, -(-n * BITS_PER_KEY // 64))
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("bits")), blocks


def _bounded(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url) judged by rules(host, path, verdict) and by listed(url), which blocks.

    Returns page_id, url, host, path, rule, verdict. The longest rule that fits wins; without one, a URL whose
    canonical form is listed is blocked, any other is allowed.
    """
    entries = rules.select(F.concat(F.lit("r"), F.translate("host", UPPER, LOWER), F.lit("\n"), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    if listed is not None:
        exact = listed.where("url is not null").select(F.concat(F.lit("u"), canonical(F.col("url"))).alias("key"))
        entries = entries.unionByName(exact.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    entries = entries.where("key is not null").groupBy("key").agg(F.min("rule").alias("rule"), F.min("verdict").alias("verdict"))
    n = entries.count()
    lengths = [r[0] for r in rules.where("path is not null").select(F.length("path")).distinct().collect()]  # as many as lengths of paths
    filt, blocks = bloom(entries, n)

    urls = pages.select("url").where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths_ = F.filter(F.lit(sorted(lengths)).cast("array<int>"), lambda k: k <= F.length("path"))
    ruled = F.flatten(F.transform(lengths_, lambda k: F.transform(suffixes, lambda s: F.concat(F.lit("r"), s, F.lit("\n"), F.substring(F.col("path"), F.lit(1), k)))))
    keys = F.concat(F.array(F.concat(F.lit("u"), canonical(F.col("url")))), ruled)
    probes = urls.where("host <> ''").select("url", F.explode(F.array_distinct(keys)).alias("key"))
    probes = probes.withColumns({"block": _block(F.col("key"), blocks), "want": _mask(F.col("key"))})
    passed = probes.join(_bounded(filt, blocks), "block").where("bits & want = want").select("url", "key")
    hits = passed.join(_bounded(entries, n), "key")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.col("rule").isNotNull(), F.length("rule"), "rule")).alias("hit"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
