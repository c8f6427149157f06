"""URL filter: a blocked Bloom filter before an exact hash join.

The list holds keys (host, path prefix) with a verdict.  A URL's candidate keys are
the suffixes of its host with prefixes of its path, of those sizes only that occur in
the list, and its own canonical form.  A list with more than ``SIZES`` pairs of sizes makes candidates
for each suffix of a host and each length that a prefix has with as many labels, by a join with the
table of sizes instead of an expression for each.  A key's hash picks a block of four
words and eight bits in it; candidates whose bits are all set pass to the exact
hash join with the list, which removes false positives.  The longest key wins.

Native.  The filter's size is known from the counted list: it is broadcast within the
bound and joined by a shuffle on the block number beyond, and likewise the list.
Candidates are narrow and leave the map side only when the filter passes them.

Defined cases: a null URL, or one without ``://``, has an empty host and path; it
fits no key and gets the default verdict; rows that repeat are kept; an empty list
gives every URL the default; an empty table gives no rows; very long URLs are matched whole; columns of
the pages that are named like those of the result (host, path, rule, verdict) are replaced by them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_or_not

#: Rules of the query, as verdict, host and path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BITS_PER_KEY = 16
#: Distinct sizes of rules that become expressions.
SIZES = 64
WORDS = 4
_SEP = "\x01"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(_SEP), path)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _masks(key: Column) -> list[Column]:
    """Two bits in each of the block's words."""
    h = F.xxhash64(F.lit("bits"), key)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(2 * WORDS)]
    return [bit[2 * i].bitwiseOR(bit[2 * i + 1]) for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The blocks that are not empty: block, w0 .. w3.  ``keys`` has a column ``key``."""
    masks = keys.select(_block(F.col("key"), blocks).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def listed_matches(urls: DataFrame, rules: DataFrame, listed: DataFrame | None) -> DataFrame:
    """host, path, rule, verdict of the distinct pairs of host and path that fit a key.

    ``rules``: host, path, rule, verdict (prefixes); ``listed``: host, path (exact, blocked, rule null).
    """
    prefixes = rules.select(_key(F.col("host"), F.col("path")).alias("key"), "rule", "verdict")
    sizes = rules.select(F.size(F.split("host", r"\.")).alias("c"), F.length("path").alias("l")).distinct()
    few = sizes.limit(SIZES + 1).collect()
    entries = prefixes
    if listed is not None:
        exact = listed.select(F.concat(F.lit("="), _key(F.col("host"), F.col("path"))).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"))
        entries = prefixes.union(exact.distinct())
    bytes_of = F.octet_length("key") + F.octet_length(F.coalesce("rule", F.lit(""))) + 100
    count, size = entries.agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    blocks = max(1, count * BITS_PER_KEY // (64 * WORDS) + 1)
    labels = F.split("host", r"\.")
    own = [F.concat(F.lit("="), _key(F.col("host"), F.col("path")))] if listed is not None else []

    def cand(c: Column, n: Column) -> Column:
        fits = (F.size(labels) >= c) & (F.length("path") >= n) & (F.col("host") != "")
        suffix = F.array_join(F.slice(labels, F.greatest(F.size(labels) - c + 1, F.lit(1)), c), ".")
        return F.when(fits, _key(suffix, F.substring(F.col("path"), F.lit(1), n)))

    if len(few) <= SIZES:
        some = urls.select("host", "path", F.explode(F.array_compact(F.array(*own, *(cand(F.lit(r["c"]), F.lit(r["l"])) for r in few)))).alias("key"))
    else:
        lengths = sizes.groupBy("c").agg(F.collect_set("l").alias("ls"))  # a row for each number of labels
        each = urls.select("host", "path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1)))).alias("c")).join(lengths, "c")
        some = each.select("host", "path", F.explode("ls").alias("l"), "c").select("host", "path", cand(F.col("c"), F.col("l")).alias("key")).where("key is not null")
        if own:
            some = some.union(urls.select("host", "path", own[0]))
    probe = some.withColumn("block", _block(F.col("key"), blocks))
    hit = F.lit(True)
    for i, m in enumerate(_masks(F.col("key"))):
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    passed = probe.join(small_or_not(bloom(entries, blocks), min(blocks, count), 8 * (WORDS + 1)), "block").where(hit).select("host", "path", "key")
    sure = passed.join(small_or_not(entries, 1, size), "key")
    best = F.max(F.struct(F.col("rule").isNotNull().alias("ruled"), F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict")))
    return sure.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, keys: list[str] | None = None, url: str = "url", default: str = "allow") -> DataFrame:
    """keys, host, path, rule and verdict, a row for each row of ``pages``."""
    host, path = host_and_path(url)
    kept = [c for c in (keys or pages.columns) if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    matches = listed_matches(parts.select("host", "path"), rules, listed).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "rule", "verdict")
    joined = parts.join(matches, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return joined.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def recrawled(pages: DataFrame, url: str = "url") -> DataFrame:
    """Canonical URLs (host, path) that more than one row of ``pages`` has."""
    host, path = host_and_path(url)
    return pages.select(host.alias("host"), path.alias("path")).where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n")).where("n > 1").select("host", "path")
