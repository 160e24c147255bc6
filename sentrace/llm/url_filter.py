"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A listed entry is a host and a path prefix with a verdict. Every URL yields one key for each
pair of a host suffix (cut at dots) and a path prefix whose length some listed path has. Keys
that miss the filter are dropped by bit tests; the rest meet the list in an exact join, so a
false positive never reaches the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrace.llm.session import free_name

BITS_PER_KEY = 16
WORDS_PER_BLOCK = 4  # 64-bit words; one block is 256 bits
PROBES = 6
MAX_BLOCKS = 1 << 18  # 8 MB: the proven bound of what is broadcast
MAX_PATH_LENGTHS = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Text after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty without '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, probe: int) -> Column:
    """Position of one probe inside a block, by double hashing."""
    first, second = F.hash(key), F.hash(key, F.lit("second"))
    return F.pmod(first.cast("long") + F.lit(probe) * second.cast("long"), F.lit(64 * WORDS_PER_BLOCK)).cast("int")


def _mask(key: Column, word: int) -> Column:
    """The bits that ``key`` sets in one word of its block."""
    bits = [
        F.when(
            F.floor(_bit(key, p) / 64) == word, F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key, p) % 64)
        ).otherwise(F.lit(0).cast("long"))
        for p in range(PROBES)
    ]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """One row per non-empty block: its number and its words."""
    column = F.col(key)
    words = [F.bit_or(_mask(column, w)).alias(f"word{w}") for w in range(WORDS_PER_BLOCK)]
    return keys.groupBy(_block(column, blocks).alias("block")).agg(*words)


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    *,
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """``pages`` with host, path, rule and verdict of each URL.

    ``listed`` has (host, path, verdict). An entry fits its host and all subdomains of it if
    the path of the URL starts with the entry's path; the longest entry (host and path
    together, then the host) wins, and of repeated entries the smallest verdict. A URL that
    no entry fits gets rule null and verdict ``default``. A null URL, or one without '://',
    has an empty host and path, which nothing fits. Entries with a null or empty host, a null
    path or verdict take no part. Repeated URLs are judged once and every row is kept;
    columns of ``pages`` named like a result column are replaced, others are kept.

    The distinct path lengths of the list, and its numbers of host labels, decide which prefixes and
    suffixes are tried; more than
    ``MAX_PATH_LENGTHS`` raise an error instead of being cut.
    """
    rules = (
        listed.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
    )
    rules = rules.select(
        F.concat_ws("\n", "host", "path").alias("rule_key"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        F.length("path").alias("path_length"),
        (F.length("host") - F.length(F.translate("host", ".", "")) + 1).alias("labels"),
        "verdict",
    )
    facts = rules.groupBy("path_length").count().limit(MAX_PATH_LENGTHS + 1).collect()  # one row per length
    if len(facts) > MAX_PATH_LENGTHS:
        raise ValueError("too many different path lengths in the list")
    lengths, total = sorted(r["path_length"] for r in facts), sum(r["count"] for r in facts)
    blocks = min(MAX_BLOCKS, max(1, math.ceil(total * BITS_PER_KEY / (64 * WORDS_PER_BLOCK))))

    address = free_name(pages, "page_url")
    rows = pages.withColumn(address, F.col(f"`{url}`").cast("string"))
    urls = rows.select(F.col(address).alias("page_url")).where(F.col("page_url").isNotNull()).distinct()
    urls = urls.select("page_url", host_of(F.col("page_url")).alias("host"), path_of(F.col("page_url")).alias("path")).where("host <> ''")
    # A host is cut only where some listed host begins, so a long one costs one step for each number of labels in the list.
    depths = sorted(r["labels"] for r in rules.select("labels").distinct().collect())  # one row per number of labels
    suffixes = F.array(*[F.substring_index("host", ".", -n) for n in depths]) if depths else F.array().cast("array<string>")
    keys = urls.select("page_url", F.explode(F.array_distinct(suffixes)).alias("suffix"), "path").where("suffix <> ''")
    keys = keys.select("page_url", "suffix", "path", F.explode(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).alias("cut"))
    keys = keys.where(F.col("cut") <= F.length("path")).select(
        "page_url", F.concat_ws("\n", "suffix", F.expr("substring(path, 1, cut)")).alias("key")
    )
    filter_table = bloom_blocks(rules, "rule_key", blocks)  # at most MAX_BLOCKS rows
    probed = keys.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filter_table), "block")
    hit = F.lit(True)
    for w in range(WORDS_PER_BLOCK):
        mask = _mask(F.col("key"), w)
        hit = hit & (F.col(f"word{w}").bitwiseAND(mask) == mask)
    possible = probed.where(hit).select("page_url", "key")
    found = possible.join(rules, possible.key == rules.rule_key)
    best = found.groupBy("page_url").agg(
        F.max(F.struct((F.col("host_length") + F.col("path_length")).alias("n"), "host_length", "rule", "verdict")).alias("best")
    )
    best = best.select("page_url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    kept = [c for c in rows.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    out = rows.select(*[F.col(f"`{c}`") for c in kept]).alias("p").join(best.alias("b"), F.col(f"p.{address}") == F.col("b.page_url"), "left")
    return out.select(
        *[F.col(f"p.`{c}`") for c in kept if c != address],
        host_of(F.col(f"p.{address}")).alias("host"),
        path_of(F.col(f"p.{address}")).alias("path"),
        F.col("b.rule").alias("rule"),
        F.coalesce("b.verdict", F.lit(default)).alias("verdict"),
    )
