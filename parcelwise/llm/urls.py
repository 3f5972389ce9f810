"""URL filters: a blocked Bloom filter before an exact hash join.

Built-in functions only. Listed canonical URLs set eight bits each in one 256-bit block
(four longs). A URL whose block lacks a bit is not listed; only possible hits join the
list itself, which removes the false positives. Host and path rules come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small

BITS_PER_URL = 16
#: Blocks of the filter (40 bytes each) and listed URLs that may be broadcast.
BROADCAST_BLOCKS = 100_000
BROADCAST_URLS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host and path without scheme, ``www.``, closing slash, query or fragment; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), r"/+$", "")))


def _bits(key: Column) -> tuple[Column, list[Column]]:
    """Hash that picks the block, and the four words of bits."""
    h = F.xxhash64(key, F.lit("bits"))
    pick = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), pick(i))
    return F.xxhash64(key, F.lit("block")), [one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(4)]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3): the filter's blocks that have a bit."""
    block, words = _bits(F.col(key))
    rows = listed.select(F.pmod(block, F.lit(blocks)).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)))


def listed_hits(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """``rows`` with boolean ``listed``: is the column ``key`` among those of ``listed``? Nulls are not."""
    one = saved(listed.select(F.col(key).alias("__key")).where("__key is not null").distinct())
    n = one.count()
    blocks = max(1, n * BITS_PER_URL // 256)
    found = bloom(one, "__key", blocks).withColumnRenamed("block", "__block")
    if blocks <= BROADCAST_BLOCKS:
        found = F.broadcast(found)
    block, words = _bits(F.col(key))
    probe = rows.withColumn("__b", F.when(F.col(key).isNotNull(), F.pmod(block, F.lit(blocks)))).join(found, F.col("__b") == F.col("__block"), "left")
    maybe = F.coalesce(reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(w) == w for i, w in enumerate(words))), F.lit(False))
    probe = probe.withColumn("__maybe", maybe).drop("__b", "__block", "w0", "w1", "w2", "w3")
    possible = probe.where("__maybe").join(small(one, BROADCAST_URLS), F.col(key) == F.col("__key"), "left").withColumn("listed", F.col("__key").isNotNull()).drop("__key")
    return possible.unionByName(probe.where("not __maybe").withColumn("listed", F.lit(False))).drop("__maybe")


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, canonical, listed) of each page.

    rules: (verdict, host, path). A rule fits its host and all its subdomains if the path
    starts with its own; the longest wins, then ``block``, then the first by name. Else a
    page is blocked if its canonical URL is in the column ``canonical`` of ``listed``.
    Null or malformed URLs have no host, fit no rule, and are allowed. Repeated rows stay.
    """
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("canonical"))
    hits = listed_hits(base, listed, "canonical")
    rule = verdict = F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1:])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return hits.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "canonical", "listed")
