"""URL verdicts: rules by host and path, and a Bloom filter cascade for listed keys.

A key is an address (host and path) or a host; a url is on the list if its address, its
host, or a domain that its host lies under is (a domain is replaced by the corpus's hosts under it). The cascade's first filter holds the listed
keys. Those of the corpus's other keys that pass it by chance go into a second filter, the listed ones
that pass that into a third, and so on until none passes wrongly. As every key of the
corpus was tried, the filters answer exactly for all of them, and a url is judged
by bit tests alone, without a join. Keys are distinct before anything else, so a
hot host is one row. A list too long for filters that every task can hold is split by hash,
with a cascade and a pass over the urls for each part.

Edge cases: a null url, or one without ``://``, has an empty host and path and no
rule, and is allowed; users and ports belong to the host column but not to keys; an empty list
allows all; of two rules that fit, the longer wins, of equally long ones the last by spelling; null page_ids and repeated rows
are judged like others; very long urls are one key; an empty table gives no rows. Columns other than
``page_id`` and ``url`` are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm.common import ascii_lower, cut

#: Host, path, verdict of each rule.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Names; the query lists the addresses of all hosts that have one of them as a part.
LISTED_NAMES = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x")
#: Share of wrong keys that a filter may pass: the first by how many there are of either kind, those after it this.
FALSE_RATE = 1 / 4
#: Listed keys of one cascade: its filters go into every task, and so many keys take some 8 MB.
PART_KEYS = 1 << 22


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (like ``net/``) and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the last to be tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def bare(host: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def address(host: Column, path: Column) -> Column:
    return F.concat(bare(host), F.when(path == "", "/").otherwise(path))


def above(host: Column) -> Column:
    """The host and the domains that it lies under."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))


@dataclass(frozen=True)
class Level:
    """One filter: a table of one row with its 64-bit words."""

    words: DataFrame
    number: int
    bits: int
    hashes: int

    def may_hold(self, key: Column) -> Column:
        words = self.words.scalar()
        bits = (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) for p in places(key, self.number, self.bits, self.hashes))
        return reduce(lambda a, b: a & b, (bit == 1 for bit in bits))


def places(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions by double hashing; halves of 31 bits keep the products within a long."""
    low = F.lit((1 << 31) - 1)
    a, b = (F.xxhash64(key, F.lit(2 * number + i)).bitwiseAND(low) for i in (0, 1))
    return [(a + F.lit(i).cast("long") * b) % F.lit(bits).cast("long") for i in range(hashes)]


def filter_of(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(count * hashes / math.log(2) / 64) * 64)
    at = keys.select(F.explode(F.array(*places(F.col("key"), number, bits, hashes))).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("mask"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(word, "word", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")))).alias("pairs"))
    return Level(cut(row.select(F.col("pairs.mask").alias("words"))), number, bits, hashes)


def cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """The levels that tell ``listed`` (key) from the rest of ``universe`` (key, distinct)."""
    marked = cut(universe.join(listed.select("key", F.lit(True).alias("on_list")).distinct(), "key", "left").select("key", F.coalesce("on_list", F.lit(False)).alias("on_list")))
    held, others = marked.filter("on_list").select("key"), marked.filter("not on_list").select("key")
    levels: list[Level] = []
    rest = others.count()
    while count := held.count():
        # a first filter that passes about as many wrong keys as it holds right ones keeps all filters small
        rate = FALSE_RATE if levels else min(FALSE_RATE, count / max(1, rest) / math.sqrt(2))
        levels.append(filter_of(held, count, rate, len(levels)))
        held, others = cut(others.filter(levels[-1].may_hold(F.col("key")))), held
    return levels


def in_list(key: Column, levels: list[Level]) -> Column:
    """Passing the first filter and not, in turn, the rest of them."""
    return reduce(lambda rest, level: level.may_hold(key) & ~rest, reversed(levels), F.lit(False))


def listed_addresses(pages: DataFrame) -> DataFrame:
    """key: the addresses in ``pages`` (url) whose host has a listed name among its parts."""
    host, path = host_and_path("url")
    named = F.arrays_overlap(F.split(bare(host), r"\."), F.array(*map(F.lit, LISTED_NAMES)))
    return pages.filter(named).select(address(host, path).alias("key")).distinct()


def judge(pages: DataFrame, listed: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each url; ``listed`` (key) names the addresses, hosts and domains to block."""
    host, path = host_and_path("url")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    listed = cut(listed.select("key").distinct())
    hosts = cut(parts.select(bare(F.col("host")).alias("key")).distinct())
    # a listed domain stands for the corpus's hosts under it, so that a url has two keys to test
    listed = listed.unionByName(hosts.select("key", F.explode(above(F.col("key"))).alias("over")).join(listed.select(F.col("key").alias("over")), "over").select("key")).distinct()
    keys = [bare(F.col("host")), address(F.col("host"), F.col("path"))]
    universe = hosts.unionByName(parts.select(keys[1].alias("key")).distinct())
    count = max(1, math.ceil(listed.count() / PART_KEYS))
    parts = parts.withColumn("hit", F.lit(False))
    for number in range(count):

        def part(key: Column, number: int = number) -> Column:
            return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(count)) == number

        levels = cascade(universe.filter(part(F.col("key"))), listed.filter(part(F.col("key"))))
        parts = parts.withColumn("hit", reduce(lambda a, b: a | b, (part(key) & in_list(key, levels) for key in keys), F.col("hit")))
        parts = cut(parts) if count > 1 else parts  # so that no task holds the filters of two parts
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def sql() -> str:
    """The query over ``pages`` in DuckDB's SQL."""
    cases = sorted(RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in cases)
    names = ", ".join(f"'{n}'" for n in LISTED_NAMES)
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
    WITH parts AS (
      SELECT page_id,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {letters}) AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
      FROM pages)
    SELECT page_id, host, path, {rule} AS rule,
           {verdict} WHEN list_has_any(string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.'), [{names}]) THEN 'block' ELSE 'allow' END AS verdict
    FROM parts"""
