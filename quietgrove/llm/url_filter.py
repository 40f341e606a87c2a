"""URL filter: host and path rules, then a list of URLs behind a blocked Bloom filter.

A list of URLs can be far larger than memory, but nearly no crawled URL is on it. So the
listed canonical URLs set bits in a Bloom filter of bounded size; the filter is broadcast,
and only crawled URLs that hit it go to a hash join with the list itself, which removes the
false positives. Every bit of a key lies in one 512-bit block, so a probe reads one row.

The filter never has more than ``MAX_BLOCKS`` blocks of eight words (32 MB as rows), which
bounds the broadcast. A longer list fills it more densely: more URLs then reach the exact
join, and the result stays the same.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
is never listed; nulls and repeats in the list count for nothing; an empty list blocks nothing.
Every input row comes back once, repeats included, with all its columns; result columns replace
input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.llm.common import free_name, replacing
from quietgrove.scratch import Scratch

WORDS_PER_BLOCK = 8
MAX_BLOCKS = 1 << 18
BITS_PER_KEY = 16


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with all its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case."""
    return ascii_lower(F.coalesce(
        F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One spelling for URLs of the same page; null where there is no host.

    Scheme, ``www.``, default ports, fragment, tracking parameters and a closing slash go;
    the other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"),
                    lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"))
    tail = F.array_join(F.sort_array(kept), "&")
    whole = F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))
    return F.when(host != "", whole)


def matching_rule(host: Column, path: Column, rules: Sequence[UrlRule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each word of the block, from six bits each of a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.shiftrightunsigned(second, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
            for i in range(WORDS_PER_BLOCK)]


def block_count(n_keys: int, bits_per_key: int = BITS_PER_KEY, max_blocks: int = MAX_BLOCKS) -> int:
    return max(1, min(max_blocks, -(-n_keys * bits_per_key // (64 * WORDS_PER_BLOCK))))


def blocked_bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row per block that is not empty: ``block`` and its words."""
    masks = keys.select(_block(F.col(key), n_blocks).alias("block"),
                        *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return masks.groupBy("block").agg(
        *[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])


def filter_urls(df: DataFrame, listed: DataFrame, rules: Sequence[UrlRule] = (), url: str = "url",
                listed_url: str = "url", bits_per_key: int = BITS_PER_KEY,
                max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """Every row of ``df`` with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    The longest rule that fits decides (``allow`` or ``block``); without one, a URL whose
    canonical form is in ``listed`` is blocked and any other allowed.
    """
    scratch = Scratch(df.sparkSession)
    keys = scratch.save(listed.select(canonical_url(F.col(f"`{listed_url}`")).alias("key"))
                        .where("key IS NOT NULL").distinct())
    n_blocks = block_count(keys.count(), bits_per_key, max_blocks)
    bloom = scratch.save(blocked_bloom(keys, "key", n_blocks))

    key = free_name(df, "key")
    rows = df.withColumn(key, canonical_url(F.col(f"`{url}`")))
    probe = F.struct("block", *[f"w{i}" for i in range(WORDS_PER_BLOCK)])
    hit_name = free_name(df, "filter_words")
    probed = rows.join(F.broadcast(bloom.select(probe.alias(hit_name))),
                       _block(rows[key], n_blocks) == F.col(f"{hit_name}.block"), "left")
    hit = reduce(lambda a, b: a & b, [
        F.col(f"{hit_name}.w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_masks(F.col(key)))])
    maybe = probed.where(F.coalesce(F.col(key).isNotNull() & hit, F.lit(False)))
    never = probed.where(~F.coalesce(F.col(key).isNotNull() & hit, F.lit(False)))

    found = free_name(df, "found")
    exact = keys.select(F.col("key").alias(found)).hint("shuffle_hash")
    joined = maybe.join(exact, F.col(key) == F.col(found), "left")
    whole = joined.unionByName(never.withColumn(found, F.lit(None).cast("string")))

    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    is_listed = F.col(found).isNotNull()
    verdict = F.coalesce(matching_rule(host, path, rules, lambda r: r.verdict),
                         F.when(is_listed, "block").otherwise("allow"))
    return replacing(whole, {"host": host, "path": path,
                             "rule": matching_rule(host, path, rules, lambda r: r.text),
                             "verdict": verdict, "listed": is_listed}, keep=df.columns)
