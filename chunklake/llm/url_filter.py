"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of ``blocks`` rows, each of four 64-bit words; a key sets one bit in each
word of one block. Pages probe it with one join on the block number; only possible hits reach the
exact join with the list, which removes the false positives. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Keys that a block of 256 bits holds on average (16 bits a key, about 0.3 % false positives).
KEYS_PER_BLOCK = 16
#: A filter of so many blocks (32 bytes of words each) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 131_072
#: Keys over which rows without a possible partner are spread.
SPREAD = 1 << 20


@dataclass(frozen=True)
class Rule:
    """``action`` for a host, its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, closing slashes, fragment and ``utm_`` fields.

    The fields of the query that remain are sorted. Null, or no ``://``: null, which is never listed.
    """
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda x: ~x.startswith("utm_") & (x != "")))
    text = F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))
    return F.when(F.instr(url, "://") > 0, text)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, else null; equal lengths go by text."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, action = F.when(fits, r.text).otherwise(text), F.when(fits, r.action).otherwise(action)
    return text, action


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")) for i in range(4)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: ``block`` and the words ``w0`` to ``w3``; empty blocks have no row."""
    masks = _masks(F.col(key))
    return keys.groupBy(_block(F.col(key), blocks).alias("block")).agg(*(F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """Judge every row of ``pages``: ``id, host, path, rule, verdict, listed``.

    ``listed`` holds the URLs to block; repeated, null and malformed ones are harmless. A rule that
    fits decides; else a page is blocked exactly if its canonical URL is listed. Pages with a null
    or malformed URL have empty host and path and are allowed; repeated pages keep their rows; an
    empty list allows all; other columns of either table are not looked at, so names can't clash.
    """
    keys = materialise(listed.select(canonical_url(F.col(listed_col)).alias("key")).where(F.col("key").isNotNull()).distinct())
    blocks = max(1, -(-keys.count() // KEYS_PER_BLOCK))
    bloom = bloom_blocks(keys, "key", blocks)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("key"), F.pmod(F.xxhash64(F.col(id_col), url), F.lit(SPREAD)).alias("salt"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    # Rows that can have no partner are spread over keys that don't exist, so that no task gets them all.
    rows = rows.withColumns({"rule": rule, "action": action, "block": F.coalesce(_block(F.col("key"), blocks), -1 - F.col("salt"))})
    probed = rows.join(F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom, "block", "left")
    for i, m in enumerate(_masks(F.col("key"))):
        probed = probed.withColumn(f"m{i}", m)
    possible = F.coalesce(reduce(and_, (F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(4))), F.lit(False)) & F.col("key").isNotNull()
    probed = probed.select(id_col, "host", "path", "rule", "action", F.when(possible, F.col("key")).alias("key"), F.when(possible, 0).otherwise(F.col("salt")).alias("salt"))
    both = probed.join(keys.select("key", F.lit(0).alias("salt"), F.lit(True).alias("listed")), ["key", "salt"], "left")
    listed_now = F.coalesce(F.col("listed"), F.lit(False))
    verdict = F.coalesce(F.col("action"), F.when(listed_now, "block").otherwise("allow"))
    return both.select(id_col, "host", "path", "rule", verdict.alias("verdict"), listed_now.alias("listed"))
