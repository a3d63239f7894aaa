"""URL verdicts: a blocked Bloom filter over listed canonical URLs, then an exact hash join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import prepare

#: Eight odd 31-bit multipliers, powers of one so that their bits don't follow each other; each picks one bit of its 32-bit lane.
SALTS = tuple(pow(0x2545F491, k, 1 << 31) | 1 for k in range(1, 9))
#: A block has 256 bits; at 16 bits a key about one probe in a thousand passes by chance.
KEYS_PER_BLOCK = 16
#: The filter never outgrows 32 MB, which suits 16 million keys; up to three times as many, more probes pass (a few in a
#: hundred), and beyond there is no filter. The join removes what passes either way.
MAX_BLOCKS, MOST_PER_BLOCK = 1 << 20, 48

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a page shows (fixed values).
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

#: A page is junk if these symbols, which markup hardly uses, make up over one in SYMBOL_SHARE of its characters.
JUNK_SYMBOLS, SYMBOL_SHARE = "*$%", 50

#: (host, path, verdict)
Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without a leading ``www.``, path without ``.html`` and trailing slashes, and sorted parameters without tracking ones.

    Scheme and fragment do not count. Null or no ``://`` gives null.
    """
    host = F.regexp_replace(host_of(url), "^www\\.", "")
    path = F.regexp_replace(path_of(url), "(\\.html)?/*$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    whole = F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, whole)


def junk_urls(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A list for ``judge``: key, the distinct canonical URLs of pages whose content is mostly symbols.

    What a page holds decides, not how its address looks. Pages with a null
    content or without a canonical URL list nothing.
    """
    body = F.col(html)
    symbols = F.length(body) - F.length(F.translate(body, JUNK_SYMBOLS, ""))
    return pages.filter(F.lit(SYMBOL_SHARE) * symbols > F.length(body)).select(canonical_url(F.col(url)).alias("key")).filter("key is not null").distinct()


class BlockedBloom:
    """Blocks of eight 32-bit lanes; a key sets one bit in each lane of one block."""

    def __init__(self, lanes: np.ndarray):
        self.lanes = lanes

    @staticmethod
    def build(keys: DataFrame, key: str) -> BlockedBloom | None:
        """Lanes are OR-ed by block on the executors, and come to the driver as at most 36 MB of Arrow arrays.

        None where the keys would fill MAX_BLOCKS so far that the filter keeps
        little away; the exact join then sees all rows.
        """
        n = keys.count()
        if n > MAX_BLOCKS * MOST_PER_BLOCK:
            return None
        n_blocks = max(1, min(MAX_BLOCKS, -(-n // KEYS_PER_BLOCK)))
        h = F.xxhash64(key)
        low = h.bitwiseAND(F.lit(0x7FFFFFFF))
        places = [F.shiftright((low * F.lit(s)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for s in SALTS]
        lanes = [F.call_function("shiftleft", F.lit(1), x).alias(f"l{i}") for i, x in enumerate(places)]
        rows = keys.select(F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks)).cast("int").alias("b"), *lanes)
        found = rows.groupBy("b").agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(8)]).toArrow()
        out = np.zeros((n_blocks, 8), dtype=np.uint32)
        at = found["b"].to_numpy()
        for i in range(8):
            out[at, i] = found[f"l{i}"].to_numpy().view(np.uint32)
        return BlockedBloom(out)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may be listed; never false for one that is."""
        h = hashes.astype(np.int64).view(np.uint64)
        block = (h >> np.uint64(32)) % np.uint64(len(self.lanes))
        low = (h & np.uint64(0x7FFFFFFF)).astype(np.uint32)
        hit = np.ones(len(h), dtype=bool)
        for i, salt in enumerate(SALTS):
            bit = (low * np.uint32(salt)) >> np.uint32(27)
            hit &= (self.lanes[block, i] >> bit) & np.uint32(1) == 1
        return hit


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict for each row.

    ``listed`` has a string column ``key`` of canonical URLs to block. Each
    distinct URL looks up its canonical form there, and in the rules each
    suffix of its host with each prefix of its path that is as long as some
    rule's. A Bloom filter of all keys, of bounded size, removes nearly every
    lookup before the exact join; where the keys would overfill it, the join
    sees all lookups. The longest fitting rule decides (equal
    lengths: the longer host); without a rule a listed URL is blocked and any
    other allowed.

    A null URL and one without ``://`` have an empty host and path and are
    allowed. Repeated rows are each judged. A column of pages named like a
    result is replaced.
    """
    spark = pages.sparkSession
    prepare(spark)
    names = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in names]
    lengths = sorted({len(path) for _, path, _ in rules})
    own = spark.createDataFrame([("r" + host + path, host + path, verdict, len(host + path) * 4096 + len(host)) for host, path, verdict in rules], "key string, rule string, verdict string, weight int")
    theirs = listed.filter("key is not null").select(F.concat(F.lit("u"), "key").alias("key")).distinct()
    keys = own.unionByName(theirs.select("key", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict"), F.lit(0).alias("weight")))
    bloom = BlockedBloom.build(keys.select("key"), "key")
    shared = spark.sparkContext.broadcast(bloom.lanes) if bloom else None

    def may_hold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bloom = BlockedBloom(shared.value)
        for h in batches:
            yield pd.Series(bloom.contains(h.to_numpy()))

    probe = F.pandas_udf(may_hold, "boolean")
    col = F.col(url)
    urls = pages.filter(F.instr(col, "://") > 0).select(col.alias("url")).distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("own"))
    labels = F.split("host", "\\.")
    # No suffix of more labels than some rule's host can fit, so a host of very many labels costs no more than its length.
    most = max((host.count(".") + 1 for host, _, _ in rules), default=1)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - (most - 1)), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(F.lit("r"), s, p))))
    looked = parts.select("url", F.explode(F.array_union(F.array(F.concat(F.lit("u"), "own")), pairs)).alias("key"))
    hits = looked.filter(probe(F.xxhash64("key"))) if bloom else looked
    best = F.max_by(F.struct("rule", "verdict"), "weight")
    found = hits.join(keys, "key").groupBy("url").agg(best.alias("best")).select(F.col("url").alias("__gs_url"), F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    base = pages.select(*kept, host_of(col).alias("host"), path_of(col).alias("path"))
    joined = base.join(found, F.col(url) == F.col("__gs_url"), "left")
    return joined.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
