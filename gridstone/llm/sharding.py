"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstone.llm.tables import written

#: Logical partitions; beyond so many, each holds more rows than asked for, and a task's sort of them may spill. The driver
#: draws MAX_PARTS * n_shards numbers at most, whatever the input.
MIN_PARTS, MAX_PARTS = 64, 1 << 14
#: The matrix is broadcast up to this many bytes, joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The number of good ones among draws without replacement, by inversion of u in [0, 1).

    The mass is summed outwards from the mode, so the steps grow with the
    standard deviation and not with the numbers of rows.
    """
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    here = math.exp(_log_choose(good, mode) + _log_choose(bad, draws - mode) - _log_choose(good + bad, draws))
    left = right = here
    a = b = mode
    u -= here
    while u >= 0 and (a > low or b < high):
        if b < high:
            right *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= right
            if u < 0:
                return b
        if a > low:
            left *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= left
            if u < 0:
                return a
        if left == 0 and right == 0:
            break
    return mode


def shard_sizes(n: int, n_shards: int) -> list[int]:
    """Row counts at most one apart; the first shards take the remainder."""
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def communication_matrix(rows: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard, drawn as a uniform shuffle would.

    Row sums are the partitions' counts, column sums the shards' sizes.
    """
    rng, left = random.Random(seed), list(sizes)
    matrix = []
    for n in rows:
        total, line = sum(left), []
        for s, size in enumerate(left):
            total -= size
            x = hypergeometric(size, total, n, rng.random()) if n else 0
            n -= x
            line.append(x)
            left[s] -= x
        matrix.append(line)
    return matrix


def shard(df: DataFrame, keys: list[str], n_shards: int = 24, seed: int = 7, rows_per_block: int = 250_000) -> DataFrame:
    """df with shard (0 to n_shards - 1, row counts at most one apart) and slot (gapless from 0 in each shard).

    Law ``rows``. Rows are dealt to logical partitions by a hash of ``keys``,
    which together should tell rows apart. The exact number of rows from each
    partition to each shard is one draw of the multivariate hypergeometric
    law; within its partition a row's random rank tells its shard (local
    permutation), and after the exchange a second random order gives its slot.
    Both orders come from seeded hashes of the keys, so a task that runs again
    yields the same rows. Logical partitions, and blocks of a shard, hold about
    rows_per_block rows (more above MAX_PARTS of them), so no task sorts a whole shard.

    Nulls count as a key value of their own; rows equal in all keys are
    interchangeable; equal texts are dealt independently, as a uniform shuffle
    asks. An empty table gives an empty result. Columns of df named shard or
    slot are replaced.
    """
    df = df.drop("shard", "slot")
    n = df.count()
    parts = min(MAX_PARTS, max(MIN_PARTS, math.ceil(n / rows_per_block)))
    keyed = df.withColumn("__gs_k", F.xxhash64(*[F.col(c) for c in keys], F.lit(seed)))
    keyed = keyed.withColumn("__gs_part", F.pmod(F.xxhash64("__gs_k", F.lit(1)), F.lit(parts)).cast("int"))
    counts = {r[0]: r[1] for r in keyed.groupBy("__gs_part").count().collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shard_sizes(n, n_shards), seed)
    cums = []
    for line in matrix:
        run, cum = 0, []
        for x in line:
            run += x
            cum.append(run)
        cums.append(cum)
    spark = df.sparkSession
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(cums)), "array<array<bigint>>")).alias("__gs_part", "__gs_cum"))
    if parts * n_shards * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    local = Window.partitionBy("__gs_part").orderBy(F.xxhash64("__gs_k", F.lit(2)), "__gs_k", *keys)
    ranked = keyed.withColumn("__gs_r", F.row_number().over(local)).join(table, "__gs_part", "left")
    blocks = max(8, math.ceil(n / n_shards / rows_per_block))
    dealt = ranked.withColumn("shard", F.expr("size(filter(__gs_cum, c -> c < __gs_r))")).drop("__gs_part", "__gs_r", "__gs_cum")
    # The high bits of the second random key tell a row's block, so blocks in order of key form one uniform order.
    dealt = dealt.withColumn("__gs_o", F.xxhash64("__gs_k", F.lit(3)))
    dealt = dealt.withColumn("__gs_b", F.floor(F.shiftrightunsigned("__gs_o", 33) * F.lit(blocks) / F.lit(float(1 << 31))).cast("int"))
    dealt = written(dealt, "dealt")
    sizes = dealt.groupBy("shard", "__gs_b").agg(F.count("*").alias("__gs_n"))
    before = Window.partitionBy("shard").orderBy("__gs_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__gs_b", F.coalesce(F.sum("__gs_n").over(before), F.lit(0)).alias("__gs_start"))
    if blocks * n_shards * 24 <= BROADCAST_BYTES:
        starts = F.broadcast(starts)
    block = Window.partitionBy("shard", "__gs_b").orderBy("__gs_o", "__gs_k", *keys)
    out = dealt.withColumn("__gs_r", F.row_number().over(block)).join(starts, ["shard", "__gs_b"])
    out = out.withColumn("slot", F.col("__gs_start") + F.col("__gs_r") - 1)
    return out.select(*df.columns, "shard", "slot")


def write_shards(sharded: DataFrame, path: str, blocks: int = 8) -> None:
    """One folder for each shard; its files hold rows in order of slot."""
    keyed = sharded.repartition("shard", F.floor(F.col("slot") % F.lit(blocks)))
    keyed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has size 8 and the checksum of no bytes (0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("text_hash"))
    out = shard(thin, ["doc_id", "text_hash", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
