"""Pairs of 64-bit fingerprints within a radius: pigeonhole blocks, then bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bucket should hold about this many rows on average; more equal blocks are asked for where there would be more.
BUCKET_ROWS = 2048
#: Buckets above this are cut into chunks, and each pair of chunks is compared on its own.
CHUNK_ROWS = 1 << 16
#: One in so many fingerprints tells how large buckets are.
SAMPLE = 64
#: Rows that a task gathers before it compares them, besides the rest of the last bucket.
GATHER_ROWS = 1 << 16
#: Order of the planes: spread, so that the equal bits of a bucket's mask don't come first together.
ORDER = [k + 16 * n for k in range(16) for n in range(4)]
#: Planes compared between two looks at which rows may still match.
LOOK = 8


def combined(blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` from 64 bits cut into ``blocks``."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << cuts[k + 1]) - (1 << cuts[k]) for k in range(blocks)]
    return [sum(x) for x in combinations(parts, agree)]


def masks(radius: int, rows: int) -> list[int]:
    """Bit masks such that fingerprints within radius agree on all bits of one at least.

    64 bits are cut into radius + m blocks; at most radius of them differ, so
    m agree. m is the least for which a bucket holds BUCKET_ROWS rows or fewer
    on average if bits are even; every m finds all pairs.
    """
    for m in (1, 2, 3):
        if rows / 2 ** (64 * m / (radius + m)) <= BUCKET_ROWS:
            break
    return combined(radius + m, m)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes: [block, bit] holds that bit of 64 fingerprints as one word, lane k for the k-th."""
    n = -(-len(fp) // 64)
    padded = np.zeros(n * 64, dtype=np.uint64)
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 64, 8), axis=2, bitorder="little")
    lanes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(lanes).view(np.uint64).reshape(n, 64)


def matches(fp: np.ndarray, start: np.ndarray, radius: int, rows: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) index arrays of all pairs j < i of one bucket within radius bits (radius at most 15).

    ``start`` is the index of the first row of each row's bucket. Each row is
    compared with 64 earlier rows at once, plane by plane: vertical counters
    of four bits and an overflow bit are updated by carry-save steps, and a
    row leaves as soon as all its 64 distances exceed the radius.
    """
    planes = planes_of(fp)
    index = np.arange(len(fp))
    block, first = index >> 6, start >> 6
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    below = (one << (index & 63).astype(np.uint64)) - one
    from_start = full << (start & 63).astype(np.uint64)
    back = 0
    who = index[start < index]
    while len(who):
        for at in range(0, len(who), rows):
            i = who[at : at + rows]
            b = block[i] - back
            valid = np.where(b == first[i], from_start[i], full)
            if not back:
                valid &= below[i]
            own = fp[i]
            c1, c2, c4, c8, over = (np.zeros(len(i), dtype=np.uint64) for _ in range(5))
            gone = ~valid
            for step, bit in enumerate(ORDER):
                diff = planes[b, bit] ^ (np.uint64(0) - ((own >> np.uint64(bit)) & one))
                k1 = c1 & diff
                c1 ^= diff
                k2 = c2 & k1
                c2 ^= k1
                k4 = c4 & k2
                c4 ^= k2
                over |= c8 & k4
                c8 ^= k4
                if step % LOOK == LOOK - 1:
                    gone |= _above((c8, c4, c2, c1), over, radius)
                    alive = gone != full
                    if not alive.any():
                        break
                    if alive.mean() < 0.7:
                        i, b, own, c1, c2, c4, c8, over, gone = (x[alive] for x in (i, b, own, c1, c2, c4, c8, over, gone))
            left = ~gone
            hit = left != 0
            if hit.any():
                i, b, left = i[hit], b[hit], left[hit]
                lanes = np.unpackbits(left.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, lane = np.nonzero(lanes)
                yield i[row], b[row] * 64 + lane
        back += 1
        who = who[block[who] - back >= first[who]]


def _above(counts: tuple[np.ndarray, ...], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (four bits and overflow) is above radius."""
    above, equal = over.copy(), ~over
    for plane, weight in zip(counts, (8, 4, 2, 1), strict=True):
        if radius & weight:
            equal = equal & plane
        else:
            above = above | (equal & plane)
            equal = equal & ~plane
    return above


def first_met(i: np.ndarray, j: np.ndarray, fp: np.ndarray, t: np.ndarray, own: list[int]) -> np.ndarray:
    """Which pairs meet under no mask before their own, so that each is handled once."""
    apart, at = fp[i] ^ fp[j], t[i]
    keep = np.ones(len(i), dtype=bool)
    for k, m in enumerate(own):
        keep &= (at <= k) | (apart & np.uint64(m) != 0)
    return keep


class Union:
    """Least-index labels under joined pairs, with arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def exploded(rows: DataFrame, own: list[int]) -> DataFrame:
    """rows once for each mask, with its number t."""
    return rows.withColumn("t", F.explode(F.array(*[F.lit(t).cast("smallint") for t in range(len(own))])))


def in_buckets(rows: DataFrame, own: list[int], work: Callable, schema: str, gather: int = GATHER_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """What ``work(table, fp, start)`` yields for tables of whole buckets of ``rows`` (with t and a bigint fp).

    A bucket holds the rows of one mask that agree on its bits. Sizes of
    buckets are estimated from one in SAMPLE fingerprints; a bucket of over
    ``chunk_rows`` rows is cut into chunks by hash, and each pair of its chunks
    becomes a bucket of its own, so that no task has to hold more than two
    chunks of it. The estimate only shapes tasks: every pair meets either way.
    ``gather`` rows are handed to work at once, or more where a bucket is larger.
    """
    bits = F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(_signed(m)).cast("bigint") for m in own]), F.col("t") + 1))
    some = rows.filter(F.pmod(F.xxhash64("fp", F.lit(9)), F.lit(SAMPLE)) == 0).select("t", bits.alias("k"))
    large = some.groupBy("t", "k").count().filter(F.col("count") * SAMPLE > chunk_rows)
    large = large.select(F.col("t").alias("__gs_t"), F.col("k").alias("__gs_k"), F.ceil(F.col("count") * SAMPLE / chunk_rows).cast("int").alias("__gs_n"))
    if large.isEmpty():
        tiled = rows.withColumn("__gs_tile", F.lit(0).cast("bigint"))
    else:
        chunk = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("__gs_n")).cast("bigint")
        others = F.transform(F.sequence(F.lit(0), F.col("__gs_n") - 1), lambda x: F.least(x.cast("bigint"), F.col("__gs_c")) * F.lit(1 << 31) + F.greatest(x.cast("bigint"), F.col("__gs_c")))
        joined = rows.join(large, (F.col("t") == F.col("__gs_t")) & (bits == F.col("__gs_k")), "left").withColumn("__gs_c", F.coalesce(chunk, F.lit(0).cast("bigint")))
        tiled = joined.withColumn("__gs_tile", F.explode(F.when(F.col("__gs_n").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(others))).select(*rows.columns, "__gs_tile")
    key = ["t", "__gs_k", "__gs_tile"]
    dealt = tiled.repartition("t", bits, "__gs_tile").withColumn("__gs_k", bits).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= gather:
                table = pa.Table.from_batches(held).combine_chunks()
                new = _changes(table, key)
                if len(new) > 1:
                    cut = int(new[-1])
                    yield from done(table.slice(0, cut), new[:-1])
                    held = table.slice(cut).combine_chunks().to_batches()
                    count = table.num_rows - cut
        if count:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from done(table, _changes(table, key))
        pa.default_memory_pool().release_unused()

    def done(table: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.append(new, table.num_rows))
        start = np.repeat(new, sizes)
        more = np.repeat(sizes > 1, sizes)
        if not more.any():
            return
        table = table.filter(pa.array(more)).combine_chunks()
        sizes = sizes[sizes > 1]
        start = np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
        fp = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        yield from work(table, fp, start)

    return dealt.mapInArrow(run, schema)


def _changes(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where a new bucket begins."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in key:
        x = table[c].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def links_within(fps: DataFrame, radius: int, n: int) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``fps`` (fp) that join exactly those linked by chains of pairs within radius.

    In each bucket a row is linked to the least one that it reaches there, so
    the links grow with the rows and not with the pairs.
    """

    own = masks(radius, n)

    def work(table: pa.Table, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        union = Union(len(fp))
        for i, j in matches(fp, start, radius):
            union.join(i, j)
        hung = np.flatnonzero(union.label != np.arange(len(fp)))
        if len(hung):
            yield pa.RecordBatch.from_arrays([pa.array(fp[hung].view(np.int64)), pa.array(fp[union.label[hung]].view(np.int64))], names=["u", "v"])

    return in_buckets(exploded(fps.select("fp"), own), own, work, "u bigint, v bigint").distinct()
