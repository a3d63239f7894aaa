"""Alike lines without loss: rarest word pairs as keys, packed shuffles, word bits, and edit similarity of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.bitsliced import Union, in_buckets
from gridstone.llm.line_words import SIMILARITY, Lines, alike, mixed
from gridstone.llm.tables import discard, written
from gridstone.llm.url_filter import BlockedBloom

#: Words are ordered by how often one in ORDER_SAMPLE texts (by hash) hold them, counted in 2 ** SLOT_BITS slots; the
#: order only shapes buckets.
ORDER_SAMPLE, SLOT_BITS = 16, 22
#: Bits of a word pair's hash, and lines ordered at once.
PAIR_BITS, SLICE_LINES = 40, 1 << 16
#: Keys are dealt in ranges of about RANGE_KEYS, by at most MAX_PARTITIONS partitions, in packs of PACK_KEYS a task.
RANGE_KEYS, MAX_PARTITIONS, PACK_KEYS = 1 << 20, 20_000, 1 << 19
#: Low bits of keys by which those that are alone are told.
KEY_SLOTS = 22
#: Keys of a range held at once; beyond them, those already paired are kept once for each length.
HELD_KEYS = 1 << 22
#: Distinct lines that a task remembers, so that it sends the keys of a very frequent line once.
SEEN = 1 << 18
#: Lines that a task verifies at once, and pairs between two looks at what is connected. Groups of more than VERIFY_CHUNK
#: lines are cut over several tasks.
VERIFY_ROWS, VERIFY_PAIRS, VERIFY_CHUNK = 1 << 13, 1 << 12, 1 << 13
#: A sketch has 64 bits for so many words of its line at most, and a power of two of them; finer ones serve verification.
COARSE, FINE, LEAST = 32, 8, 2


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each slot's words occur."""
    counts = np.zeros(1 << SLOT_BITS, dtype=np.int32)
    for batch in batches:
        lines = Lines.of(batch.column(0).cast(pa.binary()).to_pylist())
        tokens, _ = lines.pick(np.arange(len(lines.sizes)))
        np.add.at(counts, (tokens >> np.uint64(32 - SLOT_BITS)).astype(np.int64), 1)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(counts[slots].astype(np.int64))], names=["slot", "c"])


def word_classes(docs: DataFrame) -> np.ndarray:
    """The class of each slot's words (thirds of an octave, 63 at most), higher for more common ones; 4 MB, whatever the input."""
    some = docs.filter((F.pmod(F.xxhash64("text"), F.lit(ORDER_SAMPLE)) == 0) & F.col("text").isNotNull()).select("text")
    found = some.mapInArrow(_word_counts, "slot int, c bigint").groupBy("slot").agg(F.sum("c").alias("c")).filter("c > 1").toArrow()
    out = np.zeros(1 << SLOT_BITS, dtype=np.uint8)
    out[found["slot"].to_numpy()] = np.minimum(63, 1 + 3 * np.log2(found["c"].to_numpy()))
    return out


def lost_pairs(sizes: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The most pairs of adjacent words that a line of so many words can lose to an alike one: an edit breaks two at most."""
    return (2 * (1 - similarity) * sizes + 1e-9).astype(np.int64)


def line_keys(tokens: np.ndarray, sizes: np.ndarray, classes: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(line, 48-bit key) arrays in order of line; any two lines with an edit similarity of ``similarity`` or more share a key.

    ``tokens`` are 32 bits of each word, of lines of the given sizes. A line's
    keys are its first lost_pairs + 1 distinct pairs of adjacent words, in one
    order of all pairs, rarest words first. Of two alike lines each loses
    lost_pairs of its pairs at most, so the first pair that both hold is among
    the keys of either (pigeonhole).
    """
    where, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    ends = np.append(0, np.cumsum(sizes))
    for at in range(0, len(sizes), SLICE_LINES):
        n = sizes[at : at + SLICE_LINES]
        some = tokens[ends[at] : ends[at + len(n)]]
        owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        level = classes[(some >> np.uint64(32 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
        inside = owner[1:] == owner[:-1]
        pair = mixed(some[:-1] << np.uint64(32) | some[1:], 0xD6E8FEB86659FD93) >> np.uint64(64 - PAIR_BITS)
        own = np.sort((owner[:-1] << np.uint64(PAIR_BITS + 7) | (level[:-1] + level[1:]) << np.uint64(PAIR_BITS) | pair)[inside])
        own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        line = (own >> np.uint64(PAIR_BITS + 7)).astype(np.int64)
        counts = np.bincount(line, minlength=len(n))
        first = np.arange(len(own)) - (np.cumsum(counts) - counts)[line] <= lost_pairs(n, similarity)[line]
        where.append(line[first] + at)
        keys.append(mixed(own[first] & np.uint64((1 << PAIR_BITS + 7) - 1), 0x94D049BB133111EB) >> np.uint64(16))
    return np.concatenate(where), np.concatenate(keys)


def widths(sizes: np.ndarray, grain: int) -> np.ndarray:
    """64-bit words of the sketch of a line of so many words."""
    return LEAST << np.ceil(np.log2(np.maximum(1, sizes / (LEAST * grain)))).astype(np.int64)


def sketches(tokens: np.ndarray, sizes: np.ndarray, grain: int = COARSE) -> tuple[np.ndarray, np.ndarray]:
    """(words of 64 bits, first word of each line and the end): a bit for each word of a line, at its hash modulo the sketch's bits.

    The second, third, ... occurrence of a word in its line count as words of
    their own, so that lines of few words said often differ as well.
    """
    width = widths(sizes, grain)
    first = np.append(0, np.cumsum(width))
    out = np.zeros(int(first[-1]), dtype=np.uint64)
    if not len(tokens):
        return out, first
    own = np.sort(np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32) | tokens)
    place = np.arange(len(own))
    again = place - np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), place, 0))
    own = mixed((own & np.uint64(0xFFFFFFFF)) + (again.astype(np.uint64) << np.uint64(32)), 0xC2B2AE3D27D4EB4F)
    at = (own & (np.repeat(width, sizes) * 64 - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_or.at(out, np.repeat(first[:-1], sizes) + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    return out, first


def by_sketches(bits: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray, similarity: float, grain: int = COARSE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one bucket whose lengths and sketches do not rule ``similarity`` out.

    Lines are compared at the narrower sketch's width; the wider one, twice as
    wide at most, is folded to it by joining its halves.
    """
    width = widths(n, grain)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        wider = np.flatnonzero((width == 2 * w) & (n * similarity <= w * grain + 1e-9))
        at = np.concatenate([own, wider])
        if len(at) < 2:
            continue
        rows = np.concatenate([bits[first[own][:, None] + np.arange(w)], np.bitwise_or.reduce(bits[first[wider][:, None] + np.arange(2 * w)].reshape(-1, 2, w), axis=1)])
        order = np.argsort(start[at], kind="stable")
        at, rows = at[order], rows[order]
        new = np.append(True, start[at][1:] != start[at][:-1])
        heads = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        folded = width[at] > w
        for i, j in by_bits(rows, n[at], heads, similarity):
            keep = ~(folded[i] & folded[j])
            yield at[i[keep]], at[j[keep]]


def by_bits(bits: np.ndarray, n: np.ndarray, start: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one bucket whose lengths and word bits do not rule ``similarity`` out: a lost word clears one bit at most."""
    order = np.lexsort((n, start))
    bits, n, start = bits[order], n[order], start[order]
    most = ((1 - similarity) * n + 1e-9).astype(np.int64)
    back, i = 1, np.arange(len(n))
    while True:
        i = i[i - back >= start[i]]
        # Shorter ones come before, so a row whose lengths lie too far apart is done.
        i = i[n[i] - n[i - back] <= most[i]]
        if not len(i):
            return
        for at in range(0, len(i), 1 << 15):
            own = i[at : at + (1 << 15)]
            a, b = bits[own], bits[own - back]
            keep = np.bitwise_count(a & ~b).sum(axis=1) <= most[own]
            keep &= np.bitwise_count(b & ~a).sum(axis=1) <= most[own]
            if keep.any():
                yield order[own[keep]], order[(own - back)[keep]]
        back += 1


def _new_lines(lines: Lines, min_words: int, seen: set[int]) -> np.ndarray:
    """Which lines are long enough and not known to the task."""
    kept = np.flatnonzero(lines.sizes >= min_words)
    fresh = np.ones(len(kept), dtype=bool)
    for k, own in enumerate(lines.keys[kept, 0].tolist()):
        if own in seen:
            fresh[k] = False
        else:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(own)
    return kept[fresh]


def _packed(classes, min_words: int, similarity: float, bits: int):
    """Keys of the lines by range, as two arrays of 64-bit numbers in bytes: the key with the line's length, and its id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            lines = Lines.of(batch.column(0).cast(pa.binary()).to_pylist())
            kept = _new_lines(lines, min_words, seen)
            tokens, sizes = lines.pick(kept)
            line, keys = line_keys(tokens, sizes, classes.value, similarity)
            held.append((keys << np.uint64(16) | np.minimum(sizes, 0xFFFF).astype(np.uint64)[line], lines.keys[kept, 0][line]))
            count += len(keys)
            if count >= PACK_KEYS:
                yield pack(held)
                held, count = [], 0
        if count:
            yield pack(held)
        pa.default_memory_pool().release_unused()

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        entries, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        ranges = (entries >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(ranges, kind="stable")
        entries, ids, ranges = entries[order], ids[order], ranges[order]
        cuts = np.append(np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])), len(entries)).tolist()
        packs = [entries[a:b].tobytes() + ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(ranges[cuts[:-1]].astype(np.int32)), pa.array(packs, pa.binary())], names=["range", "pack"])

    return run


def _paired(similarity: float):
    """Of rows in order of range, the (fp, id) of entries whose key a line of fitting length shares; fp: key and 16 bits of the id."""

    def fits(entries: np.ndarray) -> np.ndarray:
        """Which entries, sorted, fit the one before."""
        n = (entries & np.uint64(0xFFFF)).astype(np.int64)
        if not len(n):
            return np.zeros(0, dtype=bool)
        near = (n[1:] - n[:-1] <= (1 - similarity) * n[1:] + 1e-9) | (n[1:] == 0xFFFF)
        return np.append(False, near & (entries[1:] >> np.uint64(16) == entries[:-1] >> np.uint64(16)))

    def ordered(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(entries, ids, whether they fit a neighbour) in order without repeats, and the entries and ids whose key is alone."""
        entries, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        # Most keys are alone: counts by some of their bits spare them the sort.
        slots = (entries >> np.uint64(16) & np.uint64((1 << KEY_SLOTS) - 1)).astype(np.int64)
        shared = np.bincount(slots, minlength=1 << KEY_SLOTS)[slots] > 1
        alone = entries[~shared], ids[~shared]
        entries, ids = entries[shared], ids[shared]
        order = np.lexsort((ids, entries))
        entries, ids = entries[order], ids[order]
        if len(entries):
            new = np.append(True, (entries[1:] != entries[:-1]) | (ids[1:] != ids[:-1]))
            entries, ids = entries[new], ids[new]
        near = fits(entries)
        return entries, ids, near | np.append(near[1:], False)[: len(near)], alone

    def rows(entries: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        fp = entries & np.uint64(0xFFFFFFFFFFFF0000) | ids & np.uint64(0xFFFF)
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ids.view(np.int64))], names=["fp", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, count = None, 0
        for batch in batches:
            for key, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != at and held:
                    entries, ids, keep, _ = ordered(held)
                    yield rows(entries[keep], ids[keep])
                    held, count = [], 0
                at = key
                both = np.frombuffer(pack, dtype=np.uint64).reshape(2, -1)
                held.append((both[0], both[1]))
                count += both.shape[1]
                if count >= HELD_KEYS:
                    # One line of each key and length stands for those that are sent on already.
                    entries, ids, keep, alone = ordered(held)
                    yield rows(entries[keep], ids[keep])
                    left = ~keep | np.append(True, entries[1:] != entries[:-1])[: len(keep)]
                    held = [(entries[left], ids[left]), alone]
                    count = min(int(left.sum()) + len(alone[0]), HELD_KEYS // 2)
        if held:
            entries, ids, keep, _ = ordered(held)
            yield rows(entries[keep], ids[keep])
        pa.default_memory_pool().release_unused()

    return run


def _tokens(lanes, min_words: int):
    """Id, key and words (as 32-bit hashes) of the lines whose id a Bloom filter may hold; all where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(lanes.value) if lanes else None
        seen: set[int] = set()
        for batch in batches:
            lines = Lines.of(batch.column(0).cast(pa.binary()).to_pylist())
            kept = _new_lines(lines, min_words, seen)
            ids = lines.keys[kept, 0]
            if bloom:
                # Spark's xxhash64 of a bigint is XXH64 of its eight bytes with seed 42.
                probes = np.fromiter((xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42) for k in ids.tolist()), dtype=np.uint64, count=len(ids))
                hit = bloom.contains(probes)
                kept, ids = kept[hit], ids[hit]
            tokens, sizes = lines.pick(kept)
            ends = np.append(0, np.cumsum(sizes) * 4).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(ends), pa.py_buffer(tokens.astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.ascontiguousarray(lines.keys[kept, 1]).view(np.int64)), packed], names=["id", "id2", "words"])
        pa.default_memory_pool().release_unused()

    return run


def _bucketed(rows: DataFrame, bucket: str) -> DataFrame:
    """rows with t and fp for in_buckets: 48 bits of the bucket and 16 of the line, so that large buckets can be cut."""
    fp = F.shiftleft(F.col(bucket), 16).bitwiseOR(F.col("id").bitwiseAND(0xFFFF))
    return rows.select(F.lit(0).cast("smallint").alias("t"), fp.alias("fp"), *[c for c in rows.columns if c != bucket])


def alike_lines(distinct: DataFrame, docs: DataFrame, min_words: int, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, u2, v, v2) between keys (id, id2) of ``distinct`` (id, id2, n, sketch) that connect just what chains of alike lines connect.

    Alike are lines of min_words words or more with a word-level edit
    similarity of ``similarity`` or more; no such pair is lost. Lines meet by
    ``line_keys``. The keys travel packed, and only those that two lines of
    fitting lengths share become rows. In each key's bucket sketches rule
    most pairs out; what the rest connects gets one group, named by its least
    line, so that lines which share many keys still meet in one or two groups.
    Then the words of those lines alone are fetched (behind a Bloom filter of
    bounded size; without one where there are too many lines for it) and
    compared within the groups, as hashes of 32 bits. In a group, lines that
    links already join are not compared again, so links grow with the lines.
    """
    if min_words * (2 * similarity - 1) <= 1:
        raise ValueError("lines this short or unlike may share no pair of words")
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(word_classes(docs))
    texts = docs.filter("text is not null").select("text")
    own = F.col("n") >= min_words
    expected = distinct.filter(own).agg(F.sum(2 * (1 - similarity) * F.col("n") + 1)).first()[0] or 0
    bits = max(4, int(expected / RANGE_KEYS).bit_length())
    packs = texts.mapInArrow(_packed(classes, min_words, similarity, bits), "range int, pack binary")
    dealt = packs.repartition(min(MAX_PARTITIONS, max(1 << bits, spark.sparkContext.defaultParallelism)), "range").sortWithinPartitions("range")
    entries = written(dealt.mapInArrow(_paired(similarity), "fp bigint, id bigint"), "entries")

    def meet(table: pa.Table, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        union = Union(len(fp))
        packed = table["sketch"].to_pylist()
        first = np.append(0, np.cumsum(np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 8))
        for i, j in by_sketches(np.frombuffer(b"".join(packed), dtype=np.uint64), first, table["n"].to_numpy().astype(np.int64), start, similarity):
            union.join(i, j)
        ids, label = table["id"].to_numpy(), union.label
        met = np.bincount(label, minlength=len(label))[label] > 1
        least = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(least[label][met])], names=["id", "root"])

    known = distinct.filter(own).select("id", "n", "sketch")
    rows = entries.join(known, "id").select(F.lit(0).cast("smallint").alias("t"), "fp", "id", "n", "sketch")
    met = written(in_buckets(rows, [0xFFFFFFFFFFFF0000], meet, "id bigint, root bigint").distinct(), "met")
    discard(entries)
    found = BlockedBloom.build(met.select("id").distinct(), "id")
    lanes = spark.sparkContext.broadcast(found.lanes) if found else None
    words = texts.mapInArrow(_tokens(lanes, min_words), "id bigint, id2 bigint, words binary").dropDuplicates(["id", "id2"])
    grouped = _bucketed(met.join(words, "id"), "root")

    def verify(table: pa.Table, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        id1, id2 = table["id"].to_numpy(), table["id2"].to_numpy()
        flat = [np.frombuffer(w, dtype=np.uint32) for w in table["words"].to_pylist()]
        n = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
        tokens = np.concatenate(flat)
        signatures, first = sketches(tokens.astype(np.uint64), n, FINE)
        begin, union = np.cumsum(n) - n, Union(len(fp))
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def compare() -> None:
            x, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            for at in range(0, len(x), VERIFY_PAIRS):
                i, j = x[at : at + VERIFY_PAIRS], y[at : at + VERIFY_PAIRS]
                apart = union.label[i] != union.label[j]
                i, j = i[apart], j[apart]
                hit = alike(tokens, begin, n, i, j, similarity)
                union.join(i[hit], j[hit])

        # Pairs are gathered, as many are compared at the price of a few.
        count = 0
        for i, j in by_sketches(signatures, first, n, start, similarity, FINE):
            apart = union.label[i] != union.label[j]
            held.append((i[apart], j[apart]))
            count += int(apart.sum())
            if count >= VERIFY_PAIRS:
                compare()
                count = 0
        if count:
            compare()
        # Each line hangs on the first that links lead to in this group, so that paths stay short.
        hung = np.flatnonzero(union.label != np.arange(len(fp)))
        if len(hung):
            roots = union.label[hung]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id1[hung], id2[hung], id1[roots], id2[roots])], names=["u", "u2", "v", "v2"])

    links = written(in_buckets(grouped, [0xFFFFFFFFFFFF0000], verify, "u bigint, u2 bigint, v bigint, v2 bigint", VERIFY_ROWS, VERIFY_CHUNK).distinct(), "links")
    discard(met)
    return links
