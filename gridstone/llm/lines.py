"""Line deduplication: equal and alike lines in connected groups, of which one occurrence stays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.bitsliced import Union, combined, exploded, first_met, in_buckets, matches
from gridstone.llm.components import components
from gridstone.llm.line_grams import alike_lines, sketches
from gridstone.llm.line_words import SIMILARITY, Lines, edit_similarity, line_key, mixed, normalised, normalised_lines, word_hashes
from gridstone.llm.tables import discard, prepare, written
from gridstone.llm.url_filter import BlockedBloom

#: Lines of fewer words are never alike, only equal.
MIN_WORDS = 5
#: SimHashes have two halves of 64 bits. Lines are compared that agree on AGREE of BLOCKS blocks of the first half, differ
#: by HALF_RADIUS bits there at most and by RADIUS in all: a changed word in twenty turns about eleven bits, one in forty
#: six. The second half keeps lines that merely share common words apart; the edit similarity decides. Buckets hold lines
#: / 2 ** 16 on average and cost a word operation for 64 rows; above some 10 ** 9 lines (8, 2) suits better.
BLOCKS, AGREE, HALF_RADIUS, RADIUS = 4, 1, 8, 14
#: Lines that a task verifies at once.
VERIFY_ROWS = 1 << 15
#: Lines of more words are sketched one by one.
SHORT = 192


def simhashes(lines: list[list[bytes]]) -> np.ndarray:
    """Two 64-bit halves for each (non-empty) line: majority bits of its words' hashes, ties up."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    one = word_hashes(list(chain.from_iterable(lines)))
    own = np.stack([mixed(one, 0x9E3779B97F4A7C15), mixed(one, 0x94D049BB133111EB)], axis=1)
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(lines), 2), dtype=np.uint64)
    short = np.flatnonzero(sizes <= SHORT)
    short = short[np.argsort(-sizes[short], kind="stable")]
    if len(short):
        out[short] = _majority(own, first[short], sizes[short])
    for k in np.flatnonzero(sizes > SHORT).tolist():
        out[k] = _counted(own[first[k] : first[k] + sizes[k]])
    return out


def _majority(own: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majorities of several lines, longest first: the k-th words of all enter vertical counters at once, by carry-save steps."""
    longest = int(sizes[0])
    planes = [np.zeros((len(sizes), 2), dtype=np.uint64) for _ in range(longest.bit_length())]
    still = np.searchsorted(-sizes, -np.arange(longest), side="left").tolist()  # lines of more than k words
    for k in range(longest):
        n = still[k]
        carry = own[first[:n] + k]
        for plane in planes[: (k + 1).bit_length()]:
            at = plane[:n]
            more = at & carry
            at ^= carry
            carry = more
    need = -(-sizes // 2)
    above, equal = np.zeros((len(sizes), 2), dtype=np.uint64), np.full((len(sizes), 2), np.uint64(0xFFFFFFFFFFFFFFFF))
    for bit in range(len(planes) - 1, -1, -1):
        wanted = (np.uint64(0) - ((need >> bit) & 1).astype(np.uint64))[:, None]
        above |= equal & planes[bit] & ~wanted
        equal &= ~(planes[bit] ^ wanted)
    return above | equal


def _counted(own: np.ndarray) -> np.ndarray:
    """The majority of one long line, its bits counted one by one."""
    total = np.zeros(128, dtype=np.int64)
    for at in range(0, len(own), 1 << 13):
        total += np.unpackbits(own[at : at + (1 << 13)].view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total >= len(own), bitorder="little").view("<u8")


LINES = "array<struct<line:int,id:bigint,id2:bigint,fp:bigint,fp2:bigint,n:int,sketch:binary>>"
_LINES = pa.list_(pa.struct([("line", pa.int32()), *[(c, pa.int64()) for c in ("id", "id2", "fp", "fp2")], ("n", pa.int32()), ("sketch", pa.binary())]))


def _sketched(texts: list[bytes | None], min_words: int) -> tuple[np.ndarray, ...]:
    """(text, line number, keys, SimHashes, words) of lines of min_words words or more."""
    found = [(t, k, w) for t, text in enumerate(texts) for k, w in enumerate(normalised(text)) if len(w) >= min_words]
    flat = [w for _, _, w in found]
    keys = np.frombuffer(b"".join(map(line_key, flat)), dtype="<u8").reshape(-1, 2)
    fps = simhashes(flat) if flat else np.zeros((0, 2), dtype=np.uint64)
    return np.array([x[0] for x in found], dtype=np.int64), np.array([x[1] for x in found], dtype=np.int64), keys, fps, np.array(list(map(len, flat)), dtype=np.int64)


def _line_rows(min_words: int, exact: bool):
    """Number, key, SimHash and length of each line of min_words words or more, or where exact a sketch instead, of each line with words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            bodies = texts.cast(pa.binary()).to_pylist()
            if exact:
                own = Lines.of(bodies)
                tokens, sizes = own.pick(np.arange(len(own.sizes)))
                text, number, keys = own.text, own.number, own.keys
                bits, first = sketches(tokens, sizes)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((8 * first).astype(np.int32)), pa.py_buffer(bits)])
                simhash = [pa.nulls(len(sizes), pa.int64())] * 2
            else:
                text, number, keys, fps, sizes = _sketched(bodies, min_words)
                packed, simhash = pa.nulls(len(sizes), pa.binary()), [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in fps.T]
            halves = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in keys.T]
            columns = [pa.array(number.astype(np.int32)), *halves, *simhash, pa.array(sizes.astype(np.int32)), packed]
            offsets = np.append(0, np.cumsum(np.bincount(text, minlength=len(bodies)))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_LINES.value_type)))
        pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, LINES)


def _line_texts(lanes):
    """The normalised lines whose place a Bloom filter may hold; all where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(lanes.value) if lanes else None
        for batch in batches:
            found = [(d, k, line) for d, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True) for k, line in enumerate(normalised_lines(text))]
            if bloom:
                # Spark's xxhash64 of a string is XXH64 with seed 42.
                hit = bloom.contains(np.fromiter((xxhash.xxh64_intdigest(f"{d}:{k}", 42) for d, k, _ in found), dtype=np.uint64, count=len(found)))
                found = [p for p, h in zip(found, hit.tolist(), strict=True) if h]
            bodies = [b" ".join(p[2].split()).decode("utf-8", "replace") for p in found]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int32()), pa.array(bodies, pa.string())], names=["d", "line", "body"])

    return run


def near_lines(distinct: DataFrame, docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, u2, v, v2) between keys of ``distinct`` (id, id2, fp, fp2, n, first) of lines whose SimHashes meet and which are alike.

    SimHashes must agree on some AGREE blocks and differ by radius bits at
    most, and the words' edit similarity must suffice. A first pass over
    the buckets takes fingerprints and lengths alone (lengths too far apart
    rule a pair out) and finds the lines that need verification, and where.
    Only their texts are fetched, each from its first place (a Bloom filter of
    bounded size, then a join), and dealt again. In a bucket, lines that
    verified links already join are not compared again, so links grow with
    the lines.
    """
    masks = combined(BLOCKS, AGREE)

    def candidates(table: pa.Table, fp: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, t, fp2 = table["n"].to_numpy().astype(np.int64), table["t"].to_numpy(), table["fp2"].to_numpy()
        for i, j in matches(fp, start, HALF_RADIUS):
            keep = np.abs(n[i] - n[j]) <= (1 - similarity) * np.maximum(n[i], n[j]) + 1e-9
            keep &= np.bitwise_count((fp[i] ^ fp[j])).astype(np.int64) + np.bitwise_count((fp2[i] ^ fp2[j]).view(np.uint64)) <= radius
            i, j = i[keep], j[keep]
            keep = first_met(i, j, fp, t, masks)
            yield i[keep], j[keep]

    def flag(table: pa.Table, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(len(fp), dtype=bool)
        for i, j in candidates(table, fp, start):
            hit[i] = hit[j] = True
        if hit.any():
            yield from table.select(["t", "fp", "fp2", "n"]).filter(pa.array(hit)).combine_chunks().to_batches()

    sketch = ["fp", "fp2", "n"]
    met = in_buckets(exploded(distinct.select(*sketch), masks), masks, flag, "t smallint, fp bigint, fp2 bigint, n int")
    flagged = written(met.distinct(), "flagged")
    near = written(distinct.select("id", "id2", *sketch, F.col("first.d").alias("d"), F.col("first.line").alias("line")).join(flagged, sketch), "near")
    discard(flagged)
    places = near.select("d", "line").distinct().select(F.concat_ws(":", F.col("d").cast("string"), F.col("line").cast("string")).alias("place"))
    found = BlockedBloom.build(places, "place")
    lanes = docs.sparkSession.sparkContext.broadcast(found.lanes) if found else None
    texts = docs.filter("text is not null").select(F.xxhash64("doc_id", "text").alias("d"), "text").mapInArrow(_line_texts(lanes), "d bigint, line int, body string")
    rows = written(near.join(texts.dropDuplicates(["d", "line"]), ["d", "line"]).select("t", "id", "id2", *sketch, "body"), "candidates")

    def verify(table: pa.Table, fp: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        id1, id2, bodies = table["id"].to_numpy(), table["id2"].to_numpy(), [b.split(" ") for b in table["body"].to_pylist()]
        union = Union(len(fp))
        for i, j in candidates(table, fp, start):
            apart = union.label[i] != union.label[j]
            linked = [(x, y) for x, y in zip(i[apart].tolist(), j[apart].tolist(), strict=True) if edit_similarity(bodies[x], bodies[y], similarity) >= similarity]
            if linked:
                union.join(*np.array(linked).T)
        # Each line hangs on the first that verified links lead to in this bucket, so that paths stay short.
        hung = np.flatnonzero(union.label != np.arange(len(fp)))
        if len(hung):
            roots = union.label[hung]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id1[hung], id2[hung], id1[roots], id2[roots])], names=["u", "u2", "v", "v2"])

    links = written(in_buckets(rows, masks, verify, "u bigint, u2 bigint, v bigint, v2 bigint", VERIFY_ROWS).distinct(), "links")
    discard(near)
    discard(rows)
    return links


def _roots(links: DataFrame) -> DataFrame:
    """(id, id2, root) of the linked keys, for a written table of links; roots are of the type (id) or, if two linked keys share one, (id, id2)."""
    nodes = written(links.select(F.col("u").alias("id"), F.col("u2").alias("id2")).union(links.select("v", "v2")).distinct(), "nodes")
    n, ids = nodes.agg(F.count("*"), F.count_distinct("id")).first()
    if n == ids:
        out = written(nodes.join(components(links.select("u", "v")), F.col("id") == F.col("node")).select("id", "id2", "root"), "roots")
    else:
        roots = components(links.select(*[F.struct(F.col(c).alias("id"), F.col(f"{c}2").alias("id2")).alias(c) for c in ("u", "v")]))
        out = written(roots.select(F.col("node.id").alias("id"), F.col("node.id2").alias("id2"), "root"), "roots")
    discard(nodes)
    return out


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, radius: int | None = None, similarity: float = SIMILARITY) -> DataFrame:
    """docs with text without repeated lines, and n_lines, n_dropped and dropped (line numbers from 0, in order).

    Lines are parted by ``\\n`` alone. A line is dropped unless it is the first
    of its group by doc_id (null last), hash of the text and line number. A
    group is what chains of equal or alike normalised lines connect: all
    pairs of lines of min_words words or more with a word-level edit
    similarity of ``similarity`` or more; shorter lines are only alike if
    equal, and lines without words always stay. Each character of a script
    without spaces counts as a word. With a ``radius`` alike lines are those
    whose SimHashes meet too, which loses most pairs near ``similarity``, and
    shorter lines always stay. A document may end
    up with an empty text; a null text stays null and has no lines. Rows equal
    in id and text share their lines' fate. Columns of docs named like a
    result, other than text, are replaced.

    Only hashes and places of lines are shuffled to find groups; counts and
    first places of equal lines are pre-aggregated, so a line in a third of
    all documents costs each task one row. The texts meet their drop lists in
    one join.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped", "dropped")
    identity = F.xxhash64("doc_id", "text").alias("d")
    key = ["id", "id2"]
    found = docs.select("doc_id", identity, F.explode(_line_rows(min_words, radius is None)("text")).alias("l"))
    lines = written(found.select(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "d", F.col("l.line").alias("line")).alias("place"), "l.id", "l.id2", "l.fp", "l.fp2", "l.n", "l.sketch"), "lines")
    distinct = written(lines.groupBy(*key).agg(F.min("fp").alias("fp"), F.min("fp2").alias("fp2"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("place").alias("first"), F.count("*").alias("c")), "distinct")
    if radius is None:
        links = alike_lines(distinct.select(*key, "n", "sketch"), docs, min_words, similarity)
    else:
        links = near_lines(distinct, docs, radius, similarity)
    roots = _roots(links)
    rooted = distinct.select(*key, "first", "c").join(roots, key, "left").filter("c > 1 or root is not null")
    repeated = written(rooted.select(*key, "first", "root"), "repeated")
    # Written, so that the join with a large group's lines can be split.
    kept = written(repeated.filter("root is not null").groupBy("root").agg(F.min("first").alias("kept")), "kept")
    linked = repeated.filter("root is not null").join(kept, "root").select(*key, "kept")
    firsts = linked.union(repeated.filter("root is null").select(*key, "first"))
    drops = lines.select(*key, "place").join(firsts, key).filter("place != kept")
    by_doc = written(drops.groupBy(F.col("place.d").alias("__gs_e")).agg(F.sort_array(F.collect_set("place.line")).alias("__gs_drop")), "drops")
    for table in (lines, distinct, links, roots, repeated, kept):
        discard(table)
    # The lines travel instead of the text and are looked up by place, so a text takes time in proportion to its lines.
    others = [c for c in docs.columns if c != "text"]
    keyed = docs.select(*others, identity.alias("__gs_d"), F.split("text", "\n", -1).alias("__gs_lines"))
    joined = keyed.join(by_doc.hint("shuffle_hash"), F.col("__gs_d") == F.col("__gs_e"), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__gs_lines") - 1), F.col("__gs_drop"))
    text = F.array_join(F.when(F.col("__gs_drop").isNull(), F.col("__gs_lines")).otherwise(F.transform(left, lambda k: F.get("__gs_lines", k))), "\n")
    dropped = F.coalesce("__gs_drop", F.array().cast("array<int>"))
    n_lines = F.when(F.col("__gs_lines").isNull(), 0).otherwise(F.size("__gs_lines")).cast("bigint")
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*columns, n_lines.alias("n_lines"), F.size(dropped).cast("bigint").alias("n_dropped"), dropped.alias("dropped"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (comma-joined) and text_sha256 of what stays; null for a null text."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.array_join(F.transform("dropped", lambda x: x.cast("string")), ",").alias("dropped"), F.sha2("text", 256).alias("text_sha256"))
