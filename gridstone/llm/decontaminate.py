"""Benchmark windows inside documents, found by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import prepare

WINDOW = 13
#: Bytes of benchmark text searched for in one pass; a larger benchmark takes more passes, each with its own bounded broadcast.
PASS_BYTES = 16 << 20

#: Delimiters become spaces: all ASCII but digits and letters; A-Z are lower-cased.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Search for many word sequences of at least one length at once.

    ``shift`` tells, for each block of words that ends a frame of ``m`` words,
    how far the frame may move before any pattern can end there; blocks in no
    pattern let it skip as far as possible. Blocks with shift 0 lead through
    ``buckets`` to the patterns whose first m words end in that block, which
    are compared word by word.
    """

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        self.m = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.skip = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], set[str]]]] = {}
        for p, items in patterns.items():
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.skip), m - end)
            self.buckets.setdefault(p[m - b : m], []).append((p, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of each occurrence, in order of start."""
        get, buckets, skip, m, b, n = self.shift.get, self.buckets, self.skip, self.m, self.block, len(words)
        at = m
        if b == 2:
            while at <= n:
                key = (words[at - 2], words[at - 1])
                move = get(key, skip)
                if move:
                    at += move
                    continue
                start = at - m
                for p, items in buckets[key]:
                    if tuple(words[start : start + len(p)]) == p:
                        yield start, start + len(p), items
                at += 1
        else:
            for start, w in enumerate(words):
                for p, items in buckets.get((w,), ()):
                    if tuple(words[start : start + len(p)]) == p:
                        yield start, start + len(p), items


def windows(items: list[tuple[str, str]], size: int = WINDOW) -> list[dict[tuple[bytes, ...], set[str]]]:
    """Pattern groups by length: full windows together, then each shorter whole item's length."""
    groups: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        if n:
            for k in range(len(words) - n + 1):
                groups.setdefault(n, {}).setdefault(tuple(words[k : k + n]), set()).add(item)
    return [groups[n] for n in sorted(groups, reverse=True)]


def search(words: list[bytes], automata: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans [start, end) that occurrences cover, and the items they come from."""
    spans, items = [], set()
    for a in automata:
        for start, end, found in a.find(words):
            spans.append((start, end))
            items |= found
    return merged(spans), items


def _passes(benchmark: DataFrame) -> list[list[tuple[str, str]]]:
    """The benchmark's items in groups of at most about PASS_BYTES of text."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("text")).filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // PASS_BYTES))
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return [[(r[0], r[1]) for r in grouped.filter(F.col("g") == g).collect()] for g in range(n)]


FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _finder(patterns):
    """A UDF from texts to what one pass's patterns hit; automata are built once a task."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = [WuManber(p) for p in patterns.value]
        for texts in batches:
            rows = []
            for text in texts.to_pylist():
                words = words_of(text)
                spans, items = search(words, automata)
                rows.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
            yield pa.array(rows, type=_FOUND)
        pa.default_memory_pool().release_unused()

    return F.arrow_udf(find, FOUND)


def _joined(*passes: pa.Array) -> pa.Array:
    """What several passes hit in the same texts, as one."""
    rows = []
    for found in zip(*[p.to_pylist() for p in passes], strict=True):
        spans = merged([(s["start"], s["end"]) for f in found for s in f["spans"]])
        rows.append({"n_words": found[0]["n_words"], "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted({i for f in found for i in f["items"]})})
    return pa.array(rows, type=_FOUND)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, spans (hit word ranges, merged, end exclusive) and items (sorted item ids as strings).

    A null or empty text has no words and no hit. An item without words has
    no window; a null item_id counts as the empty string. Items that share a
    window all count. An empty benchmark hits nothing. Columns of docs with
    the names of results are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    found = [_finder(spark.sparkContext.broadcast(windows(items, window)))(F.col("text")) for items in _passes(benchmark)]
    if len(found) > 1:
        found = [F.arrow_udf(_joined, FOUND)(*found)]
    out = docs.select(*kept, found[0].alias("__gs_f"))
    return out.select(*kept, *[F.col(f"__gs_f.{c}").alias(c) for c in ("n_words", "spans", "items")])


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated (at least a twentieth of the words hit)."""
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = occurrences(docs, benchmark)
    kept = [c for c in docs.columns if c not in (*names, "spans", "items")]
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    out = found.select(*kept, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
