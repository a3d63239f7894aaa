"""Phrases whose words keep together, mined by Toivonen's method: a sample proposes, full passes count exactly until closed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import discard, prepare, written

#: A phrase counts from so many occurrences, and is dropped inside a longer one that has this share (percent) of them.
LEAST, SHARE = 10, 50
#: Phrases reported of each language, and parts of a language that are ranked apart first.
TOP, PARTS = 2000, 16
#: One document in so many proposes phrases, those that occur in the sample so often. Neither bears on the result.
SAMPLE, SAMPLE_LEAST = 8, 2
#: The two filters of proposed words and word pairs have FILL bits or more for each proposal of the sample, and 2 ** BITS (16 MB)
#: at most, whatever the input. Where they fill up they let more through, and more is counted exactly.
BITS, FILL = 27, 32
#: Bytes of text that a task counts at once, longer texts being cut, and rows that it hands on at once.
CHUNK, BATCH_ROWS = 4 << 20, 1 << 16

UNKNOWN = "und"
COUNTS = "lang string, phrase string, words int, n long"
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])
#: Classes of bytes: of a word, between words, between pieces. All separators are ASCII, so UTF-8 is read by bytes.
CLASS, LOWER = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[*b".,;:!?\n\x0b\x0c\r"]] = 2
LOWER[ord("A") : ord("Z") + 1] += 32
GAP, NEXT_TWO = re.compile(rb"[\t-\r !,.:;?]"), re.compile(rb"(?:[\t-\r !,.:;?]*[^\t-\r !,.:;?]+){0,2}")


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes stirred."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process; it chooses bits of a filter and identifies nothing."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def lang_hashes(langs: list[str]) -> np.ndarray:
    return mixed(pd.util.hash_array(np.array(langs, object), categorize=False))


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second)


class Filter:
    """A bit for each hash; says of every hash put in that it may be in."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        at = mixed(h) >> np.uint64(64 - (len(self.bits).bit_length() + 5))
        return self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1


@dataclass
class Proposed:
    """Words and word pairs proposed by now and, unless this is the first pass, by the last pass (older)."""

    words: np.ndarray
    pairs: np.ndarray
    older: Proposed | None = None


def segments(text: bytes, chunk: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about ``chunk`` bytes at most, each with the place from which its words belong to the next part.

    Those words, two at most, only end phrases that begin before them.
    """
    at = 0
    while len(text) - at > chunk:
        gap = GAP.search(text, at + chunk)
        if gap is None:
            break
        end = NEXT_TWO.match(text, gap.start()).end()
        yield text[at:end], gap.start() - at
        at = gap.start()
    yield text[at:], len(text) - at


def counted(parts: list[tuple[bytes, int]], langs: np.ndarray, names: list[str], proposed: Proposed | None) -> Iterator[pa.RecordBatch]:
    """Counts of the words (in the first pass), word pairs and triples of some parts of texts, with how many words each language has.

    ``langs`` numbers the language of each part. A pair counts if both words
    are proposed, a triple if both its pairs are, and neither if that was so in
    the last pass; without ``proposed`` all count. Words have numbers of the
    batch, and phrases are pairs of numbers, so nothing is identified by a hash.
    """
    buf = np.frombuffer(b"\n".join(p for p, _ in parts) + b"\n", np.uint8)
    sizes = np.array([len(p) for p, _ in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    kind = CLASS[buf]
    inside = kind == 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return
    part = np.searchsorted(begins, starts, "right") - 1
    own = starts - begins[part] < np.array([g for _, g in parts])[part]
    # Piece numbers need telling apart neighbours only.
    piece = np.add.accumulate(kind == 2, dtype=np.int32)[starts]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[buf[inside]])])
    del kind, inside, edge, buf
    encoded = words.dictionary_encode()
    texts, size = encoded.dictionary, len(encoded.dictionary)
    # Numbers of (language, word).
    w, both = pd.factorize(langs[part] * size + encoded.indices.to_numpy().astype(np.int64))
    lang_of, text_of = both // size, both % size
    n = len(both)

    def rows(keys: list[np.ndarray], lang: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        chosen = [texts.take(pa.array(text_of[k])) for k in keys]
        phrase = chosen[0] if len(chosen) == 1 else pc.binary_join_element_wise(*chosen, " ")
        langs = pa.array(names, pa.string()).take(pa.array(lang))
        return pa.record_batch([langs, phrase, pa.array(np.full(len(counts), len(keys), np.int32)), pa.array(counts.astype(np.int64))], schema=SCHEMA)

    first = proposed is None or proposed.older is None
    if first:
        counts = np.bincount(w[own], minlength=n)
        met = np.flatnonzero(counts)
        yield rows([met], lang_of[met], counts[met])
        per_lang = np.bincount(lang_of, counts, len(names)).astype(np.int64)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([""] * len(names)), pa.array(np.zeros(len(names), np.int32)), pa.array(per_lang)], schema=SCHEMA)
    next_to = np.zeros(len(w), bool)
    next_to[:-1] = (piece[1:] == piece[:-1]) & (part[1:] == part[:-1])
    pair_at, triple_at = next_to.copy(), next_to.copy()
    triple_at[:-1] &= next_to[1:]
    if proposed is not None:
        h = word_hashes(texts)[text_of] + lang_hashes(names)[lang_of]
        holds = lambda f: Filter(f.words).may_hold(h)[w]
        joint = pair_hashes(h[w], h[np.append(w[1:], 0)])

        def wanted(f: Proposed) -> tuple[np.ndarray, np.ndarray]:
            word, pair = holds(f), Filter(f.pairs).may_hold(joint)
            return word & np.append(word[1:], False), pair & np.append(pair[1:], False)

        for k, mask in enumerate(wanted(proposed)):
            (pair_at, triple_at)[k][:] &= mask
        if not first:
            for k, mask in enumerate(wanted(proposed.older)):
                (pair_at, triple_at)[k][:] &= ~mask
    at = np.flatnonzero(pair_at & own)
    if len(at):
        number, found = pd.factorize(w[at] * n + w[at + 1])
        yield rows([found // n, found % n], lang_of[found // n], np.bincount(number))
    at = np.flatnonzero(triple_at & own)
    if len(at):
        pair, pairs = pd.factorize(w[at] * n + w[at + 1])
        number, found = pd.factorize(pair * n + w[at + 2])
        two = pairs[found // n]
        yield rows([two // n, two % n, found % n], lang_of[two // n], np.bincount(number))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def counts(docs: DataFrame, shared: Broadcast | None, chunk: int = CHUNK) -> DataFrame:
    """(lang, phrase, words, n) over all of docs (lang, text); the row of words 0 has the number of a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared is None else shared.value
        parts: list[tuple[bytes, int]] = []
        langs: list[int] = []
        names: dict[str, int] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for part in segments(text, chunk):
                    if held and held + len(part[0]) > chunk:
                        yield from sliced(counted(parts, np.array(langs), list(names), own))
                        parts, langs, names, held = [], [], {}, 0
                    parts.append(part)
                    langs.append(names.setdefault(lang, len(names)))
                    held += len(part[0]) + 1
        if parts:
            yield from sliced(counted(parts, np.array(langs), list(names), own))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def filter_bits(phrases: DataFrame, words: int, bits: int) -> np.ndarray:
    """The filter of the phrases of so many words, OR-ed on the executors; 2 ** (bits - 6) rows of two numbers at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang = np.unique(batch.column(0).to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
            if not len(names):
                continue
            split = pc.split_pattern(batch.column(1), " ")
            hashes = [word_hashes(pc.list_element(split, k)) + lang_hashes(list(names))[lang] for k in range(words)]
            h = mixed(hashes[0] if words == 1 else pair_hashes(*hashes)) >> np.uint64(64 - bits)
            yield pa.record_batch([pa.array((h >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], ["at", "bits"])

    rows = phrases.filter(F.col("words") == words).select("lang", "phrase").mapInArrow(run, "at int, bits long")
    found = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def frequent(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE, sample_least: int = SAMPLE_LEAST, chunk: int = CHUNK, bits: int = BITS) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 1 to 3 words with n >= least; words 0: a language's words.

    A sample proposes words and pairs. The first full pass counts the
    proposals and their negative border, the phrases whose parts are all
    proposed but which are not themselves: every word, each pair of proposed
    words, each triple of proposed pairs. Phrases of the border that turn out
    frequent are proposed too, and a further pass counts what that adds to the
    border, and only that, until nothing frequent is left unproposed. All
    counts are exact, and no phrase is counted in two passes.
    """
    prepare(docs.sparkSession)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample)) == 0)
    seen = written(counts(chosen.select("lang", "text"), None, chunk).filter((F.col("n") >= sample_least) & F.col("words").between(1, 2)), "proposed")
    most = max([r["count"] for r in seen.groupBy("words").count().collect()], default=0)
    bits = min(bits, max(6, (FILL * most).bit_length()))
    proposed = Proposed(filter_bits(seen, 1, bits), filter_bits(seen, 2, bits))
    discard(seen)
    out = None
    while True:
        shared = docs.sparkSession.sparkContext.broadcast(proposed)
        new = written(counts(docs.select("lang", "text"), shared, chunk).filter((F.col("n") >= least) | (F.col("words") == 0)), "frequent")
        shared.destroy()
        out = new if out is None else out.unionByName(new)
        grown = Proposed(proposed.words | filter_bits(new, 1, bits), proposed.pairs | filter_bits(new, 2, bits))
        if np.array_equal(grown.words, proposed.words) and np.array_equal(grown.pairs, proposed.pairs):
            return out
        proposed.older = None
        grown.older = proposed
        proposed = grown


def cut_score(a: Column, first: Column, rest: Column) -> Column:
    """floor(1000000 a a / (l r)), exact; 38 decimal digits hold a up to 10 ** 15."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.call_function("div", wide(a, 16) * wide(a, 16) * F.lit(1000000).cast("decimal(7,0)"), wide(first, 19) * wide(rest, 19))


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and three words in ``found`` (lang, phrase, words, n) that no longer one stands for.

    Parts of a frequent phrase are frequent, so each is in ``found``.
    """
    parts = found.filter("words between 1 and 2")
    pairs, triples = found.filter("words = 2"), found.filter("words = 3")
    word = lambda k: F.split_part("phrase", F.lit(" "), F.lit(k))
    two = lambda a, b: F.concat_ws(" ", word(a), word(b))
    cut = lambda k, first, rest: F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))
    cuts = pairs.select("lang", "phrase", "n", cut(1, word(1), word(2)).alias("cut")).unionByName(
        triples.select("lang", "phrase", "n", F.explode(F.array(cut(1, word(1), two(2, 3)), cut(2, two(1, 2), word(3)))).alias("cut"))
    )
    side = lambda name: parts.select("lang", F.col("phrase").alias(name), F.col("n").alias(name[0]))
    rows = cuts.select("lang", "phrase", F.col("n").alias("a"), F.col("cut.k").alias("k"), F.col("cut.first").alias("l_phrase"), F.col("cut.rest").alias("r_phrase"))
    known = rows.join(side("l_phrase"), ["lang", "l_phrase"]).join(side("r_phrase"), ["lang", "r_phrase"])
    best = F.min(F.struct(cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r", "a")).alias("best")
    lowest = known.groupBy("lang", "phrase").agg(best).select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")
    around = triples.select("lang", F.explode(F.array_distinct(F.array(two(1, 2), two(2, 3)))).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * SHARE))
    return kept.drop("longer")


def mined(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    docs has doc_id, lang and text; other columns are not read. Null languages
    count as ``und``, null and empty texts have no words. Repeated rows count
    each. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    found = frequent(rows, least)
    totals = found.filter("words = 0").select("lang", "n")
    order = "ORDER BY score DESC, a DESC, phrase"
    # Of each of PARTS parts of a language the first rows go on, so that however many phrases it has, PARTS * top rows meet.
    parted = scored(found).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = parted.selectExpr("*", f"row_number() OVER (PARTITION BY lang, part {order}) AS nth").filter(F.col("nth") <= top)
    ranked = first.selectExpr("*", f"row_number() OVER (PARTITION BY lang {order}) AS rank").filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
