"""Language identification by partial matching: byte context trees of each language, and exact code lengths under them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import prepare

#: A context has so many bytes at most.
ORDER = 4
#: The bounded training sample of each language: so many rows at most, taken by a hash of ids and texts, each with so
#: many bytes at most (of a longer text a stretch from a place that its hash gives).
MAX_ROWS, MAX_ROW_BYTES = 400, 4096
#: Positions scored at once, and code lengths of distinct contexts with their byte that a task remembers.
SLICE, MEMO = 1 << 20, 1 << 20
UNKNOWN = "und"


@dataclass
class Level:
    """The contexts of one order: sorted (context, byte) codes with their bits, and sorted contexts with those of an escape."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


def codes(data: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For k from 0 to ``order`` the last k bytes before each position and its own as one number.

    Before a text's start lie zero bytes.
    """
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    out = [data.astype(np.uint64)]
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        before[at < k] = 0
        out.append(out[-1] | before << np.uint64(8 * k))
    return out


def joined(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts one after another, and where each begins."""
    texts = list(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64) if texts else ends


def tree(texts: Iterable[bytes], order: int = ORDER) -> list[Level]:
    """The context tree of a language as one Level an order, with escapes by method C.

    In a context seen T times with U different bytes a byte seen c times costs
    -log2(c / (T + U)) bits and an escape to the next shorter context
    -log2(U / (T + U)).
    """
    data, starts = joined(t for t in texts if t)
    out = []
    for k, code in enumerate(codes(data, starts, order)):
        grams, counts = np.unique(code, return_counts=True)
        contexts, at = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(at, counts, len(contexts)), np.bincount(at, minlength=len(contexts))
        whole = total + kinds
        out.append(Level(grams, np.log2(whole[at] / counts) if len(grams) else np.zeros(0), contexts, np.log2(whole / kinds)))
    return out


def code_lengths(own: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Bits of each (context, byte) code of the longest order: escapes down to the longest context that knows the byte, and then its bits there.

    A byte that no context knows costs eight bits after all escapes.
    """
    bits, open_ = np.zeros(len(own)), np.arange(len(own))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        if not len(level.grams) or not len(open_):
            continue
        gram = own[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
        at = np.minimum(np.searchsorted(level.grams, gram), len(level.grams) - 1)
        known = level.grams[at] == gram
        bits[open_[known]] += level.bits[at[known]]
        open_, gram = open_[~known], gram[~known]
        at = np.minimum(np.searchsorted(level.contexts, gram >> np.uint64(8)), len(level.contexts) - 1)
        seen = level.contexts[at] == gram >> np.uint64(8)
        bits[open_[seen]] += level.escape[at[seen]]
    bits[open_] += 8
    return bits


class Scorer:
    """Bits of texts under every language; costs of codes met before are remembered."""

    def __init__(self, trees: list[list[Level]], order: int):
        self.trees, self.order = trees, order
        self.known, self.costs = np.zeros(0, np.uint64), np.zeros((0, len(trees)))

    def _costs(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, found)
        old = np.zeros(len(found), bool)
        old[at < len(self.known)] = self.known[at[at < len(self.known)]] == found[at < len(self.known)]
        out = np.empty((len(found), len(self.trees)))
        out[old] = self.costs[at[old]]
        new = found[~old]
        fresh = np.stack([code_lengths(new, levels) for levels in self.trees], 1) if len(new) else np.zeros((0, len(self.trees)))
        out[~old] = fresh
        if len(self.known) + len(new) <= MEMO:
            self.known = np.insert(self.known, at[~old], new)
            self.costs = np.insert(self.costs, at[~old], fresh, 0)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(text, language) bits. Texts are taken in slices, so that a long one needs no more memory."""
        out = np.zeros((len(texts), len(self.trees)))
        data, starts = joined(texts)
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(data))))
        for a in range(0, len(data), SLICE):
            # The slice's first positions see the bytes before it.
            low, b = max(0, a - self.order), min(len(data), a + SLICE)
            inside = text_of[low:b]
            begun = np.unique(inside, return_index=True)[1]
            # A text that began earlier has real bytes before the slice; only what lies before ``low`` is out of reach.
            code = codes(data[low:b], begun, self.order)[self.order][a - low :]
            found, which = np.unique(code, return_inverse=True)
            cost = self._costs(found)[which]
            cuts = np.unique(inside[a - low :], return_index=True)
            out[cuts[0]] += np.add.reduceat(cost, cuts[1], 0)
        return out


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_rows(docs: DataFrame, fold: Column, max_rows: int = MAX_ROWS, max_bytes: int = MAX_ROW_BYTES) -> DataFrame:
    """(lang, rank, part) of the sample: per language about max_rows rows with the least hashes, of the rows that ``fold`` leaves.

    A count by language sets the hash below which rows are kept, so that no
    sort gathers a language; ``tree_of`` drops what is over the bound. The
    counts come to the driver, one row a language as the trees do later.
    """
    own = docs.filter(fold & F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", "text", F.xxhash64("doc_id", "text").alias("rank"))
    # rank is uniform over 64 bits: 1.5 max_rows are expected below the limit.
    limits = [(r[0], min(1.0, 1.5 * max_rows / r[1]) * float(1 << 53)) for r in own.groupBy("lang").count().collect()]
    table = docs.sparkSession.createDataFrame(limits, "__gs_lang string, __gs_limit double")
    kept = own.join(F.broadcast(table), F.col("lang") == F.col("__gs_lang")).filter(F.shiftrightunsigned("rank", 11) <= F.col("__gs_limit"))
    data = F.col("text").cast("binary")
    span = F.octet_length("text") - max_bytes
    at = F.when(span > 0, F.pmod("rank", span) + 1).otherwise(F.lit(1)).cast("int")
    return kept.select("lang", "rank", F.substring(data, at, F.lit(max_bytes)).alias("part"))


MODEL = "lang string, k int, grams array<long>, bits array<double>, contexts array<long>, escape array<double>"


def train(rows: DataFrame, order: int = ORDER, max_rows: int = MAX_ROWS) -> dict[str, list[Level]]:
    """The context trees by language of (lang, rank, part); each is built by one task from its bounded sample.

    Equal parts of a language count once, so that copies of one text do not set its statistics.
    """

    def tree_of(table: pa.Table) -> pa.Table:
        lang = table["lang"][0].as_py()
        rows = sorted(set(zip(table["rank"].to_pylist(), table["part"].to_pylist(), strict=True)))[:max_rows]
        levels = tree(sorted({part for _, part in rows}), order)
        signed = lambda x: x.view(np.int64).tolist()
        out = [{"lang": lang, "k": k, "grams": signed(v.grams), "bits": v.bits.tolist(), "contexts": signed(v.contexts), "escape": v.escape.tolist()} for k, v in enumerate(levels)]
        return pa.Table.from_pylist(out, pa.schema([("lang", pa.string()), ("k", pa.int32()), ("grams", pa.list_(pa.int64())), ("bits", pa.list_(pa.float64())), ("contexts", pa.list_(pa.int64())), ("escape", pa.list_(pa.float64()))]))

    found = rows.groupBy("lang").applyInArrow(tree_of, MODEL).toArrow()
    out: dict[str, list[Level]] = {}
    order_by = sorted(range(found.num_rows), key=lambda i: (found["lang"][i].as_py(), found["k"][i].as_py()))
    value = lambda name, i: found[name][i].values.to_numpy(zero_copy_only=False)
    for i in order_by:
        level = Level(value("grams", i).view(np.uint64), value("bits", i), value("contexts", i).view(np.uint64), value("escape", i))
        out.setdefault(found["lang"][i].as_py(), []).append(level)
    return out


def identified(docs: DataFrame, model: dict[str, list[Level]], text: str = "text", order: int = ORDER) -> DataFrame:
    """docs with lang_pred and score of each whole text.

    The language under which the text's code is shortest, ties to the least by
    name; score is its posterior among all languages, each as likely before.
    A null text, one without a letter, and every text where no language was
    learned is ``und`` with score 0. Columns named like a result are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    names = sorted(model)
    shared = spark.sparkContext.broadcast([model[n] for n in names])

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value, order)
        for texts in batches:
            bits = scorer.score(texts.cast(pa.binary()).fill_null(b"").to_pylist())
            best = bits.argmin(1)
            chance = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
            yield pa.StructArray.from_arrays([pa.array([names[k] for k in best], pa.string()), pa.array(chance)], ["lang", "score"])
        pa.default_memory_pool().release_unused()

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not names:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("__gs_found", F.arrow_udf(predict, "struct<lang:string,score:double>")(text))
    return found.select(*kept, F.when(letters, F.col("__gs_found.lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(letters, F.col("__gs_found.score")).otherwise(0.0).alias("score"))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document; learned from the documents that are not held out."""
    model = train(training_rows(docs.select("doc_id", "lang", "text"), remainder(F.col("doc_id")) != 1))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
