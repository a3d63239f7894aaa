"""Toxicity: learned terms, their misspellings by automaton, and the words around them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import prepare

#: The bounded training sample: so many labelled rows of either kind at most, taken by a hash of their ids.
MAX_TOXIC, MAX_CLEAN = 1500, 3000
#: A term needs so many toxic documents, and as many different neighbourhoods, so that copies of one text count once;
#: a stem also needs so many different words.
MIN_DOCS = 4
#: Log odds from which a word or stem is a term.
MIN_ODDS = 2.5
MAX_TERMS = 5000
STEM_CHARS = range(4, 11)
#: Terms and stems of so many characters may have one edit, and terms from LONG on two.
FUZZY, LONG = 5, 9
#: A misspelled term counts for so much of the term; a quoted or reported one likewise.
FUZZY_SHARE, QUOTED_SHARE = 0.7, 0.35
#: Words on either side that make a hit's context.
CONTEXT = 5
CACHE = 150_000

PUNCTUATION = " .,;:!?\"'`()[]{}<>|/\\#*$%&@~^+=-_«»“”„‘’…¡¿"
QUOTES = "\"“”«»„‘’"
#: Words that report speech or mention a word (fixed values).
REPORTING = frozenset("said says called calls calling word words term terms quote quoted quotes wrote writes labelled labeled dit mot terme sagte wort nannte dijo palabra llamó".split())

Hit = tuple[float, bool]  # weight, whether misspelled


class LexiconTrie:
    """Terms by character; a node may end a whole term or a stem that longer words continue."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.term: dict[int, float] = {}
        self.stem: dict[int, float] = {}
        self.edits: dict[int, int] = {}
        self.stem_edits: dict[int, int] = {}
        self.reach: list[int] = [0]

    def add(self, word: str, weight: float, stem: bool, edits: int) -> None:
        path = [0]
        for c in word:
            node = self.next[path[-1]].get(c)
            if node is None:
                node = len(self.next)
                self.next[path[-1]][c] = node
                self.next.append({})
                self.reach.append(0)
            path.append(node)
        (self.stem if stem else self.term)[path[-1]] = weight
        (self.stem_edits if stem else self.edits)[path[-1]] = edits
        for node in path:
            self.reach[node] = max(self.reach[node], edits)


class LevenshteinLexicon:
    """The intersection of the words' Levenshtein automata with the trie, as states made on demand.

    A state is a set of (trie node, edits so far). A word steps through all
    terms at once and dies as soon as no term can be near it.
    """

    def __init__(self, trie: LexiconTrie):
        self.trie = trie
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, float]] = []
        self.alphabet = {c for children in trie.next for c in children}
        self.dead = self._state(frozenset())
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With skipped term characters; of each node the fewest edits."""
        best: dict[int, int] = {}
        todo = list(states)
        while todo:
            node, e = todo.pop()
            if e > best.get(node, 99) or (node in best and e == best[node]):
                continue
            best[node] = e
            if node >= 0:
                todo += [(child, e + 1) for child in self.trie.next[node].values() if e < self.trie.reach[child]]
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        found = self.ids.get(states)
        if found is None:
            found = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            exact = max([self.trie.term[n] for n, e in states if not e and n in self.trie.term] + [self.trie.stem[-n - 1] for n, e in states if n < 0 and not e], default=0.0)
            near = max([self.trie.term[n] for n, e in states if e and n in self.trie.term and e <= self.trie.edits[n]] + [self.trie.stem[-n - 1] for n, e in states if n < 0 and e], default=0.0)
            self.ends.append((exact, near))
        return found

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if node < 0:  # a stem passed; anything may follow
                out.add((node, e))
                continue
            if e <= self.trie.stem_edits.get(node, -1):
                out.add((-node - 1, e))
            for own, child in self.trie.next[node].items():
                if own == c:
                    out.add((child, e))
                elif e < self.trie.reach[child]:
                    out.add((child, e + 1))
            if e < self.trie.reach[node]:
                out.add((node, e + 1))
        return self._state(self._closed(out))

    def find(self, word: str) -> tuple[float, float]:
        """(weight as a term or by a stem, weight of the nearest misspelled term); zeros without."""
        at, steps, dead = self.start, self.steps, self.dead
        for c in word:
            if c not in self.alphabet:
                c = ""
            to = steps[at].get(c)
            if to is None:
                to = steps[at][c] = self._step(at, c)
            if to == dead:
                return 0.0, 0.0
            at = to
        return self.ends[at]


@dataclass
class Lexicon:
    """Terms and stems with their weights, and misspellings known to be harmless."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()

    def automaton(self) -> LevenshteinLexicon:
        trie = LexiconTrie()
        for w, weight in self.words.items():
            trie.add(w, weight, False, 0 if len(w) < FUZZY else 1 if len(w) < LONG else 2)
        for w, weight in self.stems.items():
            trie.add(w, weight, True, 0 if len(w) < FUZZY else 1)
        return LevenshteinLexicon(trie)


class Matcher(dict):
    """Raw word to its hit or None; a bounded cache over the automaton."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.automaton, self.harmless = lexicon.automaton(), lexicon.harmless

    def __missing__(self, raw: str) -> Hit | None:
        word = raw.strip(PUNCTUATION)
        exact, near = self.automaton.find(word) if word else (0.0, 0.0)
        hit = (exact, False) if exact else (near * FUZZY_SHARE, True) if near and word not in self.harmless else None
        if len(self) >= CACHE:
            self.clear()
        self[raw] = hit
        return hit


def quoted(words: list[str], at: int) -> bool:
    """Whether the word stands in quotation marks, or near a word that reports speech."""
    low, high = max(0, at - CONTEXT), min(len(words), at + CONTEXT + 1)
    before = sum(w.count(q) for w in words[low:at] for q in QUOTES) + (words[at][0] in QUOTES)
    after = sum(w.count(q) for w in words[at + 1 : high] for q in QUOTES) + (words[at][-1] in QUOTES)
    return before % 2 == 1 and after > 0 or any(w.strip(PUNCTUATION) in REPORTING for w in words[low:high])


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Evidence of the hits, each weighed by its context; zeros without hits or text."""
    words = text.lower().split() if text else []
    found: dict[str, float] = {}
    share = fuzzy = 0.0
    hits = [(k, h) for k, h in enumerate(map(matcher.__getitem__, words)) if h]
    for k, (weight, misspelled) in hits:
        value = weight * (QUOTED_SHARE if quoted(words, k) else 1.0)
        word = words[k].strip(PUNCTUATION)
        found[word] = max(value, found.get(word, 0.0))
        fuzzy += misspelled
        share += value
    if not hits:
        return [0.0] * 5
    values = sorted(found.values(), reverse=True)
    return [min(30.0, sum(values)) / 5, values[0], math.log1p(len(values)), fuzzy / len(hits), math.log1p(100 * share / len(words))]


def forms(word: str) -> list[str]:
    """The word, and its stems as prefixes marked by ``+``."""
    return [word, *[word[:n] + "+" for n in STEM_CHARS if n < len(word)]]


def learn_lexicon(rows: Iterable[tuple[str, int]]) -> Lexicon:
    """Words and stems far likelier in toxic than in clean texts, by documents and by neighbourhoods."""
    own: dict[str, str] = {}  # one object for each word
    rows = [([own.setdefault(w, w) for w in (w.strip(PUNCTUATION) for w in t.lower().split())], y) for t, y in rows]
    n_toxic = sum(y for _, y in rows)
    n_clean = len(rows) - n_toxic
    if not n_toxic or not n_clean:
        return Lexicon()
    toxic: dict[str, int] = {}
    for size in (0, *STEM_CHARS):  # one length of stem after the other, to count few forms at a time
        some: Counter[str] = Counter()
        for words, y in rows:
            if y:
                some.update({w[:size] + "+" if size else w for w in set(words) if len(w) > size})
        toxic |= {f: n for f, n in some.items() if n >= MIN_DOCS}
    clean: Counter[str] = Counter()
    around: dict[str, set[int]] = {}
    for words, y in rows:
        if not y:
            clean.update({f for w in set(words) for f in forms(w) if f in toxic})
    odds = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean[f] + 0.5) / (n_clean + 1)) for f, n in toxic.items()}
    strong = {f for f, x in odds.items() if x >= MIN_ODDS}
    # A chance finding among so many forms must be unlikely: binomial deviance against the log of their number.
    p, bound = n_toxic / len(rows), math.log(len(toxic) + 2) + 3

    def deviance(k: int, n: int) -> float:
        return k * math.log(k / (n * p)) + ((n - k) * math.log((n - k) / (n * (1 - p))) if n > k else 0.0)

    strong = {f for f in strong if deviance(toxic[f], toxic[f] + clean[f]) >= bound}
    grown: dict[str, set[str]] = {}
    for words, y in rows:
        if y:
            for k, w in enumerate(words):
                if own := [f for f in forms(w) if f in strong]:
                    ctx = hash((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""))
                    for f in own:
                        seen = around.setdefault(f, set())
                        if len(seen) < MIN_DOCS:
                            seen.add(ctx)
                        if f[-1] == "+" and len(more := grown.setdefault(f, set())) < MIN_DOCS:
                            more.add(w)
    kept = sorted((f for f in strong if len(around.get(f, ())) >= MIN_DOCS and (f[-1] != "+" or len(grown[f]) >= MIN_DOCS)), key=lambda f: (-odds[f], f))[:MAX_TERMS]
    found = Lexicon({f: odds[f] for f in kept if f[-1] != "+"}, {f[:-1]: odds[f] for f in kept if f[-1] == "+"})
    automaton = found.automaton()
    near: Counter[tuple[str, int]] = Counter()
    for words, y in rows:
        for w in set(words):
            exact, fuzzy = automaton.find(w) if w else (0.0, 0.0)
            if fuzzy and not exact:
                near[w, y] += 1
    harmless = {w for w, y in near if not y and math.log((near[w, 1] + 0.5) / (n_toxic + 1)) - math.log((near[w, 0] + 0.5) / (n_clean + 1)) < MIN_ODDS}
    return Lexicon(found.words, found.stems, frozenset(harmless))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 100) -> np.ndarray:
    """Projected Newton steps; the intercept is last and not shrunk.

    The other weights stay at or above zero: every feature is evidence, and
    more of it must not lower a score.
    """
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - shrink * w
        free = (w > 0) | (slope > 0)
        free[-1] = True
        h = (z[:, free] * (p * (1 - p))[:, None]).T @ z[:, free] + np.diag(shrink[free])
        new = w.copy()
        new[free] += np.clip(np.linalg.solve(h, slope[free]), -2, 2)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        z = np.asarray(rows, dtype=float).reshape(-1, 5) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[str, int]]) -> Model:
    """Each half's features come from the other half's lexicon; the final lexicon uses both.

    Without rows of both kinds nothing is toxic.
    """
    rows = sorted(dict(rows).items())
    halves = rows[::2], rows[1::2]
    x, y = [], []
    for own, other in (halves, halves[::-1]):
        matcher = Matcher(learn_lexicon(other))
        x += [features(t, matcher) for t, _ in own]
        y += [label for _, label in own]
    if len(set(y)) < 2:
        return Model(Lexicon(), np.array([0, 0, 0, 0, 0, -30.0]))
    return Model(learn_lexicon(rows), fit_logistic(np.array(x), np.array(y, dtype=float)))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> list[tuple[str, int]]:
    """(text, toxic) of at most max_toxic and max_clean labelled rows outside the held-out fold; equal texts count once."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("__gs_y")).withColumnRenamed("doc_id", "__gs_id")
    own = docs.filter("text is not null").select(F.col("doc_id"), F.col("text"))
    ids = own.select("doc_id").filter(remainder(F.col("doc_id")) != 0).distinct().join(known, F.col("doc_id") == F.col("__gs_id"))
    chosen: list[tuple[int, int]] = []
    for y, most in ((1, max_toxic), (0, max_clean)):
        chosen += [(r[0], y) for r in ids.filter(F.col("__gs_y") == y).orderBy(F.xxhash64("__gs_id"), "__gs_id").limit(most).select("__gs_id").collect()]
    if not chosen:
        return []
    # At most max_toxic + max_clean small rows, so a broadcast is bounded.
    table = docs.sparkSession.createDataFrame(chosen, "__gs_id bigint, __gs_y int")
    found = own.join(F.broadcast(table), F.col("doc_id") == F.col("__gs_id")).groupBy(F.xxhash64("text")).agg(F.first("text"), F.max("__gs_y"))
    return [(r[1], r[2]) for r in found.collect()]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) of each whole text; empty and null texts have no evidence. A column named score is replaced."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        matcher = Matcher(own.lexicon)
        for texts in batches:
            yield pa.array(own.score([features(t, matcher) for t in texts.to_pylist()]))
        pa.default_memory_pool().release_unused()

    return docs.withColumn("score", F.arrow_udf(score, "double")("text"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score is 0.5 or more."""
    taken = {c: f"__gs_own_{c}" if c == "score" else c for c in docs.columns}
    out = scored(docs.withColumnsRenamed(taken), train(docs, labels)).filter("score < 0.5")
    return out.select(*[F.col(own).alias(c) for c, own in taken.items()])
