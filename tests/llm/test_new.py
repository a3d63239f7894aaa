"""Language identification, Merkle manifest and phrase mining against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gridstone.llm import language, manifest, phrases
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The levels of one tree, from its leaves to its root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(r, more=0):
        fields = [r[0], r[1], r[2], None if r[3] is None else r[3] + more, r[4]]
        return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for k, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = []
            for levels, i in ((trees[g], k), (top, at)):
                for nodes in levels[:-1]:
                    other = i ^ 1
                    steps.append((i % 2, nodes[other] if other < len(nodes) else None))
                    i //= 2
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            v = leaf(r, 1) if hit else leaf(r)
            for slot, sibling in steps:
                v = sha(v) if sibling is None else sha(sibling, v) if slot else sha(v, sibling)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha(*[s for _, s in steps if s is not None]), v, v == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def made(n, langs, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(["a", "é", None]), rng.choice(langs), rng.choice([None, k]), rng.choice(["", None, "x" * k, "文 字\n"])) for k in range(n)]


@pytest.mark.parametrize("n, langs, levels", [(1, ["de"], 10), (2, ["de"], 10), (9, ["de", None], 1), (60, ["de", None, "", "=", "é", "Z"], 2), (130, ["de", "en", "en", "en", None], 3), (300, ["en"], 10)])
def test_manifest(spark, n, langs, levels):
    rows = made(n, langs)
    rows += rows[-1:] * 2 + [(None, None, langs[0], 3, "x"), (None, None, langs[0], None, None)] if n > 2 else []
    rng = random.Random(5)
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), DOCS).repartition(3)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("g", "idx", "n", "node", "block", "path", "root", "leaf"))])
    got = manifest.document_manifest(docs, levels).collect()
    assert Counter(map(tuple, got)) == Counter(plain_manifest(rows))
    assert n < 60 or {r.verified for r in got} == {True, False}


def test_manifest_keeps_columns(spark):
    rows = spark.createDataFrame([(k, "a", sha(str(k)), k * k) for k in range(5)], "at long, grp string, digest string, root long")
    got = manifest.manifest(rows, "grp", "at", "digest", 1)
    assert sorted(got.columns) == ["at", "digest", "grp", "path", "root", "subroot"] and got.count() == 5
    one = got.filter("at = 4").first()
    assert [s.sibling is None for s in one.path] == [True, True, False]


def test_manifest_of_nothing(spark):
    assert manifest.document_manifest(spark.createDataFrame([], DOCS)).count() == 0


# Language identification


def plain_bits(text, trained, order):
    """Code length by dictionaries of counts, byte by byte."""
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    pad = lambda t: bytes(order) + t
    for t in trained:
        padded = pad(t)
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[k][padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, pad(text)
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            context = seen[k].get(padded[i - k : i])
            if context is None:
                continue
            whole = sum(context.values()) + len(context)
            if padded[i] in context:
                bits += math.log2(whole / context[padded[i]])
                break
            bits += math.log2(whole / len(context))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("order", [0, 1, 4])
@pytest.mark.parametrize("size", [7, 1 << 20])
def test_code_lengths(monkeypatch, order, size):
    monkeypatch.setattr(language, "SLICE", size)
    monkeypatch.setattr(language, "MEMO", 40)
    rng = random.Random(order)
    make = lambda letters, n: bytes(rng.choice(letters) for _ in range(n))
    trained = [[make(b"abc ", rng.randrange(30)) for _ in range(6)], [make("aéb ".encode(), 40)], []]
    texts = [b"", b"a", make(b"abcd ", 50), b"", make("éü".encode(), 21), b"\x00\xff"]
    scorer = language.Scorer([language.tree(t, order) for t in trained], order)
    for _ in range(2):
        got = scorer.score(texts)
        want = [[plain_bits(t, own, order) for own in trained] for t in texts]
        assert np.allclose(got, want)


ODD = [None, "", " \n 12 !", "é", "x" * 50_000, "文字", "the"]


def test_language_of_documents(spark):
    real = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(None if k % 3 == 0 else 5000 + k, "en" if k % 2 else None, t) for k, t in enumerate(ODD)] * 2, "doc_id long, lang string, text string")
    docs = real.union(odd).select("*", F.lit(1).alias("lang_pred"), F.lit(2).alias("score"), F.lit(3).alias("rank"), F.lit(4).alias("n"))
    got = language.judged(docs).collect()
    assert len(got) == docs.count()
    langs = {r.doc_id: r.lang for r in real.collect()}
    held = [r for r in got if r.held_out and r.doc_id in langs]
    assert len(held) > 30 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[5001] == by[5002] == "und" and by[5004] != "und" and by[5005] in set(langs.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)


def test_language_learns_of_its_fold_only(spark):
    """Texts of the held-out fold, and their languages, leave the model alone."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    held = language.remainder(F.col("doc_id")) == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert sorted(map(tuple, language.judged(other).collect())) == sorted(map(tuple, language.judged(docs).collect()))


def test_language_without_training(spark):
    docs = spark.createDataFrame([(1, None, "abc"), (2, None, None)], "doc_id long, lang string, text string")
    assert [(r.lang_pred, r.score) for r in language.judged(docs).collect()] == [("und", 0.0)] * 2
    assert language.judged(docs.filter("false")).count() == 0


def test_language_sample_is_bounded(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END lang", "repeat(concat('w', id, ' '), 100) text")
    sample = language.training_rows(rows, F.lit(True), 50, 64)
    assert all(len(r.part) <= 64 for r in sample.collect())
    sizes = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert 40 < sizes["a"] < 120 and 40 < sizes["b"] < 120


# Phrases


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or ("und" if lang is None else lang)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in (1, 2, 3):
                for k in range(len(words) - m + 1):
                    f[lang][tuple(words[k : k + m])] += 1
    out = []
    for lang, own in f.items():
        found = []
        for p, a in own.items():
            if len(p) == 1 or a < least:
                continue
            longer = [own[q] for q in own if len(q) == 3 and len(p) == 2 and own[q] >= least and p in (q[:2], q[1:])] if len(p) == 2 else []
            if any(100 * x >= 50 * a for x in longer):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), own[p[:k]], own[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, total[lang], score) for i, (score, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def phrase_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "THE", "of", "é", "ß", "new", "York", "city", "a b", "文", "#", " "] + [f"w{k}" for k in range(30)]
    gaps = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "?! "]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice([6, 12, 42])]) + rng.choice(gaps) for _ in range(rng.randrange(80)))
        rows.append((rng.choice(["en", "de", "und", None, ""]), text + "New York City " * rng.randrange(3)))
    return rows + [("en", None), (None, None), ("en", ""), ("fr", ""), ("xx", " . "), ("en", "the the the the"), ("fr", "x" * 3000)] + rows[:9]


@pytest.mark.parametrize("seed, least, sample, sample_least, chunk, bits", [(1, 10, 8, 2, 8 << 20, 27), (2, 4, 3, 2, 64, 12), (3, 3, 10**9, 1, 500, 27), (4, 3, 1, 1, 200, 6), (5, 5, 2, 1, 1, 20)])
def test_phrases(spark, monkeypatch, seed, least, sample, sample_least, chunk, bits):
    """Whatever the sample, its bounds, the filters' size (full ones too) and the cuts of texts, the result is the plain one."""
    rows = phrase_rows(seed)
    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("phrase", "n", "words", "a", "l", "r", "score", "rank", "k"))]).repartition(3)
    own = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    monkeypatch.setattr(phrases, "frequent", lambda d, n, f=phrases.frequent: f(own, n, sample, sample_least, chunk, bits))
    got = sorted(map(tuple, phrases.mined(docs, least).collect()))
    assert got == plain_phrases(rows, least) and got


def test_phrases_top_and_empty(spark):
    rows = phrase_rows(7)
    docs = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string")
    assert sorted(map(tuple, phrases.mined(docs, 3, 2).collect())) == plain_phrases(rows, 3, 2)
    assert phrases.mined(docs.filter("false")).count() == 0


def test_phrase_score_is_exact(spark):
    a, l, r = 10**12 + 7, 10**13 + 3, 10**12 + 9
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(phrases.cut_score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1000000 * a * a // (l * r)
