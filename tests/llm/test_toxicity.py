"""The automaton against plain edit distance, and held-out accuracy."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute
import pytest
from gridstone.llm import toxicity
from hypothesis import given, settings
from hypothesis import strategies as st
from test_lines import levenshtein

TERMS = {"abcde": 2.0, "abcdx": 3.0, "aaaaabbbb": 4.0, "ab": 5.0, "bcdea": 1.5}
AUTOMATON = toxicity.Lexicon(TERMS, {"cabb": 6.0}).automaton()


@settings(max_examples=2500, deadline=None)
@given(st.text("abcdex", max_size=12))
def test_automaton(word):
    exact = max([w for t, w in TERMS.items() if t == word] + [6.0] * (word.startswith("cabb") and len(word) > 4), default=0.0)
    edits = lambda t: 0 if len(t) < toxicity.FUZZY else 1 if len(t) < toxicity.LONG else 2
    near = max([w for t, w in TERMS.items() if 0 < levenshtein(t, word) <= edits(t)], default=0.0)
    got = AUTOMATON.find(word)
    assert got[0] == exact
    assert got[1] == near or exact


def texts(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    rows = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobfug", "schwindler", "halunkeric", "halunkeron", "halunkeman", "halunkesal", "halunkelit"]))
        rows.append((k, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = texts(900, 1)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(2000, None), (2001, ""), (None, "grobfug"), (0, rows[0][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5000, 1), (2000, 1), (3, None)], "doc_id bigint, toxic int")
    return docs, labels, rows


def test_held_out(tables):
    docs, labels, rows = tables
    truth = {r[0]: r[2] for r in rows}
    found = toxicity.judged(docs, labels).collect()
    assert len(found) == len(rows) + 4
    for r in found:
        assert r.held_out == (brute.crc("" if r.doc_id is None else str(r.doc_id)) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in found if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert [r.predicted for r in found if r.doc_id in (2000, 2001)] == [0, 0]


def test_misspelled_and_quoted(tables):
    docs, labels, _ = tables
    model = toxicity.train(docs, labels)
    matcher = toxicity.Matcher(model.lexicon)
    plain = "lose words here and you are a schwindler or nothing at all"
    score = lambda t: model.score([toxicity.features(t, matcher)])[0]
    assert score(plain) > 0.5 and score(plain.replace("schwindler", "schw1ndler")) > 0.5
    assert score(plain.replace("schwindler", "linen")) < 0.5
    assert score('he said the word "schwindler" to them') < score(plain)


def test_odd_tables(tables):
    docs, labels, rows = tables
    assert toxicity.judged(docs.filter("false"), labels).count() == 0
    assert {r.predicted for r in toxicity.judged(docs, labels.filter("false")).collect()} == {0}
    assert {r.predicted for r in toxicity.judged(docs, labels.filter("toxic = 1")).collect()} == {0}
    own = docs.selectExpr("*", "7 as score", "'x' as __gs_text")
    kept = toxicity.keep_clean(own, labels)
    assert kept.columns == own.columns and {r.score for r in kept.collect()} == {7}
    assert kept.count() < docs.count()
    assert len(toxicity.training_rows(docs, labels, 5, 9)) <= 14


STEMMED = toxicity.Lexicon({"abcdeab": 3.0}, {"abcde": 2.0, "xabc": 6.0}).automaton()


@settings(max_examples=1500, deadline=None)
@given(st.text("abcdex", max_size=10))
def test_misspelled_stems(word):
    begins = [word[:n] for n in range(len(word))]
    exact = max([3.0 * (word == "abcdeab"), 2.0 * ("abcde" in begins), 6.0 * ("xabc" in begins)])
    near = max([3.0 * (levenshtein("abcdeab", word) == 1), 2.0 * any(levenshtein("abcde", x) <= 1 for x in begins)])
    got = STEMMED.find(word)
    assert got[0] == exact
    assert got[1] == near or exact


def test_misspelled_family(tables):
    docs, labels, _ = tables
    lexicon = toxicity.train(docs, labels).lexicon
    matcher = toxicity.Matcher(lexicon)
    assert any("halunkeric".startswith(s) for s in lexicon.stems)
    assert matcher["halunkeric"] and not matcher["halunkeric"][1]
    assert all(matcher[w] and matcher[w][1] for w in ("ha1unkeric", "hqlunkeron", "halnkesal"))
