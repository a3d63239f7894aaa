"""Line deduplication against all pairs of lines."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import random

import brute
import numpy as np
import pytest
import xxhash
from gridstone.llm import bitsliced, line_grams, line_words, lines
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=800, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40))
def test_edit_similarity(a, b):
    want = 1 - levenshtein(a, b) / max(len(a), len(b), 1)
    got = lines.edit_similarity(a, b)
    assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=2, max_size=6), st.sampled_from([(1 << 19, 4000), (40, 4000), (1 << 19, 12)]))
def test_alike(rows, bounds):
    rows = [*rows, rows[0] * 2, rows[0] + [1], rows[1][:-1] + [0]]
    n = np.array(list(map(len, rows)))
    tokens = np.array([x for r in rows for x in r] + [0], dtype=np.uint32)
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if max(n[i], n[j])]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_words, "BAND_CELLS", bounds[0])
        patch.setattr(line_words, "BAND_WORDS", bounds[1])
        got = line_words.alike(tokens, np.cumsum(n) - n, n, np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64))
    assert got.tolist() == [1 - levenshtein(rows[i], rows[j]) / max(n[i], n[j]) >= 0.8 - 1e-9 for i, j in pairs]


def norm(line):
    out = "".join(c.lower() if "A" <= c <= "Z" else c if c.isalnum() or ord(c) > 127 else " " for c in line)
    return [w for w in out.split(" ") if w]


def mixed(x, factor):
    full = (1 << 64) - 1
    x = ((x ^ x >> 31) * factor) & full
    x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & full
    return x ^ x >> 32


def fp(words):
    full = (1 << 64) - 1
    hashes = []
    for w in words:
        x = (sum(b * pow(line_words.BASE, k, 1 << 64) for k, b in enumerate(w.encode())) + len(w.encode())) & full
        hashes.append(mixed(x, 0x9E3779B97F4A7C15) << 64 | mixed(x, 0x94D049BB133111EB))
    return sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))


def near(a, b):
    """At least one of the four blocks of the first half agrees, and it differs by eight bits at most."""
    a, b = a >> 64, b >> 64
    cuts = [64 * k // 4 for k in range(5)]
    return sum((a ^ b) >> lo & ((1 << hi - lo) - 1) == 0 for lo, hi in zip(cuts, cuts[1:], strict=False)) >= 1 and (a ^ b).bit_count() <= 8


def expected(rows):
    """Dropped line numbers by row."""
    places = []
    for k, (d, text) in enumerate(rows):
        for n, line in enumerate((text or "").split("\n") if text is not None else []):
            words = norm(line)
            if len(words) >= lines.MIN_WORDS:
                places.append((d, k, n, words, fp(words)))
    links = [(i, j) for i in range(len(places)) for j in range(i) if places[i][3] == places[j][3] or ((places[i][4] ^ places[j][4]).bit_count() <= lines.RADIUS and near(places[i][4], places[j][4]) and 1 - levenshtein(places[i][3], places[j][3]) / max(len(places[i][3]), len(places[j][3])) >= 0.8 - 1e-9)]
    tops = brute.classes(len(places), links)
    first = {}
    for p, c in zip(places, tops, strict=True):
        first[c] = min(first.get(c, p[:3]), p[:3])
    out = {k: [] for k in range(len(rows))}
    for p, c in zip(places, tops, strict=True):
        if first[c] != p[:3]:
            out[p[1]].append(p[2])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=40), min_size=1, max_size=9))
def test_simhashes(rows):
    rows = [*rows, [w for r in rows for w in r] * 9]
    got = lines.simhashes([[w.encode() for w in r] for r in rows]).tolist()
    assert [a << 64 | b for a, b in got] == [fp(r) for r in rows]


def make_rows():
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 30]))] for _ in range(25)]
    rows = []
    for d in range(60):
        body = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                line[0] = line[0].upper() + "!"
            body.append(" ".join(line))
        rows.append((d, "\n".join(body)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "a b c d e f\r\na b c d e f"), (104, "x y z\nx y z"), (105, "é ü ñ ö ä\né ü ñ ö ä!")]


@pytest.mark.parametrize("chunk", [1 << 16, 4])
def test_dedup_lines(spark, monkeypatch, chunk):
    monkeypatch.setattr(bitsliced, "CHUNK_ROWS", chunk)
    rows = make_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1)).withColumn("dropped", F.lit("old")).repartition(3)
    out = lines.dedup_lines(docs, radius=lines.RADIUS)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped", "dropped"]
    want = expected(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert sum(map(len, want.values())) > sum(len(r[1] or "") > 0 for r in rows) / 2
    for k, (d, text) in enumerate(rows):
        assert got[d].dropped == want[k], d
        left = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in want[k])
        assert got[d].text == left
        assert got[d].n_lines == (0 if text is None else text.count("\n") + 1)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (None, None)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in lines.dedup_lines(docs).collect())
    assert got == [("1", "a b c d e"), ("1", "a b c d e"), ("None", ""), ("None", "None")]
    assert lines.dedup_lines(docs.filter("false")).count() == 0
    assert lines.dedup_digest(docs.filter("text is null")).count() == 1


def edited(rng, a, n):
    """a after n random edits of words."""
    b = list(a)
    for _ in range(n):
        at = rng.randrange(len(b))
        b[at : at + 1] = rng.choice([["x%d" % rng.randrange(900)], [], [b[at], "y%d" % rng.randrange(900)], [b[at]]])
    return b


@pytest.mark.parametrize("order", ["rare", "hash"])
def test_line_keys_lose_no_pair(order):
    """At every length and at the similarity's bound, with repeated words and with words of one class."""
    rng = random.Random(8)
    classes = np.zeros(1 << line_grams.SLOT_BITS, dtype=np.uint8)
    classes[:: 2 if order == "rare" else 1] = 40
    pairs = []
    for n in [*range(5, 60), 250, 256, 257, 300, 321, 400] * 8:
        a = ["%d" % rng.randrange(rng.choice([2, 9, 500])) for _ in range(n)]
        b = edited(rng, a, n // 5)
        if len(b) >= 5 and lines.edit_similarity(a, b) >= 0.8:
            pairs.append(([w.encode() for w in a], [w.encode() for w in b]))
    flat = [x for p in pairs for x in p]
    found = line_words.Lines.of([b" ".join(x) for x in flat])
    tokens, n = found.pick(np.arange(len(flat)))
    assert n.tolist() == list(map(len, flat))
    line, key = line_grams.line_keys(tokens, n, classes)
    own = [set() for _ in flat]
    for k, x in zip(line.tolist(), key.tolist(), strict=True):
        own[k].add(x)
    assert len(pairs) > 300 and all(own[2 * k] & own[2 * k + 1] for k in range(len(pairs)))
    for grain in (line_grams.COARSE, line_grams.FINE, 2):
        bits, first = line_grams.sketches(tokens, n, grain)
        met = {(min(i), max(i)) for a, b in line_grams.by_sketches(bits, first, n, np.zeros(len(n), dtype=np.int64), 0.8, grain) for i in zip(a.tolist(), b.tolist(), strict=True)}
        assert {(2 * k, 2 * k + 1) for k in range(len(pairs))} <= met


def test_word_hashes_of_long_words():
    words = [b"a", b"b" * 70_000, b"c" * 70_000, b"", b"a", b"x" * 600_000, b"b" * 70_000]
    got = line_words.word_hashes(words).tolist()
    assert got[0] == got[4] and got[1] == got[6] and len(set(got)) == 5
    texts = [b" ".join(words), b"a " + b"b" * 70_000]
    own = line_words.Lines.of(texts).words.tolist()
    assert len(own) == 8 and own[0] == own[3] == own[6] and own[1] == own[5] == own[7]
    assert got[:1] == line_words.word_hashes([b"a"]).tolist() and max(map(len, line_words._POWERS)) < 4 * line_words.SLICE_BYTES


@pytest.mark.parametrize("small", [False, True])
def test_whole_similarity(spark, monkeypatch, small):
    """Against the edit similarity of all pairs of lines, at each similarity from 0.8 up; also with everything cut small."""
    if small:
        for module, name, value in ((bitsliced, "CHUNK_ROWS", 4), (bitsliced, "SAMPLE", 1), (line_grams, "HELD_KEYS", 40), (line_grams, "PACK_KEYS", 30), (line_grams, "RANGE_KEYS", 20), (line_grams, "ORDER_SAMPLE", 1), (line_grams, "SEEN", 3), (line_grams, "VERIFY_ROWS", 2)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(6)
    rows = []
    for d in range(150):
        n = rng.choice([5, 6, 9, 10, 15, 20, 40, 80])
        a = ["w%d" % rng.randrange(rng.choice([40, 300])) for _ in range(n)]
        for k in range(rng.choice([1, 1, 2, 6])):
            b = edited(rng, a, rng.randrange(n // 5 + 2)) if k else edited(rng, a, n // 5 + d % 2)
            rows.append((len(rows), " ".join(a) + "\n" + " ".join(b)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    places = [(d, k, norm(x)) for d, t in rows for k, x in enumerate(t.split("\n"))]
    like = {(i, j): 1 - levenshtein(places[i][2], places[j][2]) / max(len(places[i][2]), len(places[j][2])) for i in range(len(places)) for j in range(i) if abs(len(places[i][2]) - len(places[j][2])) <= 17}
    links = [p for p, x in like.items() if x >= 0.8 - 1e-9 and (x == 1 or min(len(places[k][2]) for k in p) >= 5)]
    assert all(sum(lo <= like[p] < lo + 0.05 for p in links) > 20 for lo in (0.8, 0.85, 0.9, 0.95))
    tops = brute.classes(len(places), links)
    want = {d: [] for d, _ in rows}
    for k, (d, line, _) in enumerate(places):
        if tops[k] != k:
            want[d].append(line)
    assert {r.doc_id: r.dropped for r in lines.dedup_lines(docs).collect()} == want


def test_keys_that_clash(spark):
    """Groups are named by both halves of a key where two linked keys share one."""
    links = spark.createDataFrame([(1, 5, 2, 6), (1, 7, 3, 8), (3, 8, 4, 9)], "u bigint, u2 bigint, v bigint, v2 bigint")
    got = {}
    for r in lines._roots(links).collect():
        got.setdefault(tuple(r.root), set()).add((r.id, r.id2))
    assert sorted(map(sorted, got.values())) == [[(1, 5), (2, 6)], [(1, 7), (3, 8), (4, 9)]]
    one = lines._roots(links.filter("u2 != 7 and u != 3")).collect()
    assert {(r.id, r.id2) for r in one} == {(1, 5), (2, 6)} and len({r.root for r in one}) == 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab,Z é\n本ย", max_size=30)), max_size=5), st.sampled_from([(1 << 19, 1 << 16), (4, 3)]))
def test_lines_as_arrays(texts, bounds):
    """The same lines as by splitting; equal keys just for equal lines."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(line_words, "SLICE_BYTES", bounds[0])
        patch.setattr(line_words, "LONG_WORD", bounds[1])
        own = [t.encode() if t is not None else None for t in texts]
        got = line_words.Lines.of(own)
    want = [(t, k, tuple(w)) for t, x in enumerate(own) for k, w in enumerate(line_words.normalised(line_words.spaced(x))) if w]
    assert list(zip(got.text.tolist(), got.number.tolist(), got.sizes.tolist(), strict=True)) == [(t, k, len(w)) for t, k, w in want]
    keys = list(map(tuple, got.keys.tolist()))
    assert all((keys[a] == keys[b]) == (want[a][2] == want[b][2]) for a in range(len(want)) for b in range(a))
    tokens, n = got.pick(np.arange(len(want))[::-1])
    assert len(tokens) == sum(len(w) for _, _, w in want) and n.tolist() == [len(w) for _, _, w in want][::-1]


def test_short_and_spaceless_lines(spark):
    thai, chinese = "ยินดีต้อนรับสู่เว็บไซต์ของเรา", "版权所有未经许可不得转载本站内容"
    rows = [(1, f"Read more\nx\n\n...\n{thai}\n{chinese}"), (2, f"read more!\ny\n\n...\n{thai}\n{chinese[:-1]}物"), (3, "All rights reserved"), (4, "all rights reserved\nx")]
    got = {r.doc_id: r.dropped for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: [], 2: [0, 4, 5], 3: [], 4: [0, 1]}
