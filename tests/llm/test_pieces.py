"""Sampling against enumerated segmentations, and exact round trips."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
MODEL = Path("/opt/tokenizers/piece_bpe_32k.model")
pytestmark = pytest.mark.skipif(not MODEL.exists(), reason="no public vocabulary here")
from gridstone.llm import pieces  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="module")
def lattices():
    return pieces.Lattices(pieces.Vocabulary(MODEL.read_bytes()))


def weights(vocabulary, text):
    """Every segmentation of one chunk with its weight."""
    table = {p: k for k, p in enumerate(vocabulary.pieces) if vocabulary.weights[k]}
    own = text.replace("▁", "\0").replace(" ", "▁")

    def walk(at):
        if at == len(own):
            yield (), 1.0
        for end in range(at + 1, len(own) + 1):
            if (k := table.get(own[at:end])) is not None:
                for rest, w in walk(end):
                    yield (k, *rest), w * vocabulary.weights[k]
            elif end == at + 1:
                for rest, w in walk(end):
                    yield (*[vocabulary.byte_ids[b] for b in text[at].encode()], *rest), w * pieces.CHAR_WEIGHT

    return dict(walk(0))


@pytest.mark.parametrize("word", ["the", "ab", "a一b", "▁x", "\U0001f600", "quelle"])
def test_distribution(lattices, word):
    n = 20_000
    got = Counter(tuple(x.tolist()) for x in lattices.sample([word] * n, [k * 7919 for k in range(n)]))
    want = weights(lattices.vocabulary, " " + word)
    total = sum(want.values())
    assert set(got) <= set(want)
    for seg, w in want.items():
        assert abs(got[seg] / n - w / total) < 0.02


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" a\n\t▁é文\0e"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6))
def test_round_trip(lattices, texts):
    keys = list(range(len(texts)))
    found = lattices.sample(texts, keys)
    assert [pieces.decode(lattices.vocabulary, f.tolist()) for f in found] == texts
    for t, k, f in zip(texts, keys, found, strict=True):
        assert lattices.sample([t], [k])[0].tolist() == f.tolist()


def test_long_texts(lattices):
    texts = ["x" * 3000, "ab " * 5000, "\U0001f600" * 700, " " * 900, "𐍈é" * 400]
    assert [pieces.decode(lattices.vocabulary, f.tolist()) for f in lattices.sample(texts, [1, 2, 3, 4, 5])] == texts


def test_cache_bound(monkeypatch, lattices):
    text = " ".join(f"w{k}" for k in range(500))
    before = lattices.sample([text], [9])[0].tolist()
    monkeypatch.setattr(pieces, "NODES", 10)
    assert lattices.sample([text], [9])[0].tolist() == before


def test_encode(spark):
    rows = [(1, "A word, and\nanother."), (2, ""), (3, None), (None, "lost"), (1, "A word, and\nanother."), (4, "A word, and\nanother.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lossless", F.lit("old")).withColumn("x", F.lit(1))
    out = pieces.encode(docs, str(MODEL))
    assert out.columns == ["doc_id", "text", "x", "pieces", "lossless"]
    found = out.collect()
    assert all(r.lossless for r in found)
    assert sorted((r.pieces for r in found if not r.text), key=str) == [None, []]
    one = [tuple(r.pieces) for r in found if r.doc_id == 1]
    assert one[0] == one[1]
    again = pieces.encode(docs.repartition(3), str(MODEL)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), str(r.pieces))
    assert sorted(map(key, again)) == sorted(map(key, found))
    back = pieces.decoded(out.drop("text"), str(MODEL)).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    assert pieces.encode_digest(docs.filter("false"), str(MODEL)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aehilnorst\n▁é文\0"), max_size=30), min_size=1, max_size=6).map(" ".join))
def test_long_chunks_follow_the_same_law(lattices, text):
    """One by one or all at once, the same draws give the same pieces."""
    want = lattices.sample([text] * 3, [1, 2, 3])
    lattices.clear()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pieces, "CHUNK_CHARS", 2)
        got = lattices.sample([text] * 3, [1, 2, 3])
    assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_very_long_chunks(lattices):
    """Words of 300 to 3000 characters against an uncut lattice; sums far below the smallest number; boundaries fall evenly."""
    words = [("thequickbrownfox文" * 200)[: n] for n in (300, 1000, 3000)]
    texts = [" ".join([w, "a", w[::-1]]) for w in words]
    got = lattices.sample(texts, [5, 6, 7])
    lattices.clear()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pieces, "CHUNK_CHARS", 1 << 13)
        want = lattices.sample(texts, [5, 6, 7])
    lattices.clear()
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert [pieces.decode(lattices.vocabulary, x.tolist()) for x in got] == texts


def test_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pieces.decoded(pieces.encode(docs, str(MODEL)).withColumnRenamed("text", "own"), str(MODEL)).collect()}
    assert got[1].pieces is None and got[1].text is None and got[2].pieces == [] and all(r.lossless and r.text == r.own for r in got.values())
    assert [r.n_pieces for r in pieces.encode_digest(docs, str(MODEL)).orderBy("doc_id").collect()][:2] == [0, 0]
