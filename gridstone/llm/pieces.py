"""SentencePiece encoding by sampling segmentations from the piece lattice, and lossless decoding."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstone.llm.tables import prepare

SPACE = "▁"
#: Weight of a piece: (rank + OFFSET) ** -ALPHA; a larger ALPHA or a smaller OFFSET sharpens the sampling.
ALPHA, OFFSET = 2.0, 50.0
#: A character without a piece becomes its UTF-8 bytes; the weight of all of them together.
CHAR_WEIGHT = 1e-9
SEED = 11
#: Lattice nodes that a worker keeps between batches; beyond it starts anew.
NODES = 1_000_000
#: Characters of texts sampled at once, if they are more than one.
DRAWN_CHARS = 1 << 19
#: Slots of the piece table, as a power of two, and the multiplier of its rolling hash.
TABLE_BITS, STEP = 19, np.uint64(0x2545F4914F6CDD1D)
#: Longer chunks (texts without spaces) are sampled one by one, with twelve bytes a character for their forward sums.
CHUNK_CHARS = 256
#: A forward sum below this is scaled up by its inverse, and so are those after it.
SMALL = 1e-100


class Vocabulary:
    """Pieces, their weights and ids."""

    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = own.get_piece_size()
        self.pieces = [own.id_to_piece(k) for k in range(self.size)]
        self.byte_ids = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {k for k in range(self.size) if own.is_control(k) or own.is_unknown(k) or own.is_unused(k) or own.is_byte(k)}
        ids = [k for k in range(self.size) if k not in special]
        ids.sort(key=lambda k: (-own.get_score(k), k))
        self.weights = np.zeros(self.size)
        self.weights[ids] = (np.arange(len(ids)) + OFFSET) ** -ALPHA
        self.longest = max(len(self.pieces[k]) for k in ids)
        self.ids = {self.pieces[k]: k for k in ids}
        self.weight_of = {self.pieces[k]: float(self.weights[k]) for k in ids}
        self._index(ids)
        if any(SPACE in self.pieces[k].lstrip(SPACE) for k in ids):
            raise ValueError("a piece spans the start of a word, so words cannot be segmented on their own")
        self.bytes_of = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, k in enumerate(self.byte_ids):
            self.bytes_of[k] = bytes([b])


    def _index(self, ids: list[int]) -> None:
        """An open-addressed table from the 64-bit hashes of pieces and their prefixes to ids (-2 for a mere prefix); a clash is refused."""
        self.keys = np.zeros((1 << TABLE_BITS) + 256, dtype=np.uint64)
        self.values = np.full(len(self.keys), -1, dtype=np.int32)
        own = {self.pieces[k]: k for k in ids}
        for p in list(own):
            for n in range(1, len(p)):
                own.setdefault(p[:n], -2)
        mask, step, taken = (1 << 64) - 1, int(STEP), {}
        for p, k in own.items():
            h = 0
            for c in p:
                h = (h * step + ord(c) + 1) & mask
            key = int(_mixed(np.array([h], dtype=np.uint64), len(p))[0])
            if taken.setdefault(key, p) != p:
                raise ValueError("two pieces share a hash")
            slot = key >> (64 - TABLE_BITS)
            while self.values[slot] != -1:
                slot += 1
            self.keys[slot], self.values[slot] = key, k

    def spans(self, codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from 1: where a piece of that length starts, and its id; left is the room at each place.

        Places at which no piece goes on are left behind.
        """
        at = np.arange(len(codes))
        h = np.zeros(len(codes), dtype=np.uint64)
        for length in range(1, self.longest + 1):
            room = left[at] >= length
            at, h = at[room], h[room]
            h = h * STEP + codes[at + length - 1] + np.uint64(1)
            key = _mixed(h, length)
            slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            value = self.values[slot]
            wrong = np.flatnonzero((value != -1) & (self.keys[slot] != key))
            while len(wrong):
                slot[wrong] += 1
                value[wrong] = self.values[slot[wrong]]
                wrong = wrong[(value[wrong] != -1) & (self.keys[slot[wrong]] != key[wrong])]
            on = value != -1
            at, h, value = at[on], h[on], value[on]
            hit = value >= 0
            yield at[hit], value[hit]


def _mixed(h: np.ndarray, length: int) -> np.ndarray:
    x = (h ^ np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


_CHUNK = re.compile(" *[^ ]+| +")


def chunks_of(text: str) -> list[str]:
    """The text as words with their leading spaces.

    No piece spans two of them, so the lattice of the text is the chain of
    their lattices. A U+2581 of the text itself goes through its bytes, so
    that decoding can tell it from a space.
    """
    return _CHUNK.findall(text)


class Lattices:
    """Forward-filtered lattices of distinct chunks, as one growing array of edges.

    Each node is a place in a chunk; its edges come from earlier places and
    carry the chance that a segmentation which reaches the node does so by
    that piece. Those chances follow from the forward sums, so sampling
    backwards from a chunk's end draws whole segmentations of the chunk with
    exactly the weight of their pieces' product. Chunks of over CHUNK_CHARS
    characters keep their forward sums alone, not their edges, and follow the
    same law.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ends: dict[str, int] = {}  # chunk to the node at its end
        self.first = np.zeros(1 << 14, dtype=np.int64)  # per node: its first edge
        self.share = np.zeros(1 << 16)  # per edge: cumulated chance among its node's edges
        self.ids = np.zeros(1 << 16, dtype=np.int32)  # per edge: piece, or -1 - b for the bytes of character b
        self.size = np.zeros(1 << 16, dtype=np.int32)  # per edge: characters
        self.edges = self.nodes = 0
        self.bytes: list[tuple[int, ...]] = []
        self.byte_of: dict[str, int] = {}

    def add(self, chunks: list[str]) -> None:
        """Forward-filter new chunks, all of them place by place."""
        whole = "".join(chunks)
        codes = np.frombuffer(whole.replace(SPACE, "\0").replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars = np.array([len(c) for c in chunks])
        at = np.arange(len(codes))
        left = np.repeat(np.cumsum(chars), chars) - at  # characters to the chunk's end
        before = at + np.repeat(np.arange(len(chunks)), chars)  # the node before each character
        found = list(self.vocabulary.spans(codes, left))
        lost = np.ones(len(codes), dtype=bool)
        lost[found[0][0]] = False
        plain = np.flatnonzero(lost)
        found[0] = np.append(found[0][0], plain), np.append(found[0][1], np.array([-1 - self._byte_edge(whole[k]) for k in plain.tolist()], dtype=np.int32))
        n = len(codes) + len(chunks)
        counts = np.zeros(n + 1, dtype=np.int64)
        for k, (start, _) in enumerate(found):
            counts[before[start] + k + 2] += 1  # one edge at most for each end and length
        fill = np.cumsum(counts)
        total = int(fill[-1])
        node, piece, size = np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int32)
        for k in range(len(found) - 1, -1, -1):  # longest first, so that starts ascend
            start, own = found[k]
            ends = before[start] + k + 1
            slot = fill[ends]
            fill[ends] += 1
            node[slot], piece[slot], size[slot] = ends, own, k + 1
        weight = np.where(piece < 0, CHAR_WEIGHT, self.vocabulary.weights[np.maximum(piece, 0)])
        first = np.append(0, np.cumsum(chars + 1)[:-1])
        depth = np.arange(n) - np.repeat(first, chars + 1)
        share = self._forward(node, node - size, depth[node], weight, n)
        while self.edges + total > len(self.share):
            self.share, self.ids, self.size = (np.append(x, np.zeros_like(x)) for x in (self.share, self.ids, self.size))
        while self.nodes + n > len(self.first):
            self.first = np.append(self.first, np.zeros_like(self.first))
        self.first[self.nodes : self.nodes + n] = self.edges + np.cumsum(counts[:-1])
        new = slice(self.edges, self.edges + total)
        self.share[new], self.ids[new], self.size[new] = share, piece, size
        self.edges += total
        self.ends.update(zip(chunks, (self.nodes + first + chars).tolist(), strict=True))
        self.nodes += n

    def _forward(self, node: np.ndarray, back: np.ndarray, end: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Of each edge, the cumulated chance among its node's edges."""
        forward, share = np.ones(n), np.zeros(len(node))
        order = np.argsort(end.astype(np.uint16), kind="stable")  # at most CHUNK_CHARS + 1
        cuts = np.append(0, np.cumsum(np.bincount(end)[1:]))
        for at in range(len(cuts) - 1):
            e = order[cuts[at] : cuts[at + 1]]
            mass = forward[back[e]] * weight[e]
            new = np.append(True, node[e][1:] != node[e][:-1])
            heads = np.flatnonzero(new)
            total = np.add.reduceat(mass, heads)
            rank = np.cumsum(new) - 1
            chance = np.cumsum(mass / total[rank]) - rank
            chance[np.append(heads[1:], len(e)) - 1] = 1.0
            share[e] = np.minimum(chance, 1.0)
            places = node[e][heads]
            forward[places] = total
            small = total < 1e-100
            if small.any():  # only ratios within the longest piece matter
                for k in range(min(at + 1, self.vocabulary.longest) + 1):
                    forward[places[small] - k] /= total[small]
        return share

    def _byte_edge(self, char: str) -> int:
        if char not in self.byte_of:
            self.byte_of[char] = len(self.bytes)
            self.bytes.append(tuple(self.vocabulary.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")))
        return self.byte_of[char]

    def sample(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """One segmentation of each text as piece ids.

        All chunks step backwards together. A draw depends on the row's key
        and its place in the text alone, so neither batches nor repeated runs
        change it.
        """
        if self.nodes > NODES:
            self.clear()
        chunks, counts = [], []
        for text in texts:
            own = chunks_of(" " + text) if text else []
            chunks += own
            counts.append(len(own))
        known, lengths = self.ends, list(map(len, chunks))
        long = [k for k, n in enumerate(lengths) if n > CHUNK_CHARS]
        apart = set(long)
        if new := [c for c in dict.fromkeys(chunks) if c not in known and len(c) <= CHUNK_CHARS]:
            self.add(new)
        ends = [0 if k in apart else known[c] for k, c in enumerate(chunks)] if long else list(map(known.__getitem__, chunks))
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        bases = np.append(0, np.cumsum(sizes))
        node, length = np.array(ends, dtype=np.int64), np.array(lengths, dtype=np.int64)
        place = np.cumsum(length)  # all texts end to end; the place before which a piece ends
        low = place - length
        row = np.repeat(np.arange(len(texts)), counts)
        key = np.array(keys, dtype=np.uint64)[row]
        shift = bases[row]
        taken = np.zeros(int(bases[-1]), dtype=bool)
        found = np.zeros(int(bases[-1]), dtype=np.int32)
        for k in long:
            own, at = self._sample_long(chunks[k], key[k], place[k] - shift[k])
            taken[low[k] + at] = True
            found[low[k] + at] = own
        if long:
            short = np.ones(len(node), dtype=bool)
            short[long] = False
            node, place, low, key, shift = (x[short] for x in (node, place, low, key, shift))
        while len(node):
            u = uniform(key, place - shift)
            edge = self.first[node]
            on = np.flatnonzero(self.share[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] <= u[on]]
            back = self.size[edge]
            place = place - back
            taken[place] = True
            found[place] = self.ids[edge]
            left = place > low
            node, place, low, key, shift = (x[left] for x in (node - back, place, low, key, shift))
        starts = np.append(0, np.cumsum(taken))[bases]
        out = found[taken]
        if (out < 0).any():
            out, starts = self._with_bytes(out, starts)
        return np.split(out, starts[1:-1])

    def _sample_long(self, chunk: str, key: np.uint64, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, starts) of one segmentation of a long chunk; ``last`` is the place in the text at which it ends.

        Forward sums go place by place over the last ``longest`` ones, scaled
        up where they grow small; sampling walks back over the same pieces.
        """
        own, n = chunk.replace(SPACE, "\0").replace(" ", SPACE), len(chunk)
        ids, weights, longest = self.vocabulary.ids, self.vocabulary.weight_of, self.vocabulary.longest
        sums, scales = np.ones(n + 1), np.zeros(n + 1, dtype=np.int32)
        recent, scale = [1.0], 0  # forward sums of the last places, all at one scale

        def single(end: int) -> float:
            return weights.get(own[end - 1], CHAR_WEIGHT)

        for end in range(1, n + 1):
            total = recent[-1] * single(end)
            for size in range(2, min(longest, end) + 1):
                w = weights.get(own[end - size : end])
                if w:
                    total += recent[-size] * w
            recent.append(total)
            del recent[:-longest]
            if total < SMALL:
                recent, scale = [x / SMALL for x in recent], scale + 1
            sums[end], scales[end] = recent[-1], scale
        draws = uniform(np.full(n + 1, key, dtype=np.uint64), np.arange(last - n, last + 1))
        pieces, starts, end = [], [], n
        while end:
            edges = []
            for size in range(min(longest, end), 0, -1):
                w = single(end) if size == 1 else weights.get(own[end - size : end])
                if w:
                    # A sum that was scaled fewer times counts for more.
                    edges.append((size, sums[end - size] * SMALL ** (int(scales[end - size]) - int(scales[end])) * w))
            u, run, total = draws[end], 0.0, sum(x for _, x in edges)
            for size, x in edges:
                run += x
                if run > u * total:
                    break
            end -= size
            piece = ids.get(own[end : end + size])
            pieces.append(-1 - self._byte_edge(chunk[end]) if piece is None else piece)
            starts.append(end)
        return np.array(pieces, dtype=np.int32), np.array(starts, dtype=np.int64)

    def _with_bytes(self, out: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece replaced by their bytes' pieces."""
        widths = np.ones(len(out), dtype=np.int64)
        plain = np.flatnonzero(out < 0)
        own = [self.bytes[-1 - k] for k in out[plain].tolist()]
        widths[plain] = [len(x) for x in own]
        full = np.repeat(out, widths)
        full[np.repeat(out < 0, widths)] = [b for x in own for b in x]
        return full, np.append(0, np.cumsum(widths))[starts]


def uniform(key: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from a row's key and the place of the draw: a counter-based generator, the same on every run."""
    x = key + step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of any segmentation: bytes of its pieces without the first space."""
    table = vocabulary.bytes_of
    return b"".join([table[k] for k in ids])[1:].decode("utf-8", "surrogatepass")


def row_key(doc_id: int | str | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{doc_id}")


#: Lattices of a worker by model, kept between its tasks; NODES bounds them.
_KEPT: dict[str, Lattices] = {}


def _lattices(model: bytes) -> Lattices:
    name = xxhash.xxh3_128_hexdigest(model)
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Lattices(Vocabulary(model))
    return _KEPT[name]


FOUND = "struct<pieces:array<int>,lossless:boolean>"
_FOUND = pa.struct([("pieces", pa.list_(pa.int32())), ("lossless", pa.bool_())])


def _model(path: str) -> bytes:
    """The model file, read once on the driver and sent to the tasks: under a megabyte, refused above 64."""
    with open(path, "rb") as f:
        model = f.read((64 << 20) + 1)
    if len(model) > 64 << 20:
        raise ValueError(f"{path}: more than 64 MB")
    return model


def encode(docs: DataFrame, model_path: str, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """docs with pieces (ids of one sampled segmentation of each whole text) and lossless (whether decoding gave the text back).

    Forward sums over the piece lattice, then backward sampling; the draws
    come from the row's key and the seed, so equal rows get equal pieces on
    any cluster. As in the usual encoding a space precedes the text. An empty
    text has no pieces, a null text null ones; both are lossless. A null key is
    one more key value. Columns named pieces or lossless are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lattices = _lattices(model.value)
        for ids, texts in batches:
            keys = [row_key(k, seed) for k in ids.to_pylist()]
            own = texts.to_pylist()
            whole = [t or "" for t in own]
            found: list[np.ndarray] = []
            at = 0
            while at < len(whole):
                stop, chars = at, 0
                while stop < len(whole) and (stop == at or chars + len(whole[stop]) <= DRAWN_CHARS):
                    chars += len(whole[stop])
                    stop += 1
                found += lattices.sample(whole[at:stop], keys[at:stop])
                at = stop
            same = [decode(lattices.vocabulary, f.tolist()) == t for f, t in zip(found, whole, strict=True)]
            offsets = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))
            pieces = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array([t is None for t in own], pa.bool_()))
            yield pa.StructArray.from_arrays([pieces, pa.array(same)], fields=list(_FOUND))

    kept = [c for c in docs.columns if c not in ("pieces", "lossless")]
    out = docs.select(*kept, F.arrow_udf(run, FOUND)(F.col(key).cast("string"), F.col("text")).alias("__gs_p"))
    return out.select(*kept, F.col("__gs_p.pieces").alias("pieces"), F.col("__gs_p.lossless").alias("lossless"))


def decoded(encoded: DataFrame, model_path: str, to: str = "text") -> DataFrame:
    """encoded with the texts of its pieces in column ``to``; null pieces give null."""
    spark = encoded.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(_model(model_path))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _lattices(model.value).vocabulary
        for rows in batches:
            yield pa.array([None if ids is None else decode(vocabulary, ids) for ids in rows.to_pylist()], pa.string())

    return encoded.withColumn(to, F.arrow_udf(run, "string")("pieces"))


def encode_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces (0 for null), pieces_hash (xxhash64 of the ids) and lossless."""
    out = encode(docs.select("doc_id", "text"), model_path)
    return out.select("doc_id", F.coalesce(F.when(F.col("pieces").isNotNull(), F.size("pieces")), F.lit(0)).cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "lossless")
