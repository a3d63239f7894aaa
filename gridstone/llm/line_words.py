"""Lines as normalised words, their hashes, and edit similarity."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import xxhash

#: Least share of words in order that alike lines have: 1 - word edits / words of the longer line.
SIMILARITY = 0.8
#: Bytes of words hashed at once; a longer word enters by its digest.
SLICE_BYTES, LONG_WORD = 1 << 19, 1 << 16
#: The odd base of the words' polynomial, and powers of it and of its inverse as far as needed so far.
BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

#: ASCII punctuation and space become spaces, A-Z are lower-cased; line feeds and all other bytes stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b == 0x0A or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

#: Characters of Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters.
_SPACELESS = re.compile(rb"\xe0[\xb8-\xbf][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")


def normalised_lines(text: bytes | None) -> list[bytes]:
    """The ``\\n``-split lines of a UTF-8 text, lower-cased (A-Z) and with spaces for ASCII punctuation; no line for null."""
    return text.translate(_TABLE).split(b"\n") if text is not None else []


def normalised(text: bytes | None) -> list[list[bytes]]:
    """The words of each line."""
    return [line.split() for line in normalised_lines(text)]


def spaced(text: bytes | None) -> bytes | None:
    """A UTF-8 text with spaces around each character of a script without spaces, so that it counts as a word."""
    if not text or text.isascii() or np.frombuffer(text, dtype=np.uint8).max() < 0xE0:
        return text
    return _SPACELESS.sub(rb" \g<0> ", text) if _SPACELESS.search(text) else text


def line_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A polynomial of each word's bytes (modulo 2 ** 64), many words from one running sum over their joined bytes."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    if len(words) and sizes.max() > LONG_WORD:
        words = [w if len(w) < LONG_WORD else xxhash.xxh3_128_hexdigest(w).encode() for w in words]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes)
    out, at = [np.zeros(0, dtype=np.uint64)], 0
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        out.append(_slice_hashes(words[at:end]))
        at = end
    return np.concatenate(out)


def _slice_hashes(words: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.append(np.flatnonzero(joined == 0x20), len(joined))
    return _hashes(joined, np.append(0, ends[:-1] + 1), ends)


def _hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word [start, end) of the bytes."""
    n = len(joined)
    if len(_POWERS[0]) < n + 1:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            powers = np.full(2 * n + 2, base, dtype=np.uint64)
            powers[0] = 1
            _POWERS[k] = np.multiply.accumulate(powers)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(joined * _POWERS[0][:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64)


def mixed(one: np.ndarray, factor: int) -> np.ndarray:
    """64 even bits of each hash, by two rounds of shift and multiplication."""
    two = (one ^ (one >> np.uint64(31))) * np.uint64(factor)
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return two ^ (two >> np.uint64(32))


def edit_similarity(a: Sequence, b: Sequence, least: float = SIMILARITY, sets: tuple[set, set] | None = None) -> float:
    """1 - Levenshtein distance / longer length, of sequences; 0 where lengths or an early bound rule ``least`` out.

    ``sets`` may hold the distinct elements of both.
    """
    if a == b:
        return 1.0
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    # Each edit removes at most one distinct element.
    x, y = sets or (set(a), set(b))
    if abs(len(a) - len(b)) > most or len(x - y) > most or len(y - x) > most:
        return 0.0
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    return 1 - _distance(a, b, most) / longer


def _distance(a: Sequence, b: Sequence, most: int) -> int:
    """Levenshtein distance, bit-parallel over a; most + 1 as soon as it must be greater."""
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    n = len(a)
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for k, c in enumerate(b):
        eq = where.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        score += bool(ph & last) - bool(mh & last)
        if score - (len(b) - 1 - k) > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return score


#: Cells of a band computed at once, and words from which lines are compared one pair at a time.
BAND_CELLS, BAND_WORDS = 1 << 18, 1000


def alike(tokens: np.ndarray, first: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Whether the edit similarity of lines i and j is ``similarity`` or more, for many pairs at once.

    ``tokens`` holds all lines' words end to end, ``first`` where each line
    begins, ``n`` its words. Only the band of the distance table that so few
    edits can reach is filled, row by row for all pairs of a batch.
    """
    out = np.zeros(len(i), dtype=bool)
    longer = np.maximum(n[i], n[j])
    most = ((1 - similarity) * longer + 1e-9).astype(np.int64)
    for k in np.flatnonzero(longer > BAND_WORDS).tolist():
        a, b = (tokens[first[x] : first[x] + n[x]].tolist() for x in (i[k], j[k]))
        out[k] = edit_similarity(a, b, similarity) >= similarity
    order = np.argsort(longer, kind="stable")
    order = order[(longer <= BAND_WORDS)[order] & (np.abs(n[i] - n[j]) <= most)[order]]
    at, ordered = 0, longer[order]
    while at < len(order):
        # Lines of a batch have similar lengths, as all take as long as the longest.
        stop = int(np.searchsorted(ordered, ordered[at] * 1.2 + 4, side="right"))
        stop = min(stop, at + max(1, BAND_CELLS // (2 * int(most[order[stop - 1]]) + 1)))
        own = order[at:stop]
        # A path of so few edits strays from both ends' diagonals by half of what their lengths leave.
        reach = (most + np.abs(n[i] - n[j]))[own].max() // 2
        out[own] = _banded(tokens, first, n, i[own], j[own], int(reach)) <= most[own]
        at = stop
    return out


def _banded(tokens: np.ndarray, first: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, reach: int) -> np.ndarray:
    """Edit distances of pairs whose lengths differ by ``reach`` at most, by paths within ``reach`` of the diagonal."""
    rows, width, pairs = int(n[i].max()), 2 * reach + 1, np.arange(len(i))
    last = len(tokens) - 1
    # Pairs lie side by side. What stands beyond a line's ends only enters cells that are not read.
    a = tokens[np.minimum(first[i] + np.arange(rows)[:, None], last)]
    b = tokens[np.clip(first[j] + np.arange(-reach, rows + reach)[:, None], 0, last)]
    steps = np.arange(width, dtype=np.int16)[:, None]
    # Cell k of row r stands for the first r words of i and r + k - reach of j.
    cells = np.repeat(np.where(steps >= reach, steps - reach, 9999).astype(np.int16), len(i), axis=1)
    out = np.where(n[i] == 0, n[j], 9999)
    found = np.empty_like(cells)
    for r in range(rows):
        np.add(cells, a[r] != b[r : r + width], out=found)
        cells += np.int16(1)
        np.minimum(found[:-1], cells[1:], out=found[:-1])
        found -= steps
        np.minimum.accumulate(found, axis=0, out=found)
        found += steps
        np.minimum(found, np.int16(9999), out=cells)
        done = pairs[n[i] == r + 1]
        if len(done):
            out[done] = cells[(n[j] - n[i])[done] + reach, done]
    return out


@dataclass
class Lines:
    """The lines with words of some texts, as arrays."""

    text: np.ndarray  # of each line: the number of its text
    number: np.ndarray  # of each line: its number in the text
    sizes: np.ndarray  # of each line: its words
    first: np.ndarray  # of each line: its first word
    words: np.ndarray  # of each word: 64 bits
    keys: np.ndarray  # of each line: two numbers of 64 bits that stand for its words in order

    @staticmethod
    def of(texts: list[bytes | None]) -> Lines:
        """Lines parted by ``\\n``, normalised, with characters of scripts without spaces as words; none for null.

        No object is made for a word or a line: words are found and hashed in
        the joined bytes of all texts.
        """
        own = [spaced(t) or b"" for t in texts]
        joined = b"\n".join(own).translate(_TABLE)
        buffer = np.frombuffer(joined, dtype=np.uint8)
        inside = (buffer != 0x20) & (buffer != 0x0A)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        breaks = np.flatnonzero(buffer == 0x0A)
        line = np.searchsorted(breaks, starts)
        words = np.zeros(len(starts), dtype=np.uint64)
        long = np.flatnonzero(ends - starts > LONG_WORD)
        at = 0
        for stop in [*long.tolist(), len(starts)]:  # runs of words between very long ones, in slices of bounded bytes
            while at < stop:
                end = max(at + 1, int(np.searchsorted(ends[:stop], starts[at] + SLICE_BYTES, side="right")))
                low = int(starts[at])
                words[at:end] = _hashes(buffer[low : int(ends[end - 1])], starts[at:end] - low, ends[at:end] - low)
                at = end
            if stop < len(starts):
                words[stop] = xxhash.xxh3_64_intdigest(joined[int(starts[stop]) : int(ends[stop])])
                at = stop + 1
        head = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(head, len(line)))
        place = (np.arange(len(line)) - np.repeat(head, sizes)).astype(np.uint64) + np.uint64(1)
        keys = np.zeros((len(head), 2), dtype=np.uint64)
        if len(head):
            for k, factor in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
                spread = mixed(words + place * np.uint64(factor), factor)
                keys[:, k] = mixed(np.add.reduceat(spread, head) + sizes.astype(np.uint64), 0x94D049BB133111EB)
        # The break before each text, to tell texts and numbers of lines.
        begin = np.cumsum([0, *[len(t) + 1 for t in own[:-1]]]) if own else np.zeros(0, dtype=np.int64)
        first_line = np.searchsorted(breaks, begin)
        text = np.searchsorted(begin, starts[head], side="right") - 1 if len(head) else np.zeros(0, dtype=np.int64)
        return Lines(text, line[head] - first_line[text], sizes, head, words, keys)

    def pick(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, sizes) of the lines at ``kept``: 32 bits of each word."""
        sizes = self.sizes[kept]
        at = np.repeat(self.first[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return mixed(self.words[at], 0x9E3779B97F4A7C15) >> np.uint64(32), sizes
