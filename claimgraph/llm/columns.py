"""Arrow columns as NumPy arrays: bytes of texts, words, hashes of words and of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that end a word: space, and tab to carriage return.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z in lower case, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that are hashed at once, unless one text alone is longer.
CHUNK_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words are hashed modulo two primes below 2^31, each with a base of its own.
_FIELDS = ((2147483647, 1389796151), (2147483629, 942373217))
_PLACE = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def named(df: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins and the last ends; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about CHUNK_BYTES: first and last row, their bytes and offsets."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


class WordHasher:
    """64-bit hashes of lower-cased words, by two polynomials over their bytes, each modulo a prime.

    Bytes are read CHUNK_BYTES at a time, also those of one long word, so memory beside the hashes doesn't grow with texts.
    """

    def __init__(self) -> None:
        self._powers = [tuple(self._table(b, prime, CHUNK_BYTES + 1) for b in (base, pow(base, -1, prime))) for prime, base in _FIELDS]

    @staticmethod
    def _table(base: int, prime: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
        return out[:n]

    def _values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Both polynomials of words that lie within CHUNK_BYTES."""
        low, out = LOWER[data].astype(np.uint64) + np.uint64(1), []
        for (prime, _), (up, down) in zip(_FIELDS, self._powers, strict=True):
            p, sums = np.uint64(prime), np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(low * up[: len(data)], out=sums[1:])
            out.append((sums[ends] - sums[starts]) % p * down[starts] % p)
        return out

    def _long(self, word: np.ndarray) -> list[np.ndarray]:
        """Both polynomials of one word, part by part."""
        total = [0] * len(_FIELDS)
        for at in range(0, len(word), CHUNK_BYTES):
            part = word[at : at + CHUNK_BYTES]
            values = self._values(part, np.zeros(1, np.int64), np.array([len(part)]))
            total = [(t + int(v[0]) * pow(base, at, prime)) % prime for t, v, (prime, base) in zip(total, values, _FIELDS, strict=True)]
        return [np.array([t], np.uint64) for t in total]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h, i, n = np.zeros(len(starts), np.uint64), 0, len(starts)
        while i < n:
            a = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, a + CHUNK_BYTES, side="right")))
            part = data[a : int(ends[j - 1])]
            values = self._values(part, starts[i:j] - a, ends[i:j] - a) if len(part) <= CHUNK_BYTES else self._long(part)
            for v in values:
                h[i:j] = (h[i:j] << np.uint64(31)) + v
            i = j
        return mix(h ^ ((ends - starts).astype(np.uint64) * _ODD))


def exact_shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The shingles that shingle_sets hashes, as tuples of words."""
    words = text.lower().split()  # of bytes: only A-Z fold, and only SEPARATOR splits
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def _places(width: int) -> np.ndarray:
    return np.resize(_PLACE, width) + np.arange(width, dtype=np.uint64) * np.uint64(2)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` hashes of words, in their order."""
    grams = np.zeros(max(len(words) - width + 1, 0), dtype=np.uint64)
    for k, place in enumerate(_places(width)):
        grams += words[k : k + len(grams)] * place
    return mix(grams)


def _same_bytes(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, size: np.ndarray) -> bool:
    """Whether each run of size bytes in x at x_at is the one in y at y_at; CHUNK_BYTES are looked at at once."""
    upto, i = np.concatenate([[0], np.cumsum(size)]), 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + CHUNK_BYTES, side="right")) - 1)
        if j == i + 1:
            same = np.array_equal(x[x_at[i] : x_at[i] + size[i]], y[y_at[i] : y_at[i] + size[i]])
        else:
            within = np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], size[i:j])
            same = np.array_equal(x[np.repeat(x_at[i:j], size[i:j]) + within], y[np.repeat(y_at[i:j], size[i:j]) + within])
        if not same:
            return False
        i = j
    return True


class ShingledText:
    """The shingles of one text, compared as sorted arrays of hashes, with what shows that no two of them were mixed up.

    Words of equal hashes are compared byte by byte, shingles of equal hashes word by word, within a text and between
    two. Where one differs, and for texts of less than one shingle, the shingles are compared as tuples of words. It
    holds about 35 bytes a word and the text itself.
    """

    def __init__(self, text: np.ndarray, width: int, hasher: WordHasher) -> None:
        self.data, self.width = LOWER[text], width
        starts, ends, _ = word_spans(self.data, np.array([0, len(text)]))
        self.words = hasher(self.data, starts, ends)
        order = np.argsort(self.words, kind="stable")
        h, at, size = self.words[order], starts[order], (ends - starts)[order]
        again = np.flatnonzero(h[1:] == h[:-1])
        self.exact = np.array_equal(size[again], size[again + 1]) and _same_bytes(self.data, at[again], self.data, at[again + 1], size[again])
        new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
        self.known, self.at, self.size = h[new], at[new], size[new].astype(np.int32)
        grams = shingle_hashes(self.words, width)
        order = np.argsort(grams, kind="stable")
        g = grams[order]
        again = np.flatnonzero(g[1:] == g[:-1])
        self.exact = self.exact and len(g) > 0 and all(np.array_equal(self.words[order[again] + k], self.words[order[again + 1] + k]) for k in range(width))
        new = np.concatenate([[True], g[1:] != g[:-1]])[: len(g)]
        self.shingles, self.first = g[new], order[new].astype(np.int32)

    def tuples(self) -> set[tuple[bytes, ...]]:
        return exact_shingles(self.data.tobytes(), self.width)

    def common(self, other: "ShingledText") -> tuple[int, int]:
        """How many shingles both texts have, and how many there are in either."""
        if self.exact and other.exact:
            _, i, j = np.intersect1d(self.known, other.known, assume_unique=True, return_indices=True)
            exact = np.array_equal(self.size[i], other.size[j]) and _same_bytes(self.data, self.at[i], other.data, other.at[j], self.size[i])
            _, i, j = np.intersect1d(self.shingles, other.shingles, assume_unique=True, return_indices=True)
            exact = exact and all(np.array_equal(self.words[self.first[i] + k], other.words[other.first[j] + k]) for k in range(self.width))
            if exact:
                return len(i), len(self.shingles) + len(other.shingles) - len(i)
        mine, theirs = self.tuples(), other.tuples()
        return len(mine & theirs), len(mine | theirs)


def shingle_sets(column: pa.Array, width: int, hasher: WordHasher) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles as sorted 64-bit hashes; a text of fewer words is one shingle."""
    data, at = text_bytes(column)
    place = _places(width)
    for _, _, part, off in chunks(data, at):
        starts, ends, first = word_spans(part, off)
        words = hasher(part, starts, ends)
        grams = shingle_hashes(words, width)
        for i in range(len(off) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                yield mix((words[a:b] * place[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)
