"""Vectorised text kernels that run inside Arrow tasks: hashing of words, shingles and byte windows."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 20  # bytes hashed at a time, so that scratch arrays stay small whatever a text's length


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def powers(n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, for an odd base."""
    p = np.empty(n, U64)
    p[0] = 1
    p[1:] = 0x9E3779B97F4A7C15
    return np.multiply.accumulate(p)


@functools.cache
def inverse_powers(n: int) -> np.ndarray:
    p = np.empty(n, U64)
    p[0] = 1
    p[1:] = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    return np.multiply.accumulate(p)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def normal_words(text: bytes) -> bytes:
    """Words in A-Z lower case, joined by one space. bytes.split() cuts at exactly space and tab to return."""
    return b" ".join(text.lower().split())


#: Prime moduli and bases of the word polynomials; a power of two as modulus makes words such as Thue-Morse strings collide.
PRIMES = ((2147483647, 1640531527), (2147483629, 1013904223))


@functools.cache
def _prime_powers(prime: int, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime."""
    p = np.ones(n, np.uint32)
    done = 1
    while done < n:
        step = min(done, n - done)
        p[done:done + step] = p[:step].astype(U64) * U64(pow(base, done, prime)) % U64(prime)
        done += step
    return p


def _long_word(words: bytes, at: int, end: int) -> np.uint64:
    """The value that ``word_hashes`` gives a word, taken piece by piece."""
    value = 0
    for prime, base in PRIMES:
        h = 0
        for k in range(at, end, PIECE):
            b = np.frombuffer(words, np.uint8, min(end, k + PIECE) - k, k)
            part = int(((b.astype(U64) + U64(1)) * _prime_powers(prime, base, PIECE)[:len(b)]).sum(dtype=U64))
            h = (h + part * pow(base, k - at, prime)) % prime
        value = value << 32 | h
    return U64(value)


def word_hashes(words: bytes) -> np.ndarray:
    """64-bit hashes of space-separated words; each piece holds whole words.

    A word's bytes are the coefficients of a polynomial, taken at a base modulo
    each of two primes near 2 ** 31.
    """
    if not words:
        return np.empty(0, U64)
    out, at, n = [], 0, len(words)
    while at < n:
        end = n if n - at <= PIECE else words.rfind(b" ", at, at + PIECE)
        if end <= at:  # one word longer than a piece
            end = words.find(b" ", at)
            end = n if end < 0 else end
            out.append(np.array([_long_word(words, at, end)], U64))
        else:
            b = np.frombuffer(words, np.uint8, end - at, at)
            stops = np.append(np.flatnonzero(b == 32), len(b))
            starts = np.concatenate([[0], stops[:-1] + 1])
            b = b.astype(U64) + U64(1)
            value, sums = np.zeros(len(stops), U64), np.zeros(len(b) + 1, U64)
            for prime, base in PRIMES:
                np.cumsum(b * _prime_powers(prime, base, PIECE)[:len(b)], out=sums[1:])  # below 2 ** 59
                back = _prime_powers(prime, pow(base, -1, prime), PIECE)
                value = value << U64(32) | (sums[stops] - sums[starts]) % U64(prime) * back[starts] % U64(prime)
            out.append(value)
        at = end + 1
    return mix(np.concatenate(out))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


#: Odd weights of the words of a shingle.
WEIGHTS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(words: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; shorter texts have one shingle, empty ones none."""
    w = word_hashes(words)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.full(n, min(len(w), size), U64)
    for j in range(min(size, len(w))):
        h += w[j:j + n] * (WEIGHTS[j % 5] + U64(2 * (j // 5)))
    return distinct(mix(h))


def exact_shingles(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Codes of the distinct word shingles of each text, sorted; equal codes are equal words, within one call.

    Words are numbered, and codes widened by one word at a time and numbered
    anew, so nothing is hashed. A text with fewer words has one shingle, whose
    code no other width shares; an empty one has none.
    """
    number: dict[bytes, int] = {}
    w = [np.array([number.setdefault(x, len(number)) for x in t.split(b" ")] if t else [], U64) for t in texts]
    codes, out, first = w, [np.empty(0, U64)] * len(texts), 0
    for width in range(1, size + 1):
        joined = np.concatenate(codes) if codes else np.empty(0, U64)
        known, place = np.unique(joined, return_inverse=True)
        places = np.split(place.astype(U64), np.cumsum([len(c) for c in codes])[:-1]) if codes else []
        for k, (p, t) in enumerate(zip(places, w, strict=True)):
            if len(t) == width < size or width == size and len(t) >= size:
                out[k] = distinct(p + U64(first))
        first += len(known)
        codes = [p[:-1] << U64(32) | t[width:] for p, t in zip(places, w, strict=True)]
    return out
