"""Cuts texts into chunks that a tokenizer treats alone, and keeps what it said of each chunk.

Prose repeats its words, so a task looks chunks up by a 64-bit hash in a table
of bounded size and calls the tokenizer for new ones only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from .textcore import PIECE, U64, inverse_powers, mix, powers

GROUP = 1 << 20  # bytes of text handled at a time


def grouped(texts: list[bytes], limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts of about ``limit`` bytes; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def chunk_keys(b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit keys of byte ranges that lie one behind the other; never 0."""
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(stops, starts[at] + PIECE, "right")))
        lo, hi = int(starts[at]), int(stops[to - 1])
        if hi - lo > PIECE:  # one very long chunk
            h = 0
            for k in range(lo, hi, PIECE):
                part = b[k:min(hi, k + PIECE)].astype(U64) + U64(1)
                h = (h * 0xD6E8FEB86659FD93 + int((part * powers(PIECE)[:len(part)]).sum(dtype=U64))) % (1 << 64)
            out[at] = h
        else:
            sums = np.zeros(hi - lo + 1, U64)
            np.cumsum((b[lo:hi].astype(U64) + U64(1)) * powers(PIECE)[:hi - lo], out=sums[1:])
            s, e = starts[at:to] - lo, stops[at:to] - lo
            out[at:to] = (sums[e] - sums[s]) * inverse_powers(PIECE)[s]
        at = to
    out = mix(out + (stops - starts).astype(U64) * U64(0x9E3779B97F4A7C15))
    out[out == 0] = 1
    return out


class ChunkTable:
    """Remembers (ids, floats) of chunks; ``encode(list[bytes])`` gives (lengths, flat ids, floats) of new ones.

    The hash finds a slot; a chunk counts as known only if its bytes are those kept there.
    """

    def __init__(self, encode: Callable, floats: int = 0, slots: int = 1 << 20, pool: int = 1 << 23):
        self.encode, self.slots, self.limit = encode, slots, pool
        self.keys = np.zeros(slots, U64)
        self.at = np.zeros(slots, np.int64)
        self.len = np.zeros(slots, np.int64)
        self.floats = np.zeros((slots, floats))
        self.byte_at = np.zeros(slots, np.int64)
        self.byte_len = np.zeros(slots, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.keys[:] = 0
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 1  # pool[0] is id 0
        self.bytes, self.bytes_used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _grown(pool: np.ndarray, used: int, more: int) -> np.ndarray:
        if used + more <= len(pool):
            return pool
        grown = np.zeros(max(2 * len(pool), used + more), pool.dtype)
        grown[:used] = pool[:used]
        return grown

    def _append(self, ids: np.ndarray) -> int:
        self.pool = self._grown(self.pool, self.used, len(ids))
        at, self.used = self.used, self.used + len(ids)
        self.pool[at:self.used] = ids
        return at

    @staticmethod
    def _same(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` bytes at either place are equal, for each chunk (``n`` > 0)."""
        out, ends = np.zeros(len(n), bool), np.cumsum(n)
        at = 0
        while at < len(n):  # in runs, so that scratch arrays stay small
            before = ends[at] - n[at]
            to = max(at + 1, int(np.searchsorted(ends, before + GROUP, "right")))
            begin = ends[at:to] - n[at:to] - before
            step = np.arange(ends[to - 1] - before)
            unequal = x[np.repeat(x_at[at:to] - begin, n[at:to]) + step] != y[np.repeat(y_at[at:to] - begin, n[at:to]) + step]
            out[at:to] = ~np.logical_or.reduceat(unequal, begin)
            at = to
        return out

    def look_up(self, b: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """For each chunk: place in the pool, number of ids, floats. Valid until the next call."""
        if self.used > self.limit or self.bytes_used > 4 * self.limit:  # start anew, so that memory stays bounded
            self._clear()
        size = stops - starts
        keys = chunk_keys(b, starts, stops)
        slot = (keys & U64(self.slots - 1)).astype(np.int64)
        at, n, x = self.at[slot], self.len[slot], self.floats[slot]
        known = (self.keys[slot] == keys) & (self.byte_len[slot] == size)
        k = np.flatnonzero(known)
        known[k] = self._same(b, starts[k], self.bytes, self.byte_at[slot[k]], size[k])
        miss = np.flatnonzero(~known)
        while len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            where = miss[first]
            # chunks of one hash but other bytes wait for the next round
            alike = size[miss] == size[where][back]
            k = np.flatnonzero(alike)
            alike[k] = self._same(b, starts[miss[k]], b, starts[where][back[k]], size[miss[k]])
            lens, ids, floats = self.encode([b[s:e].tobytes() for s, e in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            begin = self._append(ids) + np.cumsum(lens) - lens
            now, back = miss[alike], back[alike]
            at[now], n[now] = begin[back], lens[back]
            x[now] = floats[back]
            s = slot[where]
            kept = np.concatenate([b[i:j] for i, j in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            self.bytes = self._grown(self.bytes, self.bytes_used, len(kept))
            self.bytes[self.bytes_used:self.bytes_used + len(kept)] = kept
            ends = self.bytes_used + np.cumsum(size[where])
            self.bytes_used += len(kept)
            self.keys[s], self.at[s], self.len[s], self.floats[s] = new, begin, lens, floats
            self.byte_at[s], self.byte_len[s] = ends - size[where], size[where]
            miss = miss[~alike]
        return at, n, x

    def ids(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The chunks' ids one behind the other."""
        ends = np.cumsum(n)
        return self.pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
