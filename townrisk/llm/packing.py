"""Packs token sequences into windows by sum-of-squares placement.

A document is its ids and a closing 0. Its full windows become sequences of
their own; the rest goes, uncut, to the fill level (or a new window) that makes
the sum of squared counts of partially filled windows smallest, ties to the
fullest. The counts are kept in an array by level. At the end of a task, and
when more than ``MAX_OPEN`` windows are open (which bounds memory), the windows
still open are poured into one another, cutting pieces at window ends; what is
left over fills windows of powers of two, which need no padding.

Every task packs the rows of its own partition, without a shuffle: placing is
online by nature, and a rerun of the task on the same rows gives the same
sequences. Sequence numbers hold the partition in their upper bits.

Edge cases: null and empty texts are the single closing id; repeated rows are
packed each; a null doc_id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import ChunkTable, grouped
from .textcore import text_bytes

WINDOW = 1024
MAX_OPEN = 4096
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in set(shown)]
    return {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}


@functools.cache
def byte_bpe(path: str):
    """An encoder of ordinary text (without added tokens) with the vocabulary of a byte-level BPE file.

    The file's merges stand in the order of their ids, so ids are ranks.
    """
    import public_tokenizers
    import tiktoken
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = _byte_letters()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("merges aren't in the order of ids")
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merged)}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def added_tokens(path: str) -> tuple[bytes, ...]:
    """The texts of the file's added tokens, which the tokenizer takes as one id wherever they stand."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"].encode() for t in json.load(f).get("added_tokens", []))


@functools.cache
def whole_tokenizer(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _encode_chunks(path: str):
    encoder, added = byte_bpe(path), added_tokens(path)

    def one(chunk: bytes) -> list[int]:
        text = chunk.decode("utf-8", "replace")
        if any(t in chunk for t in added):
            return whole_tokenizer(path).encode(text, add_special_tokens=False).ids
        return encoder.encode_ordinary(text)

    def encode(chunks: list[bytes]):
        ids = [one(c) for c in chunks]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        return lens, np.fromiter((i for x in ids for i in x), np.uint16, int(lens.sum())), np.zeros((len(ids), 0))

    return encode


@functools.cache
def chunk_table(path: str) -> ChunkTable:
    """One table for a Python worker, whatever the number of tasks it runs."""
    return ChunkTable(_encode_chunks(path))


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.arange(256)
    plain = (b > 32) & (b < 127)
    two, three = (b >= 0xC3) & (b <= 0xDF), (b == 0xE0) | ((b >= 0xE4) & (b <= 0xEF))
    return plain, two, three


def cut_places(b: np.ndarray) -> np.ndarray:
    """Places of a single space between characters that surely aren't blank.

    The pre-tokenizer always begins a token there: its patterns take one leading
    space, and none runs from a non-blank character into a space.
    """
    plain, two, three = _classes()
    p = np.flatnonzero(b == 32)
    p = p[(p > 0) & (p < len(b) - 1)]
    after = (plain | two | three)[b[p + 1]]
    before = plain[b[p - 1]] | ((b[p - 1] >= 128) & (two[b[np.maximum(p - 2, 0)]] | three[b[np.maximum(p - 3, 0)]]
                                                    & (b[np.maximum(p - 2, 0)] >= 128)))
    return p[after & before]


def token_ids(texts: list[bytes], table: ChunkTable):
    """For each text its ids and the closing 0, as a list of uint16 arrays."""
    out: list[np.ndarray] = []
    for lo, hi in grouped(texts):
        group = texts[lo:hi]
        b = np.frombuffer(b"".join(group), np.uint8)
        ends = np.cumsum([len(t) for t in group])
        begins = ends - [len(t) for t in group]
        begin = np.zeros(len(b), bool)
        begin[cut_places(b)] = True
        begin[begins[begins < ends]] = True
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], len(b))[:len(starts)]
        at, n, _ = table.look_up(b, starts, stops)
        # a closing id (place 0 of the pool) behind the last chunk of each text
        close = np.searchsorted(starts, ends, "left")
        at, n = np.insert(at, close, 0), np.insert(n, close, 1)
        flat = table.ids(at, n)
        per_text = np.cumsum(n)[close + np.arange(len(close))]
        out += np.split(flat, per_text[:-1])
    return out


class SumOfSquares:
    """Online placing of pieces of 1 .. window - 1 ids; ``closed`` takes finished sequences."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.closed: list[list] = []

    def add(self, piece) -> None:
        size = len(piece[2])
        levels = np.flatnonzero(self.count[:self.window - size + 1])
        best, level = 2 * self.count[size] + 1, 0
        if len(levels):
            to = levels + size
            change = 1 - 2 * self.count[levels] + np.where(to < self.window, 2 * self.count[to] + 1, 0)
            k = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(levels[k])
        held = [piece] if not level else [*self.open[level].pop(), piece]
        if level:
            self.count[level] -= 1
        if level + size == self.window:
            self.closed.append(held)
            return
        self.open[level + size].append(held)
        self.count[level + size] += 1
        if self.count.sum() > self.max_open:
            self.pour()

    def pour(self) -> None:
        """Closes all open windows, cutting pieces where a window is full."""
        pieces = [p for level in reversed(self.open) for held in level for p in held]
        left = sum(len(p[2]) for p in pieces)
        self.count[:] = 0
        self.open = [[] for _ in range(self.window)]
        room, held = 0, []
        for doc, start, ids, total in pieces:
            while len(ids):
                if not room:
                    # whole windows, then the largest power of two that is filled
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    held = []
                    self.closed.append(held)
                take = min(room, len(ids))
                held.append((doc, start, ids[:take], total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take


def _pack(path: str, window: int):
    def run(batches):
        table, state, number = chunk_table(path), SumOfSquares(window), TaskContext.get().partitionId() << 40

        def rows():
            nonlocal number
            out: list[tuple] = []
            for held in state.closed:
                offset = 0
                for doc, start, ids, total in held:
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset))
                    offset += len(ids)
                number += 1
            state.closed.clear()
            columns = list(zip(*out, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
            for lo, hi in grouped(texts):
                for doc, ids in zip(docs[lo:hi], token_ids(texts[lo:hi], table), strict=True):
                    whole = len(ids) // window * window
                    for k in range(0, whole, window):
                        state.closed.append([(doc, k, ids[k:k + window], len(ids))])
                    if whole < len(ids):
                        state.add((doc, whole, ids[whole:].copy(), len(ids)))
                yield rows()
        state.pour()
        yield rows()

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row per piece."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        _pack(path or tokenizer_path(), window), SCHEMA)
