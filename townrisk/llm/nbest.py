"""N-best encoding over the piece lattice of a SentencePiece vocabulary, and decoding.

The lattice of a text has an edge for every piece that fits; a character that is
no piece gets an edge of its byte pieces with the penalty ``unknown``. Forward
Viterbi gives every node the exact score of its best prefix. With these as
heuristics an A-star search runs backward from the end: the first N paths that
it completes are the N best.

No piece of the vocabulary runs from another character into a space, so the
lattice falls apart before every space that follows something else. A word's
forward pass runs once for many words of a length together (numpy), and a task
remembers words in a table of bounded size. A text's N best paths can only leave
the best one in the N - 1 words whose second-best path costs least; just these
are searched, and their lists merged by a heap.

Ties: at equal score the forward pass takes the longer last piece, and of equal
paths the one whose leftmost changed word comes first ranks first.

Edge cases: null and empty texts have no pieces, score 0, and decode to the
empty text; U+2581 in a text is written in bytes, so decoding is exact for every
text; vocabulary entries that are never produced (score of -1e8 or less) are not
edges; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkTable, chunk_keys, grouped
from .textcore import U64, inverse_powers, mix, powers, text_bytes

N = 3
SHORT = 40  # bytes of a word up to which words are handled together
NEVER = -1e8


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces as bytes (a space for the word mark), their scores, and byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.piece: dict[bytes, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(sp.get_piece_size()):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes.append(bytes([int(name[3:5], 16)]))
                self.byte_ids[self.bytes[-1][0]] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes.append(b"")
            else:
                b = name.replace("▁", " ").encode()
                if any(b[k] != 32 and b[k + 1] == 32 for k in range(len(b) - 1)):
                    raise ValueError("a piece runs into a space, so words aren't independent")
                self.bytes.append(b)
                if sp.get_score(i) > NEVER:
                    self.piece[b] = (i, float(sp.get_score(i)))
        self.longest = max(map(len, self.piece))
        self.unknown = min(s for _, s in self.piece.values()) - 10
        # the same edges as sorted hashes, for many words at once
        flat = list(self.piece)
        stops = np.cumsum([len(p) for p in flat])
        keys = chunk_keys(np.frombuffer(b"".join(flat), np.uint8), stops - [len(p) for p in flat], stops)
        order = np.argsort(keys)
        self.keys = keys[order]
        if len(np.unique(self.keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        self.ids = np.array([self.piece[p][0] for p in flat])[order]
        self.scores = np.array([self.piece[p][1] for p in flat])[order]
        self.lens = np.array([len(b) for b in self.bytes])
        self.flat = np.frombuffer(b"".join(self.bytes) or b"\0", np.uint8)
        self.begin = np.cumsum(self.lens) - self.lens

    def edges(self, word: bytes, end: int):
        """(start, ids, score) of the edges into node ``end``, longest first; ends of characters only."""
        found = []
        for start in range(max(0, end - self.longest), end):
            if word[start] & 0xC0 != 0x80 and (hit := self.piece.get(word[start:end])):
                found.append((start, (hit[0],), hit[1]))
        start = end - 1
        while word[start] & 0xC0 == 0x80 and start:
            start -= 1
        if not any(s == start for s, _, _ in found):
            found.append((start, tuple(int(self.byte_ids[x]) for x in word[start:end]), self.unknown))
        return found


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _node(word: bytes, at: int) -> bool:
    return at == len(word) or word[at] & 0xC0 != 0x80


def forward(v: Vocabulary, word: bytes):
    """Best prefix score of each node, the edge that reaches it, and the loss of the second-best edge."""
    best, back, loss = [-np.inf] * (len(word) + 1), [None] * (len(word) + 1), [np.inf] * (len(word) + 1)
    best[0] = 0.0
    for end in range(1, len(word) + 1):
        if not _node(word, end):
            continue
        second = -np.inf
        for e in v.edges(word, end):
            s = best[e[0]] + e[2]
            if s > best[end]:
                second, best[end], back[end] = best[end], s, e
            elif s > second:
                second = s
        loss[end] = best[end] - second
    return best, back, loss


def search(v: Vocabulary, word: bytes, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of a word, best first: A-star from the end with forward scores as heuristic.

    Of the paths from a node to the end only the n best can be part of the
    result, so a node is expanded n times at most; equals are taken depth first.
    """
    best, _, _ = forward(v, word)
    agenda, tick, out, taken = [(-best[-1], 0, len(word), 0.0, None)], 0, [], [0] * (len(word) + 1)
    while agenda and len(out) < n:
        _, _, node, behind, path = heapq.heappop(agenda)
        taken[node] += 1
        if taken[node] > n:
            continue
        if node == 0:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            out.append((behind, tuple(ids)))
            continue
        for start, ids, score in v.edges(word, node):
            tick -= 1
            heapq.heappush(agenda, (-(best[start] + score + behind), tick, start, behind + score, (ids, path)))
    return out


def _one(v: Vocabulary, word: bytes):
    best, back, loss = forward(v, word)
    ids, node, gap = [], len(word), np.inf
    while node:
        gap = min(gap, loss[node])
        ids.append(back[node][1])
        node = back[node][0]
    return [i for part in reversed(ids) for i in part], best[-1], gap


def _many(v: Vocabulary, words: np.ndarray):
    """(lengths, ids, (score, gap)) of words of one length, rows of ``words``."""
    n, m = words.shape
    sums = np.zeros((n, m + 1), U64)
    np.cumsum((words.astype(U64) + U64(1)) * powers(m)[None, :], axis=1, out=sums[:, 1:])
    inv = inverse_powers(m)
    node = np.ones((n, m + 1), bool)
    node[:, 1:m] = words[:, 1:] & 0xC0 != 0x80
    last = np.maximum.accumulate(np.where(node, np.arange(m + 1), 0)[:, :-1], axis=1)  # start of the character before each end
    best, loss = np.full((n, m + 1), -np.inf), np.full((n, m + 1), np.inf)
    start_of, id_of = np.zeros((n, m + 1), np.int64), np.zeros((n, m + 1), np.int64)
    best[:, 0] = 0
    rows = np.arange(n)
    for end in range(1, m + 1):
        top, second = np.full(n, -np.inf), np.full(n, -np.inf)
        alone = np.zeros(n, bool)  # the last character is a piece
        for start in range(max(0, end - v.longest), end):
            key = mix((sums[:, end] - sums[:, start]) * inv[start] + U64(end - start) * U64(0x9E3779B97F4A7C15))
            at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
            hit = (v.keys[at] == key) & node[:, start] & node[:, end]
            alone |= hit & (last[:, end - 1] == start)
            s = np.where(hit, best[:, start] + v.scores[at], -np.inf)
            better = s > top
            second = np.where(better, top, np.maximum(second, s))
            start_of[better, end], id_of[better, end] = start, v.ids[at[better]]
            top = np.where(better, s, top)
        s = np.where(~alone & node[:, end], best[rows, last[:, end - 1]] + v.unknown, -np.inf)
        better = s > top
        second = np.where(better, top, np.maximum(second, s))
        start_of[better, end], id_of[better, end] = last[better, end - 1], -1
        best[:, end] = np.where(better, s, top)
        with np.errstate(invalid="ignore"):
            loss[:, end] = np.where(node[:, end], best[:, end] - second, np.inf)
    ids = np.full((n, m), -1, np.int64)
    at, gap = np.full(n, m), np.full(n, np.inf)
    for end in range(m, 0, -1):
        r = np.flatnonzero(at == end)
        if not len(r):
            continue
        gap[r] = np.minimum(gap[r], loss[r, end])
        s = start_of[r, end]
        piece = id_of[r, end] >= 0
        ids[r[piece], s[piece]] = id_of[r[piece], end]
        for k, lo in zip(r[~piece].tolist(), s[~piece].tolist(), strict=True):
            ids[k, lo:end] = v.byte_ids[words[k, lo:end]]
        at[r] = s
    kept = ids >= 0
    return kept.sum(axis=1), ids[kept], np.stack([best[:, m], gap], axis=1)


def word_encoder(v: Vocabulary):
    def encode(words: list[bytes]):
        lens, floats = np.zeros(len(words), np.int64), np.zeros((len(words), 2))
        ids: list = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, ks in by_size.items():
            if size > SHORT or len(ks) < 4:
                for k in ks:
                    ids[k], *floats[k] = _one(v, words[k])
                    lens[k] = len(ids[k])
                continue
            for at in range(0, len(ks), 4096):
                part = ks[at:at + 4096]
                n, flat, x = _many(v, np.frombuffer(b"".join(words[k] for k in part), np.uint8).reshape(-1, size))
                lens[part], floats[part] = n, x
                for k, one in zip(part, np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    ids[k] = one
        return lens, np.concatenate([np.asarray(x, np.uint16) for x in ids]) if ids else np.empty(0, np.uint16), floats

    return encode


@functools.cache
def word_table(path: str) -> ChunkTable:
    return ChunkTable(word_encoder(vocabulary(path)), floats=2)


@functools.lru_cache(maxsize=50_000)
def _searched(path: str, word: bytes, n: int):
    return search(vocabulary(path), word, n)


def merge(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best sums that take one score of each list (sorted, best first): (sum, choice of each list)."""
    first = (0,) * len(lists)
    heap, seen, out = [(-sum(x[0] for x in lists), first)], {first}, []
    while heap and len(out) < n:
        total, choice = heapq.heappop(heap)
        out.append((-total, choice))
        for k in range(len(lists)):
            if choice[k] + 1 < len(lists[k]):
                nxt = (*choice[:k], choice[k] + 1, *choice[k + 1:])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (total + lists[k][choice[k]] - lists[k][choice[k] + 1], nxt))
    return out


def encode_texts(texts: list[bytes], path: str, n: int = N):
    """For each text its n best (score, ids), best first; ids of the dummy leading space included."""
    table, out = word_table(path), []
    for lo, hi in grouped(texts):
        group = [b" " + t if t else b"" for t in texts[lo:hi]]
        b = np.frombuffer(b"".join(group), np.uint8)
        ends = np.cumsum([len(t) for t in group])
        begins = ends - [len(t) for t in group]
        cut = np.zeros(len(b), bool)
        if len(b):
            cut[1:] = (b[1:] == 32) & (b[:-1] != 32)
        cut[begins[begins < ends]] = True
        starts = np.flatnonzero(cut)
        stops = np.append(starts[1:], len(b))[:len(starts)]
        at, size, x = table.look_up(b, starts, stops)
        flat = table.ids(at, size)
        done = np.append(0, np.cumsum(size))
        for k in range(hi - lo):
            w = slice(*np.searchsorted(starts, (begins[k], ends[k])))
            if w.start == w.stop:
                out.append([(0.0, np.empty(0, np.uint16))])
                continue
            ids, score, gap = flat[done[w.start]:done[w.stop]], float(x[w, 0].sum()), x[w, 1]
            m = min(n - 1, len(gap))
            few = np.sort(np.argsort(gap, kind="stable")[:m]) if m < len(gap) else np.arange(len(gap))
            few = few[np.isfinite(gap[few])]
            lists = [_searched(path, b[starts[w.start + j]:stops[w.start + j]].tobytes(), n) for j in few.tolist()]
            ranked = []
            for total, choice in merge([[s for s, _ in one] for one in lists], n) if n > 1 else [(0.0, ())]:
                if not any(choice):
                    ranked.append((score, ids))
                    continue
                parts, upto = [], 0
                for j, one, c in zip(few.tolist(), lists, choice, strict=True):
                    if c:
                        parts += [ids[upto:done[w.start + j] - done[w.start]], np.array(one[c][1], np.uint16)]
                        upto = done[w.start + j + 1] - done[w.start]
                ranked.append((score + total - sum(one[0][0] for one in lists), np.concatenate([*parts, ids[upto:]])))
            out.append(ranked)
    return out


def decode(v: Vocabulary, ids: np.ndarray) -> bytes:
    """The text's bytes: pieces one behind the other, without the dummy leading space."""
    ids = ids.astype(np.int64)
    n = v.lens[ids]
    ends = np.cumsum(n)
    return v.flat[np.repeat(v.begin[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()[1:]


def _encode(path: str, n: int):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32()))]))

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in grouped(texts):
                rows = [[{"score": s, "ids": i.astype(np.int32)} for s, i in ranked] for ranked in encode_texts(texts[lo:hi], path, n)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(rows, kind)], ["doc_id", "nbest"])

    return run


def encode(docs: DataFrame, n: int = N, path: str | None = None) -> DataFrame:
    """doc_id, nbest (array of score and ids, best first): a row per input row."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        _encode(path or model_path(), n), "doc_id long, nbest array<struct<score:double,ids:array<int>>>")


def _digest(path: str, n: int):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for lo, hi in grouped(texts):
                found = encode_texts(texts[lo:hi], path, n)
                crc = [[zlib.crc32(i.astype("<u4").tobytes()) for _, i in ranked] for ranked in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([len(r[0][1]) for r in found], pa.int64()),
                     pa.array([c[0] for c in crc], pa.int64()), pa.array([r[0][0] for r in found]),
                     pa.array([",".join(f"{s:.0f}" for s, _ in r) for r in found], pa.string()),
                     pa.array([",".join(map(str, c)) for c in crc], pa.string()),
                     pa.array([all(decode(v, i) == t for _, i in r) for r, t in zip(found, texts[lo:hi], strict=True)])],
                    ["doc_id", "n_pieces", "ids_crc32", "best_score", "nbest_scores", "nbest_crc32", "decoded_equal"])

    return run


def encoding_report(docs: DataFrame, n: int = N, path: str | None = None) -> DataFrame:
    """Digests of ``encode`` and whether every one of the n best decodes to the text: a row per input row."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(
        _digest(path or model_path(), n), "doc_id long, n_pieces long, ids_crc32 long, best_score double, "
        "nbest_scores string, nbest_crc32 string, decoded_equal boolean")
