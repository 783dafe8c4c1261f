"""Repeated byte strings by longest-previous-factor arrays over a sparse suffix order.

For a least length T (200 bytes), the suffixes of all texts are thinned and
dealt out so that suffixes with a common prefix of T bytes always meet:

1. Every T-byte string picks an anchor, the smallest hash among its k-grams
   (the leftmost of equals). Equal strings pick the same k-gram at the same
   place. Neighbouring strings share anchors, about one for 80 bytes of text.
2. Anchors whose k-gram occurs once can't lie in a repeated string and go. If
   all occurrences of a k-gram have the same context (every byte of the strings
   that picked it), all its strings repeat; so do those of a context that occurs
   twice. No text moves for either.
3. What is left are distinct contexts of recurring k-grams. They meet by k-gram,
   a task takes them in blocks, sorts their suffixes, and the longest previous
   factor of a suffix is the longer match with the previous or next smaller
   position in suffix order; longest next factors are the mirror image.
   A k-gram with more than ``CROWD`` distinct contexts is no block. There the
   strings are taken in cells of neighbouring places before the k-gram, first
   wide, then narrow, last one by one: cells whose common bytes occur once are
   dropped, cells with equal outer bytes are settled, the others are cut.

``keep="first"`` removes what has an earlier copy (previous factor of T or more)
and so leaves the first of every string; ``keep="none"`` removes all copies.
Earlier means the smaller (doc_id, text digest, place).

Edge cases: null and short texts lose nothing; rows that repeat doc_id and text
are different documents with equal results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from .chunks import grouped
from .textcore import PIECE, U64, inverse_powers, mix, powers, text_bytes

LENGTH, GRAM = 200, 40
CROWD = 16384  # contexts of a block: about 5 MB of text, some 250 MB of arrays, a few seconds
CELLS = (32, 6, 1)  # places in a cell, by round
BLOCK = 1 << 18
_LOW = U64(0xFFFFFF)  # places within a piece


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from running minima of blocks in both directions."""
    n = len(v) - w + 1
    blocks = np.full(-(-len(v) // w) * w, np.iinfo(U64).max, U64)
    blocks[:len(v)] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def anchors(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(document, place, first, last, gram hash, context hash) of the anchors of texts that end at ``ends``.

    first and last are the starts of the strings that picked the anchor.
    """
    none = [np.empty(0, np.int64)] * 4 + [np.empty(0, U64)] * 2
    starts = np.concatenate([[0], ends[:-1]])
    long = np.flatnonzero(ends - starts >= length)
    if not len(long):
        return none
    m = len(b)
    sums = np.zeros(m + 1, U64)
    np.cumsum((b.astype(U64) + U64(1)) * powers(2 * PIECE)[:m], out=sums[1:])
    inv = inverse_powers(2 * PIECE)
    h = mix((sums[gram:] - sums[:-gram]) * inv[:m - gram + 1])
    low = window_minima((h & ~_LOW) | np.arange(len(h), dtype=U64), length - gram + 1)
    counts = ends[long] - starts[long] - length + 1
    doc = np.repeat(long, counts)
    p = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    q = (low[p] & _LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (doc[1:] != doc[:-1])]))
    first, last, q, doc = p[new], p[np.append(new[1:], len(p)) - 1], q[new], doc[new]
    context = (sums[last + length] - sums[first]) * inv[first]
    context = mix(context ^ mix((q - first).astype(U64) * U64(1 << 20) + (last - first).astype(U64)))
    return [doc, q - starts[doc], first - starts[doc], last - starts[doc], h[q], context]


def _find_anchors(batches):
    names = ["doc_id", "tag", "first", "reach", "gram", "context"]
    for batch in batches:
        ids, tags, texts = batch.column("doc_id"), batch.column("tag"), text_bytes(batch.column("text"))
        for lo, hi in grouped(texts):
            # a longer text is taken in pieces that overlap by one string less a byte
            size = sum(map(len, texts[lo:hi]))
            pieces = [(0, b"".join(texts[lo:hi]))] if size <= PIECE else [
                (at, texts[lo][at:at + PIECE + LENGTH - 1]) for at in range(0, size, PIECE)]
            for at, piece in pieces:
                ends = np.cumsum([len(t) for t in texts[lo:hi]]) if size <= PIECE else np.array([len(piece)])
                doc, place, first, last, gram, context = anchors(np.frombuffer(piece, np.uint8), ends)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), tags.take(rows), pa.array((first + at).astype(np.int32)),
                     pa.array(((place - first) * 256 + last - first).astype(np.int32)),
                     pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names)


# ---- suffix order of a block ------------------------------------------------------------------

def _ranks(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    rank = np.empty(len(key), np.int32)
    s = key[order]
    rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1], dtype=np.int32)]) if len(key) else []
    return rank


def prefix_ranks(s: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Rank of s[i:i+h] among all such strings for h = 8, 16, .. and ``length`` (doubling; shorter at the end)."""
    padded = np.concatenate([s, np.zeros(length, np.uint8)])
    n = len(s)
    word = np.zeros(n, U64)
    for k in range(8):
        word = word << U64(8) | padded[k:k + n]
    levels, h = {8: _ranks(word)}, 8
    while h < length:
        to = min(2 * h, length)
        r = levels[h]
        follow = np.zeros(n, np.int32)
        follow[:max(0, n - (to - h))] = r[to - h:] + 1
        levels[to] = _ranks(r.astype(U64) << U64(32) | follow.astype(U64))
        h = to
    return levels


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the nearest element to the left that is smaller, else -1 (pointer jumping)."""
    at = np.arange(len(x)) - 1
    open_ = np.flatnonzero(at >= 0)
    open_ = open_[x[at[open_]] > x[open_]]
    while len(open_):
        at[open_] = at[at[open_]]  # what lies between is larger
        open_ = open_[at[open_] >= 0]
        open_ = open_[x[at[open_]] > x[open_]]
    return at


def _match(levels: dict[int, np.ndarray], s: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, ``length`` at most."""
    got = np.where(levels[length][a] == levels[length][b], length, 0)
    part = np.flatnonzero(got < length)
    for h in sorted((x for x in levels if x < length), reverse=True):
        i, j = a[part] + got[part], b[part] + got[part]
        ok = (np.maximum(i, j) < len(s)) & (got[part] + h <= length)
        ok[ok] = levels[h][i[ok]] == levels[h][j[ok]]
        got[part[ok]] += h
    for _ in range(7):
        i, j = a[part] + got[part], b[part] + got[part]
        ok = (np.maximum(i, j) < len(s)) & (got[part] < length)
        part = part[ok]
        part = part[s[i[ok]] == s[j[ok]]]
        got[part] += 1
    return got


def longest_factors(s: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor, ``length`` at most, of the suffixes at the sorted ``starts``.

    In suffix order the best match among smaller positions is the previous or
    the next smaller position; among larger ones, the same with order reversed.
    ``starts`` leave at least ``length`` bytes of their own text.
    """
    levels = prefix_ranks(s, length)
    order = np.argsort(levels[length][starts], kind="stable")  # ties by position
    pos = starts[order]
    out = []
    for key in (np.arange(len(starts))[order], -np.arange(len(starts))[order]):
        best = np.zeros(len(pos), np.int64)
        before = _nearest_smaller(key)
        after = len(key) - 1 - _nearest_smaller(key[::-1])[::-1]
        for near in (before, after):
            k = np.flatnonzero((near >= 0) & (near < len(pos)))
            best[k] = np.maximum(best[k], _match(levels, s, pos[k], pos[near[k]], length))
        back = np.empty(len(pos), np.int64)
        back[order] = best
        out.append(back)
    return out[0], out[1]


def _runs(p: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of runs of consecutive numbers."""
    if not len(p):
        return []
    cut = np.flatnonzero(np.diff(p) != 1)
    return list(zip(p[np.append(0, cut + 1)].tolist(), p[np.append(cut, len(p) - 1)].tolist(), strict=True))


_SPAN = "doc_id long, tag long, lo int, hi int"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()),
                                       pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], ["doc_id", "tag", "lo", "hi"])


def _order(r: dict) -> tuple:
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["tag"], r["first"])


def _block_spans(first_only: bool):
    """Contexts sorted by gram -> spans of repeated strings; a gram's contexts stay in one block."""
    def block(rows: list[dict]) -> pa.RecordBatch:
        rows.sort(key=_order)
        s = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        counts = np.array([len(r["bytes"]) - LENGTH + 1 for r in rows])
        base = np.cumsum([len(r["bytes"]) for r in rows]) - [len(r["bytes"]) for r in rows]
        owner = np.repeat(np.arange(len(rows)), counts)
        shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        earlier, later = longest_factors(s, base[owner] + shift, LENGTH)
        hit = earlier >= LENGTH if first_only else (earlier >= LENGTH) | (later >= LENGTH)
        out, ends = [], np.cumsum(counts)
        for k in np.unique(owner[hit]).tolist():
            r = rows[k]
            own = np.flatnonzero(hit[ends[k] - counts[k]:ends[k]]) + r["first"]
            out += [(r["doc_id"], r["tag"], lo, hi + LENGTH) for lo, hi in _runs(own)]
        return _span_batch(out)

    def run(batches):
        held: list[dict] = []
        size, gram = 0, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["gram"] != gram and size >= BLOCK:
                    yield block(held)
                    held, size = [], 0
                gram = r["gram"]
                held.append(r)
                size += len(r["bytes"])
        if held:
            yield block(held)

    return run


def _cells(width: int):
    """Cuts ranges of strings into cells: places before the k-gram from a multiple of ``width`` on.

    A cell's inner bytes are common to all strings that may stand in it, its
    outer bytes those of the strings that do.
    """
    names = ["gram", "cell", "inner", "outer", "copies", "doc_id", "tag", "first", "lo", "hi"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                b = np.frombuffer(r["bytes"], np.uint8)
                sums = np.zeros(len(b) + 1, U64)
                np.cumsum((b.astype(U64) + U64(1)) * powers(4096)[:len(b)], out=sums[1:])
                place, inv = r["place"], inverse_powers(4096)  # all within the context
                cells = np.arange((place - r["hi"]) // width, (place - r["lo"]) // width + 1)
                lo = np.maximum(place - (cells + 1) * width + 1, r["lo"])
                hi = np.minimum(place - cells * width, r["hi"])
                # bytes common to every string of the cell; any one string of it has them all
                begin, end = place - cells * width, place - (cells + 1) * width + 1 + LENGTH
                inner = mix((sums[end] - sums[begin]) * inv[begin] + cells.astype(U64))
                outer = mix((sums[hi + LENGTH] - sums[lo]) * inv[lo] + mix((place - lo).astype(U64) * U64(4096) + (place - hi).astype(U64)))
                for k in range(len(cells)):
                    out.append((r["gram"], int(cells[k]), int(inner[k].astype(np.int64)), int(outer[k].astype(np.int64)), r["copies"],
                                r["doc_id"], r["tag"], r["first"], int(lo[k]), int(hi[k])))
            c = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)], names)

    return run


def _crowd_spans(cut: DataFrame, first_only: bool) -> list[DataFrame]:
    """Spans of repeated strings of the crowded grams; ``cut`` has their contexts."""
    out = []
    ranges = cut.select("gram", "copies", "doc_id", "tag", "first", "place", "bytes", F.lit(0).alias("lo"),
                        F.expr(f"octet_length(bytes) - {LENGTH}").alias("hi"))
    for width in CELLS:
        cells = shared_table(ranges.mapInArrow(
            _cells(width), "gram long, cell int, inner long, outer long, copies long, doc_id long, tag long, first int, lo int, hi int"), "cells")
        groups = shared_table(cells.groupBy("gram", "cell", "inner").agg(
            F.sum("copies").alias("n"), (F.min("outer") == F.max("outer")).alias("same"),
            F.min(F.struct("doc_id", "tag", "first", "lo")).alias("least")).filter("n > 1"), "cell-groups")
        cells = cells.drop("copies").join(groups, ["gram", "cell", "inner"])
        settled = cells.filter("same")
        if first_only:
            settled = settled.filter("struct(doc_id, tag, first, lo) > least")
        out.append(settled.select("doc_id", "tag", F.expr("first + lo").alias("lo"), F.expr(f"first + hi + {LENGTH}").alias("hi")))
        if width > 1:
            open_ = cells.filter("not same").select("doc_id", "tag", "first", "lo", "hi")
            ranges = _keyed(open_, cut.select("gram", "copies", "doc_id", "tag", F.col("first").alias("_first"), "place", "bytes")
                            ).filter("first = _first").drop("_first")
    return out


def _cut_contexts(batches):
    for batch in batches:
        ids, tags = batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist()
        out = []
        for k, (text, parts) in enumerate(zip(text_bytes(batch.column("text")), batch.column("contexts").to_pylist(), strict=True)):
            out += [(p["gram"], p["copies"], p["crowd"], ids[k], tags[k], p["first"], p["reach"] // 256,
                     text[p["first"]:p["first"] + p["reach"] % 256 + LENGTH]) for p in parts or ()]
        c = list(zip(*out, strict=True)) or [()] * 8
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types, strict=True)],
                                         ["gram", "copies", "crowd", "doc_id", "tag", "first", "place", "bytes"])


def _remove(batches):
    """Cuts the united spans out of each text."""
    for batch in batches:
        removed, spans, digest, kept = [], [], [], []
        for text, parts in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            gone, at, left, n = 0, 0, [], 0
            for p in sorted(parts, key=lambda p: p["lo"]):
                lo, hi = p["lo"], p["hi"]
                if lo > at or n == 0:
                    n += 1
                    left.append(text[at:lo])
                    at = lo
                gone += max(0, hi - at)
                at = max(at, hi)
            left.append(text[at:])
            rest = b"".join(left)
            removed.append(gone)
            spans.append(n)
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "tag", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def _keyed(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on doc_id (null equals null) and tag."""
    r = right.withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    return left.join(r, left.doc_id.eqNullSafe(r._doc) & (left.tag == r._tag), how).drop("_doc", "_tag")


def repeated_spans(docs: DataFrame, keep: str = "none") -> tuple[DataFrame, DataFrame]:
    """(affected texts: doc_id, tag, text, whole; spans in them: doc_id, tag, lo, hi).

    ``docs`` has doc_id, tag and text. ``whole`` lists spans known without
    comparing contexts.
    """
    first_only = keep == "first"
    # reach: 256 * (places from the first string to the k-gram) + places to the last string
    found = shared_table(docs.mapInArrow(
        _find_anchors, "doc_id long, tag long, first int, reach int, gram long, context long"), "anchors")
    grams = shared_table(found.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
                         .filter("n > 1").select("gram", F.expr("a <> b").alias("mixed")), "recurring-grams")
    recurring = shared_table(found.join(grams, "gram"), "recurring-anchors")
    # one row per distinct context of a recurring gram, with its first occurrence
    contexts = shared_table(recurring.groupBy("gram", "context", "mixed").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc_id", "tag", "first", "reach")).alias("at")), "contexts")
    many = contexts.filter("copies > 1").select("gram", "context", "at")
    whole = recurring.join(many, ["gram", "context"])
    if first_only:
        whole = whole.filter("struct(doc_id, tag, first, reach) > at")
    whole = whole.select("doc_id", "tag", "first", F.expr(f"first + reach % 256 + {LENGTH}").alias("end"))
    crowds = shared_table(contexts.filter("mixed").groupBy("gram").agg(F.count("*").alias("m"))
                          .select("gram", (F.col("m") > CROWD).alias("crowd")), "crowds")
    asked = contexts.filter("mixed").join(crowds, "gram").select(
        "at.doc_id", "at.tag", F.struct("gram", "copies", "crowd", "at.first", "at.reach").alias("context"))
    kinds = "array<struct<gram:bigint,copies:bigint,crowd:boolean,first:int,reach:int>>"
    per_doc = (whole.select("doc_id", "tag", F.struct("first", "end").alias("span"), F.lit(None).alias("context"))
               .unionByName(asked.withColumn("span", F.lit(None)))
               .groupBy("doc_id", "tag").agg(F.collect_list("span").alias("whole"),
                                             F.collect_list("context").cast(kinds).alias("contexts")))
    texts = shared_table(_keyed(docs, per_doc).dropDuplicates(["doc_id", "tag"]), "affected-texts")
    cut = shared_table(texts.filter("size(contexts) > 0").select("doc_id", "tag", "text", "contexts").mapInArrow(
        _cut_contexts, "gram long, copies long, crowd boolean, doc_id long, tag long, first int, place int, bytes binary"), "context-bytes")
    spans = [texts.select("doc_id", "tag", F.explode("whole").alias("s")).selectExpr("doc_id", "tag", "s.first as lo", "s.end as hi"),
             cut.filter("not crowd").repartition("gram").sortWithinPartitions("gram").mapInArrow(_block_spans(first_only), _SPAN)]
    crowded = cut.filter("crowd")
    if not crowded.isEmpty():
        spans += _crowd_spans(crowded, first_only)
    return texts.select("doc_id", "tag", "text"), functools.reduce(DataFrame.unionByName, spans)


def remove_repeats(docs: DataFrame, keep: str = "none") -> DataFrame:
    """doc_id, tag, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes (null: nothing removed), one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    # doc_id names a row unless it is null or repeated; then a digest of the text does
    plain = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty()
    docs = docs.select("doc_id", (F.lit(0).cast("long") if plain else F.xxhash64("text")).alias("tag"), "text")
    texts, spans = repeated_spans(docs, keep)
    lists = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    cut = _keyed(texts, lists).select("doc_id", "tag", "text", "spans").mapInArrow(
        _remove, "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    cut = shared_table(cut, "cut-texts")
    rows = docs.select("doc_id", "tag", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole_sha256"))
    return _keyed(rows, cut, "left").select(
        "doc_id", "tag", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept_bytes")
