"""Feature collections read in byte ranges, so that one large file is read by many tasks.

Whether a byte stands inside a string, and how deeply nested it is, follows
from everything before it. Each task first sums its range up for both cases
(the range begins outside or inside a string): how many quotes and by how much
the nesting grows. Running sums over the list of ranges then give the state at
every range's start, and a second pass takes the objects that begin in the
range as features, reading on behind its end to finish the last. Escaped quotes
are told by the backslashes before them, which may stand before the range.
Features are the direct elements of the root's last member named ``features``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import written

SPLIT = 32 << 20
LOOK = 4096
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)


def _open(uri: str):
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _between(file, first: int, end: int) -> bytes:
    file.seek(first)
    return file.read(end - first)


def slashes_before(file, at: int) -> int:
    """The backslashes that stand right before a place."""
    n = 0
    while at - n > 0:
        data = _between(file, max(0, at - n - LOOK), at - n)
        run = len(data) - len(data.rstrip(b"\\"))
        n += run
        if run < len(data):
            break
    return n


def marks(data: bytes, slashes: int, in_string: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets outside strings, +1 or -1 for each, number of quotes) of a piece that follows ``slashes`` backslashes."""
    b = np.frombuffer(data, np.uint8)
    quotes, back = np.flatnonzero(b == 34), np.flatnonzero(b == 92)
    # the backslashes right before a quote: the run that ends there, and what came before the piece
    if len(quotes) and (len(back) or slashes):
        begins = back[np.flatnonzero(np.diff(back, prepend=-2) != 1)]
        after = quotes[quotes > 0]
        hit = after[b[after - 1] == 92]
        start = begins[np.searchsorted(begins, hit - 1, side="right") - 1] if len(hit) else hit
        run = hit - start + np.where(start == 0, slashes, 0)
        escaped = hit[run % 2 == 1]
        if quotes[0] == 0 and slashes % 2:
            escaped = np.append(escaped, 0)
        quotes = np.setdiff1d(quotes, escaped, assume_unique=True)
    at = np.flatnonzero((b == 123) | (b == 125) | (b == 91) | (b == 93))
    at = at[(np.searchsorted(quotes, at) + in_string) % 2 == 0]
    return at, np.where((b[at] == 123) | (b[at] == 91), 1, -1), len(quotes)


def _sum_up(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with _open(r["path"]) as f:
                data, slashes = _between(f, r["first"], r["end"]), slashes_before(f, r["first"])
            outside, inside = marks(data, slashes, False), marks(data, slashes, True)
            rows.append((r["path"], r["first"], r["end"], outside[2] % 2, int(outside[1].sum()), int(inside[1].sum())))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "first", "end", "quotes", "d0", "d1"), x, strict=True)) for x in rows],
                                         pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("first", "end", "quotes", "d0", "d1")]]))


def parts(file, first: int, end: int, in_string: bool, depth: int):
    """(place, kind, text) of what begins in the range: arrays of the root with their key, their ends, objects inside them."""
    at, data, slashes = first, _between(file, first, end), slashes_before(file, first)
    begun, held = None, []  # an object that isn't over yet, and its bytes so far
    while data:
        places, signs, quotes = marks(data, slashes, in_string)
        after = depth + np.cumsum(signs)
        for k in np.flatnonzero((after <= 3) & (after >= 1)):
            p, d, c = int(places[k]), int(after[k]), data[places[k]]
            if begun is not None and signs[k] < 0 and d == 2:
                yield begun, "object", b"".join(held) + (data[begun - at:p + 1] if begun >= at else data[:p + 1])
                begun, held = None, []
            elif at + p >= end:
                if begun is None:
                    return
            elif d == 3 and c == 123 and signs[k] > 0:
                begun = at + p
            elif d == 2 and c == 91 and signs[k] > 0:
                key = _KEY.search(_between(file, max(0, at + p - LOOK), at + p))
                yield at + p, "array", key[1] if key else b""
            elif d == 1 and c == 93:
                yield at + p, "end", b""
        if begun is None:
            return
        held.append(data[max(0, begun - at):])
        in_string, depth = bool((quotes + in_string) % 2), int(after[-1]) if len(after) else depth
        tail = len(data) - len(data.rstrip(b"\\"))
        slashes = tail + (slashes if tail == len(data) else 0)
        at += len(data)
        data = _between(file, at, at + (1 << 20))


def _scan(batches):
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("pos", pa.int64()), ("kind", pa.string()), ("text", pa.string())])
    for batch in batches:
        for r in batch.to_pylist():
            rows, size = [], 0
            with _open(r["path"]) as f:
                for pos, kind, text in parts(f, r["first"], r["end"], bool(r["in_string"]), r["depth"]):
                    rows.append({"path": r["path"], "first": r["first"], "pos": pos, "kind": kind, "text": text.decode("utf-8")})
                    size += len(text)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)


def ranges(spark: SparkSession, paths: list[str], split: int) -> DataFrame:
    """(path, first, end) of all files; a task a range."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    r = files.select("path", F.explode(F.expr(
        f"transform(sequence(0L, length - 1, {split}L), x -> struct(x as first, least(x + {split}L, length) as end))")).alias("r")).select("path", "r.*")
    r = written(r, "geojson-ranges")
    return r.repartition(max(1, r.count()))


def split_features(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    """(path, fid, text): the features of every file, numbered in their order."""
    r = ranges(spark, paths, split)
    sums = written(r.mapInArrow(_sum_up, "path string, first long, end long, quotes long, d0 long, d1 long"), "geojson-sums")
    before = Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    state = sums.withColumn("in_string", F.coalesce(F.sum("quotes").over(before) % 2, F.lit(0)))
    state = state.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string") == 1, F.col("d1")).otherwise(F.col("d0"))).over(before), F.lit(0)))
    state = written(state.select("path", "first", "end", "in_string", "depth"), "geojson-state")
    found = written(state.repartition(max(1, state.count())).mapInArrow(_scan, "path string, first long, pos long, kind string, text string"), "geojson-parts")
    # a file has a few root arrays
    opens = found.where("kind = 'array' and text = 'features'").groupBy("path").agg(F.max("pos").alias("_open"))
    ends = found.where("kind = 'end'").select("path", F.col("pos").alias("_end"))
    span = opens.join(ends, "path").where("_end > _open").groupBy("path", "_open").agg(F.min("_end").alias("_end"))
    f = found.where("kind = 'object'").join(span, "path").where("pos > _open and pos < _end").select("path", "first", "pos", "text")
    counts = f.groupBy("path", "first").agg(F.count("*").alias("n"))
    base = counts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("path", "first").orderBy("pos")) - 1
    return f.withColumn("_own", own).join(base, ["path", "first"]).select("path", (F.col("_base") + F.col("_own")).alias("fid"), "text")


def _collection(column: str):
    def run(batches):
        began = False
        for batch in batches:
            lines = [x.as_py() for x in batch.column(0)]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([("," if began or k else '{"type":"FeatureCollection","features":[') + x
                                                            for k, x in enumerate(lines)])], [column])
                began = True
        yield pa.RecordBatch.from_arrays([pa.array(["]}" if began else '{"type":"FeatureCollection","features":[]}'])], [column])

    return run


def write_collections(features: DataFrame, out_dir: str, column: str = "feature") -> None:
    """Each partition as one file with a whole feature collection."""
    features.select(F.col(column).cast("string")).mapInArrow(_collection(column), f"{column} string").write.mode("overwrite").text(out_dir)
