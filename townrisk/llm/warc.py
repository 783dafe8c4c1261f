"""WARC archives: a writer with revisit records, and a reader that splits files by byte range.

Every record is a gzip member of its own. The reader takes (path, first byte,
end byte) ranges; a task looks for the gzip magic in its range, takes a place
for a member only if it inflates to a whole WARC header, and owns the records
that start inside the range, reading past the range's end to finish the last.
So no index is needed, and a file of any size is read by many tasks.

Files are opened by URI through pyarrow.fs in a folder that all executors share.
A writing task names its files after its partition and attempt, and only files
listed by the attempt that succeeded are read; lost tasks leave unread files.

Edge cases: repeated page_ids give a row each, with their own payloads; a null payload is empty, a null url an empty target; a null page_id
has an empty record id; control characters in a url are percent-encoded; equal
payloads of at least ``REVISIT_FROM`` bytes are written once, as the response
with the largest page_id; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, shared_table

REVISIT_FROM = 1000
ROLL = 64 << 20  # bytes after which a task begins a new archive
SPLIT = 16 << 20
MOST_TASKS = 100_000  # of a read; beyond it a task reads several ranges
READ = 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"


def open_folder(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def record(kind: str, number, url: str, payload: bytes, sha1: str, refers_to=None) -> bytes:
    """A record as a gzip member. A revisit's block is empty; its digest is that of the full payload."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if number is None else number}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + squeeze.flush()


def _write(folder: str, roll: int):
    def run(batches):
        context = TaskContext.get()
        system, base = open_folder(folder)
        stem = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, name, size, records, files = None, "", 0, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"{stem}-{len(files):05d}.warc.gz"
                    out, size, records = system.open_output_stream(name, compression=None), 0, 0
                payload = (r["html"] or "").encode("utf-8", "surrogatepass") if r["refers_to"] is None else b""
                member = record("response" if r["refers_to"] is None else "revisit", r["page_id"], r["url"], payload, r["sha1"], r["refers_to"])
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= roll:
                    out.close()
                    files.append((name, size, records))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size, records))
        c = list(zip(*files, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())],
                                         ["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns path, bytes and records of each archive."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").withColumns({
        "sha1": F.sha1(F.coalesce("html", F.lit(""))), "size": F.octet_length(F.coalesce("html", F.lit(""))),
        "check": F.xxhash64(F.coalesce("html", F.lit("")))})
    twins = shared_table(rows.filter(f"size >= {REVISIT_FROM}").groupBy("sha1", "size", "check")
                         .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                         .filter("n > 1 and first is not null").drop("n"), "equal-payloads")
    marked = rows.join(twins, ["sha1", "size", "check"], "left").select(
        "page_id", "url", "sha1", F.expr("case when not (page_id <=> first) then first end").alias("refers_to"), "html")
    marked = marked.withColumn("html", F.expr("case when refers_to is null then html end"))
    return shared_table(marked.mapInArrow(_write(folder, roll), "path string, bytes long, records long"), "archives")


class Window:
    """Bytes of an open file by position, read in blocks of READ."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, position: int, most: int | None = None) -> bytes:
        """Some bytes from ``position`` on, at least a magic's length unless the file ends; none at its end."""
        stop = self.start + len(self.data)
        if not self.start <= position < (stop if stop == self.size else stop - len(MAGIC) + 1):
            self.file.seek(position)
            self.start, self.data = position, self.file.read(min(READ, max(0, self.size - position)))
        at = position - self.start
        return self.data[at:at + (most or READ)]


def inflate(window: Window, position: int) -> tuple[bytes, int] | None:
    """(content, end) of a gzip member that begins at ``position`` and holds a WARC record; else None.

    Stops as soon as the first bytes say that it is something else.
    """
    engine, content, at = zlib.decompressobj(31), [], position
    head, whole = bytearray(), False
    try:
        while not engine.eof:
            data = window.at(at, READ if whole else 4096)
            if not data:
                return None
            content.append(engine.decompress(data))
            at += len(data)
            if not whole:
                # the header has no limit; the last bytes of what came before are enough to find its end
                seen = max(0, len(head) - 3)
                head += content[-1]
                if not head.startswith(b"WARC/1."[:len(head)]):
                    return None
                whole = head.find(b"\r\n\r\n", seen) >= 0
    except zlib.error:
        return None
    return (b"".join(content), at - len(engine.unused_data)) if whole else None


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.decode("utf-8", "replace").partition(":")
        fields[key.strip().lower()] = value.strip()
    return fields, rest[:int(fields.get("content-length") or 0)]


def members(window: Window, first: int, end: int):
    """(place, content) of the records that start in [first, end)."""
    at = first
    while at < end:
        data = window.at(at)
        if not data:
            return
        hit = data.find(MAGIC)
        if hit < 0:
            at += max(1, len(data) - len(MAGIC) + 1)  # a magic may run over the block's end
            continue
        if at + hit >= end:
            return
        found = inflate(window, at + hit)
        if found is None:
            at += hit + 1
            continue
        yield at + hit, found[0]
        at = found[1]


def _read(batches):
    names = ["path", "place", "record_id", "target", "record_type", "refers_to", "digest", "payload"]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 8, types, strict=True)], names)

    for batch in batches:
        for r in batch.to_pylist():
            system, base = open_folder(r["path"])
            rows, held = [], 0
            with system.open_input_file(base) as f:
                for place, content in members(Window(f, f.size()), r["first"], r["end"]):
                    h, payload = parse(content)
                    rows.append((r["path"], place, h.get("warc-record-id", ""), h.get("warc-target-uri"), h.get("warc-type"),
                                 h.get("warc-refers-to"), h.get("warc-payload-digest"), payload))
                    held += len(payload)
                    if held > 4 * READ:
                        yield packed(rows)
                        rows, held = [], 0
            yield packed(rows)


def read_archives(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of ``archives`` (path, bytes): path, place, record_id, target, record_type, refers_to, digest, payload."""
    ranges = archives.select("path", F.explode(F.expr(
        f"transform(sequence(0L, greatest(bytes - 1, 0L), {split}L), x -> struct(x as first, least(x + {split}L, bytes) as end))")).alias("r")
    ).select("path", "r.first", "r.end")
    # a number of its own, as ranges are tiny rows that Spark would put together again into one task
    ranges = shared_table(ranges, "ranges")
    return ranges.repartition(max(1, min(MOST_TASKS, ranges.count()))).mapInArrow(
        _read, "path string, place long, record_id string, target string, record_type string, refers_to string, digest string, payload binary")


def check_counts(archives: DataFrame, rows: DataFrame) -> None:
    """Stops if an archive didn't give back as many records as were written into it."""
    read = rows.groupBy("path").agg(F.count("*").alias("read"))
    lost = archives.join(read, "path", "full").filter("not records <=> coalesce(read, 0)").select("path", "records", "read").limit(5).collect()
    if lost:
        raise ValueError("records written and read differ: " + "; ".join(f"{r.path} {r.records} {r.read or 0}" for r in lost))


def round_trip(pages: DataFrame, folder: str | None = None, roll: int = ROLL, split: int = SPLIT) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of ``pages`` as read back from written archives."""
    number = "cast(regexp_extract({}, '^<urn:page:(.*)>$', 1) as bigint)"
    archives = write_archives(pages, folder, roll)
    rows = shared_table(read_archives(archives, split).select(
        "path",
        F.expr(number.format("record_id").replace("cast(", "cast(nullif(").replace(" as bigint)", ", '') as bigint)")).alias("page_id"),
        F.octet_length("payload").cast("long").alias("own_bytes"), F.sha1("payload").alias("own_digest"), "record_type",
        F.expr(number.format("refers_to")).alias("refers_to"), F.expr("substring(digest, 6)").alias("named")), "records")
    check_counts(archives, rows)
    # a revisit has the payload of the response it names, by page and by digest: a page_id can stand on several payloads
    whole = shared_table(rows.filter("record_type = 'response' and page_id is not null")
                         .join(rows.select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
                         .select(F.col("page_id").alias("refers_to"), F.col("own_bytes").alias("bytes"), F.col("own_digest").alias("digest"))
                         .filter(f"bytes >= {REVISIT_FROM}").distinct(), "responses")
    return rows.join(whole.withColumn("named", F.col("digest")), ["refers_to", "named"], "left").select(
        "page_id", F.coalesce("bytes", "own_bytes").alias("payload_bytes"), F.coalesce("digest", "own_digest").alias("payload_digest"),
        "record_type", "refers_to")
