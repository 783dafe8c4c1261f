"""Token ids as Arrow files: equal-length sequences and masks, read without copying.

A file is an Arrow IPC file (the random-access form, with a footer). Its record
batches have two fixed-size-list columns, ``ids`` and ``mask``, of ``SEQUENCE``
values each, the mask in single bits: sequence i of a file stands at a place
that follows from i alone, so a mapped file gives any sequence and its mask as
views of its bytes. The documents' ids,
each closed by an end id, run on from sequence to sequence; only the last
sequence of a file has padding, where the mask is 0. Beside it stands an index
file of the same form: doc_id, start (in the file) and n_tokens.

Documents are dealt by ranges of doc_id, so file after file holds them in
ascending order (null first; repeated ids by a hash of their text). A task
sorts its range, encodes and writes it; a file ends at the first document end
after ``ROLL`` ids. Files are opened by URI through pyarrow.fs in a folder that
all executors share, and named after partition and attempt; only files listed
by the attempt that succeeded are read. Starts over all files follow from the
list of files, one row each.

Ids are 16-bit where the vocabulary allows, else 32-bit.

Edge cases: null and empty texts are the lone end id; repeated rows are written
each; a null doc_id stays null and comes first; very long texts are encoded in
slices and may run over any number of sequences and batches; an empty table
gives no file and an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder, shared_table
from .packing import _byte_letters, tokenizer_path
from .warc import open_folder

SEQUENCE = 1024
BATCH = 256          # sequences of a record batch
ROLL = 16 << 20      # ids after which a file ends
END = 2
SLICE = 1 << 18      # characters encoded at a time
WORDS = 1_000_000    # words, and parts of words, a worker remembers
LONGEST = 48         # characters of a word worth remembering
INDEX_ROWS = 1 << 14

FILES = "part int, number int, path string, index_path string, ids long, documents long, sequences long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])

# The byte-level pre-tokenizer begins a token at every single space between two characters that
# aren't blank, between a letter and one of these marks, and between a lone line end and a letter.
_CUT = re.compile(r" (?<=[^\s\u180e] )(?=[^\s\u180e])")
_ALPHABET, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?#*$%&"
_INNER = re.compile(rf"(?<=[{_ALPHABET}])(?=[{_MARKS}\n])|(?<=[{_ALPHABET}{_MARKS}]\n)(?=[{_ALPHABET}])")
# Letters after one space at most are one token for the model, which reads bytes by their stand-ins.
_LETTERS, _STEM = re.compile(f" ?[{_ALPHABET}]+"), re.compile(f"[{_ALPHABET}]+")
_BYTES = {byte: letter for letter, byte in _byte_letters().items()}
_STAND_INS = {ord(c): "".join(_BYTES[b] for b in c.encode()) for c in map(chr, range(256)) if _LETTERS.fullmatch(c) or c == " "}
_SPACE = _BYTES[32]


_blank = re.compile(r"[\s\u180e]").match


class _Blank(Exception):
    """A word that begins or ends blank: not every space beside it is a cut."""


class _Known(dict):
    """Ids of texts met before, ``WORDS`` at most: when half of them are in it, those met since the last time stay aside."""

    def __init__(self, make):
        self.make, self.aside = make, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.aside.pop(text, None)
        if ids is None:
            ids = self.make(text)
        if len(text) <= LONGEST:
            if len(self) >= WORDS // 2:
                self.aside = self.copy()
                self.clear()
            self[text] = ids
        return ids


class Encoder:
    """Ids of whole texts by the tokenizers library, as bytes; words met before aren't encoded again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        most = max(self.tokenizer.get_vocab().values(), default=0)
        self.dtype = np.dtype("<u2" if most < 1 << 16 else "<u4")
        self.bytes = [x.tobytes() for x in np.arange(most + 1, dtype=self.dtype)]
        self.parts = _Known(self._part)   # by parts that are cut where tokens begin
        self.words = _Known(self._between)   # by words that follow a space, without it, and aren't blank at an end

    def _letters(self, stand_ins: str) -> bytes:
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(stand_ins)])

    def _part(self, part: str) -> bytes:
        if _LETTERS.fullmatch(part):
            return self._letters(part.translate(_STAND_INS))
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, self.dtype).tobytes()

    def _between(self, word: str) -> bytes:
        stem = word.rstrip(_MARKS)
        plain = stem.isascii()
        if stem.isalpha() if plain else _STEM.fullmatch(stem):
            if len(stem) < len(word):
                return self.words[stem] + self.parts[word[len(stem):]]
            return self._letters(_SPACE + (stem if plain else stem.translate(_STAND_INS)))
        if not word or _blank(word[0]) or _blank(word[-1]):
            raise _Blank
        return self._word(word)

    def _word(self, word: str) -> bytes:
        """The ids of a word that follows a space; blanks at its ends belong to it."""
        first, *rest = _INNER.split(word)
        head = self.words[first] if _STEM.fullmatch(first) else self.parts[" " + first]
        return b"".join([head, *map(self.parts.__getitem__, rest)]) if rest else head

    def pieces(self, text: str):
        """The ids of ``text`` in order, slice by slice."""
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            yield self._slice(text[at + (at > 0):end], at > 0)
            at = end

    def _slice(self, text: str, spaced: bool) -> bytes:
        """The ids of a slice, which follows a space that is a cut if ``spaced``."""
        words = text.split(" ")
        head, tail = [] if spaced else words[:1], words[-1:]
        if len(words) > len(head):  # the last word may end blank
            words, last = words[len(head):-1], tail[0]
            try:
                if head and (not head[0] or _blank(head[0][-1])) or not last or _blank(last[0]):
                    raise _Blank
                parts = [b"".join(map(self.parts.__getitem__, _INNER.split(head[0])))] if head else []
                parts += map(self.words.__getitem__, words)
                parts.append(self._word(last) if _blank(last[-1]) else self.words[last])
                return b"".join(parts)
            except _Blank:
                pass
        first, *rest = _CUT.split(" " + text if spaced else text)
        ids = [*map(self.parts.__getitem__, _INNER.split(first))]
        return b"".join(ids + [self._word(w) if not w or _blank(w[0]) or _blank(w[-1]) else self.words[w] for w in rest])


@functools.cache
def encoder(path: str) -> Encoder:
    """One for a Python worker, whatever the number of tasks it runs."""
    return Encoder(path)


class _Writer:
    """A data file and its index, filled document by document."""

    def __init__(self, system, stem: str, dtype: np.dtype, sequence: int, note: dict):
        kind = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))],
                                {k: str(v) for k, v in note.items()})
        self.path, self.index_path = f"{stem}.arrow", f"{stem}.index.arrow"
        self.sinks = [system.open_output_stream(p, compression=None) for p in (self.path, self.index_path)]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], INDEX)
        self.dtype, self.sequence = dtype, sequence
        self.held, self.held_bytes, self.places = [], 0, ([], [], [])
        self.ids = self.documents = self.sequences = 0

    def add(self, doc_id, pieces) -> None:
        start = self.ids
        for p in pieces:
            self.held.append(p)
            self.held_bytes += len(p)
            self.ids += len(p) // self.dtype.itemsize
            if self.held_bytes >= BATCH * self.sequence * self.dtype.itemsize:
                self._flush(False)
        for column, value in zip(self.places, (doc_id, start, self.ids - start), strict=True):
            column.append(value)
        self.documents += 1
        if len(self.places[0]) >= INDEX_ROWS:
            self._flush_index()

    def _flush_index(self) -> None:
        if self.places[0]:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.places], schema=INDEX))
            self.places = ([], [], [])

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.held), self.dtype)
        whole = len(values) // self.sequence
        rest = values[whole * self.sequence:]
        self.held, self.held_bytes = [rest.tobytes()], rest.nbytes
        values, mask = values[:whole * self.sequence], np.ones(whole * self.sequence, bool)
        if last and len(rest):
            pad = self.sequence - len(rest)
            values = np.concatenate([values, rest, np.zeros(pad, self.dtype)])
            mask = np.concatenate([mask, np.ones(len(rest), bool), np.zeros(pad, bool)])
        for k in range(0, len(values), BATCH * self.sequence):  # every batch but a file's last has BATCH sequences
            part = slice(k, k + BATCH * self.sequence)
            if not last and len(values) - k < BATCH * self.sequence:
                self.held, self.held_bytes = [values[k:].tobytes(), *self.held], values[k:].nbytes + self.held_bytes
                break
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.sequence) for x in (values, mask)]
            self.data.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            self.sequences += len(columns[0])

    def close(self) -> tuple:
        self._flush(True)
        self._flush_index()
        for x in (self.data, self.index, *self.sinks):
            x.close()
        return self.path, self.index_path, self.ids, self.documents, self.sequences


def _write(folder: str, path: str, sequence: int, roll: int, end: int):
    def run(batches):
        context, known = TaskContext.get(), encoder(path)
        system, base = open_folder(folder)
        stem = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        note = {"sequence": sequence, "end": end, "vocabulary": os.path.basename(path)}
        close = np.array([end], known.dtype).tobytes()
        out, rows = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    out = _Writer(system, f"{stem}-{len(rows):05d}", known.dtype, sequence, note)
                text = text.as_py()
                out.add(doc_id, (p for ps in (known.pieces(text or ""), (close,)) for p in ps))
                if out.ids >= roll:
                    rows.append((context.partitionId(), len(rows), *out.close()))
                    out = None
        if out is not None:
            rows.append((context.partitionId(), len(rows), *out.close()))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in FILES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], names)

    return run


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, sequence: int = SEQUENCE,
                      roll: int = ROLL, end: int = END) -> DataFrame:
    """Writes ``docs`` (doc_id, text) in ascending doc_id order; a row for each file, with its first id's place over all files."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    system, base = open_folder(folder)
    system.create_dir(base, recursive=True)
    # the last key deals rows of one doc_id, of equal texts even, over several ranges
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns(
        {"_tie": F.xxhash64(F.coalesce("text", F.lit(""))), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "_tie", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files = shared_table(ranged.mapInArrow(_write(folder, path or tokenizer_path(), sequence, roll, end), FILES), "token-files")
    # one row a file: a range of many documents each, so this order is over a short list
    before = Window.partitionBy(F.lit(0)).orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return shared_table(files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long"))), "token-file-starts")


class TokenFile:
    """A written file: ``len``, sequences by place, and any run of ids. Local files are mapped, others read by batch."""

    def __init__(self, uri: str):
        system, base = open_folder(uri)
        self.source = pa.memory_map(base) if system.type_name == "local" else system.open_input_file(base)
        self.file = pa.ipc.open_file(self.source)
        note = {k.decode(): v.decode() for k, v in (self.file.schema.metadata or {}).items()}
        self.sequence = int(note["sequence"])
        self._at, self._batch = -1, None

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if not n else (n - 1) * BATCH + self.file.get_batch(n - 1).num_rows

    def _columns(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if k != self._at:
            batch = self.file.get_batch(k)
            self._at, self._batch = k, (batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self._batch

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence ``i``, views of the file."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, at = divmod(i, BATCH)
        return tuple(c[at * self.sequence:(at + 1) * self.sequence] for c in self._columns(k))

    def run(self, start: int, n: int):
        """Views that make up the ids [start, start + n)."""
        size = BATCH * self.sequence
        while n > 0:
            k, at = divmod(start, size)
            part = self._columns(k)[0][at:at + n]
            if not len(part):
                raise EOFError(f"{n} ids are missing from {start} on")
            yield part
            start, n = start + len(part), n - len(part)

    def close(self) -> None:
        self._batch = self.file = None
        self.source.close()


def _read(batches):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for r in batch.to_pylist():
            data = TokenFile(r["path"])
            system, base = open_folder(r["index_path"])
            with system.open_input_file(base) as f:
                index = pa.ipc.open_file(f)
                for k in range(index.num_record_batches):
                    places = index.get_batch(k)
                    crc = []
                    for start, n in zip(places.column(1).to_pylist(), places.column(2).to_pylist(), strict=True):
                        c = 0
                        for part in data.run(start, n):
                            c = zlib.crc32(part.astype("<u4").tobytes(), c)
                        crc.append(c)
                    starts = pa.array(places.column(1).to_numpy() + r["start"])
                    yield pa.RecordBatch.from_arrays([places.column(0), starts, places.column(2), pa.array(crc, pa.int64())], names)
            data.close()


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; a task reads a file or a few."""
    few = files.select("path", "index_path", "start")
    return few.repartition(max(1, few.count())).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files_report(docs: DataFrame, **options) -> DataFrame:
    """The documents of ``docs`` as written into token files and read back."""
    return read_token_files(write_token_files(docs, **options))
