"""Secret scan: candidates by shape, false positives removed by a random forest.

A candidate is a run of key characters with a digit or two capitals in a row, of ``SHORTEST`` or more
characters (runs joined by single dots are one), or the whole value assigned to a
credential word, quoted or up to a blank, of any length and form. Its features: length, character classes and their transitions, how
likely its letter pairs are in the corpus, how much of it corpus words cover,
path signs, and the words beside it. The forest (Spark MLlib) is trained on
labelled findings: a table given by the caller, else the labels of
``weak_label`` for findings whose format or context decides the matter. At most
``TRAIN_ROWS`` labelled findings are used, half of them of each label (all, where a
label has fewer), chosen by a hash of their text and weighted so that the labels
keep their shares; word and letter-pair counts cover the whole corpus.

Without findings of both labels there is nothing to learn, and the share of
secrets among the labelled findings is every finding's score.

Edge cases: a null text counts as empty and has no findings; repeated rows have
equal findings; other columns are ignored; an empty table gives an empty
result; scanning is linear in the text.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table
from .common import split_by_ids

SHORTEST = 12
TRAIN_ROWS = 20_000
LEAST = 1e-6  # share of all corpus words from which on a word is in the dictionary
TREES, DEPTH, SEED = 40, 6, 7
CUTOFF = 0.5

_KEY = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
_SEED = re.compile("[0-9]|[A-Z]{2}")
_WORD = re.compile(r"[^\W\d_]{3,}")
_NEAR = re.compile(r"[^\W\d_]+")
#: Words that announce a credential, and formats that issuers document.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "credential", "auth", "bearer")
LONGEST_WORD = max(map(len, CREDENTIAL_WORDS))
ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
                    r"|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+")
_ASSIGN = re.compile("(?:" + "|".join(CREDENTIAL_WORDS) + r")[\"'`]?[ \t]*(?::=|=>|[:=])[ \t]*", re.IGNORECASE)
_QUOTED = {q: re.compile(f"{q}[^{q}\\n]*{q}") for q in "\"'`"}
_TOKEN = re.compile(r"\S+")
_OPENERS = {")": "(", "]": "[", "}": "{", ">": "<"}
FEATURES = ("length", "digits", "upper", "lower", "hex", "entropy", "transitions", "pairs", "slashes", "dashes",
            "before_path", "after_path", "assigned", "credential_word", "quoted", "coverage", "neighbours")


def assigned_values(text: str) -> list[tuple[int, int]]:
    """Values assigned to credential words: between quotes, or up to a blank without the punctuation that closes them."""
    out, at = [], 0
    while m := _ASSIGN.search(text, at):
        start = at = m.end()
        quote = text[start:start + 1]
        if whole := quote in _QUOTED and _QUOTED[quote].match(text, start):
            start, end = start + 1, whole.end() - 1
        else:
            start += quote in _QUOTED
            token = _TOKEN.match(text, start)
            end = token.end() if token else start
            extra = {c: text.count(c, start, end) - text.count(o, start, end) for c, o in _OPENERS.items()}
            while end > start and (text[end - 1] in ",;.\"'`" or extra.get(text[end - 1], 0) > 0):
                end -= 1
                extra[text[end]] = extra.get(text[end], 0) - 1
        if text[start:start + 1] not in (":", "=") and any(c.isalnum() for c in text[start:end]):
            out.append((start, end))
            at = end
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Assigned values, and runs of key characters that hold a digit or two capitals; each character is looked at a bounded number of times."""
    runs, free = [], 0
    for m in _SEED.finditer(text):
        at = m.start()
        if at < free:
            continue
        start = at
        while start > free and (text[start - 1] in _KEY_CHARS or text[start - 1] == "." and start - 1 > free and text[start - 2] in _KEY_CHARS):
            start -= 1
        end = _KEY.match(text, at).end()
        free = end
        if end - start < SHORTEST:
            continue
        parts = text[start:end].split(".")
        if len(parts) > 1 and any(ISSUED.fullmatch(p) for p in parts):  # a key at the end of a sentence that goes on without a blank
            for p in parts:
                if len(p) >= SHORTEST and _SEED.search(p):
                    runs.append((start, start + len(p)))
                start += len(p) + 1
        else:
            runs.append((start, end))
    values, out, k = assigned_values(text), [], 0
    for start, end in runs:
        while k < len(values) and values[k][1] <= start:
            out.append(values[k])
            k += 1
        if k == len(values) or end <= values[k][0]:
            out.append((start, end))
    return out + values[k:]


def credential_before(text: str, start: int) -> tuple[bool, bool]:
    """(an assignment sign stands before the candidate, the word before it announces a credential)."""
    at = start
    while at and text[at - 1] in " \t\"'`":
        at -= 1
    assigned = text[max(0, at - 1):at] in ("=", ":") or text[max(0, at - 2):at] == "=>"
    while at and text[at - 1] in " \t\"'`=:>":
        at -= 1
    return assigned, text[max(0, at - LONGEST_WORD):at].lower().endswith(CREDENTIAL_WORDS)


def weak_label(text: str, start: int, end: int) -> int | None:
    """1 for issued formats and values assigned to a credential word; 0 for what is surely something else."""
    value = text[start:end]
    assigned, said = credential_before(text, start)
    if ISSUED.fullmatch(value):
        return 1
    if assigned and said:
        at = start
        while at and text[at - 1] in " \t":
            at -= 1
        left = text[max(0, at - 1):at]
        sure = len(value) >= SHORTEST and _SEED.search(value) or any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        return 1 if sure or left in ("=", '"', "'", "`") and not value.isdigit() else None
    if "." in value and not any(len(p) >= SHORTEST and _SEED.search(p) for p in value.split(".")):  # hosts, versions, file names
        return 0
    if value.isdigit() or "/" in value or text[max(0, start - 1):start] in ("/", "@", ".") or text[end:end + 1] == "@":
        return 0
    return None


def word_places(text: str) -> tuple[array, array]:
    """Where the words of a text start and end."""
    starts, ends = array("q"), array("q")
    for m in _NEAR.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def features(text: str, start: int, end: int, pairs: np.ndarray, places: tuple[array, array]) -> tuple[list[float], list[str], list[str]]:
    """The features that need no dictionary; the words in the candidate and those beside it."""
    v = text[start:end]
    n = len(v)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in v]
    low = v.lower()
    counts = Counter(v)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) - 97
    letters = np.where((codes >= 0) & (codes < 26), codes, 26)
    likely = float(np.bincount(letters[:-1] * 27 + letters[1:], minlength=729) @ pairs.ravel() / (len(letters) - 1)) if n > 1 else 0.0
    assigned, said = credential_before(text, start)
    starts, ends = places
    before, after = bisect_right(ends, start), bisect_left(starts, end)
    left = [text[starts[k]:ends[k]].lower() for k in range(max(0, before - 3), before)]
    right = [text[starts[k]:ends[k]].lower() for k in range(after, min(len(starts), after + 3))]
    return ([float(n), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n,
            float(all(c in "0123456789abcdef" for c in low)),
            -sum(c / n * math.log2(c / n) for c in counts.values()),
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, likely,
            float(v.count("/")), float(v.count("-") + v.count("_")),
            float(text[max(0, start - 1):start] in ("/", ".", "@")), float(text[end:end + 1] in ("/", "@", ".") and text[end + 1:end + 2].isalnum()),
            float(assigned), float(said),
            float(text[max(0, start - 1):start] in ("'", '"', "`") and start > 0)], _WORD.findall(low), left + right)


def _word_counts(batches):
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text").to_pylist():
            at = 0
            for s, e in candidates(text):  # what a candidate is made of doesn't speak for itself
                counts.update(_WORD.findall(text[at:s].lower()))
                at = e
            counts.update(_WORD.findall(text[at:].lower()))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


def corpus_model(docs: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """Log probability of each letter given the one before (27 x 27), and the words (word) with a share of LEAST or more.

    Counts run over the whole corpus, candidates left out; the driver gets 27 x 27 sums. No
    more than 1 / LEAST words can have that share, whatever the size of the corpus.
    """
    counts = shared_table(docs.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    letter = "abcdefghijklmnopqrstuvwxyz"
    steps = (counts.select("n", F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("pair"))
             .filter("pair rlike '^[a-z]{2}$'").groupBy("pair").agg(F.sum("n").alias("n")).collect())
    table = np.ones((27, 27))
    for r in steps:
        table[letter.index(r.pair[0]), letter.index(r.pair[1])] += r.n
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.log(table / table.sum(axis=1, keepdims=True)), counts.filter(F.col("n") >= LEAST * total).select("word")


def _find(pairs: np.ndarray):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float64())),
                               ("inside", pa.list_(pa.string())), ("beside", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                found = candidates(t)
                places = word_places(t) if found else None
                out.append([dict(zip(("start", "end", "label", "x", "inside", "beside"),
                                     (s, e, weak_label(t, s, e), *features(t, s, e, pairs, places)), strict=True)) for s, e in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(out, kind)], ["doc_id", "tag", "found"])

    return run


def with_dictionary(each: DataFrame, known: DataFrame) -> DataFrame:
    """``each`` with coverage and neighbours added to x, from a join of the words in and beside the candidates."""
    uses = each.select("row", "start", F.explode(F.expr(
        "concat(transform(inside, w -> struct(w as word, length(w) as covered, 0 as near)), "
        "transform(beside, w -> struct(w as word, 0 as covered, 1 as near)))")).alias("u")).select("row", "start", "u.*")
    # at most 1 / LEAST words: broadcast, so that no word's uses meet in one task
    hits = uses.join(F.broadcast(known), "word").groupBy("row", "start").agg(F.sum("covered").alias("covered"), F.sum("near").alias("near"))
    # a value that is one word of the corpus is taken for prose ("the key: patience")
    word = "size(inside) = 1 and coalesce(covered, 0) >= `end` - start"
    return each.join(hits, ["row", "start"], "left").withColumn("label", F.expr(f"if({word}, 0, label)")).withColumn("x", F.expr(
        "concat(x, array(coalesce(covered, 0) / (`end` - start), if(size(beside) = 0, 0D, coalesce(near, 0) / size(beside))))"))


def scored(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """``found`` with a score; ``labelled`` has label and x."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # copies of a finding are one row with their number as weight, so a hot document can't fill the sample
    each = shared_table(labelled.filter("label in (0, 1)").groupBy("label", "doc_id", "start", "x").agg(F.count("*").alias("n")), "labelled-findings")
    counts = {r.label: r for r in each.groupBy("label").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).collect()}
    # bounded per label, chosen by content; the hash of a finding doesn't depend on where it is stored
    share = [min(1.0, TRAIN_ROWS / 2 / counts[k].rows) if k in counts else 0.0 for k in (0, 1)]
    sample = shared_table(each.filter(F.expr(
        f"xxhash64(x, doc_id, start) / 18446744073709551616D + 0.5D < case label when 1 then {share[1]!r}D else {share[0]!r}D end")), "sample")
    taken = {r.label: r.n for r in sample.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not taken.get(0) or not taken.get(1):
        total = sum(r["all"] for r in counts.values())
        return found.withColumn("score", F.lit((counts[1]["all"] if 1 in counts else 0) / max(1, total)))
    # weights give the labels the shares that they have among all findings
    scale = [counts[k]["all"] / taken[k] for k in (0, 1)]
    rows = sample.select(F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"),
                         F.expr(f"n * case label when 1 then {scale[1]!r}D else {scale[0]!r}D end").alias("weight"))
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, weightCol="weight").fit(rows.coalesce(4))
    return (model.transform(found.withColumn("features", array_to_vector("x")))
            .withColumn("score", F.round(vector_to_array("probability")[1], 9)).drop("features", "rawPrediction", "probability", "prediction"))


def scan(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, tag, n_candidates, findings (array of start, end, score with a score of CUTOFF or more): a row per input row.

    ``labels``: doc_id, start, end, is_secret of reviewed findings; without it the weak labels are used.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64("text")).select("doc_id", "tag", "text")
    pairs, known = corpus_model(docs)
    rows = shared_table(docs.mapInArrow(
        _find(pairs), "doc_id long, tag long, found array<struct<start:int,end:int,label:int,x:array<double>,"
                               "inside:array<string>,beside:array<string>>>")
        .withColumn("row", F.monotonically_increasing_id()), "findings")
    each = rows.select("row", "doc_id", F.explode("found").alias("f")).select("row", "doc_id", "f.*")
    each = shared_table(with_dictionary(each, known).select("row", "doc_id", "start", "end", "label", "x"), "candidates")
    if labels is None:
        labelled = each.filter("label is not null")
    else:
        labelled = each.drop("label").join(labels.select("doc_id", "start", "end", F.col("is_secret").cast("int").alias("label")),
                                           ["doc_id", "start", "end"])
    hits = (scored(each, labelled).filter(F.col("score") >= CUTOFF).groupBy("row")
            .agg(F.sort_array(F.collect_list(F.struct("start", "end", "score"))).alias("findings")))
    none = "cast(array() as array<struct<start:int,end:int,score:double>>)"
    return rows.join(hits, "row", "left").select("doc_id", "tag", F.expr("cast(size(found) as bigint)").alias("n_candidates"),
                                                 F.expr(f"coalesce(findings, {none})").alias("findings"))


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_candidates, n_secrets, secrets (start:end, comma-joined), max_score: a row per input row."""
    return scan(docs).select(
        "doc_id", "n_candidates", F.expr("cast(size(findings) as bigint)").alias("n_secrets"),
        F.expr("array_join(transform(findings, f -> concat(f.start, ':', f.end)), ',')").alias("secrets"),
        F.expr("array_max(transform(findings, f -> f.score))").alias("max_score"))


def _redact(batches):
    for batch in batches:
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("findings").to_pylist(), strict=True):
            parts, at = [], 0
            for f in found or ():
                parts += [text[at:f["start"]], "[SECRET]"]
                at = f["end"]
            out.append("".join(parts) + text[at:] if found else text)
        yield batch.select([n for n in batch.schema.names if n not in ("text", "findings")]).append_column("text", pa.array(out, pa.string()))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by [SECRET]; a null text stays null, other columns stay as they are."""
    names = docs.columns
    found = shared_table(scan(docs.select("doc_id", "text")).filter("size(findings) > 0").dropDuplicates(["doc_id", "tag"])
                         .select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), "findings"), "found")
    # rows that surely have no finding stay where they are
    sure, rest = split_by_ids(docs, "doc_id", found.select("_doc").distinct())
    rows = rest.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_tag")), "left")
    joined = joined.select(*names, "findings")
    others = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return sure.select(*names).unionByName(joined.mapInArrow(_redact, f"{others}, text string").select(*names))
