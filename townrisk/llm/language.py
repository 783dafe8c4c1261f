"""Language identification: the family first, then linear support vector machines within it.

Texts become frequencies of hashed letter pairs and triples. One-versus-one
linear SVMs (squared hinge loss) tell the families apart, and inside the chosen
family one-versus-one SVMs tell its languages apart; in both steps the votes
decide, then the summed margins. Languages are those of the training rows;
families are the fixed table below, and a code outside it is a family of its own.

The machines are fitted on a bounded sample: about ``PER_LANGUAGE`` rows of a
language and ``TRAIN_ROWS`` in all, chosen by a hash of doc_id, whole texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; with
a single learned language every text with letters gets it; without training
rows every text is ``und``; rows with a null doc_id aren't held out nor learned
from; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import grouped

#: Families of common language codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indo-aryan": ("hi", "ur", "bn", "mr", "pa", "gu", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
    "sinitic": ("zh", "yue", "wuu"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
DIM = 4096
PER_LANGUAGE, TRAIN_ROWS = 400, 4000
_LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    """Letters and bytes of longer characters stay; all else becomes a blank."""
    table = np.full(256, 32, np.uint8)
    keep = [*range(97, 123), *range(128, 256)]
    table[keep] = keep
    return table


def vectors(texts: list[str]) -> np.ndarray:
    """Rows of square roots of frequencies of hashed byte pairs and triples (so each has length 1, or 0)."""
    table, out = _byte_classes(), np.zeros((len(texts), DIM), np.float32)
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    for lo, hi in grouped(raw):
        b = table[np.frombuffer(b"  ".join(raw[lo:hi]) + b"    ", np.uint8)].astype(np.uint32)
        ends = np.cumsum([len(t) + 2 for t in raw[lo:hi]])
        doc = np.repeat(np.arange(hi - lo), np.diff(ends, prepend=0))
        n = len(doc)
        pair = b[:n] * np.uint32(257) + b[1:n + 1]
        counts = np.zeros((hi - lo) * DIM, np.int64)
        second = b[1:n + 1] != 32
        second[ends - 1] = False  # that byte is the next text's
        for gram, use in ((pair * np.uint32(2654435761), (b[:n] != 32) | second),
                          ((pair * np.uint32(65599) + b[2:n + 2]) * np.uint32(2246822519), second)):
            at = doc * DIM + (gram >> np.uint32(20)).astype(np.int64)
            counts += np.bincount(at[use], minlength=len(counts))
        counts = counts.reshape(hi - lo, DIM)
        out[lo:hi] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, steps: int = 150, cost: float = 50.0) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss; y is -1 or 1. Accelerated full gradients."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    rate = np.float32(1 / (1 + 4 * cost))
    w = np.zeros(x.shape[1], np.float32)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        grad = ahead - 2 * cost * ((weight * slack * y) @ x)
        new = ahead - rate * grad
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + np.float32((t - 1) / t_new) * (new - w), new, t_new
    return w


class OneVersusOne:
    """A machine for each two classes; the votes decide, then the summed margins."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.classes = sorted(set(labels.tolist()))
        self.pairs = [(i, j) for i in range(len(self.classes)) for j in range(i + 1, len(self.classes))]
        self.weights = np.zeros((DIM + 1, len(self.pairs)), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            use = (labels == self.classes[i]) | (labels == self.classes[j])
            self.weights[:, k] = linear_svm(x[use], np.where(labels[use] == self.classes[i], 1, -1).astype(np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and the winner's smallest probability against another class."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes, sums, least = (np.zeros((len(x), n)) for _ in range(3))
        least[:] = np.inf
        for k, (i, j) in enumerate(self.pairs):
            for c, m in ((i, margins[:, k]), (j, -margins[:, k])):
                votes[:, c] += m > 0
                sums[:, c] += np.clip(m, -4, 4)
                least[:, c] = np.minimum(least[:, c], m)
        best = np.argmax(votes + sums / (8 * n + 1), axis=1)
        return best, 1 / (1 + np.exp(-2 * least[np.arange(len(x)), best]))


class Hierarchy:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([_FAMILY.get(c, "=" + c) for c in langs.tolist()], dtype=object)
        self.top = OneVersusOne(x, family)
        self.inner = [OneVersusOne(x[family == f], langs[family == f]) for f in self.top.classes]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.top.predict(x)
        lang = np.empty(len(x), dtype=object)
        for k, machine in enumerate(self.inner):
            rows = np.flatnonzero(family == k)
            if len(rows):
                inner, s = machine.predict(x[rows])
                lang[rows] = [machine.classes[c] for c in inner.tolist()]
                score[rows] = score[rows] * s
        return lang.tolist(), score


def _training_vectors(batches):
    for batch in batches:
        x = vectors([t or "" for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["lang", "x"])


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, most: int = TRAIN_ROWS) -> Hierarchy | None:
    """Fits on ``rows`` (doc_id, text, lang); None without any."""
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(2, min(per_language, most // len(counts)))
    chance = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < chance[F.col("lang")] * 1_000_000)
    # bounded above: ``most`` vectors of DIM floats
    got = picked.select("lang", "text").mapInArrow(_training_vectors, "lang string, x binary").collect()
    if not got:
        got = rows.select("lang", "text").limit(each).mapInArrow(_training_vectors, "lang string, x binary").collect()
    got = sorted(got, key=lambda r: (r.lang, bytes(r.x)))
    return Hierarchy(np.stack([np.frombuffer(r.x, "<f4") for r in got]), np.array([r.lang for r in got], dtype=object))


def has_letter(text: str) -> bool:
    """A character of the Unicode letter categories; number letters aren't."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def _predict(model: Hierarchy | None):
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            speaks = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
            for at in range(0, len(speaks), 512):
                rows = speaks[at:at + 512]
                found, s = model.predict(vectors([texts[k] for k in rows]))
                for k, name in zip(rows, found, strict=True):
                    lang[k] = name
                score[rows] = s
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row.

    Learns from rows with a language whose crc32(doc_id) modulo ``folds`` isn't ``fold``.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    model = fit(docs.filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
                .select("doc_id", "lang", "text"))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        _predict(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
