"""Personal data: pattern spans, and terms that reveal them, found by corpus co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Their
values are the protected entities, and so are the classes they belong to (mail
domain, IP network, card issuer, phone prefix), whose documents add up where the
values themselves are unique. A term that stands within ``REACH`` words of
an entity discloses it as far as their pointwise mutual information goes:
PMI = log2(N n(e,t) / (n(e) n(t))) over document counts of the whole corpus,
against the entity's own information content IC = -log2(n(e) / N). Every pair is
scored; a term is generalised at PMI >= ``GENERALISE`` * IC and removed at
PMI >= ``REMOVE`` * IC (a PMI of IC means that the term occurs with the entity
only). Co-occurrence is counted near the entity, so a document gives a number of
pairs linear in its text; marking is not bound to that window: a generalised
term is marked throughout every document that holds the entity, a removed term,
which stands for the entity by itself, throughout all documents. A pair that independent words would show as often with a probability
above ``CHANCE`` (Chernoff bound) says nothing; of pairs with the PMI, that is
so in tables of a few dozen documents only. Counts are distributed aggregates; a
document's row holds only its own spans.

Edge cases: a null text counts as empty; repeated rows count as documents of
their own; rows with a null doc_id are kept; other columns are ignored; an
empty table gives an empty result; all scans are linear in the text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table

KINDS = ("email", "ip", "card", "phone", "term")
REACH, CHANCE = 5, 0.05
GENERALISE, REMOVE = 0.8, 0.97
PACK = 20_000  # terms after which a batch of them leaves the worker
MOST_BITS = 28   # a filter of terms has at most 2^28 bits

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")  # takes whole chains, so no digit is scanned twice
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: around each @, a local part back to the last match, then a domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1  # no later match can reach over this @
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """A chain of dotted numbers holds one match for each four of its parts."""
    out = []
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if "." in text:
        out += [(s, 1, e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(kind: int, value: str) -> str:
    """A value in a form that doesn't depend on its spelling."""
    return f"{KINDS[kind]}:" + (value.lower() if kind < 2 else re.sub("[^0-9]", "", value))


def protected(kind: int, value: str) -> tuple[str, str]:
    """The entity and its class: mail domain, IP network (three parts), card issuer (six digits), phone prefix (all but seven digits)."""
    name = entity(kind, value)
    own = name.partition(":")[2]
    if kind == 0:
        return name, "domain:" + own.rpartition("@")[2]
    if kind == 1:
        return name, "network:" + own.rpartition(".")[0]
    return name, "issuer:" + own[:6] if kind == 2 else "prefix:" + own[:-7]


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words within REACH words of each span and outside all spans."""
    inside = bytearray(len(text)) if spans else b""
    for s, _, e in spans:
        inside[s:e] = b"\x01" * (e - s)
    out = []
    for s, kind, e in spans:
        names = protected(kind, text[s:e])
        width = 200
        while True:  # enough text for REACH words on either side, whatever their length
            left = list(_TERM.finditer(text, max(0, s - width), s))
            right = list(_TERM.finditer(text, e, e + width))
            if (len(left) > REACH or width > s) and (len(right) > REACH or e + width >= len(text)):
                break
            width *= 4
        # a word cut by the left edge of the window is never among the last REACH
        for m in left[-REACH:] + right[:REACH]:
            if not inside[m.start()]:
                out += [(name, m[0].lower(), m.start(), m.end()) for name in names]
    return out


_SCAN = ("doc_id long, tag long, spans array<struct<start:int,kind:int,end:int>>, held array<string>, "
         "near array<struct<entity:string,term:string,start:int,end:int>>")


def _scan(batches):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans, held, near = [], [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            held.append(sorted({name for s, k, e in found for name in protected(k, text[s:e])}))
            near.append([dict(zip(("entity", "term", "start", "end"), x, strict=True)) for x in near_terms(text, found)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), pa.array(spans, spans_type),
                                          pa.array(held, pa.list_(pa.string())), pa.array(near, near_type)],
                                         ["doc_id", "tag", "spans", "held", "near"])


def term_filter(terms: DataFrame) -> bytes:
    """Bits by the CRC-32 of each term, 16 or more a term: what no term has is surely none of them. At most 32 MB, whatever the terms."""
    size = min(MOST_BITS, max(15, (16 * terms.count()).bit_length()))
    place = F.expr(f"shiftrightunsigned(crc32(cast(term as binary)), {32 - size}) + 1")
    parts = terms.select(place.alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    out = bytearray(1 << size - 3)
    for r in parts.toLocalIterator():
        out[(r.part - 1) * len(r.bits):r.part * len(r.bits)] = r.bits
    return bytes(out)


def _passes(wanted: bytes):
    """Whether a term may be one of those that the filter was made of."""
    shift = 33 - (len(wanted) * 8).bit_length()

    def run(term: str) -> bool:
        h = zlib.crc32(term.encode()) >> shift
        return wanted[h >> 3] >> (h & 7) & 1 == 1

    return run


def _places(wanted: bytes):
    """doc_id, tag, term, places (start and end in turn): a row per document and term outside its spans, of those terms that pass the filter."""
    may_tell = _passes(wanted)

    def packed(docs, tags, terms, places):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int64()), pa.array(terms, pa.string()),
                                           pa.array(places, pa.list_(pa.int32()))], ["doc_id", "tag", "term", "places"])

    def run(batches):
        for batch in batches:
            docs, tags, terms, places = [], [], [], []
            for d, tag, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tag", "text")), strict=True):
                found = base_spans(text)
                inside = bytearray(len(text)) if found else b""
                for s, _, e in found:
                    inside[s:e] = b"\x01" * (e - s)
                at: dict[str, list[int]] = {}
                for m in _TERM.finditer(text):
                    if not (found and inside[m.start()]):
                        at.setdefault(m[0].lower(), []).extend(m.span())
                told = [t for t in at if may_tell(t)]
                docs += [d] * len(told)
                tags += [tag] * len(told)
                terms += told
                places += [at[t] for t in told]
                if len(terms) > PACK:
                    yield packed(docs, tags, terms, places)
                    docs, tags, terms, places = [], [], [], []
            yield packed(docs, tags, terms, places)

    return run


def marked_terms(docs: DataFrame, scanned: DataFrame, telling: DataFrame) -> DataFrame:
    """doc_id, tag, start, end, ratio of the disclosing terms, wherever in a text they stand."""
    # terms that surely tell nothing stay in their task; the join settles the rest
    placed = docs.mapInArrow(_places(term_filter(telling.select("term").distinct())), "doc_id long, tag long, term string, places array<int>")
    own = scanned.select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), F.explode("held").alias("_held")).distinct()
    hits = placed.join(telling, "term").join(own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))
                                             & (F.col("entity") == F.col("_held")), "left")
    each = hits.filter(f"ratio >= {REMOVE} or _held is not null").groupBy("doc_id", "tag", "term", "places").agg(F.max("ratio").alias("ratio"))
    return each.select("doc_id", "tag", "ratio", F.explode(F.expr(
        "transform(sequence(0, size(places) - 2, 2), i -> struct(places[i] as start, places[i + 1] as end))")).alias("p")).select(
        "doc_id", "tag", "p.start", "p.end", "ratio")


def _term_counts(wanted: bytes):
    """term, documents that hold it: a row per batch and term that passes the filter."""
    may_count = _passes(wanted)

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update(set(_TERM.findall(text.lower())))
            terms = [t for t in counts if may_count(t)]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[t] for t in terms], pa.int64())], ["term", "n"])

    return run


def disclosures(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """entity, term, ratio (PMI / IC) of the pairs that chance doesn't explain and with a ratio of GENERALISE or more."""
    each = scanned.select("doc_id", "tag", "row", F.explode("near").alias("p")).select("row", "p.entity", "p.term")
    pairs = each.distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    mentions = scanned.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    # terms that surely stand beside no value are left uncounted in their task; the join drops the rest of them
    wanted = term_filter(each.select("term").distinct())
    terms = docs.select("text").mapInArrow(_term_counts(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    n = docs.count()
    # lower-casing can change letters outside the pattern's view, so a count is never below the pair's own
    scored = pairs.join(mentions, "entity").join(shared_table(terms, "term-counts"), "term", "left").withColumn(
        "n_t", F.greatest(F.coalesce("n_t", "n_et"), "n_et"))
    ratio = f"case when n_e >= {n} then 0 else log2({n} * n_et / (n_e * n_t)) / -log2(n_e / {n}) end"
    # n_e documents hold the term at least n_et times by chance: exp(-n_e * divergence of n_et / n_e from n_t / n)
    rest = f"case when n_et < n_e then (n_e - n_et) * ln((n_e - n_et) / n_e / (1 - n_t / {n})) else 0 end"
    chance = f"case when n_et * {n}D <= n_e * n_t then 1 else exp(-(n_et * ln(n_et * {n}D / n_e / n_t) + {rest})) end"
    return (scored.withColumn("ratio", F.expr(ratio)).filter(f"ratio >= {GENERALISE}")
            .filter(f"{chance} <= {CHANCE}").select("entity", "term", "ratio"))


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, tag, spans (array of start, kind, end, ratio): a row per input row; term spans carry their ratio."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("tag", F.xxhash64("text")).select("doc_id", "tag", "text")
    scanned = shared_table(docs.mapInArrow(_scan, _SCAN).withColumn("row", F.monotonically_increasing_id()), "personal-scan")
    telling = shared_table(disclosures(scanned, docs), "disclosures")
    extra = (marked_terms(docs, scanned, telling).groupBy("doc_id", "tag")
             .agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "ratio")).alias("extra"))
             .withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"}))
    none = "cast(array() as array<struct<start:int,kind:int,end:int,ratio:double>>)"
    joined = scanned.join(extra, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left")
    return joined.select("doc_id", "tag", F.expr(
        "array_sort(concat(transform(spans, s -> struct(s.start as start, s.kind as kind, s.end as end, cast(null as double) as ratio)), "
        f"coalesce(extra, {none})))").alias("spans"))


def _sanitise(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            parts, at = [], 0
            for s in spans:
                if s["start"] < at:
                    at = max(at, s["end"])
                    continue
                gone = s["kind"] == 4 and s["ratio"] >= REMOVE
                parts += [text[at:s["start"]], "" if gone else f"[{KINDS[s['kind']].upper()}]"]
                at = s["end"]
            out.append("".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id and the text with entities and generalised terms replaced by their kind, removed terms taken out."""
    found = find_personal(docs).dropDuplicates(["doc_id", "tag"]).withColumnsRenamed({"doc_id": "_doc", "tag": "_tag"})
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    return (rows.join(found, rows.doc_id.eqNullSafe(found._doc) & (rows.tag == found._tag))
            .select("doc_id", "text", "spans").mapInArrow(_sanitise, "doc_id long, text string"))


def personal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row per input row."""
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    join = "array_join(transform({}, s -> concat({}[s.kind], ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind < 4)"
    return find_personal(docs).select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(4)],
        F.expr(f"sha2({join.format(base, kinds)}, 256)").alias("base_sha256"),
        F.expr(join.format("spans", kinds)).alias("spans"))
