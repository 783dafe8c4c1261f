"""Personal data: base spans against plain patterns, disclosure against plain counts."""

import hashlib
import math
import random
import re

from townrisk.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_spans_equal_the_patterns():
    rng = random.Random(8)
    for letters in ("a@.b_ ", "1.20 5", "41 -7é", "+1 (2).3-", "a1@.+- "):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
            assert P.base_spans(t) == plain(t), t
    t = "mail a.b@c.d_x@e.f, 4111 1111 1111 1111, 10.0.0.256 1.2.3.4.5.6.7.8 +49 (30) 1234-567"
    assert P.base_spans(t) == plain(t) and len(plain(t)) >= 4


def test_long_texts_are_linear():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000 + ".", "+1" * 100_000, "9" * 200_000 + "..1"):
        P.base_spans(t)


def rows_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_report_and_edges(spark):
    t = "write to Ann.B@x.org or 10.1.2.3 é 4111111111111111 now +1 202 555 0123"
    rows = [(1, t), (2, None), (3, ""), (1, t), (None, "a@b.c"), (5, "z" * 2_000 + " q@r.st")]
    got = P.personal_report(rows_of(spark, [(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, tag int")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x for d, x in rows if d == r.doc_id) or ""
        base = ",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in plain(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in plain(text)) for j in range(4)]
        assert r.spans == base  # support of three documents isn't reached
    assert P.personal_report(rows_of(spark, [])).collect() == []


def test_disclosing_terms(spark):
    """'falcon' occurs with one address only, 'harbour' mostly, 'about' everywhere."""
    rows = [(d, f"about falcon harbour boss@corp.example about w{d}") for d in range(6)]
    rows += [(100 + d, "harbour about lights") for d in range(1)]
    rows += [(200 + d, f"about nothing number{d} here") for d in range(200)]
    docs = rows_of(spark, rows)
    found = {r.doc_id: r for r in P.find_personal(docs).collect()}
    assert all(found[200 + d].spans == [] for d in range(200)) and found[100].spans == []
    n = len(rows)
    ratio = {"falcon": 1.0, "harbour": math.log2(n * 6 / (6 * 7)) / -math.log2(6 / n)}
    for d in range(6):
        text = dict(rows)[d]
        terms = {text[s.start:s.end]: s.ratio for s in found[d].spans if s.kind == 4}
        assert set(terms) == set(ratio) and all(abs(terms[k] - v) < 1e-9 for k, v in ratio.items())
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert clean[0] == "about  [TERM] [EMAIL] about w0" and clean[200] == dict(rows)[200] and len(clean) == n


def test_unique_values_disclose(spark):
    """Values that occur once: the term beside one, and the term beside all of a domain, are scored."""
    rows = [(d, f"about falcon person{d}@corp.example about harbour") for d in range(20)]
    rows += [(50, "about heron lone@other.example about harbour")]
    rows += [(200 + d, "about harbour nothing here") for d in range(300)]
    docs = rows_of(spark, rows)
    found = {r.doc_id: r for r in P.find_personal(docs).collect()}
    for d in [*range(20), 50]:
        text = dict(rows)[d]
        got = {text[s.start:s.end]: s.ratio for s in found[d].spans if s.kind == 4}
        assert got == {"heron" if d == 50 else "falcon": 1.0}
    # by its own address alone 'falcon' has a ratio of log(321 / 20) / log(321) < GENERALISE
    assert P.protected(0, "A@B.c") == ("email:a@b.c", "domain:b.c") and P.protected(1, "10.1.2.3")[1] == "network:10.1.2"
    assert P.protected(2, "4111 1111 1111 1111")[1] == "issuer:411111" and P.protected(3, "+1 202 555 0123")[1] == "prefix:1202"


def test_terms_far_from_the_entity(spark):
    """A disclosing term is marked throughout the documents with its entity, a removed one in all documents."""
    far = " about nothing" * 20
    rows = [(d, f"falcon harbour boss@corp.example about{far} Harbour falcon") for d in range(20)]
    rows += [(50, f"falcon{far}"), (51, f"harbour{far}"), (52, f"harbour{far}")]
    rows += [(None, f"x@corp.example{far} harbour"), (None, f"x@corp.example{far} harbour")]
    rows += [(200 + d, far) for d in range(1000)]
    found = sorted(((r.doc_id, r.spans) for r in P.find_personal(rows_of(spark, rows)).collect()), key=str)
    assert len(found) == len(rows)
    for d, spans in found:
        text = dict(rows)[d]
        got = [text[s.start:s.end] for s in spans if s.kind == 4]
        want = ["falcon", "harbour", "Harbour", "falcon"] if d in range(20) else {50: ["falcon"], None: ["harbour"]}.get(d, [])
        assert got == want, d


def test_filter_holds_terms_back_but_none_that_tell(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß語", k=6)) for _ in range(6000)})
    told = words[::10]
    bits = P.term_filter(spark.createDataFrame([(w,) for w in told], "term string"))
    docs = spark.createDataFrame([(1, 7, " ".join(words)), (2, 8, "")], "doc_id long, tag long, text string")
    got = [r.term for r in docs.mapInArrow(P._places(bits), "doc_id long, tag long, term string, places array<int>").collect()]
    assert set(told) <= set(got) and len(got) == len(set(got)) < 0.25 * len(words)
    none = P.term_filter(spark.createDataFrame([], "term string"))
    assert docs.mapInArrow(P._places(none), "doc_id long, tag long, term string, places array<int>").isEmpty()


def test_only_terms_beside_values_are_counted(spark, monkeypatch):
    """The words of documents without values stay in their tasks, and the counts of the others are whole."""
    written = {}

    def table(df, name, **options):
        written[name] = df.cache()
        return written[name]

    monkeypatch.setattr(P, "shared_table", table)
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(5000)})
    rows = [(d, f"falcon harbour boss@corp.example about w{d}") for d in range(6)] + [(100 + d, "harbour About") for d in range(30)]
    rows += [(200 + d, " ".join(words[d * 100:d * 100 + 100])) for d in range(50)]
    found = {r.doc_id: [s.kind for s in r.spans] for r in P.find_personal(rows_of(spark, rows)).collect()}
    counts = {r.term: r.n_t for r in written["term-counts"].collect()}
    assert {t: counts.get(t) for t in ("falcon", "harbour", "about")} == {"falcon": 6, "harbour": 36, "about": 36}
    assert len(counts) < 100 and set(written) == {"personal-scan", "term-counts", "disclosures"}
    assert all(found[d] == ([4, 0] if d < 6 else []) for d, _ in rows)
