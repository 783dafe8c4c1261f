"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass makes, per document, a digest of its word sequence, the size of its
   shingle set and a MinHash signature. Documents with the same word sequence
   form a class; from here on its smallest doc_id stands for it.
2. Signature bands deal representatives into buckets. Nothing emits all pairs of
   a bucket: each bucket gets a leader (the member that shares most with others,
   summed over its buckets). A member is first a candidate with one leader, the
   one that it shares most buckets with; its other leaders are candidates only
   where they are in another component after that.
3. Candidates are compared signature batch by signature batch. After each
   batch a pair goes if the posterior probability (uniform prior) that its
   similarity reaches the threshold is below ``miss``. Survivors are verified
   on their full shingle sets, by words and not by hashes.
4. Buckets whose members are then still in different components are finished:
   every member outside the bucket's largest component is held against all
   members, in blocks of signatures, with the same Bayesian test; survivors of
   different components are verified, the most alike first. So each candidate
   pair of a bucket is either verified, pruned by the posterior, or connected.

``rows`` x ``bands`` = 5 x 48 misses a pair at similarity 0.75 with probability
2.3e-6 and nearly none above; ``miss`` bounds the pruning likewise.

Edge cases: null and empty texts have no shingles and link with nothing; fewer
words than a shingle make one shingle; repeated rows fall in one class; rows
that share a doc_id but not the text are one node with several texts, and a
link of any of them counts; leaders that tie go by the smaller id; very long
texts and words are hashed in pieces of 1 MB, a verified pair is held whole;
extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_table, table_scope
from .graph import components
from .textcore import U64, exact_shingles, normal_words, shingle_set, text_bytes

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 5
HASHES = 480  # the bands use the first BANDS * ROWS of them
MISS = 1e-6
BATCHES = (32, 64, 128, 240, HASHES)
BLOCK = 256


@functools.cache
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240117)
    return (rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1),
            rng.integers(0, 1 << 32, HASHES, dtype=np.uint32))


def signature(shingles: np.ndarray) -> bytes:
    """16 bits of each of the smallest permuted values."""
    a, b = _family()
    x = (shingles >> U64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        v = np.multiply.outer(a, x[k:k + 512])
        v += b[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x2C1B3C6D)
    low ^= low >> np.uint32(13)
    return (low & np.uint32(0xFFFF)).astype("<u2").tobytes()


@functools.cache
def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Fewest matches in n hashes for which P(similarity >= threshold | matches) is still ``miss`` or more.

    With a uniform prior that posterior is P(Bin(n + 1, t) <= matches).
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that no batch prunes, and their matches."""
    at, done, found = np.arange(len(left)), 0, np.zeros(len(left), np.int64)
    for n in BATCHES:
        found[at] += (left[at, done:n] == right[at, done:n]).sum(axis=1)
        at = at[found[at] >= least_matches(n)]
        done = n
    return at, found[at]


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def _sign(batches):
    for batch in batches:
        key, size, sig = [], [], []
        for t in text_bytes(batch.column("text")):
            w = normal_words(t)
            s = shingle_set(w, SHINGLE)
            key.append(hashlib.blake2b(w, digest_size=16).digest())
            size.append(len(s))
            sig.append(signature(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "seq", "n", "sig"])


def _prune(batches):
    for batch in batches:
        if batch.num_rows:
            at, _ = survivors(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")))
            yield batch.select(["a", "b"]).take(pa.array(at))


def _verify(batches):
    """Keeps the pairs with 100 * intersection >= PERCENT * union, counted on the words themselves."""
    for batch in batches:
        keep = []
        for k, pair in enumerate(zip(text_bytes(batch.column("text_a")), text_bytes(batch.column("text_b")), strict=True)):
            x, y = exact_shingles([normal_words(t) for t in pair], SHINGLE)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common and 100 * common >= PERCENT * (len(x) + len(y) - common):
                keep.append(k)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _block_pairs(batches):
    """Each row: one member against a block of its bucket. Emits the pairs that survive the Bayesian test."""
    for batch in batches:
        a, b, matches, comp_a, comp_b = [], [], [], [], []
        for r in batch.to_pylist():
            # two members that are both held against the bucket meet once
            block = [m for m in r["block"] if m["comp"] != r["comp"] and (m["comp"] == r["main"] or m["id"] > r["id"])
                     and 100 * min(m["n"], r["n"]) >= PERCENT * max(m["n"], r["n"])]
            if not block:
                continue
            sigs = np.frombuffer(b"".join(m["sig"] for m in block), "<u2").reshape(-1, HASHES)
            own = np.broadcast_to(np.frombuffer(r["sig"], "<u2"), sigs.shape)
            at, found = survivors(own, sigs)
            # a pair that shares several bands counts in the first one only
            same = (own[at, :BANDS * ROWS] == sigs[at, :BANDS * ROWS]).reshape(len(at), BANDS, ROWS).all(axis=2)
            for k, n, first in zip(at, found, same.argmax(axis=1), strict=True):
                if first == r["band"]:
                    a.append(r["id"])
                    b.append(block[k]["id"])
                    matches.append(int(n))
                    comp_a.append(r["comp"])
                    comp_b.append(block[k]["comp"])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, matches, comp_a, comp_b)],
                                         ["a", "b", "matches", "comp_a", "comp_b"])


def _sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs with the given columns of both partners."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return pairs


def _ordered(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _unpruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sizes and the Bayesian test on their signatures leave."""
    return shared_table(_sides(pairs, reps, "sig", "n")
                        .filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
                        .mapInArrow(_prune, "a long, b long"), "star-candidates")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return shared_table(_sides(pairs, texts, "text").mapInArrow(_verify, "a long, b long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    with table_scope(docs.sparkSession):
        signed, named = _named(docs.select(F.col("doc_id").cast("long"), "text"))
    return (signed.join(named, "seq", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.expr("doc_id <=> component_id")))


def _named(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, seq, n of every row; and the component of every class (seq)."""
    sketched = shared_table(ids.mapInArrow(_sign, "doc_id long, seq binary, n long, sig binary"), "signatures")
    signed = shared_table(sketched.select("doc_id", "seq", "n"), "shingle-counts", keep=True)
    classes = shared_table(signed.filter("n > 0").groupBy("seq").agg(F.min("doc_id").alias("rep")).filter("rep is not null"),
                           "classes")
    reps = shared_table(sketched.join(classes, (sketched.seq == classes.seq) & (sketched.doc_id == classes.rep), "left_semi")
                        .select("doc_id", "n", "sig").distinct(), "representatives")

    # buckets with more than one member; counts and leaders are written before they are joined
    # back, so that Spark deals both sides of the join anew and can split a hot bucket
    bands = reps.select(F.col("doc_id").alias("id"), F.posexplode(F.expr(
        f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sig, {2 * ROWS} * i + 1, {2 * ROWS})))"))
        .alias("band", "key"))
    shared = shared_table(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "bucket-sizes")
    members = shared_table(bands.join(shared, "key"), "buckets")
    central = members.groupBy("id").agg(F.sum(F.log("size")).alias("shares"))
    leaders = shared_table(members.join(central, "id").groupBy("key")
                           .agg(F.max_by(-F.col("id"), F.struct("shares", -F.col("id"))).alias("neg"))
                           .select("key", (-F.col("neg")).alias("leader")), "leaders")
    stars = shared_table(members.join(leaders, "key").filter("id <> leader")
                         .groupBy("id", "leader").agg(F.count("*").alias("common")), "stars")
    texts = shared_table(ids.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), "texts")
    one = stars.groupBy("id").agg((-F.max_by(-F.col("leader"), F.struct("common", -F.col("leader")))).alias("leader"))
    links = _verified(_unpruned(_ordered(one), reps), texts)
    comps = components(links)
    apart = stars.select("id", "leader")
    for side in ("id", "leader"):
        apart = (apart.join(comps.select(F.col("id").alias(side), F.col("comp").alias(f"comp_{side}")), side, "left")
                 .withColumn(f"comp_{side}", F.coalesce(f"comp_{side}", side)))
    tried = one.select("id", "leader")
    others = apart.filter("comp_id <> comp_leader").select("id", "leader").join(tried, ["id", "leader"], "left_anti")
    links = links.union(_verified(_unpruned(_ordered(others), reps), texts))
    comps = components(links)

    # what the stars leave open: members outside their bucket's largest component, against all of the bucket
    placed = (members.filter("size > 2").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    split = shared_table(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
                         .filter("low <> high").select("key"), "open-keys")
    placed = shared_table(placed.join(split, "key"), "open-buckets")
    if not placed.isEmpty():
        rest = shared_table(_block_candidates(placed, reps), "block-candidates")
        best = rest.withColumn("place", F.expr("row_number() over (partition by a, comp_b order by matches desc, b)"))
        links = links.union(_verified(best.filter("place <= 3").select("a", "b"), texts))
        comps = components(links)
        # a component is named by a member, so its name has the component that it is part of now
        left = best.filter("place > 3")
        for side in "ab":
            left = left.join(comps.select(F.col("id").alias(f"comp_{side}"), F.col("comp").alias(f"now_{side}")), f"comp_{side}", "left")
        left = left.filter("coalesce(now_a, comp_a) <> coalesce(now_b, comp_b)").select("a", "b")
        more = _verified(left, texts)
        if not more.isEmpty():
            comps = components(links.union(more))
    return signed, shared_table(classes.join(comps, classes.rep == comps.id, "left")
                                .select("seq", F.coalesce("comp", "rep").alias("component")), "class-components", keep=True)


def _block_candidates(placed: DataFrame, reps: DataFrame) -> DataFrame:
    """a, b, matches, comp_a, comp_b of surviving pairs across components; ``placed``: id, key, band, size, comp."""
    sized = placed.groupBy("key", "comp").agg(F.count("*").alias("c"))
    largest = shared_table(sized.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main")), "main-parts")
    rows = placed.join(reps.select(F.col("doc_id").alias("id"), "n", "sig"), "id")
    blocks = (rows.withColumn("part", F.expr(f"pmod(xxhash64(id), cast(ceil(size / {BLOCK}) as int))"))
              .groupBy("key", "part").agg(F.collect_list(F.struct("id", "comp", "n", "sig")).alias("block"))
              .select("key", "block"))
    queries = shared_table(rows.join(largest, "key").filter("comp <> main")
                           .select("key", "id", "band", "comp", "main", "n", "sig"), "open-members")
    return queries.join(blocks, "key").mapInArrow(
        _block_pairs, "a long, b long, matches long, comp_a long, comp_b long")
