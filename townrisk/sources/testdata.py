"""Deterministic mapping of the TPC-H-like test tables onto engine inputs.

The engine's real inputs (crime counts, population, depth grids, borings,
hazard polygons, area polygons) are not available as test data, so each
input is derived from one test table with plain column expressions.  All
derivations stay lazy; Catalyst prunes the columns and pushes filters into
the parquet scans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ts_ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


# --- areas and incidents ----------------------------------------------------

def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, ward, town, pop, zone: one row per customer.

    ``nation`` is a 25-row dimension; Spark broadcasts it by its own size
    estimate (a few hundred bytes), so customer is never shuffled for it.
    """
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(c.c_custkey.alias("key"), n.n_name.alias("ward"),
                    c.c_name.alias("town"),
                    F.greatest(c.c_acctbal, F.lit(0.0)).alias("pop"),
                    c.c_nationkey.cast("long").alias("zone")))


def SERIOUS() -> Column:
    return F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")


def DAILY() -> Column:
    return F.col("o_orderpriority") == "3-MEDIUM"


def VISITOR() -> Column:
    return F.col("o_orderpriority") == "5-LOW"


def incidents(spark: SparkSession, sf_dir: str, year: int | None = None) -> DataFrame:
    """Yearly counts per area: key, yr, serious, daily, visitor, total.

    A ``year`` becomes a date range that reaches the parquet scan.
    """
    o = table(spark, sf_dir, "orders")
    if year is not None:
        o = o.where((F.col("o_orderdate") >= ts_ntz(f"{year}-01-01 00:00:00"))
                    & (F.col("o_orderdate") < ts_ntz(f"{year + 1}-01-01 00:00:00")))
    return (o.groupBy(F.col("o_custkey").alias("key"),
                      F.year("o_orderdate").alias("yr"))
            .agg(F.count_if(SERIOUS()).cast("long").alias("serious"),
                 F.count_if(DAILY()).cast("long").alias("daily"),
                 F.count_if(VISITOR()).cast("long").alias("visitor"),
                 F.count(F.lit(1)).cast("long").alias("total")))


def incidents_two_years(spark: SparkSession, sf_dir: str,
                        cur: int = K.CURRENT_YEAR,
                        prev: int = K.PREVIOUS_YEAR) -> DataFrame:
    """Per-area counts of the current and the previous year in ONE pass.

    The date range is a plain predicate on ``o_orderdate`` so it reaches the
    parquet scan; the aggregation is a single hash aggregate keyed by the
    area (partial aggregation before the shuffle), and its output is hash
    partitioned on ``key`` so the following join to the areas reuses it.
    """
    o = (table(spark, sf_dir, "orders")
         .where((F.col("o_orderdate") >= ts_ntz(f"{prev}-01-01 00:00:00"))
                & (F.col("o_orderdate") < ts_ntz(f"{cur + 1}-01-01 00:00:00"))))
    is_cur = F.year("o_orderdate") == cur
    is_prev = F.year("o_orderdate") == prev
    return (o.groupBy(F.col("o_custkey").alias("key"))
            .agg(F.count_if(is_cur & SERIOUS()).cast("long").alias("serious_cur"),
                 F.count_if(is_prev & SERIOUS()).cast("long").alias("serious_prev"),
                 F.count_if(is_cur & DAILY()).cast("long").alias("daily_cur"),
                 F.count_if(is_cur & VISITOR()).cast("long").alias("visitor_cur"),
                 F.count_if(is_cur).cast("long").alias("total_cur"),
                 F.count_if(is_prev).cast("long").alias("total_prev")))


def incident_kinds(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """A year's crime table: key and one count column per kind, dealt from each priority by order key."""
    o = (table(spark, sf_dir, "orders")
         .where((F.col("o_orderdate") >= ts_ntz(f"{year}-01-01 00:00:00"))
                & (F.col("o_orderdate") < ts_ntz(f"{year + 1}-01-01 00:00:00"))))
    dealt = {"1-URGENT": K.VIOLENT, "2-HIGH": K.BURGLARY, "3-MEDIUM": K.DAILY_THEFTS,
             "5-LOW": (K.VISITOR_CRIMES[0], K.VISITOR_CRIMES[2])}
    counts = [F.count_if((F.col("o_orderpriority") == p) & (F.col("o_orderkey") % len(kinds) == i)).cast("long").alias(kind)
              for p, kinds in dealt.items() for i, kind in enumerate(kinds)]
    return (o.groupBy(F.col("o_custkey").alias("key"))
            .agg(*counts, F.count(F.lit(1)).cast("long").alias(K.CRIME_TOTAL)))


# --- points, borings, hazards ------------------------------------------------

def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth grid points: x, y, depth, elev, basin (no unique id exists)."""
    return points_from(table(spark, sf_dir, "lineitem"))


def points_from(l: DataFrame) -> DataFrame:
    """The point columns from any (batch or streaming) lineitem frame."""
    return l.select(
        ((l.l_orderkey * 7919 + l.l_linenumber * 104729) % 99991 / F.lit(1000.0)).alias("x"),
        ((l.l_orderkey * 15485863 + l.l_linenumber * 32452843) % 99989 / F.lit(1000.0)).alias("y"),
        F.round(l.l_discount * 10, 2).alias("depth"),
        (l.l_quantity - 25).alias("elev"),
        F.concat(l.l_returnflag, l.l_linestatus).alias("basin"))


def borings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse classified points: pid, x, y, cls."""
    p = table(spark, sf_dir, "part")
    return p.select(
        p.p_partkey.alias("pid"),
        ((p.p_partkey * 7919) % 9973 / F.lit(100.0)).alias("x"),
        ((p.p_partkey * 6271) % 9949 / F.lit(100.0)).alias("y"),
        F.when(p.p_size <= 20, "small").when(p.p_size <= 40, "mid")
        .otherwise("large").alias("cls"))


def _ring_from(anchor_x: Column, anchor_y: Column, verts) -> Column:
    return F.array(*[F.struct((anchor_x + F.lit(float(vx))).alias("x"),
                              (anchor_y + F.lit(float(vy))).alias("y"))
                     for vx, vy in verts])


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hazard triangles: poly_id, river, rk, cx, cy, ring."""
    s = table(spark, sf_dir, "supplier")
    cx = ((s.s_suppkey * 37) % 100).cast("double")
    cy = ((s.s_suppkey * 53) % 100).cast("double")
    return s.select(s.s_suppkey.alias("poly_id"),
                    (s.s_suppkey % 3).alias("river"),
                    (s.s_nationkey % 6 + 1).cast("int").alias("rk"),
                    cx.alias("cx"), cy.alias("cy"),
                    _ring_from(cx, cy, K.HAZARD_TRIANGLE).alias("ring"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One L-shaped, counter-clockwise zone ring per nation.

    zone (nation key), ward (region name), name (nation name), ring.
    """
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    k = n.n_nationkey
    ox = (k % K.ZONE_LATTICE * K.ZONE_PITCH).cast("double")
    oy = (F.floor(k / K.ZONE_LATTICE) * K.ZONE_PITCH).cast("double")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(k.cast("long").alias("zone"), r.r_name.alias("ward"),
                    n.n_name.alias("name"), n.n_regionkey.alias("region"),
                    _ring_from(ox, oy, K.ZONE_RING).alias("ring")))


def zone_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain lattice squares of the zones (they share borders).

    ward = lattice row, used by the outline (dissolve) operator.
    """
    n = table(spark, sf_dir, "nation")
    k = n.n_nationkey
    ox = (k % K.ZONE_LATTICE * K.ZONE_PITCH).cast("double")
    oy = (F.floor(k / K.ZONE_LATTICE) * K.ZONE_PITCH).cast("double")
    p = K.ZONE_PITCH
    return n.select(k.cast("long").alias("zone"),
                    F.floor(k / K.ZONE_LATTICE).cast("long").alias("ward"),
                    _ring_from(ox, oy, ((0, 0), (p, 0), (p, p), (0, p))).alias("ring"))


def crossed_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings that cross or touch themselves: poly_id, rings."""
    s = table(spark, sf_dir, "supplier")
    cx = ((s.s_suppkey * 37) % 100).cast("double")
    cy = ((s.s_suppkey * 53) % 100).cast("double")
    kinds = [_ring_from(cx, cy, v) for v in K.FIXTURE_CROSSED_RINGS]
    ring = F.coalesce(*[F.when(s.s_suppkey % len(kinds) == i, r) for i, r in enumerate(kinds)])
    return s.select(s.s_suppkey.alias("poly_id"), F.array(ring).alias("rings"))


def big_ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of one ring with a vertex a part, in order around the centre (n keys in a row): _k, x1, y1, x2, y2, ma, mb."""
    centre, least, spread, steps = K.FIXTURE_BIG_RING
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"))
    n = p.agg(F.count("*").alias("n"))
    angle = F.lit(2 * math.pi) * F.col("i") / n.scalar()
    radius = F.lit(least) + F.lit(spread) * (F.col("i") * 7919 % steps) / F.lit(float(steps))
    v = p.select("i", (F.lit(centre) + radius * F.cos(angle)).alias("x"), (F.lit(centre) + radius * F.sin(angle)).alias("y"))
    nxt = v.select(((F.col("i") - 1 + n.scalar()) % n.scalar()).alias("at"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return v.withColumn("at", F.col("i") % n.scalar()).join(nxt, "at").select(F.lit(0).cast("long").alias("_k"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2",
                                   F.lit(1).cast("long").alias("ma"), F.lit(0).cast("long").alias("mb"))


def area_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas with a generated raw name: key, ward, raw_name, pop.

    ``ward`` is ``wardNN`` (zero padded, so no ward name prefixes another);
    the raw name carries a kanji or full-width block number.
    """
    c = table(spark, sf_dir, "customer")
    key = c.c_custkey
    ward = F.concat(F.lit("ward"), F.lpad((key % 23).cast("string"), 2, "0"))
    suffix = (F.when(key % 3 == 0, F.lit("一丁目"))
              .when(key % 3 == 1, F.lit("二十一丁目"))
              .otherwise(F.lit("１丁目")))
    return c.select(key.alias("key"), ward.alias("ward"),
                    F.concat(ward, F.lit("town"), key.cast("string"), suffix).alias("raw_name"),
                    F.greatest(c.c_acctbal, F.lit(0.0)).alias("pop"))
