"""A Merkle manifest of a dataset by lag and lead windows: leaves, subroots, root and proofs.

Every row is a leaf, the hash of its columns. Leaves of a group (a language)
stand in the order of their key, and every ``fan`` consecutive nodes of a level
are hashed into one of the next, until one is left, the group's subroot; the
subroots, in the order of their groups, make the root in the same way.

A node of level j stands on the first of its leaves, fan^j rows from the next
node. So within a block of fan^``LEVELS`` leaves a level's siblings are lag and
lead columns at that fixed offset, masked by the node's slot in its run and by
the run's length, and the row of a run's first child hashes the parent. All
levels of a block share one exchange and one sort; the blocks' roots are the
leaves of the next round. A row finds the siblings of its ancestors as the last
ones that stand before it in the block.

Blocks bound every window, however large a group is. Places in a group follow
from a range partitioning, the row's place in its range and the sizes of the
ranges. Proofs of later rounds are joined from the top down, block by block, so
no join has a hot key.

Edge cases: a null in any column is hashed as ``-``, apart from every value; a
null group is a group of its own and comes first; rows of a null key come first
in their group; repeated keys stand in the order of their leaves, equal rows
beside each other; an empty text is a value of 0 bytes; very long texts are
hashed whole; an empty table has no rows and no root; columns that aren't named
take no part, and names can't clash, as only ``_``-named columns are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_table

FAN = 2
LEVELS = 8  # levels of a round; blocks of FAN ** LEVELS nodes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<l:string,r:string>"


def row_hash(values: list[Column]) -> Column:
    """SHA-256 (hex) of the values in order: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def folded(steps: str, leaf: str) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.expr(f"aggregate({steps}, {leaf}, (h, s) -> sha2(concat(s.l, h, s.r), 256))")


def proof_hash(steps: str) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.expr(f"sha2(array_join(transform({steps}, s -> concat(s.l, s.r)), ''), 256)")


def placed(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with _pos, from 0 in the order of ``order`` within _group, and _n, the group's size."""
    keys = [F.col("_group"), *order, F.col("_row")]
    # _row deals equal rows over several ranges
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = shared_table(ranged.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn("_part", F.expr("shiftright(_at, 33)"))
    runs = ranged.groupBy("_group", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    group = Window.partitionBy("_group")
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_group", "_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                       F.sum("_size").over(group).alias("_n"))
    return ranged.join(runs, ["_group", "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def climb(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """``nodes`` (_group, _pos, _n, _digest) with _block, _steps (its siblings up to the block's root) and _top (on a block's first row)."""
    size = fan ** levels
    df = nodes.withColumn("_block", F.expr(f"_pos div {size}")).withColumn("_top", F.col("_digest"))
    block = Window.partitionBy("_group", "_block").orderBy("_pos")
    for j in range(levels):
        stride = fan ** j
        slot, node = F.expr(f"_pos div {stride} % {fan}"), F.expr(f"_n > {stride} and _pos % {stride} = 0")
        empty = F.lit("")
        lags = [F.when(slot >= o, F.lag("_top", o * stride).over(block)) for o in range(fan - 1, 0, -1)]
        leads = [F.when(slot < fan - o, F.lead("_top", o * stride).over(block)) for o in range(1, fan)]
        df = df.withColumn(f"_s{j}", F.when(node, F.struct(F.concat(*[F.coalesce(x, empty) for x in lags]).alias("l"),
                                                           F.concat(*[F.coalesce(x, empty) for x in leads]).alias("r"))))
        # the first child hashes the run; a group that has one node left keeps it
        df = df.withColumn("_top", F.when(F.expr(f"_n <= {stride}"), F.col("_top"))
                           .when(F.expr(f"_pos % {stride * fan} = 0"), F.sha2(F.concat("_top", f"_s{j}.r"), 256)))
    above = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(*nodes.columns, "_block", F.when(F.expr(f"_pos % {size} = 0"), F.col("_top")).alias("_top"),
                     F.filter(F.array(*[F.last(f"_s{j}", ignorenulls=True).over(above) for j in range(levels)]),
                              lambda s: s.isNotNull()).cast(f"array<{_STEP}>").alias("_steps"))


def tree(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(leaves with _steps up to their block's root, (_group, _digest) of the groups' roots, the rounds from the second on)."""
    size, rounds = fan ** levels, []
    most = nodes.agg(F.max("_n")).first()[0] or 0
    while True:
        rounds.append(shared_table(climb(nodes, fan, levels), "tree"))
        tops = rounds[-1].filter("_top is not null")
        if most <= size:
            return rounds[0], tops.select("_group", F.col("_top").alias("_digest")), rounds[1:]
        nodes = tops.select("_group", F.col("_block").alias("_pos"), F.expr(f"(_n + {size - 1}) div {size}").alias("_n"), F.col("_top").alias("_digest"))
        most = -(-most // size)


def _descended(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """(_group, _block, _more, carried columns) of the first round's blocks; ``top``: _group, _more and what is carried down."""
    at = top.withColumn("_block", F.lit(0).cast("long"))
    for r in reversed(rounds):
        joined = r.select("_group", "_block", F.col("_pos").alias("_child"), "_steps").join(at, ["_group", "_block"])
        at = joined.withColumn("_more", F.concat("_steps", "_more")).drop("_steps", "_block").withColumnRenamed("_child", "_block")
    return at


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with _subroot, _root and _steps, the siblings from leaf to root as (left, right) of each level."""
    named = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first, then bytewise
    rows = placed(leaves.withColumn("_group", named), [F.col(key).asc_nulls_first(), F.col(leaf)])
    first, subroots, rounds = tree(rows.withColumn("_digest", F.col(leaf)), fan, levels)
    # the subroots are the leaves of one more tree, in one group
    of_groups = placed(subroots.select(F.lit("").alias("_group"), F.col("_group").alias("_of"), "_digest"), [F.col("_of")])
    g_first, roots, g_rounds = tree(of_groups, fan, levels)
    none = F.array().cast(f"array<{_STEP}>")
    g_top = _descended(g_rounds, roots.select("_group", F.col("_digest").alias("_root"), none.alias("_more")))
    groups = g_first.join(g_top, ["_group", "_block"]).select(
        F.col("_of").alias("_group"), F.col("_digest").alias("_subroot"), "_root", F.concat("_steps", "_more").alias("_more"))
    top = _descended(rounds, groups)
    out = first.select(*leaves.columns, "_group", "_block", "_steps").join(top, ["_group", "_block"])
    return out.select(*leaves.columns, "_subroot", "_root", F.concat("_steps", "_more").alias("_steps"))


def manifest_report(docs: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` with every leaf proved; tampered rows (n_chars + 1 where 7 divides crc32 of doc_id) fail."""
    values = {c: F.col(c) for c in COLUMNS}
    more = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + F.lit(1)}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    leaves = shared_table(docs.select(F.col("doc_id").cast("long"), "lang", row_hash(list(values.values())).alias("leaf"),
                                      F.when(hit, row_hash(list(more.values()))).alias("tampered")), "leaves")
    proved = manifest(leaves, "lang", "doc_id", "leaf", fan, levels).withColumn("_start", F.coalesce("tampered", "leaf"))
    return proved.select("doc_id", "leaf", F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
                         proof_hash("_steps").alias("proof_sha256"), folded("_steps", "_start").alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
