"""How many distinct members cover each point of an integer axis.

Counting distinct members over points would multiply every interval by its length. Here the intervals
of one member are merged first, so each point is covered by a member once, and the counts are running
sums of +1 at a start and -1 after an end. Work follows the number of intervals, not their length.

Running sums have two levels: blocks of coordinates are summed apart, the totals of the blocks of an axis
are scanned, and each block begins with the sum of those before it. So a long axis is many small groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import written


#: Coordinates of a block: the rows of a group of the first level, at most.
BLOCK = 1 << 14


def _by_block(rows: DataFrame, blocks: DataFrame, axis: list[str]) -> DataFrame:
    """Rows with the other columns of their block; a null axis is one of its own."""
    own = {c: f"own_{c}" for c in (*axis, "block")}
    other = blocks.select(*(F.col(c).alias(n) for c, n in own.items()), *(c for c in blocks.columns if c not in own))
    both = rows.join(other, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(n)) for c, n in own.items())))
    return both.drop(*own.values())


def swept(points: DataFrame, axis: list[str], names: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """axis, length, first, last (the point before the next, null for the axis's last one), and the running sum of each d_<name>.

    ``points`` has axis, at, length (null but for one row of each axis, its first) and d_<name>, one row a point.
    """
    rows = points.withColumn("block", F.expr(f"at div {block}"))
    totals = rows.groupBy(*axis, "block").agg(F.min("at").alias("head"), F.max("length").alias("length"), *(F.sum(f"d_{n}").alias(f"d_{n}") for n in names))
    blocks = Window.partitionBy(*axis).orderBy("block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*axis, "block", F.lead("head").over(blocks).alias("after"), F.max("length").over(blocks.rowsBetween(Window.unboundedPreceding, 0)).alias("whole"), *(F.coalesce(F.sum(f"d_{n}").over(before), F.lit(0)).alias(f"o_{n}") for n in names))
    held = _by_block(rows.drop("length"), offsets, axis)
    inside = Window.partitionBy(*axis, "block").orderBy("at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return held.select(*axis, F.col("whole").alias("length"), F.col("at").alias("first"), (F.coalesce(F.lead("at").over(inside), "after") - 1).alias("last"), *((F.col(f"o_{n}") + F.sum(f"d_{n}").over(so_far)).cast("int").alias(n) for n in names))


def islands(rows: DataFrame, by: list[str], at: str, distance: Column, block: int = BLOCK) -> DataFrame:
    """Rows with ``island``: the first of the places that follow each other at no more than ``distance``.

    Places of a group are distinct. Groups are cut into blocks, and then those of a block joined with the
    block before it, as in ``swept``.
    """
    dealt = rows.withColumn("block", F.expr(f"`{at}` div {block}")).withColumn("reach", distance)
    inside = Window.partitionBy(*by, "block").orderBy(at)
    # The first place of a block has none before it there: null.
    marked = dealt.withColumn("fresh", F.when(F.col(at) - F.lag(at).over(inside) > F.col("reach"), F.col(at)))
    totals = marked.groupBy(*by, "block").agg(F.min(at).alias("head"), F.max(at).alias("tail"), F.max("fresh").alias("fresh"), F.first("reach").alias("reach"))
    blocks = Window.partitionBy(*by).orderBy("block")
    tail = F.lag("tail").over(blocks)
    begun = totals.select(*by, "block", "fresh", F.when(tail.isNull() | (F.col("head") - tail > F.col("reach")), F.col("head")).alias("begins"))
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = begun.select(*by, "block", F.coalesce("begins", F.max(F.greatest("fresh", "begins")).over(before)).alias("carried"))
    held = _by_block(marked, carried, by)
    start = F.max("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("island", F.coalesce(start, "carried")).drop("block", "reach", "fresh", "carried")


def merged(intervals: DataFrame, by: list[str], together: str) -> DataFrame:
    """Unions of overlapping or touching intervals (l, r) within each group; empty ones (r < l) go.

    ``together`` counts the rows that an interval could meet: those that stand alone pass by.
    """
    rows = intervals.where("r >= l")
    lone = rows.where(F.col(together) == 1).select(*by, "l", "r")
    w = Window.partitionBy(*by).orderBy("l", "r")
    reach = F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1))
    several = rows.where(F.col(together) > 1).withColumn("fresh", F.when(F.col("l") <= reach + 1, 0).otherwise(1))
    several = several.withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return lone.unionByName(several.groupBy(*by, "island").agg(F.min("l").alias("l"), F.max("r").alias("r")).drop("island"))


def runs(intervals: DataFrame, ends: DataFrame, axis: list[str], member: str, together: str, measures: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """axis, length, first, last and the count of each measure, constant from first to last.

    ``intervals`` has axis, member, ``together``, m (number of the measure), l, r; ``ends`` has axis and
    length: points 1 to length are covered without gap. Members are merged by (axis, member, measure),
    so one long axis spreads over many tasks; changes of a point are added up before they are shuffled,
    and then summed by blocks.
    """
    one = merged(intervals.where(F.col(member).isNotNull()), [*axis, member, "m"], together)
    at = F.explode(F.array(F.struct(F.greatest("l", F.lit(1)).alias("at"), F.lit(1).alias("d")), F.struct((F.greatest("r", F.lit(0)) + 1).alias("at"), F.lit(-1).alias("d"))))
    steps = one.select(*axis, "m", at.alias("s")).select(*axis, F.lit(None).cast("int").alias("length"), "m", "s.at", "s.d")
    # A row at the first point of each axis carries its length.
    base = ends.where("length >= 1").select(*axis, F.col("length").cast("int").alias("length"), F.lit(-1).alias("m"), F.lit(1).alias("at"), F.lit(0).alias("d"))
    points = steps.unionByName(base).groupBy(*axis, "at").agg(F.max("length").alias("length"), *(F.sum(F.when(F.col("m") == k, F.col("d")).otherwise(0)).alias(f"d_{name}") for k, name in enumerate(measures)))
    # Blocks and their totals are read apart: the points are made once and written.
    out = swept(written(intervals.sparkSession, points, "points"), axis, measures, block)
    return out.withColumn("last", F.least(F.coalesce("last", "length"), F.col("length")).cast("int")).where("first <= last")


def expanded(run_rows: DataFrame, point: str) -> DataFrame:
    """A row for each point of each run."""
    return run_rows.withColumn(point, F.explode(F.sequence("first", "last"))).drop("first", "last")


def coverage_runs(intervals: DataFrame, axis: str, member: str, length: str, left: str = "l", right: str = "r") -> DataFrame:
    """axis, length, first, last, n_members: distinct members over each point from first to last."""
    rows = intervals.select(F.col(axis).alias("axis"), F.col(member).alias("member"), F.col(left).cast("int").alias("l"), F.col(right).cast("int").alias("r"), F.lit(0).alias("m"))
    rows = rows.withColumn("together", F.count("*").over(Window.partitionBy("axis", "member")))
    ends = intervals.groupBy(F.col(axis).alias("axis")).agg(F.max(length).cast("int").alias("length"))
    return runs(rows, ends, ["axis"], "member", "together", ("n_members",)).withColumnRenamed("axis", axis)


def coverage_counts(intervals: DataFrame, axis: str, member: str, length: str, left: str = "l", right: str = "r") -> DataFrame:
    """axis, point, n_members: distinct members over each point 1..length of each axis."""
    return expanded(coverage_runs(intervals, axis, member, length, left, right), "point").select(axis, "point", "n_members")
