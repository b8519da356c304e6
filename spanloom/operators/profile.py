"""Endpoint-support profiles of representatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import expanded, runs
from spanloom.runtime import written
from spanloom.schemas import MEASURES, PROFILE_COLUMNS, SCORING_COLUMNS, require_columns

RADIUS = 50
#: Alignments of a query beyond which it is spread over tasks.
WHOLE = 200_000
#: Alignments for a task that holds whole queries.
TASK = 250_000


def selected(alignments: DataFrame, representatives: DataFrame) -> DataFrame:
    """The scoring columns of the representatives' alignments. Ids are unique, so a semi join does."""
    reps = representatives.select(F.col("representative_contig_id").alias("query_id"))
    return require_columns(alignments, SCORING_COLUMNS, "alignments").select(*SCORING_COLUMNS).join(reps, "query_id", "left_semi")


def _first_length() -> Column:
    """The length of the first row by (from, to, target)."""
    return F.min_by("query_length", F.struct("query_from", "query_to", "target_id"))


def lengths(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(_first_length().cast("int").alias("length"))


def votes(hits: DataFrame, radius: int) -> DataFrame:
    """query_id, target_id, together, m, l, r: where on its query's axis a row counts, for each measure.

    Rows are dealt by query and target before they are multiplied by the measures.
    """
    r = F.lit(radius)
    a, b, n = F.col("query_from"), F.col("query_to"), F.col("length")
    clip = lambda lo, hi: (F.greatest(lo, F.lit(1)), F.least(hi, n))
    spans = (
        (*clip(b - r, b + r), None),
        (*clip(a - r, a + r), None),
        (*clip(b, b + r), None),
        (*clip(a - r, a), None),
        (*clip(b - r, b), None),
        (*clip(a, a + r), None),
        (*clip(b - r, b + r), b < n - r),
        (*clip(a - r, a + r), a > 1 + r),
        (a + r, b - r, a + r <= b - r),
    )
    entries = [F.struct(F.lit(k).alias("m"), lo.cast("int").alias("l"), hi.cast("int").alias("r")) for k, (lo, hi, _) in enumerate(spans)]
    held = F.filter(F.array(*(e if ok is None else F.when(ok, e) for e, (_, _, ok) in zip(entries, spans, strict=True))), lambda x: x.isNotNull())
    dealt = hits.withColumn("together", F.count("*").over(Window.partitionBy("query_id", "target_id")))
    return dealt.select("query_id", "target_id", "together", F.inline(held))


def query_sizes(hits: DataFrame) -> DataFrame:
    """query_id, length, n (alignments) of each query; written, as the steps that deal queries to tasks read it."""
    once = hits.groupBy("query_id").agg(F.min("query_length").alias("least"), F.max("query_length").alias("most"), F.count("query_length").alias("told"), F.count("*").alias("n"))
    sizes = written(hits.sparkSession, once, "query-sizes")
    # Only queries whose rows tell several lengths need the first row.
    same = F.coalesce((F.col("least") == F.col("most")) & (F.col("told") == F.col("n")), F.lit(False))
    out = sizes.where(same).select("query_id", F.col("least").cast("int").alias("length"), "n")
    odd = sizes.where(~same).select("query_id", "n")
    if odd.isEmpty():
        return out
    return out.unionByName(lengths(hits.join(odd.select("query_id"), "query_id", "left_semi")).join(odd, "query_id").select("query_id", "length", "n"))


def has_crowded(hits: DataFrame, sizes: DataFrame | None = None) -> bool:
    """Whether any query has too many alignments to be dealt whole."""
    return not (sizes if sizes is not None else query_sizes(hits)).where(F.col("n") > WHOLE).isEmpty()


def _changes(dealt: DataFrame, radius: int) -> DataFrame:
    """query_id, length, at, m, d: +1 where a target begins to count for a measure, -1 after it ends.

    Of a target's intervals, in order, each keeps what those before it don't reach, so none is counted twice.
    """
    r, a, b, n = F.lit(radius), F.col("query_from"), F.col("query_to"), F.col("length")
    low = lambda x: F.greatest(x, F.lit(1))
    high = lambda x: F.least(x, n)
    inner_b, inner_a, spans = b < n - r, a > 1 + r, a + r <= b - r
    # Where the earlier intervals of the same target reach: for ends, in the order of ends; for starts, of starts.
    reaches = {"query_to": {"wide_b": high(b + r), "near_b": high(b), "inner_b": F.when(inner_b, high(b + r))}, "query_from": {"wide_a": high(a + r), "near_a": high(a), "inner_a": F.when(inner_a, high(a + r)), "between": F.when(spans, b - r)}}
    rows = dealt
    for order, own in reaches.items():
        before = Window.partitionBy("query_id", "target_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"reach_{name}": F.max(x).over(before) for name, x in own.items()})
    # In the order of MEASURES: from, to, what reached before, and whether the interval counts.
    pieces = (
        (low(b - r), high(b + r), "wide_b", None),
        (low(a - r), high(a + r), "wide_a", None),
        (low(b), high(b + r), "wide_b", None),
        (low(a - r), high(a), "near_a", None),
        (low(b - r), high(b), "near_b", None),
        (low(a), high(a + r), "wide_a", None),
        (low(b - r), high(b + r), "inner_b", inner_b),
        (low(a - r), high(a + r), "inner_a", inner_a),
        (a + r, b - r, "between", spans),
    )
    held, known = {}, F.col("target_id").isNotNull()
    for m, (lo, hi, reach, counts) in enumerate(pieces):
        first = F.greatest(lo, F.col(f"reach_{reach}") + 1)
        held[f"l_{m}"] = F.when(known & (first <= hi) if counts is None else known & counts & (first <= hi), first).cast("int")
        held[f"r_{m}"] = hi.cast("int")
    rows = rows.select("query_id", F.when(n >= 1, n).alias("length"), *(c.alias(name) for name, c in held.items()))
    # The first point of each axis is there whatever begins at it.
    entries = [F.struct(F.lit(-1).alias("m"), F.when(F.col("length").isNotNull(), 1).alias("l"), F.lit(0).alias("r"))]
    entries += [F.struct(F.lit(m).alias("m"), F.col(f"l_{m}").alias("l"), F.col(f"r_{m}").alias("r")) for m in range(len(pieces))]
    pieced = rows.select("query_id", "length", F.inline(F.array(*entries))).where("l IS NOT NULL")
    both = F.array(F.struct(low(F.col("l")).alias("at"), F.lit(1).alias("d")), F.struct((F.greatest("r", F.lit(0)) + 1).alias("at"), F.lit(-1).alias("d")))
    return pieced.select("query_id", "length", "m", F.inline(both))


def whole_runs(hits: DataFrame, sizes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``profile_runs`` of queries that a task can hold: all that is shuffled are the alignments, once, by their query."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    tasks = max(2 * hits.sparkSession.sparkContext.defaultParallelism, -(-total // TASK))
    dealt = hits.select("query_id", "target_id", "query_from", "query_to").repartition(tasks, "query_id").join(sizes.select("query_id", "length"), "query_id")
    points = _changes(dealt, radius).groupBy("query_id", "at").agg(F.max("length").alias("length"), *(F.sum(F.when(F.col("m") == k, F.col("d")).otherwise(0)).alias(name) for k, name in enumerate(MEASURES)))
    along = Window.partitionBy("query_id").orderBy("at")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    length = F.max("length").over(so_far)
    out = points.select("query_id", length.alias("length"), F.col("at").alias("first"), (F.lead("at").over(along) - 1).alias("last"), *(F.sum(name).over(so_far).cast("int").alias(name) for name in MEASURES))
    return out.withColumn("last", F.least(F.coalesce("last", "length"), F.col("length")).cast("int")).where("first <= last")


def profile_runs(hits: DataFrame, radius: int = RADIUS, sizes: DataFrame | None = None) -> DataFrame:
    """The profile as runs of equal counts: query_id, length, first, last, the nine measures.

    Queries are dealt whole; those with more than ``WHOLE`` alignments are spread over their targets.
    """
    sizes = sizes if sizes is not None else query_sizes(hits)
    if not has_crowded(hits, sizes):
        return whole_runs(hits, sizes, radius)
    crowded = sizes.where(F.col("n") > WHOLE)
    ends = crowded.select("query_id", "length")
    spread = runs(votes(hits.join(ends, "query_id"), radius), ends, ["query_id"], "target_id", "together", MEASURES)
    rest = sizes.where(F.col("n") <= WHOLE)
    return whole_runs(hits.join(crowded.select("query_id"), "query_id", "left_anti"), rest, radius).unionByName(spread)


def _scores(radius: int, masked: bool) -> dict[str, Column]:
    b, n, r = F.col("boundary_position"), F.col("length"), F.lit(radius)
    inner = (b > 1 + r) & (b < n - r) if masked else F.lit(True)
    both = {f"{g}_b_score": F.least(f"{g}_end_target_count", f"{g}_start_target_count") for g in ("local", "directional", "overlap")}
    lead = F.col("internal_end_target_count") - F.col("internal_start_target_count")
    one = {f"one_sided_{side}_score": F.when(inner, F.greatest(x, F.lit(0))).otherwise(0).cast("int") for side, x in (("end", lead), ("start", -lead))}
    return both | one


def boundary_profile(hits: DataFrame, radius: int = RADIUS, thresholds: dict[str, int] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row for each coordinate of each query with alignments.

    With ``thresholds`` (by geometry) only coordinates where some score reaches its threshold: runs
    that can't reach any aren't expanded.
    """
    flat = profile_runs(hits, radius, sizes)
    if thresholds:
        flat = flat.where(passing(thresholds, _scores(radius, masked=False)))
    rows = expanded(flat, "boundary_position").withColumns(_scores(radius, masked=True)).withColumn("query_length", F.col("length").cast("long")).withColumn("radius_nt", F.lit(radius).cast("long"))
    rows = rows.select(*PROFILE_COLUMNS)
    return rows.where(passing(thresholds)) if thresholds else rows


#: Score column of each geometry.
GEOMETRIES = {"local": "local_b_score", "directional": "directional_b_score", "overlap": "overlap_b_score", "one_sided_end": "one_sided_end_score", "one_sided_start": "one_sided_start_score"}


def passing(thresholds: dict[str, int], scores: dict[str, Column] | None = None) -> Column:
    """Whether any score reaches the threshold of its geometry."""
    return reduce(lambda a, b: a | b, ((scores[GEOMETRIES[g]] if scores else F.col(GEOMETRIES[g])) >= n for g, n in thresholds.items()))


def boundary_summary(hits: DataFrame, representatives: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row a representative, those without alignments too."""
    got = hits.groupBy("query_id").agg(_first_length().cast("long").alias("query_length"), F.count("*").alias("alignment_row_count"), F.count_distinct("target_id").alias("target_contig_count"))
    reps = representatives.select("representative_contig_id")
    out = reps.join(got, reps.representative_contig_id == got.query_id, "left")
    return out.select("representative_contig_id", "query_length", F.lit(radius).cast("long").alias("radius_nt"), F.col("query_id").isNotNull().alias("has_nonself_alignments"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("alignment_row_count", "target_contig_count")))


def profile_audit(profile: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: queries and rows found and expected; they are equal."""
    found = profile.agg(F.count_distinct("query_id").alias("scored_queries"), F.count("*").alias("profile_rows"))
    due = summary.agg(F.count_if("has_nonself_alignments").alias("expected_queries"), F.coalesce(F.sum("query_length"), F.lit(0)).cast("long").alias("expected_rows"))
    return found.crossJoin(due)  # one row each


def profile_watch() -> dict[str, Column]:
    """What tells, of a profile as it is written, that each query has a row for each coordinate: rows, queries (by their first row), and a sum by query."""
    return {"rows": F.count(F.lit(1)), "queries": F.count_if(F.col("boundary_position") == 1), "sums": F.sum(F.xxhash64("query_id").cast("decimal(20,0)"))}


def profile_expected(summary: DataFrame) -> dict:
    """The same of the summary: a query's rows are its length."""
    own = F.xxhash64("representative_contig_id").cast("decimal(20,0)") * F.col("query_length").cast("decimal(15,0)")
    return summary.where("has_nonself_alignments").agg(F.coalesce(F.sum("query_length"), F.lit(0)).cast("long").alias("rows"), F.count("*").alias("queries"), F.sum(own).alias("sums")).first().asDict()
