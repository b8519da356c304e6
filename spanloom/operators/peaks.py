"""Separated score peaks: greedy selection by score, suppressing what lies near."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.intervals import islands
from spanloom.operators.profile import GEOMETRIES
from spanloom.runtime import ship, written
from spanloom.schemas import PROFILE_COLUMNS, PROFILE_MEASURES, InputError, require_columns

#: End and start counts of each geometry.
COUNTS = {g: ("internal_end_target_count", "internal_start_target_count") if g.startswith("one") else (f"{g}_end_target_count", f"{g}_start_target_count") for g in GEOMETRIES}


def thresholds(*, local: int | None = 2, directional: int | None = 2, overlap: int | None = 2, one_sided: int | None = 10) -> dict[str, int]:
    """Thresholds of the geometries in use; None leaves one out. One-sided peaks share theirs."""
    out = {k: v for k, v in {"local": local, "directional": directional, "overlap": overlap, "one_sided_end": one_sided, "one_sided_start": one_sided}.items() if v is not None}
    if not out or min(out.values()) < 1:
        raise InputError("at least one minimum score is needed, and each must be 1 or more")
    return out


def pick(position: np.ndarray, own: np.ndarray, paired: np.ndarray, geometry: str, distance: int) -> list[tuple[int, int]]:
    """(index of the score maximum, index of the chosen position) in the order of selection.

    Positions ascend; all of them pass the threshold. The chosen position stands for the region of
    the maximum: where the paired scores are best (local), nearest to the weighted centre (one-sided),
    or the maximum itself.
    """
    alive = np.ones(len(position), bool)
    out = []
    for top in np.lexsort((position, -own)).tolist():
        if not alive[top]:
            continue
        lo, hi = np.searchsorted(position, (position[top] - distance, position[top] + distance + 1))
        near = lo + np.flatnonzero(alive[lo:hi])
        if geometry == "local":
            choice = near[np.lexsort((position[near], -own[near], -paired[near]))[0]]
        elif geometry.startswith("one_sided"):
            weight = own[near].astype(np.int64)
            centre = np.rint((position[near].astype(np.int64) * weight).sum() / weight.sum())
            choice = near[np.lexsort((position[near], -own[near], np.abs(position[near] - centre)))[0]]
        else:
            choice = top
        out.append((top, int(choice)))
        for p in (position[top], position[choice]):
            lo, hi = np.searchsorted(position, (p - distance, p + distance + 1))
            alive[lo:hi] = False
    return out


_METHOD = {"local": "directional_or_overlap_within_local_region", "one_sided_end": "weighted_center", "one_sided_start": "weighted_center"}


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of sorted rows, with the places where groups begin; one group at least is held back until it ends."""
    held: list[pa.RecordBatch] = []
    last = None

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            c = table.column(k).combine_chunks()
            null = np.asarray(c.is_null())
            new |= np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), False)) | (null[1:] != null[:-1])
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = tuple(batch.column(k)[-1].as_py() for k in keys)
        held.append(batch)
        if ends == last:
            continue  # still the group that is held
        last = ends
        table = pa.Table.from_batches(held)
        at = begins(table)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
        held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, begins(table)


_KINDS = {"query_id": "string", "query_length": "long", "radius_nt": "long", "score_geometry": "string", "peak_selection_rank": "long", "score_max_position": "long", "score_max_value": "long", "peak_position": "long", "peak_score": "long", **dict.fromkeys(PROFILE_MEASURES, "long")}


def passing_islands(positions: DataFrame, limits: dict[str, int], whole: bool = False) -> DataFrame:
    """Rows of the profile for each geometry whose threshold they reach: with score_geometry, own (its score) and island.

    Places of a geometry that lie farther apart than the least distance of two peaks, twice the radius, can't
    influence each other: islands are selected from one by one. With ``whole`` a query's places are read in one
    task, in order; profiles that are dealt by query aren't shuffled for that. Else queries are cut into blocks.
    """
    each = F.array_compact(F.array(*(F.when(F.col(GEOMETRIES[g]) >= n, F.struct(F.lit(g).alias("score_geometry"), F.col(GEOMETRIES[g]).cast("long").alias("own"))) for g, n in limits.items())))
    if whole:
        long = positions.select(*PROFILE_COLUMNS, F.inline(each))
        along = Window.partitionBy("query_id", "score_geometry").orderBy("boundary_position")
        at, before = F.col("boundary_position"), F.lag("boundary_position").over(along)
        fresh = long.withColumn("fresh", F.when(before.isNull() | (at - before > F.col("radius_nt") * 2), at))
        return fresh.withColumn("island", F.max("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")
    # Blocks and rows are read apart: the positions are found once and written.
    long = written(positions.sparkSession, positions.select(*PROFILE_COLUMNS, F.inline(each)), "passing-positions")
    return islands(long, ["query_id", "score_geometry"], "boundary_position", F.col("radius_nt") * 2)


def score_peaks(positions: DataFrame, limits: dict[str, int], whole: bool = False) -> DataFrame:
    """Peaks of every geometry from profile rows (at least those that reach a threshold).

    The selection runs on islands: a task gets them sorted and holds one at a time. The order of selection
    of a query and geometry is that of the maxima by score and position, whatever their islands. ``whole`` says
    that no query is so large that its islands should go to several tasks.
    """
    ship(positions.sparkSession)
    require_columns(positions, PROFILE_COLUMNS, "profile")
    found = {n: k for n, k in _KINDS.items() if n != "peak_selection_rank"}
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in found.items()])
    keys = ("query_id", "score_geometry", "island")

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in _groups(batches, keys):
            position, own, directional, overlap = (rows.column(n).to_numpy().astype(np.int64) for n in ("boundary_position", "own", "directional_b_score", "overlap_b_score"))
            paired = np.maximum(directional, overlap)
            geometry, radius = rows.column("score_geometry").take(pa.array(begin)).to_pylist(), rows.column("radius_nt").take(pa.array(begin)).to_pylist()
            pairs = [(lo + a, lo + b) for lo, hi, g, r in zip(begin.tolist(), [*begin[1:].tolist(), rows.num_rows], geometry, radius, strict=True) for a, b in pick(position[lo:hi], own[lo:hi], paired[lo:hi], g, 2 * r)]
            top, at = np.array(pairs, np.int64).reshape(-1, 2).T
            stored = rows.take(pa.array(at))
            new = {"score_max_position": position[top], "score_max_value": own[top], "peak_position": position[at], "peak_score": own[at]}
            yield from pa.table([pa.array(new[f.name], f.type) if f.name in new else stored.column(f.name).cast(f.type) for f in schema], schema=schema).to_batches()

    islanded = passing_islands(positions, limits, whole)
    dealt = islanded.sortWithinPartitions("query_id", "score_geometry", "boundary_position") if whole else islanded.repartition(*keys).sortWithinPartitions(*keys, "boundary_position")
    found = dealt.mapInArrow(select, ", ".join(f"{n} {k}" for n, k in found.items()))
    selected = Window.partitionBy("query_id", "score_geometry").orderBy(F.desc("score_max_value"), "score_max_position")
    found = found.withColumn("peak_selection_rank", F.row_number().over(selected).cast("long"))
    order = Window.partitionBy("query_id", "score_geometry").orderBy("peak_position")
    named = found.withColumn("peak_index", F.row_number().over(order).cast("long"))
    end, start = ({g: c[k] for g, c in COUNTS.items()} for k in (0, 1))
    by = lambda columns: F.coalesce(*(F.when(F.col("score_geometry") == g, F.col(c)) for g, c in columns.items()))
    method = F.coalesce(*(F.when(F.col("score_geometry") == g, F.lit(m)) for g, m in _METHOD.items()), F.lit("score_maximum"))
    return named.select(
        F.format_string("%s:%s:P%03d", "query_id", "score_geometry", "peak_index").alias("peak_id"), "query_id", "query_length", "radius_nt", "score_geometry", "peak_index", "peak_selection_rank", "score_max_position", "score_max_value", "peak_position", method.alias("peak_position_method"),
        (F.col("peak_position") - F.col("score_max_position")).alias("position_shift_nt"), "peak_score", by(end).alias("end_target_count"), by(start).alias("start_target_count"), *PROFILE_MEASURES, (F.col("radius_nt") * 2).alias("minimum_peak_distance_nt"),
    )


def peaks_per_geometry(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("score_geometry").agg(F.count("*").alias("peak_count"))
