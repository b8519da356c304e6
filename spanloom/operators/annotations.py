"""Annotations of peak targets, and the dominant ones on each side of a peak."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.titles import MISSING_LABELS, joined_tokens, role, role_is_ambiguous, trimmed
from spanloom.operators import targets as tg
from spanloom.operators.targets import peak_targets
from spanloom.runtime import ship
from spanloom.schemas import ANNOTATION_COLUMNS, ANNOTATION_TEXT, SUMMARISED, InputError, require_columns

_TITLE, _ROLE = "best_viral_title", "viral_protein_role"
#: What is read from a title.
TITLE_LABELS = (_ROLE, "viral_protein_named_tokens", "viral_protein_role_ambiguous")
#: What the summary and the audit read of annotated targets.
SUMMARY_INPUT = ("query_id", "peak_id", "target_id", "enters_peak_end_count", "enters_peak_start_count", "has_spanning_alignment", "has_diamond_hit", "has_viral_hit", "best_hit_is_viral", *ANNOTATION_TEXT)
#: Stored count of a peak, and the flag whose sum over its annotated targets must equal it.
COUNT_FLAGS = {"end_target_count": "enters_peak_end_count", "start_target_count": "enters_peak_start_count", "spanning_target_count": "has_spanning_alignment"}
_SIDES = {"end": "enters_peak_end_count", "start": "enters_peak_start_count"}
_SIDE_COUNTS = ("target_count", "diamond_hit_target_count", "no_diamond_hit_target_count", "viral_hit_target_count", "best_hit_viral_target_count", "best_hit_not_viral_target_count", "ambiguous_viral_protein_role_target_count")


def annotated_targets(targets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Targets that count at their peak, with their annotation, if any. Columns beyond the contract come along."""
    require_columns(annotations, ANNOTATION_COLUMNS, "annotations")
    extra = _extra(annotations, targets)
    relevant = targets.where(_RELEVANT)
    out = relevant.join(annotations, relevant.target_id == annotations.qseqid, "left")
    return out.select(*targets.columns, F.col("qseqid").isNotNull().alias("has_diamond_hit"), *extra)


_RELEVANT = "enters_peak_end_count OR enters_peak_start_count OR has_spanning_alignment"


def _extra(annotations: DataFrame, targets: DataFrame) -> list[str]:
    extra = [c for c in annotations.columns if c != "qseqid"]
    if clash := sorted(set(extra) & {*targets.columns, "has_diamond_hit"}):
        raise InputError(f"annotations: columns {clash} are also columns of the targets")
    return extra


def annotated_peak_targets(peaks: DataFrame, alignments: DataFrame, annotations: DataFrame, ordered: bool = False) -> DataFrame:
    """The same as ``annotated_targets`` of the peaks' targets; alignments meet their annotations before peaks multiply them."""
    require_columns(annotations, ANNOTATION_COLUMNS, "annotations")
    notes = annotations.where("qseqid IS NOT NULL").withColumnsRenamed({"qseqid": "target_id"}).withColumn("has_diamond_hit", F.lit(True))
    out = peak_targets(peaks, alignments, notes, ordered)
    own = out.columns[: -len(notes.columns) + 1]
    extra = _extra(annotations, out.select(*own))
    return out.where(_RELEVANT).select(*own, F.coalesce("has_diamond_hit", F.lit(False)).alias("has_diamond_hit"), *extra)


def _cluster(df: DataFrame) -> list[str]:
    """The query, if there: it follows from the peak, and tables dealt by it need no shuffle to be grouped."""
    return [c for c in ("query_id",) if c in df.columns]


def annotation_mismatches(peaks: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row, mismatches: peaks whose annotated targets don't add up to their three counts."""
    seen = annotated.groupBy(*_cluster(annotated), "peak_id").agg(*(F.count_if(f).alias(f"seen_{c}") for c, f in COUNT_FLAGS.items())).drop("query_id")
    both = peaks.select("peak_id", *COUNT_FLAGS).join(seen, "peak_id", "left")
    wrong = reduce(lambda a, b: a | b, (F.col(c) != F.coalesce(f"seen_{c}", F.lit(0)) for c in COUNT_FLAGS))
    return both.agg(F.count_if(wrong).alias("mismatches"))


def with_title_labels(annotated: DataFrame) -> DataFrame:
    """Role, tokens and ambiguity of the title, if they aren't there; each distinct title is read once and joined back."""
    if _ROLE in annotated.columns:
        return annotated
    titles = annotated.select(_TITLE).where(F.col(_TITLE).isNotNull() & (trimmed(F.col(_TITLE)) != "")).distinct()
    t = F.col(_TITLE)
    labels = titles.select(t.alias("__title"), role(t).alias("viral_protein_role"), joined_tokens(t).alias("viral_protein_named_tokens"), role_is_ambiguous(t).alias("viral_protein_role_ambiguous"))
    return annotated.join(labels, F.col(_TITLE) == F.col("__title"), "left").drop("__title")


def by_side(labelled: DataFrame) -> DataFrame:
    """Rows with peak_side: a target on both sides stands for both."""
    sides = F.array_compact(F.array(*(F.when(F.col(flag), F.lit(side)) for side, flag in _SIDES.items())))
    return labelled.withColumn("peak_side", F.explode(sides))


def _count_name(side: str, name: str) -> str:
    return f"{side}_{'observed_target_count' if name == 'target_count' else name}"


def _missing(value: Column) -> Column:
    """Whether a trimmed value stands for none; most are longer than any that does."""
    return (F.length(value) <= max(map(len, MISSING_LABELS))) & F.upper(value).isin(*MISSING_LABELS)


def _present(value: Column, name: str) -> Column:
    """The trimmed value, null if missing."""
    bare = trimmed(value)
    return bare if name == _ROLE else F.when(~_missing(bare), bare)


def annotation_long(sides: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """peak_id, peak_side, target_id, (``also``,) annotation_name, annotation_value of every value that isn't missing."""
    keys = ["peak_id", "peak_side", "target_id", *also]
    rows = sides.select(*keys, *(F.col(c).cast("string").alias(c) for c in SUMMARISED))
    long = rows.unpivot(keys, list(SUMMARISED), "annotation_name", "annotation_value").where("annotation_value IS NOT NULL")
    bare = long.withColumn("annotation_value", trimmed(F.col("annotation_value")))
    return bare.where((F.col("annotation_name") == _ROLE) | ~_missing(F.col("annotation_value")))


def dominant_value(long: DataFrame, by: list[str], value: str, member: str, *, repeats: bool = True) -> DataFrame:
    """The value that most distinct members of each group have; of equals, the first by its text.

    by, value, value_count, fraction (of the sum of all values' counts), distinct_count. Members are
    made distinct before they are counted, so a hot value is added up in parts; so are the counts of a
    group of very many values. Without ``repeats`` (a member has a value of a group once) members
    needn't be made distinct, and only counts are shuffled.
    """
    rows = long.select(*by, value, member)
    n = (rows.distinct() if repeats else rows).groupBy(*by, value).agg(F.count(member).alias("value_count"))
    top = F.min_by(F.struct(F.col(value).alias("v"), "value_count"), F.struct(-F.col("value_count"), value))
    out = n.groupBy(*by).agg(top.alias("top"), F.sum("value_count").alias("total"), F.count("*").alias("distinct_count"))
    return out.select(*by, F.col("top.v").alias(value), "top.value_count", (F.col("top.value_count") / F.col("total")).alias("fraction"), "distinct_count")


def dominant_annotations(long: DataFrame) -> DataFrame:
    # Annotated targets have one row for each peak and target, and a side once.
    return dominant_value(long, [*_cluster(long), "peak_id", "peak_side", "annotation_name"], "annotation_value", "target_id", repeats=False).drop("query_id")


def _kinds() -> dict[str, list[tuple[str, Column]]]:
    """For each side (and the spanning targets): the name of each count, and which of the side's targets count."""
    hit, viral, own = F.col("has_diamond_hit"), F.coalesce("has_viral_hit", F.lit(False)), F.coalesce("best_hit_is_viral", F.lit(False))
    kinds = (F.lit(True), hit, ~hit, viral, own, hit & ~own, F.coalesce("viral_protein_role_ambiguous", F.lit(False)))
    named = list(zip(_SIDE_COUNTS, kinds, strict=True))
    return {**dict.fromkeys(_SIDES, named), "spanning": named[:4]}


#: Place of the flags of a target, as a text with a letter for each, among its values.
_FLAGS = -1


def with_present(labelled: DataFrame) -> DataFrame:
    """Rows with ``present``: place and trimmed value of every annotation that isn't missing."""
    entries = [F.struct(F.lit(j).alias("place"), _present(F.col(c).cast("string"), c).alias("value")) for j, c in enumerate(SUMMARISED)]
    return labelled.withColumn("present", F.filter(F.array(*entries), lambda x: x["value"].isNotNull()))


def _values(labelled: DataFrame) -> DataFrame:
    """peak_id, place, value, on_end, on_start: the flags of each target, and its values if it counts on a side."""
    rows = labelled if "present" in labelled.columns else with_present(labelled)
    flag = lambda c: F.when(c, "1").otherwise("0")
    held = {**_SIDES, "spanning": "has_spanning_alignment"}
    flags = F.concat(*(flag(F.col(held[side]) & kind) for side, kinds in _kinds().items() for _, kind in kinds))
    own = F.array(F.struct(F.lit(_FLAGS).alias("place"), flags.alias("value")))
    sides = [F.coalesce(c, F.lit(False)).alias(f"on_{side}") for side, c in _SIDES.items()]
    return rows.select(*_cluster(rows), "peak_id", *sides, F.inline(F.when((F.col("enters_peak_end_count") | F.col("enters_peak_start_count")) & F.col("present").isNotNull(), F.concat(own, "present")).otherwise(own)))


def _tallied(values: DataFrame) -> DataFrame:
    """One row a peak: the counts of its sides and the dominant values. Rows are counted by value, then by place, then by peak."""
    keys = [c for c in values.columns if c not in ("place", "value", "on_end", "on_start")]
    n = values.groupBy(*keys, "place", "value").agg(F.count("*").alias("n"), *(F.count_if(f"on_{side}").alias(f"n_{side}") for side in _SIDES))
    names = [_count_name(side, name) for side, kinds in _kinds().items() for name, _ in kinds]
    sums = [F.sum(F.when((F.col("place") == _FLAGS) & (F.substring("value", k + 1, 1) == "1"), F.col("n")).otherwise(0)).alias(name) for k, name in enumerate(names)]
    tops = []
    for side in _SIDES:
        own = F.col(f"n_{side}")
        some = own > 0
        # Of equals, the first by its text.
        tops += [F.min_by(F.when(some, F.struct("value", own.alias("n"))), F.when(some, F.struct(-own, "value"))).alias(f"top_{side}"), F.sum(own).alias(f"total_{side}"), F.count_if(some).alias(f"distinct_{side}")]
    placed = n.groupBy(*keys, "place").agg(*tops, *sums)
    picked = []
    for side in _SIDES:
        top, some = F.col(f"top_{side}"), F.col(f"distinct_{side}") > 0
        for j, name in enumerate(SUMMARISED):
            here = (F.col("place") == j) & some
            for column, source in zip(_dominant_names(side, name), (top["value"], top["n"], top["n"] / F.col(f"total_{side}"), F.col(f"distinct_{side}")), strict=True):
                picked.append(F.max(F.when(here, source)).alias(column))
    return placed.groupBy(*keys).agg(*picked, *(F.sum(name).alias(name) for name in names)).drop("query_id")


def _dominant_names(side: str, name: str) -> tuple[str, str, str, str]:
    """Columns of a side's dominant value: itself, its count, its fraction, and how many values there are."""
    return f"{side}_dominant_{name}", f"{side}_dominant_{name}_target_count", f"{side}_dominant_{name}_fraction_among_nonmissing", f"{side}_distinct_{name}_count"


def _tally_types() -> dict[str, str]:
    """The columns of ``peak_tallies``."""
    out = {"peak_id": "string"}
    for side in _SIDES:
        out |= {_count_name(side, c): "long" for c in _SIDE_COUNTS}
        for name in SUMMARISED:
            out |= dict(zip(_dominant_names(side, name), ("string", "long", "double", "long"), strict=True))
    return out | {_count_name("spanning", c): "long" for c in _SIDE_COUNTS[:4]}


#: Entries of one array: peaks times alignments of a query.
_CELLS = 1 << 22


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each text among the distinct ones, -1 if null, and these in the order of their bytes."""
    coded = values.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary)
    rank = np.full(len(order) + 1, -1)  # the last one is for nulls
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _tallied_query(rows: pa.Table, peaks: pa.Table) -> pa.Table:
    """Counts and dominant values of the peaks of a query, from its alignments with what is noted of their targets."""
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[k]) for c, k in _tally_types().items()])
    if not rows.num_rows or not peaks.num_rows:
        return schema.empty_table()
    target = rows.column("target_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(target, kind="stable")
    first = np.flatnonzero(np.diff(target[order], prepend=-2))
    f, t = (rows.column(c).to_numpy()[order] for c in ("query_from", "query_to"))
    own = rows.take(pa.array(order[first]))  # a row for each target
    kinds = (own.column("kinds").to_numpy()[:, None] >> np.arange(len(_SIDE_COUNTS)) & 1).astype(np.float64)
    values = [(name, *_ranked(own.column(name).combine_chunks())) for name in SUMMARISED]
    some = lambda m: m if len(first) == len(order) else np.logical_or.reduceat(m, first, axis=1)
    parts, step = [], max(1, _CELLS // len(order))
    for lo in range(0, peaks.num_rows, step):
        here = peaks.slice(lo, step)
        flags = tg.flags(f, t, *(here.column(c).to_numpy()[:, None] for c in ("peak_position", "radius_nt", "query_length")))
        geometry = np.array(here.column("score_geometry").to_pylist(), object)
        out = {"peak_id": here.column("peak_id").combine_chunks()}
        held = {side: some(reduce(np.logical_or, ((geometry == g)[:, None] & flags[f"{what}_{side}"] for g, what in tg.ENTERS.items()))) for side in _SIDES}
        for side, held_here in {**held, "spanning": some(flags["spanning"])}.items():
            counts = (held_here @ kinds).astype(np.int64)
            out |= {_count_name(side, c): pa.array(counts[:, k]) for k, c in enumerate(_SIDE_COUNTS)}
        for side, held_here in held.items():
            at, which = np.nonzero(held_here)
            for name, rank, texts in values:
                code, size = rank[which], max(1, len(texts))
                n = np.bincount((at * size + code)[code >= 0], minlength=len(geometry) * size).reshape(-1, size)
                # Of equals, the first by its text.
                top = n.argmax(axis=1)
                most, total = n[np.arange(len(top)), top], n.sum(axis=1)
                found = (texts.take(pa.array(top, mask=most == 0)), pa.array(most), pa.array(most / np.maximum(total, 1)), pa.array((n > 0).sum(axis=1)))
                out |= dict(zip(_dominant_names(side, name), found, strict=True))
        parts.append(pa.table([out[f.name] for f in schema], schema=schema))
    return pa.concat_tables(parts)


def peak_tallies(peaks: DataFrame, alignments: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row for each peak that may have targets: the counts of its sides and the dominant values.

    The alignments of a query, with what is noted of their targets, meet its peaks in one task; which targets are
    on a side of a peak, and how many have a value, is told by arrays, so the rows of peaks and targets aren't made.
    Queries of more than ``LISTED`` alignments are dealt in parts, as ``peak_targets`` deals them, and their rows are
    counted one by one.
    """
    require_columns(annotations, ANNOTATION_COLUMNS, "annotations")
    spark = peaks.sparkSession
    ship(spark)
    labelled = with_title_labels(annotations.where("qseqid IS NOT NULL"))
    kinds = lambda held: reduce(Column.__add__, (F.when(kind, 1 << k).otherwise(0) for k, (_, kind) in enumerate(_kinds()["end"]))).cast("long") if held else F.lit(0b101).cast("long")
    notes = labelled.withColumn("has_diamond_hit", F.lit(True)).select(F.col("qseqid").alias("target_id"), kinds(True).alias("kinds"), *(_present(F.col(c).cast("string"), c).alias(c) for c in SUMMARISED))
    rows, keys = alignments.select("query_id", "target_id", "query_from", "query_to"), peaks.select(*tg.PEAK_KEYS)
    rows, keys = (df.where("query_id IS NOT NULL") for df in (rows, keys))  # none meets no other
    counted = tg.by_query(rows)
    large = counted.where(F.col("n") > tg.LISTED).select("query_id")
    more = []
    if not large.isEmpty():
        both = annotated_peak_targets(keys.join(large, "query_id", "left_semi"), rows.join(large, "query_id", "left_semi"), with_present(labelled))
        more = [_tallied(_values(both))]
        rows, keys, counted = (df.join(large, "query_id", "left_anti") for df in (rows, keys, counted))
    tasks = tg.tasks_of(keys, rows, counted)
    # Notes make rows wide: tasks must be as many before the join as after it, or what they write doesn't fit their memory.
    noted = rows.repartition(tasks, "target_id").join(notes, "target_id", "left").withColumn("kinds", F.coalesce("kinds", kinds(False)))
    met = noted.repartition(tasks, "query_id").groupBy("query_id").cogroup(keys.repartition(tasks, "query_id").groupBy("query_id"))
    whole = met.applyInArrow(_tallied_query, ", ".join(f"{c} {k}" for c, k in _tally_types().items()))
    return reduce(DataFrame.unionByName, more, whole)


def dominant_of_tallies(tallied: DataFrame) -> DataFrame:
    """The same as ``dominant_annotations`` of the peaks' targets: one row for each peak, side and annotation that has a value."""
    entries = []
    for side in _SIDES:
        for name in SUMMARISED:
            found = zip(_dominant_names(side, name), ("annotation_value", "value_count", "fraction", "distinct_count"), strict=True)
            entries.append(F.struct(F.lit(side).alias("peak_side"), F.lit(name).alias("annotation_name"), *(F.col(c).alias(n) for c, n in found)))
    return tallied.select("peak_id", F.inline(F.array(*entries))).where("distinct_count > 0")


def _filled(column: str) -> Column:
    if column.endswith("_nonmissing"):
        return F.coalesce(column, F.lit(0.0)).alias(column)
    return F.coalesce(column, F.lit(0)).cast("long").alias(column) if column.endswith("_count") else F.col(column)


def described(peaks: DataFrame, tallied: DataFrame) -> DataFrame:
    """All columns of the peaks, counts of each side, the dominant annotations, and spanning counts."""
    return peaks.join(tallied, "peak_id", "left").select(*peaks.columns, *(_filled(c) for c in _tally_types() if c != "peak_id"))


def peak_annotation_summary(peaks: DataFrame, annotated: DataFrame) -> DataFrame:
    """The peaks described by annotated targets that are there; ``peak_tallies`` needn't make them."""
    # Annotated targets have one row for each peak and target, and a side once: rows are targets.
    return described(peaks, _tallied(_values(with_title_labels(annotated))))


def contradicted() -> Column:
    """Whether the counts of a peak's summary contradict each other."""
    sums = [(f"{s}_target_count", [f"{s}_observed_target_count"]) for s in ("end", "start", "spanning")]
    sums += [(f"{s}_observed_target_count", [f"{s}_diamond_hit_target_count", f"{s}_no_diamond_hit_target_count"]) for s in ("end", "start", "spanning")]
    sums += [(f"{s}_diamond_hit_target_count", [f"{s}_best_hit_viral_target_count", f"{s}_best_hit_not_viral_target_count"]) for s in ("end", "start")]
    return reduce(lambda a, b: a | b, (F.col(total) != reduce(lambda x, y: x + y, map(F.col, parts)) for total, parts in sums))


def summary_mismatches(summary: DataFrame) -> DataFrame:
    """One row, mismatches: peaks whose summary counts contradict each other."""
    return summary.agg(F.count_if(contradicted()).alias("mismatches"))


def summary_diagnostics(summary: DataFrame) -> DataFrame:
    """How many peaks have different dominant values on their sides, for four annotations."""
    names = ("best_domain", "best_viral_family", "viral_protein_role", "best_viral_species")
    return summary.agg(F.count("*").alias("peaks"), *(F.count_if(F.col(f"end_dominant_{n}") != F.col(f"start_dominant_{n}")).alias(f"different_{n}") for n in names))
