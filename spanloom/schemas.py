"""Column contracts of the tables, and checks of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InputError(ValueError):
    """An input that breaks its contract."""


# The columns of the public table layouts, in their order.
RAW_ALIGNMENT = "query_id string, target_id string, identity_pct double, aligned_length int, query_start int, query_end int, query_length int, target_start int, target_end int, target_length int, query_coverage double, target_coverage double, evalue double, bitscore double"
SCORING_COLUMNS = ("query_id", "target_id", "query_length", "query_from", "query_to")
ANNOTATION_TEXT = ("best_domain", "best_family", "best_genus", "best_species", "best_title", "best_viral_family", "best_viral_genus", "best_viral_species", "best_viral_title")
ANNOTATION_COLUMNS = ("qseqid", "has_viral_hit", "best_hit_is_viral", *ANNOTATION_TEXT)
SUMMARISED = (*ANNOTATION_TEXT, "viral_protein_role", "viral_protein_named_tokens")
MEASURES = ("local_end_target_count", "local_start_target_count", "directional_end_target_count", "directional_start_target_count", "overlap_end_target_count", "overlap_start_target_count", "internal_end_target_count", "internal_start_target_count", "spanning_target_count")
PROFILE_MEASURES = ("local_end_target_count", "local_start_target_count", "local_b_score", "directional_end_target_count", "directional_start_target_count", "directional_b_score", "overlap_end_target_count", "overlap_start_target_count", "overlap_b_score", "internal_end_target_count", "internal_start_target_count", "one_sided_end_score", "one_sided_start_score", "spanning_target_count")
PROFILE_COLUMNS = ("query_id", "query_length", "boundary_position", "radius_nt", *PROFILE_MEASURES)
LAYOUT_COLUMNS = ("peak_id", "alternative_query_id", "end_target_count", "start_target_count", "alternative_union_coverage_fraction", "projected_orientation_relation", "oriented_endpoint_order", "linear_end_to_start_gap_nt", "sequence_end_end_to_start_gap_nt")
LINK_COLUMNS = ("peak_id", "source_query_id", "target_id", "alternative_query_id")


def require_columns(df: DataFrame, columns, name: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InputError(f"{name}: missing columns {missing}")
    return df


def key_faults(df: DataFrame, *keys: str) -> DataFrame:
    """One row, n_faults: rows that a distinct, complete key would not have."""
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return df.agg((F.count("*") - F.count_distinct(key)).alias("n_faults"))


def require_key(df: DataFrame, *keys: str, name: str) -> DataFrame:
    """Raises where a key repeats or (single keys) is null."""
    if n := key_faults(df, *keys).first().n_faults:
        raise InputError(f"{name}: {n} rows with a repeated or missing {', '.join(keys)}")
    return df


def faults(df: DataFrame, name: str, *, columns=(), key: tuple[str, ...] = (), rules: dict[str, Column] | None = None) -> DataFrame:
    """table_name, fault, n_rows, example of each fault of a table; no rows if it has none.

    Faults are columns that are missing, rows without a part of the key, rows beyond the first of a key,
    and rows for which one of ``rules`` holds. The table is read once and shuffled once, a row for each key
    and task; ``example`` is the smallest key (null without one).
    """
    rules, spark = rules or {}, df.sparkSession
    lost = sorted(set(columns) - set(df.columns))
    held = [k for k in key if k in df.columns]
    usable = {k: v for k, v in rules.items() if _resolves(df, v)}
    # The parts of a key, joined: text for the examples.
    shown = F.concat_ws(", ", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in held)) if held else F.lit(None).cast("string")
    per = df.groupBy(*held).agg(F.count("*").alias("rows"), *(F.count_if(v).alias(f"r{k}") for k, v in enumerate(usable.values())))
    absent = reduce(Column.__or__, (F.col(k).isNull() for k in held), F.lit(False))
    text = ", ".join(held)
    kinds = [(f"missing {text}", F.when(absent, F.col("rows"))), (f"repeated {text}", F.when(~absent, F.col("rows") - 1))] if held and len(held) == len(key) else []
    kinds += [(k, F.col(f"r{j}")) for j, k in enumerate(usable)]
    found = [F.struct(F.lit(k).alias("fault"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_rows"), F.min(F.when(n > 0, shown)).alias("example")) for k, n in kinds]
    out = per.agg(F.array(*found).alias("x")).select(F.inline("x")).where("n_rows > 0") if found else spark.createDataFrame([], "fault string, n_rows long, example string")
    gone = spark.createDataFrame([(f"no column {c}", None, None) for c in lost], "fault string, n_rows long, example string")
    return out.unionByName(gone).select(F.lit(name).alias("table_name"), "fault", "n_rows", "example")


def _resolves(df: DataFrame, condition: Column) -> bool:
    """Whether the table has the columns that a condition reads."""
    from pyspark.errors import AnalysisException

    try:
        return bool(df.select(condition).columns)
    except AnalysisException:
        return False


def require_valid(df: DataFrame, name: str, **what) -> DataFrame:
    """Raises with all faults of a table."""
    if found := faults(df, name, **what).orderBy("fault").collect():
        said = "; ".join(r.fault if r.n_rows is None else f"{r.n_rows} rows: {r.fault}" + (f" (first: {r.example})" if r.example is not None else "") for r in found)
        raise InputError(f"{name}: {said}")
    return df
