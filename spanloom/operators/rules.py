"""Rules that label peaks, and the action of each representative."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.runtime import written
from spanloom.schemas import LAYOUT_COLUMNS, LINK_COLUMNS, InputError, require_columns, require_key


@dataclass(frozen=True)
class Thresholds:
    # The defaults of the rules.
    max_spanning_target_count: int = 0
    min_end_start_target_count: int = 3
    min_directional_or_overlap_b_score: int = 2
    min_dominant_annotation_fraction: float = 0.8
    min_alternative_union_coverage_fraction: float = 0.4
    max_alternative_gap_nt: int = 300
    min_one_sided_score: int = 10
    min_unsupported_extension_nt: int = 200

    def __post_init__(self):
        for name, value in asdict(self).items():
            fraction = name.endswith("_fraction")
            low = 0 if name.startswith("max_") else 1
            if not (0 < value <= 1 if fraction else value >= low):
                raise InputError(f"{name} must be {'in (0, 1]' if fraction else f'at least {low}'}")


DEFAULTS = Thresholds()

COMPARED = {"domain": "best_domain", "viral_family": "best_viral_family", "protein_role": "viral_protein_role"}
QUARANTINE_RULES = ("two_sided_different_diamond_annotations", "strong_one_sided_end", "strong_one_sided_start")
BLOCKERS = ("targets_span_peak",)
REVIEW_RULES = ("insufficient_end_or_start_targets", "weak_directional_and_overlap_scores", "no_clear_diamond_annotation_difference")
LISTS = {"matched_quarantine_rules": QUARANTINE_RULES, "matched_quarantine_blockers": BLOCKERS, "matched_review_rules": REVIEW_RULES}
_MEASURED = ("peak_id", "query_id", "query_length", "peak_position", "score_geometry", "peak_score", "end_target_count", "start_target_count", "directional_b_score", "overlap_b_score", "spanning_target_count")


def sure(c: Column) -> Column:
    """A comparison that a missing value fails, so that its negation holds."""
    return F.coalesce(c, F.lit(False))


def with_relations(summary: DataFrame) -> DataFrame:
    """How the dominant values of the two sides compare; relations that are there already stay."""
    new = {}
    for name in COMPARED.values():
        if f"end_start_{name}_relation" in summary.columns:
            continue
        require_columns(summary, (f"end_dominant_{name}", f"start_dominant_{name}"), "peak summary")
        a, b = F.col(f"end_dominant_{name}"), F.col(f"start_dominant_{name}")
        new[f"end_start_{name}_relation"] = F.when(a.isNull() & b.isNull(), "both_missing").when(b.isNull(), "start_missing").when(a.isNull(), "end_missing").when(a == b, "same").otherwise("different")
    return summary.withColumns(new)


def with_differences(peaks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Where both sides have a clear dominant value and the two differ."""

    def clear(side: str, name: str) -> Column:
        stem = f"{side}_dominant_{name}"
        return sure((F.col(f"{stem}_target_count") >= t.min_end_start_target_count) & (F.col(f"{stem}_fraction_among_nonmissing") >= t.min_dominant_annotation_fraction))

    flags = {f"different_clear_{short}": sure(F.col(f"end_start_{name}_relation") == "different") & clear("end", name) & clear("start", name) for short, name in COMPARED.items()}
    return peaks.withColumns(flags).withColumn("different_clear_diamond_annotation", reduce(lambda a, b: a | b, map(F.col, flags)))


def with_flags(peaks: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Every rule as a column of its own."""
    many = lambda side: F.col(f"{side}_target_count") >= t.min_end_start_target_count
    out = peaks.withColumns({
        "maximum_directional_or_overlap_b_score": F.greatest("directional_b_score", "overlap_b_score"),
        "enough_end_start_targets": sure(many("end") & many("start")),
        "has_spanning_targets": sure(F.col("spanning_target_count") > t.max_spanning_target_count),
    }).withColumn("enough_directional_or_overlap_b_score", sure(F.col("maximum_directional_or_overlap_b_score") >= t.min_directional_or_overlap_b_score))
    if "nearby_two_sided_alternative_count" in peaks.columns:
        near = F.col("nearby_two_sided_alternative_count") > 0
        out = out.withColumns({"has_nearby_two_sided_alternative": near, "rule_nearby_two_sided_alternative": near})
    if "reciprocal_one_sided_pair_count" in peaks.columns:
        out = out.withColumn("rule_reciprocal_one_sided_pair", F.col("reciprocal_one_sided_pair_count") > 0)
    geometry = F.col("score_geometry")
    beyond = F.when(geometry == "one_sided_end", F.col("query_length") - F.col("peak_position")).when(geometry == "one_sided_start", F.col("peak_position") - 1).otherwise(0)
    out = out.withColumn("unsupported_extension_nt", beyond.cast("long"))
    strong = sure((F.col("peak_score") >= t.min_one_sided_score) & (F.col("unsupported_extension_nt") >= t.min_unsupported_extension_nt))
    enough, scored, differs = F.col("enough_end_start_targets"), F.col("enough_directional_or_overlap_b_score"), F.col("different_clear_diamond_annotation")
    return out.withColumns({
        "rule_targets_span_peak": F.col("has_spanning_targets"),
        "rule_two_sided_different_diamond_annotations": enough & scored & differs,
        "rule_strong_one_sided_end": sure(geometry == "one_sided_end") & strong,
        "rule_strong_one_sided_start": sure(geometry == "one_sided_start") & strong,
        "rule_insufficient_end_or_start_targets": ~enough,
        "rule_weak_directional_and_overlap_scores": enough & ~scored,
        "rule_no_clear_diamond_annotation_difference": enough & scored & ~differs,
    })


def with_decision(peaks: DataFrame) -> DataFrame:
    """Names of the rules that hold, action and reason: a blocker outweighs quarantine, quarantine review."""
    out = peaks.withColumns({c: F.array_compact(F.array(*(F.when(F.col(f"rule_{r}"), F.lit(r)) for r in rules))) for c, rules in LISTS.items()})
    blocked, held = F.size("matched_quarantine_blockers") > 0, F.size("matched_quarantine_rules") > 0
    reason = lambda head, c: F.concat(F.lit(head), F.array_join(c, ","))
    return out.withColumns({
        "peak_action": F.when(~blocked & held, "quarantine").otherwise("review"),
        "decision_reason": F.when(blocked, reason("quarantine_blocked_by:", "matched_quarantine_blockers")).when(held, reason("quarantine_rules:", "matched_quarantine_rules")).otherwise(reason("review_rules:", "matched_review_rules")),
    })


def marked_layouts(layouts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Layouts with the kind and size of their gap, and whether they are near enough to count."""
    require_columns(layouts, LAYOUT_COLUMNS, "alternative layouts")
    within = lambda c: sure(F.col(c).between(0, t.max_alternative_gap_nt))
    inside = sure(F.col("oriented_endpoint_order") == "end_before_start") & within("linear_end_to_start_gap_nt")
    around = sure(F.col("oriented_endpoint_order") == "start_before_end") & within("sequence_end_end_to_start_gap_nt")
    enough = reduce(lambda a, b: a & b, (sure(F.col(f"{s}_target_count") >= t.min_end_start_target_count) for s in ("end", "start")))
    covered = sure(F.col("alternative_union_coverage_fraction") >= t.min_alternative_union_coverage_fraction)
    one_way = ~F.col("projected_orientation_relation").eqNullSafe("mixed")
    return layouts.withColumns({
        "alternative_gap_kind": F.when(around, "fasta_end_gap").when(inside, "internal_gap"),
        "alternative_gap_nt": F.when(around, F.col("sequence_end_end_to_start_gap_nt")).when(inside, F.col("linear_end_to_start_gap_nt")).cast("long"),
        "is_nearby_two_sided_alternative_layout": enough & covered & one_way & (inside | around),
    })


def nearby_layouts(layouts: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """One row for each peak with a near layout: how many, and the best of them."""
    near = marked_layouts(layouts, t).where("is_nearby_two_sided_alternative_layout")
    best = F.min_by(
        F.struct("alternative_query_id", "alternative_gap_kind", "alternative_gap_nt", F.col("alternative_union_coverage_fraction").alias("union_coverage_fraction"), "end_target_count", "start_target_count"),
        F.struct(-F.least("end_target_count", "start_target_count"), -F.col("alternative_union_coverage_fraction"), F.col("alternative_gap_nt"), F.col("alternative_query_id")),
    )
    out = near.groupBy("peak_id").agg(F.count("*").alias("nearby_two_sided_alternative_count"), best.alias("b"))
    names = {"query_id": "alternative_query_id", "gap_kind": "alternative_gap_kind", "gap_nt": "alternative_gap_nt", "union_coverage_fraction": "union_coverage_fraction", "end_target_count": "end_target_count", "start_target_count": "start_target_count"}
    return out.select("peak_id", "nearby_two_sided_alternative_count", *(F.col(f"b.{c}").alias(f"best_nearby_alternative_{n}") for n, c in names.items()))


def routes(peaks: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of end peaks and of start peaks: peak, its query, the query reached, and the target."""
    own = links.select(*LINK_COLUMNS).distinct().join(peaks.select("peak_id", "score_geometry"), "peak_id")
    side = lambda a, b: own.where(f"score_geometry = 'one_sided_{a}'").select(F.col("peak_id").alias(f"{a}_peak_id"), F.col("source_query_id").alias(f"{a}_query_id"), F.col("alternative_query_id").alias(f"{b}_query_id"), "target_id")
    return side("end", "start"), side("start", "end")


def viable_pairs(ends: DataFrame, starts: DataFrame, least: int) -> DataFrame:
    """end_peak_id, start_peak_id, end_query_id, start_query_id of peaks that reach each other's queries by ``least`` targets each.

    Only these can share as many: routes are counted before any target is joined, so a target that very many
    queries have costs no more than its links.
    """
    queries = ["end_query_id", "start_query_id"]
    enough = lambda rows, peak: rows.groupBy(peak, *queries).agg(F.count("target_id").alias("n")).where(F.col("n") >= least).drop("n")
    return enough(ends, "end_peak_id").join(enough(starts, "start_peak_id"), queries)


def reciprocal_pairs(peaks: DataFrame, links: DataFrame, t: Thresholds = DEFAULTS, *, check: bool = False) -> DataFrame:
    """One row for each one-sided peak with partners: an end peak of one query and a start peak of another that
    reach each other through enough shared targets. ``check`` makes sure of one row a peak first."""
    require_columns(links, LINK_COLUMNS, "alternative links")
    if check:
        require_key(peaks, "peak_id", name="peaks")
    spark = links.sparkSession
    ends, starts = (written(spark, rows, name) for rows, name in zip(routes(peaks, links), ("end-routes", "start-routes"), strict=True))
    viable = written(spark, viable_pairs(ends, starts, t.min_end_start_target_count), "viable-pairs")
    keys = ["end_query_id", "start_query_id"]
    held = [rows.join(viable, [f"{side}_peak_id", *keys], "left_semi") for side, rows in (("end", ends), ("start", starts))]
    # A route is there once, so rows are targets.
    pairs = held[0].join(held[1], [*keys, "target_id"]).groupBy("end_peak_id", "start_peak_id", *keys).agg(F.count("target_id").alias("n")).where(F.col("n") >= t.min_end_start_target_count)
    return _partners(pairs)


def reciprocal_pairs_of_targets(peaks: DataFrame, targets: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """``reciprocal_pairs`` where the links of a one-sided peak are all other queries that its own side's targets align to.

    Then a target that enters an end peak of one query and a start peak of another is a route both ways, and no
    other is, so the peaks meet at their targets: no link is made. Peaks go by numbers until pairs are counted.
    """
    spark = targets.sparkSession
    kinds = {side: f"one_sided_{side}" for side in ("end", "start")}
    numbers = written(spark, peaks.where(F.col("score_geometry").isin(*kinds.values())).select("peak_id", "query_id", F.monotonically_increasing_id().alias("number")), "peak-numbers")
    sides = {}
    for side, kind in kinds.items():
        own = targets.where((F.col("score_geometry") == kind) & F.col(f"enters_peak_{side}_count")).select("query_id", "peak_id", "target_id")
        own = own.join(numbers, ["query_id", "peak_id"]).select("target_id", F.col("query_id").alias(f"{side}_query_id"), F.col("number").alias(f"{side}_number"))
        sides[side] = written(spark, own, f"{side}-targets")
    met = sides["end"].join(sides["start"], "target_id").where("end_query_id <> start_query_id")
    # A peak has a target once, so rows are targets.
    pairs = met.groupBy("end_number", "start_number").agg(F.count("*").alias("n")).where(F.col("n") >= t.min_end_start_target_count)
    for side in kinds:
        pairs = pairs.join(numbers.select(F.col("number").alias(f"{side}_number"), F.col("peak_id").alias(f"{side}_peak_id"), F.col("query_id").alias(f"{side}_query_id")), f"{side}_number")
    return _partners(pairs)


def _partners(pairs: DataFrame) -> DataFrame:
    """One row for each peak of pairs."""
    view = F.explode(F.array(
        F.struct(F.col("end_peak_id").alias("peak_id"), F.col("start_peak_id").alias("other"), F.col("start_query_id").alias("query")),
        F.struct(F.col("start_peak_id").alias("peak_id"), F.col("end_peak_id").alias("other"), F.col("end_query_id").alias("query")),
    ))
    both = pairs.select("n", view.alias("v")).select("n", "v.*")
    return both.groupBy("peak_id").agg(F.count_distinct("other").alias("reciprocal_one_sided_pair_count"), F.max("n").alias("maximum_reciprocal_shared_target_count"), F.array_sort(F.collect_set("other")).alias("reciprocal_one_sided_peak_ids"), F.array_sort(F.collect_set("query")).alias("reciprocal_one_sided_query_ids"))


def peak_decisions(summary: DataFrame, layouts: DataFrame | None = None, links: DataFrame | None = None, t: Thresholds = DEFAULTS, *, check: bool = False, partners: DataFrame | None = None) -> DataFrame:
    """The summary with relations, flags, thresholds, rule lists, action and reason.

    Layouts and links (or ``partners``, their reciprocal pairs) add descriptors and never change the action.
    ``check`` makes sure of one row a peak first.
    """
    peaks = require_columns(with_relations(summary), _MEASURED, "peak summary")
    if check:
        require_key(peaks, "peak_id", name="peak summary")
    if layouts is not None:
        peaks = peaks.join(nearby_layouts(layouts, t), "peak_id", "left").fillna(0, ["nearby_two_sided_alternative_count"])
    if partners is None and links is not None:
        partners = reciprocal_pairs(peaks, links, t)
    if partners is not None:
        peaks = peaks.join(partners, "peak_id", "left").fillna(0, ["reciprocal_one_sided_pair_count", "maximum_reciprocal_shared_target_count"])
        peaks = peaks.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("reciprocal_one_sided_peak_ids", "reciprocal_one_sided_query_ids")})
    flagged = with_flags(with_differences(peaks, t), t).withColumns({f"threshold_{k}": F.lit(v) for k, v in asdict(t).items()})
    return with_decision(flagged)


def rule_match_counts(decisions: DataFrame) -> DataFrame:
    """rule_kind, rule_name, peak_count."""
    named = lambda kind: F.transform(kind, lambda x: F.struct(F.lit(kind).alias("rule_kind"), x.alias("rule_name")))
    kinds = F.explode(F.concat(*map(named, LISTS)))
    return decisions.select(kinds.alias("r")).groupBy("r.rule_kind", "r.rule_name").agg(F.count("*").alias("peak_count"))


def query_actions(decisions: DataFrame) -> DataFrame:
    """One row for each query with peaks; any quarantined peak decides. Ids are those of the deciding peaks."""
    held = F.col("peak_action") == "quarantine"
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("peak_position", "score_geometry", "peak_id"))))
    out = decisions.groupBy("query_id").agg(
        F.count("*").alias("peak_count"), F.count_if(held).alias("quarantine_peak_count"), F.count_if(~held).alias("review_peak_count"), ids(held).alias("__q"), ids(~held).alias("__r"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in LISTS),
    )
    some = F.col("quarantine_peak_count") > 0
    return out.select("query_id", "peak_count", "quarantine_peak_count", "review_peak_count", F.when(some, "quarantine").otherwise("review").alias("representative_action"), F.transform(F.when(some, F.col("__q")).otherwise(F.col("__r")), lambda x: x["peak_id"]).alias("action_peak_ids"), *LISTS)


def representative_actions(boundary_summary: DataFrame, actions: DataFrame, *, check: bool = False) -> DataFrame:
    """Every representative; those without a peak are ``no_selected_boundary``.

    ``check`` makes sure of one row a representative on either side first.
    """
    if check:
        require_key(boundary_summary, "representative_contig_id", name="boundary summary")
        require_key(actions, "query_id", name="query actions")
    rows = boundary_summary.withColumnRenamed("representative_contig_id", "query_id").join(actions, "query_id", "left")
    counts, lists = ("peak_count", "quarantine_peak_count", "review_peak_count"), ("action_peak_ids", *LISTS)
    return rows.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in counts} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in lists} | {"representative_action": F.coalesce("representative_action", F.lit("no_selected_boundary"))})


def action_counts(actions: DataFrame) -> dict[str, int]:
    return {r.representative_action: r.n for r in actions.groupBy("representative_action").agg(F.count("*").alias("n")).collect()}
