"""Titles, dominant annotations, rules, layouts and pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import titles as ti
from spanloom.operators import annotations as an
from spanloom.operators import profile as pr
from spanloom.operators import rules as ru
from spanloom.operators import targets as tg
from spanloom.schemas import InputError

TITLES = {
    "RNA-dependent RNA polymerase [Virus X]": ("rdrp", [], False),
    "hypothetical protein [Virus X]": ("unknown", [], False),
    "segment L protein [Virus X]": ("unknown", ["L"], False),
    "RdRp and helicase VP12a vp 3 NSs NS5 gn Gc": ("rdrp", ["VP12A", "VP3", "NSs", "NS5", "Gn", "Gc"], True),
    "nonstructural polyprotein": ("polyprotein", [], False),
    "non-structural protein NSm": ("nonstructural", ["NSm"], False),
    "M-segment envelope protein, segment S": ("glycoprotein", ["M", "S"], False),
    "capsids": ("unknown", [], False),
    "  ": (None, [], False),
    None: (None, [], False),
}


def test_titles(spark):
    df = spark.createDataFrame([(t,) for t in TITLES], "t string")
    got = df.select("t", *(c.alias(n) for n, c in ti.title_labels(F.col("t")).items()), ti.joined_tokens(F.col("t")).alias("j")).collect()
    for r in got:
        role, tokens, ambiguous = TITLES[r.t]
        assert (r.viral_protein_role, r.viral_protein_named_tokens, r.viral_protein_role_ambiguous) == (role, tokens, ambiguous), r.t
        assert r.j == ("|".join(tokens) if tokens else None)


def test_trimming_takes_spaces_of_any_script(spark):
    values = ["\u00a0 a b \u3000", "\tx ", "\u2003", " n/A ", None]
    got = [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "v string").select(ti.trimmed(F.col("v")), ti.is_missing_label(F.col("v"))).collect()]
    assert got == [("a b", False), ("\tx", False), ("", True), ("n/A", True), (None, None)]


def test_dominant_value_ties_and_hot_members(spark):
    rows = [("g", "b", "m1"), ("g", "b", "m1"), ("g", "a", "m2"), ("g", "c", None), ("h", "z", "m1"), ("h", "z", "m2"), ("h", "y", "m3")]
    got = {r.k: r for r in an.dominant_value(spark.createDataFrame(rows, "k string, v string, m string"), ["k"], "v", "m").collect()}
    assert (got["g"].v, got["g"].value_count, got["g"].fraction, got["g"].distinct_count) == ("a", 1, 0.5, 3)
    assert (got["h"].v, got["h"].value_count) == ("z", 2)


def summary_row(**changes):
    base = {"peak_id": "p", "query_id": "q", "query_length": 1000, "peak_position": 500, "score_geometry": "local", "peak_score": 5, "end_target_count": 5, "start_target_count": 5, "directional_b_score": 3, "overlap_b_score": 1, "spanning_target_count": 0}
    for s in ("end", "start"):
        for n in ru.COMPARED.values():
            base |= {f"{s}_dominant_{n}": f"{s}-{n}" if n == "best_domain" else "same", f"{s}_dominant_{n}_target_count": 4, f"{s}_dominant_{n}_fraction_among_nonmissing": 0.9}
    return base | changes


def decide(spark, *rows, t=ru.DEFAULTS, **more):
    kinds = {int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in summary_row().items())
    df = spark.createDataFrame([tuple(summary_row(**r).values()) for r in rows], schema)
    return {r.peak_id: r for r in ru.peak_decisions(df, t=t, **more).collect()}


def test_actions_and_reasons(spark):
    got = decide(
        spark,
        {"peak_id": "differs"}, {"peak_id": "blocked", "spanning_target_count": 1}, {"peak_id": "few", "end_target_count": 2}, {"peak_id": "weak", "directional_b_score": 1},
        {"peak_id": "alike", "end_dominant_best_domain": "x", "start_dominant_best_domain": "x"}, {"peak_id": "missing", "end_dominant_best_domain": None},
        {"peak_id": "end", "score_geometry": "one_sided_end", "peak_score": 10, "peak_position": 800, "end_target_count": 2}, {"peak_id": "start", "score_geometry": "one_sided_start", "peak_score": 10, "peak_position": 200, "end_target_count": 2}, {"peak_id": "start2", "score_geometry": "one_sided_start", "peak_score": 10, "peak_position": 201, "end_target_count": 2},
    )
    assert {k: r.decision_reason for k, r in got.items()} == {
        "differs": "quarantine_rules:two_sided_different_diamond_annotations", "blocked": "quarantine_blocked_by:targets_span_peak", "few": "review_rules:insufficient_end_or_start_targets", "weak": "review_rules:weak_directional_and_overlap_scores",
        "alike": "review_rules:no_clear_diamond_annotation_difference", "missing": "review_rules:no_clear_diamond_annotation_difference", "end": "quarantine_rules:strong_one_sided_end", "start": "review_rules:insufficient_end_or_start_targets", "start2": "quarantine_rules:strong_one_sided_start",
    }
    assert got["blocked"].matched_quarantine_rules == ["two_sided_different_diamond_annotations"] and got["blocked"].peak_action == "review"
    assert got["missing"].end_start_best_domain_relation == "end_missing"
    # The review rules and the two-sided rule part all peaks among them.
    for r in got.values():
        assert len(r.matched_review_rules) + ("two_sided_different_diamond_annotations" in r.matched_quarantine_rules) == 1


def test_thresholds_are_checked():
    for bad in ({"max_spanning_target_count": -1}, {"min_dominant_annotation_fraction": 0.0}, {"min_alternative_union_coverage_fraction": 1.1}, {"min_one_sided_score": 0}):
        with pytest.raises(InputError):
            ru.Thresholds(**bad)


LAYOUT = "peak_id string, alternative_query_id string, end_target_count long, start_target_count long, alternative_union_coverage_fraction double, projected_orientation_relation string, oriented_endpoint_order string, linear_end_to_start_gap_nt long, sequence_end_end_to_start_gap_nt long"


def test_layouts(spark):
    rows = [
        ("p", "a", 3, 9, 0.5, None, "end_before_start", 300, None), ("p", "b", 3, 9, 0.6, "same", "start_before_end", None, 0), ("p", "c", 9, 9, 0.39, "same", "end_before_start", 0, 0), ("p", "d", 9, 9, 0.9, "mixed", "end_before_start", 0, 0),
        ("p", "e", 9, 9, 0.9, "same", "end_before_start", 301, 0), ("p", "f", 9, 9, 0.9, "same", None, 0, 0), ("q", "a", 2, 9, 0.9, "same", "end_before_start", 0, 0),
    ]
    got = ru.nearby_layouts(spark.createDataFrame(rows, LAYOUT)).collect()
    assert [(r.peak_id, r.nearby_two_sided_alternative_count, r.best_nearby_alternative_query_id, r.best_nearby_alternative_gap_kind, r.best_nearby_alternative_gap_nt) for r in got] == [("p", 2, "b", "fasta_end_gap", 0)]


def test_pairs_and_optional_inputs(spark):
    peaks = [{"peak_id": "e", "query_id": "A", "score_geometry": "one_sided_end"}, {"peak_id": "s", "query_id": "B", "score_geometry": "one_sided_start"}, {"peak_id": "x", "query_id": "B"}]
    links = [(p, q, f"t{k}", r) for k in range(3) for p, q, r in (("e", "A", "B"), ("s", "B", "A"))] + [("e", "A", "t0", "B"), ("x", "B", "t1", "A")]
    link_table = spark.createDataFrame(links, "peak_id string, source_query_id string, target_id string, alternative_query_id string")
    got = decide(spark, *peaks, links=link_table, layouts=spark.createDataFrame([], LAYOUT))
    assert (got["e"].reciprocal_one_sided_pair_count, got["e"].maximum_reciprocal_shared_target_count, got["e"].reciprocal_one_sided_peak_ids) == (1, 3, ["s"])
    assert got["s"].reciprocal_one_sided_query_ids == ["A"] and got["s"].rule_reciprocal_one_sided_pair
    assert got["x"].reciprocal_one_sided_peak_ids == [] and got["x"].nearby_two_sided_alternative_count == 0


def test_representative_actions(spark):
    rows = [{"peak_id": "p1", "query_id": "A"}, {"peak_id": "p0", "query_id": "A", "peak_position": 600}, {"peak_id": "p2", "query_id": "A", "spanning_target_count": 2}, {"peak_id": "p3", "query_id": "B", "end_target_count": 0}]
    kinds = {int: "long", float: "double", str: "string"}
    df = spark.createDataFrame([tuple(summary_row(**r).values()) for r in rows], ", ".join(f"{k} {kinds[type(v)]}" for k, v in summary_row().items()))
    decisions = ru.peak_decisions(df, check=True)
    summary = spark.createDataFrame([("A", 9), ("B", 9), ("C", None)], "representative_contig_id string, query_length long")
    got = {r.query_id: r for r in ru.representative_actions(summary, ru.query_actions(decisions)).collect()}
    assert (got["A"].representative_action, got["A"].action_peak_ids, got["A"].quarantine_peak_count, got["A"].review_peak_count) == ("quarantine", ["p1", "p0"], 2, 1)
    assert (got["B"].representative_action, got["B"].action_peak_ids) == ("review", ["p3"])
    assert (got["C"].representative_action, got["C"].peak_count, got["C"].matched_review_rules) == ("no_selected_boundary", 0, [])
    with pytest.raises(InputError):
        ru.representative_actions(summary.union(summary), ru.query_actions(decisions), check=True)
    counts = {(r.rule_kind, r.rule_name): r.peak_count for r in ru.rule_match_counts(decisions).collect()}
    assert counts["matched_quarantine_rules", "two_sided_different_diamond_annotations"] == 3
    with pytest.raises(InputError):
        ru.peak_decisions(df.union(df), check=True)


def test_links_take_all_queries(spark):
    """A hot target on 30 queries of any id, and pairs of queries that share three."""
    from spanloom.plans import fixtures as fx

    ids = [f"Q{k}" for k in range(15, 45)]
    held = {q: {"hot", *(f"t{n // 2}_{k}" for k in range(2))} for n, q in enumerate(ids)}
    kind = {q: ("end", "start")[n % 2] for n, q in enumerate(ids)}
    alignments = spark.createDataFrame([(q, t) for q in ids for t in sorted(held[q])], "query_id string, target_id string")
    targets = spark.createDataFrame([(f"p{q}", q, t, f"one_sided_{kind[q]}", kind[q] == "end", kind[q] == "start") for q in ids for t in sorted(held[q])], "peak_id string, query_id string, target_id string, score_geometry string, enters_peak_end_count boolean, enters_peak_start_count boolean")
    links = spark.sql(fx.LINKS, targets=targets, alignments=alignments)
    assert {tuple(r) for r in links.collect()} == {(f"p{q}", q, t, o) for q in ids for o in ids if o != q for t in held[q] & held[o]}
    got = {r.peak_id: (r.reciprocal_one_sided_peak_ids, r.maximum_reciprocal_shared_target_count) for r in ru.reciprocal_pairs(targets.select("peak_id", "score_geometry").distinct(), links).collect()}
    assert got == {f"p{q}": ([f"p{ids[n ^ 1]}"], 3) for n, q in enumerate(ids)}


def test_a_target_of_ten_thousand_queries(spark):
    """Routes over one shared target alone are counted and dropped before targets are joined."""
    n, near = 10_000, 12
    kind = lambda k: ("end", "start")[k % 2]
    peaks = spark.createDataFrame([(f"p{k}", f"one_sided_{kind(k)}") for k in range(n)], "peak_id string, score_geometry string")
    rows = [(f"p{k}", f"q{k}", "hot", f"q{(k + d) % n}") for k in range(n) for d in range(-near, near + 1) if d]
    true = range(0, n, 500)  # these share three targets with the next
    rows += [(f"p{a}", f"q{a}", f"t{k}_{j}", f"q{b}") for k in true for a, b in ((k, k + 1), (k + 1, k)) for j in range(2)]
    # An end peak that reaches three targets of a query that doesn't reach back, and one with others' targets.
    rows += [("p10", "q10", f"x{j}", "q21") for j in range(2)] + [("p20", "q20", f"y{j}", "q31") for j in range(2)] + [("p31", "q31", f"z{j}", "q20") for j in range(2)]
    links = spark.createDataFrame(rows, "peak_id string, source_query_id string, target_id string, alternative_query_id string")
    viable = ru.viable_pairs(*ru.routes(peaks, links), 3)
    assert {(r.end_peak_id, r.start_peak_id) for r in viable.collect()} == {(f"p{k}", f"p{k + 1}") for k in true} | {("p20", "p31")}
    got = {r.peak_id: (r.reciprocal_one_sided_peak_ids, r.maximum_reciprocal_shared_target_count) for r in ru.reciprocal_pairs(peaks, links.union(links)).collect()}
    assert got == {f"p{a}": ([f"p{b}"], 3) for k in true for a, b in ((k, k + 1), (k + 1, k))}


def test_a_summary_shuffles_nothing_after_the_join(spark):
    """Peaks multiply targets; all shuffles of what they give, and of its summary, must come before that."""
    found = spark.createDataFrame([(f"{q}:{p}", q, 400, p, 10, "local") for q in ("q0", "q1") for p in (30, 90, 200)], "peak_id string, query_id string, query_length long, peak_position long, radius_nt long, score_geometry string")
    hits = spark.createDataFrame([(f"q{k % 2}", f"t{k % 9}", 25 + k, 90 + k) for k in range(40)], "query_id string, target_id string, query_from int, query_to int")
    columns = {"qseqid": [f"t{k}" for k in range(5)], "has_viral_hit": [True] * 5, "best_hit_is_viral": [False] * 5, **{c: [f" {c} {k % 2} " if k % 3 else None for k in range(5)] for c in an.ANNOTATION_TEXT}}
    notes = spark.createDataFrame(pa.table(columns))
    joined = an.annotated_peak_targets(found, hits, an.with_present(an.with_title_labels(notes)))
    plain = an.annotated_targets(tg.peak_targets(found, hits), notes)
    both = [sorted(map(str, df.select(*plain.columns).collect())) for df in (joined, plain)]
    assert both[0] == both[1]
    tallied = an._tallied(an._values(joined))
    plan = tallied._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Join")[0]
    assert sorted(map(str, tallied.collect())) == sorted(map(str, an._tallied(an._values(an.with_title_labels(plain))).collect()))


def described_by_chance(seed=3):
    """Peaks of every geometry, alignments (some targets have several, one has no name), and notes with equals, blanks and nulls."""
    r = random.Random(seed)
    peaks = [(f"{q}:{g}:{p}", q, 400, p, 10, g) for q in ("q0", "q1", "q2", "bare", None) for g in pr.GEOMETRIES for p in (12, 90, 91, 200, 389)]
    hits = [(q, r.choice([None, *(f"t{k}" for k in range(30))]), f, f + r.choice([5, 60, 108, 300])) for q in ("q0", "q1", "q1", "q1", "q2", "other", None) for f in (r.randint(1, 210) for _ in range(25))]
    text = lambda: r.choice([None, "", " ", "n/a", " é ", "e", "Z", "z", "\U0001f600", "\uffff"])
    notes = [(f"t{k}" if k else None, r.choice([True, False, None]), r.choice([True, False, None]), *(text() for _ in an.ANNOTATION_TEXT[:-1]), r.choice([*TITLES])) for k in range(24)]
    return peaks, hits, notes


@pytest.mark.parametrize("listed", [tg.LISTED, 30, 0])
def test_dominant_values_without_rows_of_peaks_and_targets(spark, monkeypatch, listed):
    """Counted where alignments meet peaks, they are those of the annotated targets, also of queries that are dealt in parts."""
    peaks, hits, notes = described_by_chance()
    peaks = spark.createDataFrame(peaks, "peak_id string, query_id string, query_length long, peak_position long, radius_nt long, score_geometry string")
    hits = spark.createDataFrame(hits, "query_id string, target_id string, query_from int, query_to int")
    notes = spark.createDataFrame(notes, "qseqid string, has_viral_hit boolean, best_hit_is_viral boolean, " + ", ".join(f"{c} string" for c in an.ANNOTATION_TEXT))
    annotated = an.with_title_labels(an.annotated_targets(tg.peak_targets(peaks, hits), notes))
    want = an.dominant_annotations(an.annotation_long(an.by_side(annotated), ("query_id",))), an.peak_annotation_summary(peaks, annotated)
    monkeypatch.setattr(tg, "LISTED", listed)
    tallied = an.peak_tallies(peaks, hits, notes)
    for got, due in zip((an.dominant_of_tallies(tallied), an.described(peaks, tallied)), want, strict=True):
        assert got.columns == due.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, due.collect()))
    assert want[0].count() > 100
    if listed > 30:
        plan = tallied._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" in plan and "Generate" not in plan


def test_tallies_take_some_peaks_at_a_time(monkeypatch):
    peaks, hits, _ = described_by_chance()
    rows = pa.table({"target_id": [h[1] for h in hits], "query_from": [h[2] for h in hits], "query_to": [h[3] for h in hits], "kinds": [1 + k % 2 * 4 for k in range(len(hits))], **{c: pa.array([None if k % 7 == 0 else str(k % 5) for k in range(len(hits))]) for c in an.SUMMARISED}})
    keys = pa.table(dict(zip(tg.PEAK_KEYS, zip(*[(p[0], p[1], *p[2:]) for p in peaks]), strict=True)))
    whole = an._tallied_query(rows, keys)
    monkeypatch.setattr(an, "_CELLS", 400)
    assert an._tallied_query(rows, keys).equals(whole.combine_chunks()) and whole.num_rows == len(peaks)


def test_pairs_by_targets_are_those_by_links(spark):
    """Several peaks a query, targets on one side only, and pairs within a query, which don't count."""
    from spanloom.plans import fixtures as fx

    held = {(f"Q{q}", side, k): {f"t{(q * 5 + k * 3 + j * j) % 11}" for j in range(6)} for q in range(8) for side in ("end", "start") for k in range(2) if (q + k) % 3}
    name = lambda q, side, k: f"{q}:{side}{k}"
    rows = [(name(*p), p[0], t, f"one_sided_{p[1]}", (p[1] == "end") == (t != "t3"), p[1] == "start") for p, ts in held.items() for t in sorted(ts)]
    targets = spark.createDataFrame(rows, "peak_id string, query_id string, target_id string, score_geometry string, enters_peak_end_count boolean, enters_peak_start_count boolean")
    peaks = targets.select("peak_id", "query_id", "score_geometry").distinct()
    links = spark.sql(fx.LINKS, targets=targets, alignments=targets.select("query_id", "target_id").distinct())
    got, want = (sorted(map(str, df.collect())) for df in (ru.reciprocal_pairs_of_targets(peaks, targets), ru.reciprocal_pairs(peaks, links)))
    assert got == want and len(got) > 4


def test_notes_are_joined_in_as_many_tasks_as_peaks(spark):
    peaks = spark.createDataFrame([("p", "q", 900, 400, 50, "local")], "peak_id string, query_id string, query_length long, peak_position long, radius_nt long, score_geometry string")
    hits = spark.createDataFrame([("q", f"t{k}", 10, 400) for k in range(5)], "query_id string, target_id string, query_from int, query_to int")
    notes = spark.createDataFrame([("t1", "x"), ("t9", "y")], "target_id string, note string")
    df = tg.peak_targets(peaks, hits, notes)
    assert {r.target_id: r.note for r in df.collect()} == {f"t{k}": "x" if k == 1 else None for k in range(5)}
    assert "RepartitionByExpression [target_id" in df._jdf.queryExecution().optimizedPlan().toString()
