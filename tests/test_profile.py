"""Counts over coordinates against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators import intervals as iv
from spanloom.operators import peaks as pk
from spanloom.operators import profile as pr
from spanloom.operators import targets as tg
from spanloom.operators.alignments import counts, normalised, typed
from spanloom.schemas import MEASURES

SCHEMA = "query_id string, target_id string, query_length int, query_from int, query_to int"


def brute(rows, r):
    """Every coordinate by the definition of each count."""
    out = {}
    for q in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == q), key=lambda x: (x[3], x[4], x[1] or ""))
        n = own[0][2]
        for b in range(1, n + 1):
            sets = {m: set() for m in MEASURES}
            for _, t, _, f, e in own:
                if t is None:
                    continue
                near_e, near_f = abs(b - e) <= r, abs(b - f) <= r
                for m, ok in (
                    ("local_end", near_e), ("local_start", near_f), ("directional_end", b - r <= e <= b), ("directional_start", b <= f <= b + r), ("overlap_end", b <= e <= b + r), ("overlap_start", b - r <= f <= b),
                    ("internal_end", near_e and e < n - r), ("internal_start", near_f and f > 1 + r), ("spanning", f <= b - r and e >= b + r),
                ):
                    if ok:
                        sets[f"{m}_target_count"].add(t)
            c = {m: len(s) for m, s in sets.items()}
            for g in ("local", "directional", "overlap"):
                c[f"{g}_b_score"] = min(c[f"{g}_end_target_count"], c[f"{g}_start_target_count"])
            lead = c["internal_end_target_count"] - c["internal_start_target_count"]
            inner = 1 + r < b < n - r
            c["one_sided_end_score"], c["one_sided_start_score"] = (max(lead, 0), max(-lead, 0)) if inner else (0, 0)
            out[q, b] = c
    return out


def same(spark, rows, r):
    hits = spark.createDataFrame(rows, SCHEMA)
    got = {(x.query_id, x.boundary_position): x.asDict() for x in pr.boundary_profile(hits, r).collect()}
    want = brute(rows, r)
    assert set(got) == set(want)
    for k, c in want.items():
        assert {m: got[k][m] for m in c} == c, k
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_profile_is_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for q, n in (("a", 40), ("b", 25), ("c", 7)):
        for _ in range(30):
            f = rng.randint(1, n)
            rows.append((q, rng.choice(["t1", "t2", "t3", None]), n, f, rng.randint(f, n)))
    same(spark, rows, rng.choice([1, 3, 10]))


def test_worked_cases(spark):
    ends = [("q", f"t{k}", 1000, 1, 500) for k in range(12)]
    got = same(spark, ends, 50)["q", 500]
    assert got["one_sided_end_score"] == 12 and got["one_sided_start_score"] == 0
    mixed = [("q", f"t{k}", 1000, 1, 500) for k in range(30)] + [("q", f"s{k}", 1000, 500, 990) for k in range(3)]
    assert same(spark, mixed, 50)["q", 500]["one_sided_end_score"] == 27
    even = [("q", f"t{k}", 1000, 1, 500) for k in range(12)] + [("q", f"s{k}", 1000, 500, 990) for k in range(12)]
    assert same(spark, even, 50)["q", 500]["one_sided_end_score"] == 0


def test_one_target_counts_once_and_two_rows_do_not_span(spark):
    rows = [("q", "t", 300, 1, 150), ("q", "t", 300, 1, 155), ("q", "t", 300, 160, 300)]
    got = same(spark, rows, 20)
    assert got["q", 150]["local_end_target_count"] == 1
    assert got["q", 158]["spanning_target_count"] == 0


def test_mirroring_swaps_sides(spark):
    rng = random.Random(5)
    rows = [("q", f"t{rng.randint(0, 4)}", 60, *sorted((rng.randint(1, 60), rng.randint(1, 60)))) for _ in range(25)]
    a = {x.boundary_position: x for x in pr.boundary_profile(spark.createDataFrame(rows, SCHEMA), 5).collect()}
    b = {x.boundary_position: x for x in pr.boundary_profile(spark.createDataFrame([(q, t, n, n + 1 - e, n + 1 - f) for q, t, n, f, e in rows], SCHEMA), 5).collect()}
    for p in a:
        for g in ("local", "directional", "overlap", "internal"):
            assert a[p][f"{g}_end_target_count"] == b[61 - p][f"{g}_start_target_count"]


def test_thresholds_give_the_passing_rows(spark):
    rng = random.Random(9)
    rows = [("q", f"t{rng.randint(0, 9)}", 80, *sorted((rng.randint(1, 80), rng.randint(1, 80)))) for _ in range(40)]
    hits, limits = spark.createDataFrame(rows, SCHEMA), {"local": 3, "one_sided_end": 2}
    want = pr.boundary_profile(hits, 6).where(pr.passing(limits))
    got = pr.boundary_profile(hits, 6, limits)
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect())) and want.count()


def test_summary_keeps_representatives_without_alignments(spark):
    hits = spark.createDataFrame([("q", "t", 9, 1, 5), ("q", None, 8, 2, 5)], SCHEMA)
    reps = spark.createDataFrame([("q",), ("n",)], "representative_contig_id string")
    got = {r.representative_contig_id: r for r in pr.boundary_summary(hits, reps, 3).collect()}
    assert (got["q"].query_length, got["q"].alignment_row_count, got["q"].target_contig_count) == (9, 2, 1)
    assert (got["n"].query_length, got["n"].has_nonself_alignments, got["n"].alignment_row_count) == (None, False, 0)
    assert pr.boundary_profile(hits.limit(0), 3).count() == 0


def test_coverage_counts_of_any_intervals(spark):
    rows = [("a", 1, -3, 2, 5), ("a", 1, 2, 3, 5), ("a", 2, 3, 9, 5), ("a", None, 1, 5, 5), ("b", 7, 4, 3, 4)]
    df = spark.createDataFrame(rows, "axis string, member int, l int, r int, length int")
    got = {(r.axis, r.point): r.n_members for r in iv.coverage_counts(df, "axis", "member", "length").collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 3): 2, ("a", 4): 1, ("a", 5): 1, **{("b", k): 0 for k in range(1, 5)}}


def test_normalising(spark):
    row = ("q", "t", "99.5", "10", "100", "20", "200", "5", "90", "95", "0.4", "0.9", "1e-9", "50")
    names = typed(spark.createDataFrame([], "query_id string, target_id string, identity_pct string, aligned_length string, query_start string, query_end string, query_length string, target_start string, target_end string, target_length string, query_coverage string, target_coverage string, evalue string, bitscore string")).columns
    raw = spark.createDataFrame([row, ("q", "q", *row[2:]), (None, "t", *row[2:])], ", ".join(f"{n} string" for n in names))
    got = normalised(typed(raw)).collect()
    assert len(got) == 1 and (got[0].query_from, got[0].query_to, got[0].relative_orientation) == (20, 100, -1)
    c = counts(typed(raw)).first()
    assert (c.input_alignments, c.self_alignments, c.alignments_without_id, c.normalized_alignments) == (3, 1, 1, 1)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        typed(raw.withColumn("query_end", raw.query_id)).collect()


@pytest.mark.parametrize(("peaks", "hot"), [(tg.PEAKS, tg.HOT), (3, 40), (0, 1)])
def test_peak_targets_of_a_hot_query(spark, monkeypatch, peaks, hot):
    """A query with most of the rows gives the same whether peaks are sent to all tasks or it is dealt in parts."""
    rng = random.Random(11)
    rows = [("hot" if k % 3 else f"q{k % 7}", f"t{rng.randrange(40)}", f, f + rng.randint(5, 60)) for k in range(600) for f in [rng.randint(1, 300)]]
    found = [(f"{q}:{p}", q, 400, p, 10, "local") for q in ("hot", "q0", "q3", "none") for p in (30, 90, 200)]
    alignments = spark.createDataFrame(rows, "query_id string, target_id string, query_from int, query_to int")
    keys = spark.createDataFrame(found, "peak_id string, query_id string, query_length long, peak_position long, radius_nt long, score_geometry string")
    monkeypatch.setattr(tg, "PEAKS", max(peaks, 1))
    monkeypatch.setattr(tg, "HOT", hot)
    got = {(r.peak_id, r.target_id): r for r in tg.peak_targets(keys, alignments).collect()}
    assert set(got) == {(p[0], r[1]) for p in found for r in rows if r[0] == p[1]}
    for (peak, target), r in got.items():
        q, b = peak.split(":")
        own = [x for x in rows if x[0] == q and x[1] == target]
        assert (r.alignment_count, r.crossing_alignment_count) == (len(own), sum(x[2] < int(b) < x[3] for x in own))
        assert r.contributes_local_start == any(abs(x[2] - int(b)) <= 10 for x in own)
    if peaks == 3:
        assert {r.query_id for r in tg.hot_queries(alignments).collect()} >= {"hot"}


def test_one_axis_of_ten_million_points(spark):
    """Blocks of a long axis are groups of their own, and their sums go on from block to block."""
    n, k = 10_000_000, 60_000
    rng = np.random.default_rng(4)
    left, size, who = rng.integers(-50, n + 50, k), rng.integers(-3, 20_000, k), rng.integers(0, 30_000, k)
    df = spark.createDataFrame(pa.table({"axis": ["a"] * k, "member": who, "l": left, "r": left + size, "length": [n] * k}))
    got = iv.coverage_runs(df, "axis", "member", "length").toArrow().sort_by("first")
    first, last, count = (got.column(c).to_numpy() for c in ("first", "last", "n_members"))
    assert (first[0], last[-1]) == (1, n) and (first[1:] == last[:-1] + 1).all()
    # By hand: intervals of a member, one after the other, and one difference array.
    change, order = np.zeros(n + 2, np.int64), np.lexsort((left, who))
    reach, of = 0, None
    for i in order.tolist():
        a, b = max(left[i], 1), min(left[i] + size[i], n)
        if who[i] != of:
            of, reach = who[i], 0
        a = max(a, reach + 1)
        if b >= a:
            change[a] += 1
            change[b + 1] -= 1
            reach = b
    assert (np.repeat(count, last - first + 1) == np.cumsum(change)[1 : n + 1]).all()


@pytest.mark.parametrize("block", [1, 3, 50, iv.BLOCK])
def test_blocks_of_any_size(spark, block):
    """Axes, also a null one, whose points fall into few or many blocks."""
    rng = random.Random(block)
    points = [(axis, at, 40 if at == 1 else None, rng.randint(-2, 2)) for axis in ("a", "b", None) for at in [1, *sorted(rng.sample(range(2, 300), 25))]]
    got = {(r.axis, r.first): (r.length, r.last, r.n) for r in iv.swept(spark.createDataFrame(points, "axis string, at int, length int, d_n int"), ["axis"], ("n",), block).collect()}
    want = {}
    for axis in ("a", "b", None):
        own, total = [p for p in points if p[0] == axis], 0
        for p, after in zip(own, [*own[1:], None], strict=True):
            total += p[3]
            want[axis, p[1]] = (40, after and after[1] - 1, total)
    assert got == want


def test_crowded_queries_are_counted_as_others(spark, monkeypatch):
    """Queries dealt whole, spread over their targets, or some of either: the same profile and peaks."""
    rng = random.Random(5)
    rows = []
    for _ in range(900):
        q = rng.randrange(4)
        f = rng.randint(1, 280)
        rows.append((f"q{q}", None if rng.random() < 0.02 else f"t{rng.randrange(60)}", 300 if q else rng.choice((300, 290)), f, rng.randint(f, 300)))
    hits = spark.createDataFrame(rows, SCHEMA)
    found = {}
    for most in (10**6, 230, 0):
        monkeypatch.setattr(pr, "WHOLE", most)
        limits = pk.thresholds(one_sided=2)
        crowded = pr.has_crowded(hits)
        assert crowded == (most < 10**6)
        peaks = pk.score_peaks(pr.boundary_profile(hits, 20, limits), limits, whole=not crowded)
        found[most] = sorted(map(tuple, pr.boundary_profile(hits, 20).collect())), sorted(map(tuple, peaks.collect()))
        assert found[most][0] and found[most][1]
    assert found[10**6] == found[230] == found[0]


def test_alignments_are_shuffled_once(spark):
    """From the alignments to the peaks' islands there is one shuffle of rows, by query."""
    hits = spark.createDataFrame([("q", f"t{k}", 300, 1 + k, 200 + k) for k in range(30)], SCHEMA)
    limits = pk.thresholds()
    positions = pk.passing_islands(pr.boundary_profile(hits, 20, limits), limits, whole=True)
    shuffles = [x for x in positions._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "Broadcast" not in x]
    assert sum("REPARTITION_BY_NUM" in x for x in shuffles) == 1
    # Sizes of queries, a row each, may be brought to them.
    assert len(shuffles) <= 2 and all("query_id" in x and "target_id" not in x.split("plan_id")[0] for x in shuffles), shuffles


@pytest.mark.parametrize("listed", [10**6, 0])
def test_ordered_targets_are_the_others_in_order(spark, monkeypatch, listed):
    """In order by lists or by sorting; lists leave nothing to be sorted or shuffled after the join."""
    monkeypatch.setattr(tg, "LISTED", listed)
    rng = random.Random(9)
    rows = [(f"q{rng.randrange(5)}", f"t{rng.randrange(40)}", 300, f, rng.randint(f, 300)) for f in (rng.randint(1, 280) for _ in range(400))]
    hits = spark.createDataFrame(rows, SCHEMA)
    peaks = spark.createDataFrame([(f"q{q}:local:P{k:03d}", f"q{q}", 300, 30 * k, 20, "local") for q in range(5) for k in range(1, 9)], "peak_id string, query_id string, query_length long, peak_position long, radius_nt long, score_geometry string")
    notes = spark.createDataFrame([(f"t{k}", {"n": k}) for k in range(30)], "target_id string, more map<string,int>")
    out = tg.peak_targets(peaks, hits, notes, ordered=True)
    got = out.collect()
    keys = [(x.query_id, x.peak_id, x.target_id) for x in got]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    by_key = lambda rows: {(x.peak_id, x.target_id): x for x in rows}
    assert by_key(got) == by_key(tg.peak_targets(peaks, hits, notes).collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("peak_id" in plan.split("rangepartitioning(")[1].split(")")[0]) == (not listed)
