"""Peak selection, targets and their audits."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import annotations as an
from spanloom.operators import intervals as iv
from spanloom.operators import peaks as pk
from spanloom.operators import profile as pr
from spanloom.operators import targets as tg
from spanloom.schemas import ANNOTATION_COLUMNS, PROFILE_MEASURES, InputError


def plain(rows, geometry, d):
    """Greedy selection, one list at a time. rows: (position, own score, paired score)."""
    left, out = sorted(rows, key=lambda r: (-r[1], r[0])), []
    while left:
        top = left[0]
        near = [r for r in left if abs(r[0] - top[0]) <= d]
        if geometry == "local":
            got = min(near, key=lambda r: (-r[2], -r[1], r[0]))
        elif geometry.startswith("one"):
            centre = round(sum(r[0] * r[1] for r in near) / sum(r[1] for r in near))
            got = min(near, key=lambda r: (abs(r[0] - centre), -r[1], r[0]))
        else:
            got = top
        out.append((top[0], got[0]))
        left = [r for r in left if abs(r[0] - top[0]) > d and abs(r[0] - got[0]) > d]
    return out


@pytest.mark.parametrize("geometry", ["local", "overlap", "one_sided_end"])
def test_pick_is_the_plain_loop(geometry):
    rng = random.Random(3)
    for _ in range(200):
        rows = [(p, rng.randint(1, 5), rng.randint(0, 5)) for p in sorted(rng.sample(range(1, 300), rng.randint(1, 80)))]
        position, own, paired = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        got = [(int(position[a]), int(position[b])) for a, b in pk.pick(position, own, paired, geometry, 20)]
        assert got == plain(rows, geometry, 20)


def test_plateau_gives_its_centre():
    position = np.arange(800, 901)
    own = np.full(101, 10)
    assert [int(position[b]) for _, b in pk.pick(position, own, own * 0, "one_sided_end", 100)] == [850]


def test_thresholds():
    assert pk.thresholds(local=None, overlap=None) == {"directional": 2, "one_sided_end": 10, "one_sided_start": 10}
    with pytest.raises(InputError):
        pk.thresholds(local=0)
    with pytest.raises(InputError):
        pk.thresholds(local=None, directional=None, overlap=None, one_sided=None)


def stage(spark):
    rows = []
    for k in range(14):
        rows += [("q", f"a{k}", 900, 5 + k, 400 + k % 5), ("q", f"b{k}", 900, 404 + k % 7, 890 - k), ("q", f"c{k}", 900, 300 + k, 420)]
    rows += [("q", "span", 900, 1, 900), ("p", "x", 300, 1, 100)]
    alignments = spark.createDataFrame(rows, "query_id string, target_id string, query_length int, query_from int, query_to int")
    limits = pk.thresholds()
    peaks = pk.score_peaks(pr.boundary_profile(alignments, 50, limits), limits).cache()
    return alignments, peaks


def test_peaks_and_targets_agree(spark, monkeypatch):
    alignments, peaks = stage(spark)
    found = {r.peak_id: r for r in peaks.collect()}
    assert {r.score_geometry for r in found.values()} >= {"local", "directional"} and all(k.endswith(f"P{r.peak_index:03d}") for k, r in found.items())
    targets = tg.peak_targets(peaks, alignments)
    assert tg.target_mismatches(peaks, targets).first().mismatches == 0
    assert tg.target_mismatches(peaks, targets.where("target_id <> 'a3'")).first().mismatches > 0
    assert targets.count() == sum(43 for _ in found)
    assert tg.target_counts(peaks, alignments, targets).first().selected_alignments == 43
    monkeypatch.setattr(tg, "PEAKS", 0)  # more peaks than are sent to all tasks
    assert sorted(map(tuple, tg.peak_targets(peaks, alignments).collect())) == sorted(map(tuple, targets.collect()))
    # Peaks from the dense profile are the same.
    again = pk.score_peaks(pr.boundary_profile(alignments, 50), pk.thresholds())
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, peaks.collect()))


def test_no_peaks_keep_their_schema(spark):
    alignments, peaks = stage(spark)
    none = pk.score_peaks(pr.boundary_profile(alignments, 50), {"local": 999})
    assert none.count() == 0 and none.schema == peaks.schema
    assert tg.peak_targets(none, alignments).count() == 0


@pytest.mark.parametrize("block", [1, 7, 64, iv.BLOCK])
def test_islands(spark, block):
    rng = random.Random(block)
    rows = [(g, p, 5) for g in ("a", "b", None) for p in sorted(rng.sample(range(1, 500), 90))]
    df = spark.createDataFrame(rows, "g string, p int, d int")
    got = {(r.g, r.p): r.island for r in iv.islands(df, ["g"], "p", F.col("d"), block).collect()}
    want, before = {}, None
    for g, p, d in rows:
        want[g, p] = want[before] if before and before[0] == g and p - before[1] <= d else p
        before = (g, p)
    assert got == want


@pytest.mark.parametrize("block", [64, iv.BLOCK])
def test_peaks_of_islands_are_those_of_the_whole_axis(spark, monkeypatch, block):
    monkeypatch.setattr(iv.islands, "__defaults__", (block,))
    rng, radius, rows = random.Random(8), 6, []
    for q, n in (("a", 900), ("b", 120), (None, 300)):
        p = 0
        while (p := p + rng.choice([1, 1, 1, 2, 9, 12, 13, 14, 40])) < n:
            score = [rng.randint(0, 4) for _ in range(5)]
            rows.append((q, n, p, radius, rng.randint(0, 9), rng.randint(0, 9), score[0], rng.randint(0, 9), rng.randint(0, 9), score[1], rng.randint(0, 9), rng.randint(0, 9), score[2], rng.randint(0, 9), rng.randint(0, 9), score[3], score[4], 1))
    schema = ", ".join(f"{c} {'string' if c == 'query_id' else 'long'}" for c in ("query_id", "query_length", "boundary_position", "radius_nt", *PROFILE_MEASURES))
    limits = pk.thresholds(one_sided=2)
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.query_id, r.score_geometry, r.peak_selection_rank): (r.score_max_position, r.peak_position) for r in pk.score_peaks(df, limits).collect()}
    names = [x.split()[0] for x in schema.split(", ")]
    want = {}
    for q in ("a", "b", None):
        for g, least in limits.items():
            own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == q]
            some = [(r["boundary_position"], r[pr.GEOMETRIES[g]], max(r["directional_b_score"], r["overlap_b_score"])) for r in own if r[pr.GEOMETRIES[g]] >= least]
            want |= {(q, g, k): x for k, x in enumerate(plain(some, g, 2 * radius), 1)}
    assert got == want
    sizes = pk.passing_islands(df, limits).groupBy("query_id", "score_geometry", "island").count()
    assert sizes.agg({"count": "max"}).first()[0] < 60 and sizes.count() > 30


def above_the_join(df):
    """The exchanges and sorts that a plan has above its topmost join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\b(?:Exchange|Sort)\b", re.split(r"\w*Join\b", plan)[0])


def test_annotated_targets_are_written_where_they_are_joined(spark):
    alignments, peaks = stage(spark)
    notes = spark.createDataFrame([("a1", True), ("a3", False)], "qseqid string, has_viral_hit boolean")
    for c in ANNOTATION_COLUMNS:
        if c not in notes.columns:
            notes = notes.withColumn(c, F.lit(None).cast("boolean" if c == "best_hit_is_viral" else "string"))
    assert not above_the_join(an.annotated_peak_targets(peaks, alignments, notes))


def test_tasks_follow_the_joined_rows(spark, monkeypatch):
    """However few bytes are shuffled, as peaks multiply them after that."""
    alignments, peaks = stage(spark)
    monkeypatch.setattr(tg, "ROWS", 10, raising=False)
    joined = peaks.join(alignments, "query_id").count()
    targets = tg.peak_targets(peaks, alignments)
    assert targets.rdd.getNumPartitions() == -(-joined // 10) > 8
    assert not above_the_join(targets)


def test_an_audit_adds_up_where_targets_are_joined(spark):
    """The final aggregation of a peak's counts reads the partial one, and that the targets, with no shuffle between."""
    alignments, peaks = stage(spark)
    plan = tg.target_mismatches(peaks, tg.peak_targets(peaks, alignments))._jdf.queryExecution().executedPlan().toString()
    sums = [k for k, line in enumerate(plan.splitlines()) if re.search(r"HashAggregate\(keys=\[query_id#\w+, peak_id#\w+\]", line)]
    assert len(sums) == 2 and sums[1] == sums[0] + 1
    assert not re.findall(r"\b(?:Exchange|Sort)\b", re.split(r"\w*Join\b", "\n".join(plan.splitlines()[sums[0] :]))[0])
