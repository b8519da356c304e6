"""Blocked gzip, order of parts, rounding casts, faults of inputs."""

import gzip
import io
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from spanloom.operators import alignments as al
from spanloom.schemas import InputError, faults, require_valid
from spanloom.sources import blocked
from spanloom.sources import readers as rd


def test_blocked_lines_in_any_ranges(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(blocked, "MEMBER", 90)
    for text in (b"", b"\n", b"one", b"a\n\nb", b"".join(b"%d\t%s\n" % (k, bytes(rng.choice(b"\x1f\x8b\x08\x04xyz") for _ in range(rng.randint(0, 300)))) for k in range(60))):
        data = b"".join(blocked.compressed(iter([text])))
        assert gzip.decompress(data) == text
        want = text.split(b"\n")
        want = want[:-1] if not want[-1] else want
        for size in (1, 37, 200, 1000, len(data) + 5):
            got = [x for lo in range(0, len(data), size) for some in blocked.lines(io.BytesIO(data), lo, lo + size) for x in some]
            assert got == want, size


def test_blocked_alignments_by_several_tasks(spark, tmp_path, monkeypatch):
    row = lambda k: "\t".join(["q", f"t{k}", "99.5", *"123456789", "1e-9", "" if k % 5 else "50"])
    text = [row(k) for k in range(40_000)]
    files = blocked.write_lines(spark.createDataFrame([(x,) for x in text], "value string").repartition(2), f"file://{tmp_path}/a.tsv.gz")
    assert len(files) == 2 and all(blocked.is_blocked(spark, u) for u, _ in files)
    monkeypatch.setattr(blocked.read_lines, "__defaults__", (8_000,))
    got = rd.read_alignment_text(spark, tmp_path / "a.tsv.gz")
    assert got.rdd.getNumPartitions() > 8
    assert sorted((r.target_id, r.bitscore) for r in got.collect()) == sorted((f"t{k}", None if k % 5 else "50") for k in range(40_000))
    assert sum(n > 0 for n in (len(p) for p in got.rdd.glom().collect())) > 8
    # Plain gzip is read as ever, and is the same table.
    with gzip.open(tmp_path / "plain.tsv.gz", "wt") as f:
        f.write("\n".join(text) + "\n")
    assert not blocked.is_blocked(spark, str(tmp_path / "plain.tsv.gz"))
    plain = rd.read_alignment_text(spark, tmp_path / "plain.tsv.gz")
    assert plain.columns == got.columns and plain.exceptAll(got).count() == 0 == got.exceptAll(plain).count()
    (tmp_path / "odd.tsv.gz").write_bytes(b"".join(blocked.compressed(iter([b"a\tb\n"]))))
    with pytest.raises(Exception, match="malformed row"):
        rd.read_alignment_text(spark, tmp_path / "odd.tsv.gz").collect()


def test_parts_of_a_folder(spark, tmp_path):
    ids = tmp_path / "list.txt"
    ids.mkdir()
    for k in range(12):  # small and large parts, so that splits come in another order
        (ids / f"part-{k:02d}").write_text("".join(f" i{k}_{j} \n\n" for j in range((k * 7) % 11 * 50)))
    got = [(r.line_number, r.contig_id) for r in rd.read_id_list(spark, ids).orderBy("line_number").collect()]
    assert got == list(enumerate((f"i{k}_{j}" for k in range(12) for j in range((k * 7) % 11 * 50)), 1))
    fasta = tmp_path / "reps.fa"
    fasta.mkdir()
    (fasta / "a").write_text("\n>x one\nAC\n")
    (fasta / "b").write_text(">y\nAC\n")
    (fasta / "c").write_text("")
    assert sorted(r[0] for r in rd.read_representatives(spark, fasta).collect()) == ["x", "y"]
    (fasta / "b").write_text("ACGT\n>y\nAC\n")
    (fasta / "d").write_text(" \nTT\n")
    assert sorted((r.file[-1], r.line) for r in rd.early_sequences(spark, fasta).collect()) == [("b", "ACGT"), ("d", "TT")]
    with pytest.raises(InputError, match="reps.fa/b"):
        rd.read_representatives(spark, fasta)


def test_tables_in_order(spark, tmp_path):
    place = str(tmp_path / "t.parquet")
    spark.range(0, 5000, 1, 7).select((F.lit(5000) - F.col("id")).alias("x"), F.lit("é").alias("y")).orderBy("x").write.option("maxRecordsPerFile", 300).parquet(place)
    got = rd.read_in_order(spark, place)
    assert got.columns == ["position", "x", "y"] and [(r.position, r.x) for r in got.orderBy("position").collect()] == [(k, k) for k in range(1, 5001)]


CASTS = ["12.6", "12.5", "-12.5", "1e2", " 7 ", "+5", "1_000", "1.", "  -3.49", "1e-1", "2147483647.4", ".5", "-.5", "1E+2", "1.5e1", "\t8", "8\n", "00012", "1.2_3", "1e0_1", "1.25e1", "0.4999999999999999999999", "1e-20", "25e-1", "-2.5e0", "-0", None]


def test_rounding_is_the_other_engine_s(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CASTS)], "k int, t string")
    got = {r.k: r.n for r in df.select("k", al.rounded(F.col("t"), "int").alias("n")).collect()}
    assert got == {k: duckdb.execute("SELECT CAST(? AS INTEGER)", [t]).fetchone()[0] for k, t in enumerate(CASTS)}
    for bad in ("", " ", "1e3.5", "5e", "NaN", "٣", "12,5", "2147483647.5", "9999999999", "1e", "- 5", "1__0", "_1", "1_", "true", ".", "-", "1e2147483648", "1e40"):
        with pytest.raises(duckdb.Error):
            duckdb.execute("SELECT CAST(? AS INTEGER)", [bad])
        with pytest.raises(Exception, match="CAST_INVALID_INPUT|OVERFLOW|OUT_OF"):
            spark.createDataFrame([(bad,)], "t string").select(al.rounded(F.col("t"), "int")).collect()


def test_rounding_reads_a_number_once(spark):
    texts = ["0.4999999999999999999999e0", "-0.49999999999999999995e0", "1_0.5_0e0_1", "\n 2_5e-0_1\r"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", al.rounded(F.col("t"), "int").alias("n"))
    assert {r.k: r.n for r in df.collect()} == {k: duckdb.execute("SELECT CAST(? AS INTEGER)", [t]).fetchone()[0] for k, t in enumerate(texts)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2 and "regexp_extract" not in plan


def test_faults(spark):
    df = spark.createDataFrame([("q", "q", 1), ("q", "t", 2), ("q", "t", 3), ("q", "t", 9), (None, "t", 4), (None, "t", 5), ("a", "a", 6)], "query_id string, target_id string, n int")
    rules = {"self hit": F.col("query_id") == F.col("target_id"), "n over 4": F.col("n") > 4, "no such column": F.col("zz") > 1}
    found = {tuple(r) for r in faults(df, "hits", columns=("query_id", "zz", "aa"), key=("query_id", "target_id"), rules=rules).collect()}
    assert found == {("hits", "self hit", 2, "a, a"), ("hits", "n over 4", 3, "a, a"), ("hits", "missing query_id, target_id", 2, "null, t"), ("hits", "repeated query_id, target_id", 2, "q, t"), ("hits", "no column aa", None, None), ("hits", "no column zz", None, None)}
    with pytest.raises(InputError, match="2 rows: repeated query_id, target_id .first: q, t.*3 rows: n over 4|no column"):
        require_valid(df, "hits", columns=("zz",), key=("query_id", "target_id"), rules=rules)
    assert faults(df, "hits", columns=("n",), key=("n",)).collect() == [] and require_valid(df, "hits", key=("n",)) is df
    none = df.limit(0)
    assert faults(none, "hits", key=("n",), rules=rules).collect() == [] and faults(none, "hits", rules=rules).collect() == []
    assert [tuple(r) for r in faults(df, "hits", rules=rules).where("fault = 'self hit'").collect()] == [("hits", "self hit", 2, None)]
