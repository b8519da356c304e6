"""The pipeline's stages against brute force, and the registered queries."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EN, ES = "the of and to in that it was for on are with as his they at be this from".split(), "el la de que y a en un ser se no haber por con su para como estar todo".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(1)
    d = tmp_path_factory.mktemp("sf")
    say = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "er"]) for _ in range(n))
    items = [(k, say(EN, 20)) for k in range(3)]
    rows = [(k, say(EN if k % 2 else ES, rng.randint(30, 90)), "en" if k % 2 else "es") for k in range(80)]
    text = dict((k, t) for k, t, _ in rows)
    rows += [(100, text[1], "en"), (101, text[1] + " end", "en"), (102, f"{text[2]} {items[0][1]}", "es"), (103, "1234 !!!", None), (104, None, "en"), (105, f"{say(EN, 40)} mail joe@corp.example.com", "en"), (106, say(ES, 3000), "es")]
    full = [(k, t, lang, "s", len(t or "")) for k, t, lang in rows]
    full += [full[5], full[5]]  # repeated rows are one document
    spark.createDataFrame(full, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, [1.0, float(k % 3), 0.5 * k]) for k in range(12)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k % 7}</p>") for k in range(20)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d), full


def test_stages_and_run(spark, tables):
    d, full = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(spark, stage(spark, docs, d), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = {r.doc_id: r for r in docs.collect()}
    every = {r[0] for r in full}
    assert set(seen["language_id"]) == every - {103, 104}
    assert set(seen["near_dedup"]) == every - {103, 104, 100, 101}
    assert sum(r.doc_id == 5 for r in docs.collect()) == 1
    assert set(seen["decontamination"]) == every - {103, 104, 100, 101, 102}
    assert set(seen["pii"]) == set(seen["decontamination"])
    assert seen["pii"][105].text.endswith("[EMAIL]") and all(r.n_chars == len(r.text) for r in seen["pii"].values())
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} == set(seen["pii"])
    by: dict = {}
    for r in packed:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sum(r.length for r in rows) == rows[0].doc_tokens for rows in by.values())


def test_near_dedup_of_ids_with_several_texts(spark):
    """An id's other text isn't lost with a copy of another document."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(EN) + str(rng.randint(0, 99)) for _ in range(n))
    one, other, third = say(60), say(60), say(50)
    rows = [(1, one), (2, other), (2, one), (3, one + " more"), (4, None), (4, None), (4, ""), (5, ""), (2, other), (None, one), (None, one), (6, third), (6, third), (7, "...")]
    docs = spark.createDataFrame([(k, t, "en", f"s{j}", 0) for j, (k, t) in enumerate(rows)], COLUMNS).coalesce(1)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, one), (2, other), (4, None), (4, ""), (5, ""), (None, one), (None, one), (6, third), (7, "...")], key=repr)
    # Without such ids the smallest id stays.
    plain = docs.where("source NOT IN ('s1', 's8', 's4', 's5')")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, plain, "").collect()), key=repr) == sorted([(1, one), (4, ""), (5, ""), (None, one), (None, one), (6, third), (7, "...")], key=repr)


def test_stages_keep_columns_of_any_name(spark, tables):
    """Names that the operators use themselves, and an empty table."""
    d, full = tables
    extra = {"score": "doc_id + 100", "rejected": "'r'", "__text": "doc_id", "__row": "1L", "kept": "'k'", "n_shingles": "2", "__base": "3", "id": "4"}
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", *(f"{x} AS {n}" for n, x in extra.items()))
    for empty in (docs.limit(0), docs):
        now = empty
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = corpus_pipeline.written(spark, stage(spark, now, d), name)
            assert now.columns == docs.columns and now.dtypes == docs.dtypes
        assert corpus_pipeline.STAGES[-1][1](spark, now, d).columns[0] == "doc_id"
    rows = now.collect()
    assert len(rows) > 70 and all((r.score, r.rejected, r["__text"], r["__row"], r.kept, r.n_shingles, r["__base"], r.id) == (r.doc_id + 100, "r", r.doc_id, 1, "k", 2, 3, 4) for r in rows)


def test_queries_of_the_operators(spark, tables):
    d, full = tables
    queries = entry.queries()
    names = {int(re.match(r"op(\d+)_", q)[1]): q for q in queries if q.startswith("op")}
    assert sorted(names) == list(range(1, 14)) and "pipeline" in queries
    for n in (1, 3, 6, 7, 9, 11):
        assert queries[names[n]](spark, d).count() == len(full), n
    assert queries[names[8]](spark, d).count() == 20 and queries[names[12]](spark, d).count() == 12 and queries[names[13]](spark, d).count() == 0  # no phrase occurs 30 times
    assert {r.doc_id for r in queries[names[5]](spark, d).collect()} == {102}
    assert {1, 100, 101} <= {r.doc_id for r in queries[names[4]](spark, d).collect()}
    assert queries[names[2]](spark, d).selectExpr("sum(n_tokens) AS a").first().a == queries[names[3]](spark, d).selectExpr("sum(n_tokens - 1) AS a").first().a
    lang = queries[names[1]](spark, d)
    assert {r.lang_pred for r in lang.collect()} == {"en", "es", "und"}
