"""Near-duplicate vectors, held against all pairs."""

import math
import random

import numpy as np
import pytest

from spanloom.llm import hyperplanes as hp
from spanloom.llm.queries import queries
from spanloom.runtime import table


def brute(rows, threshold=0.9):
    """vec_id, n_links, component_id, kept of (vec_id, vector) rows."""
    fine = lambda k, v: k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    up = {k: k for k, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links = [0] * len(rows)
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if fine(k, v) else None for k, v in rows]
    for i, x in enumerate(unit):
        for j in range(i):
            y = unit[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(rows[i][0]), root(rows[j][0])))
                up[b] = a
    return sorted(((k, n, root(k) if k is not None else None, k is None or root(k) == k) for (k, _), n in zip(rows, links, strict=True)), key=repr)


def planted(dims=24, seed=5):
    """Groups of copies and near copies (also some on both sides of the threshold), chains, and single vectors."""
    r = np.random.default_rng(seed)
    out = list(r.standard_normal((300, dims)))
    for spread in (0.05, 0.1, 0.2, 0.3, 0.35, 0.4, 0.5):
        centre = r.standard_normal(dims)
        out += list(centre + spread * r.standard_normal((40, dims)))
    for k in range(20):
        a, b = np.eye(dims)[:2]
        out.append(math.cos(k * 0.4) * a + math.sin(k * 0.4) * b)  # each near the next alone
    out += [out[3]] * 30 + [out[3] * 1e3]
    order = list(range(len(out)))
    random.Random(seed).shuffle(order)
    return [(7 * k + 1, [float(x) for x in out[i]]) for k, i in enumerate(order)]


def found(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("bucket", "part"), [(hp.BUCKET, hp.PART), (16, 7)])
def test_as_brute_force(spark, bucket, part):
    rows = planted()
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in rows], "vec_id long, embedding array<double>, size int, codes string").repartition(5)
    assert found(hp.near_vectors(df, bucket=bucket, part=part)) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [1.0, inf]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1e300, 1e290]), (10, [1e-300, -0.0]), (11, [1.0, 0.0, 0.0]), (12, [1.0]), (13, [5.0]), (None, [1.0, 0.0]), (14, [-1.0, 0.0]), (7, [0.0, 1.0]), (15, [0.0, 2.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(hp.near_vectors(df)) == brute(rows)
    assert hp.near_vectors(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    """Pairs a little above the threshold: next to none without a table in common."""
    for n in (100, 10_000, 1_000_000):
        tables, bits = hp.layout(n)
        r = np.random.default_rng(n)
        a, b = r.standard_normal((2, 20_000, 32))
        a /= np.linalg.norm(a, axis=1)[:, None]
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = 0.9 * a + math.sqrt(1 - 0.81) * b
        sides = [(x @ hp.planes(32, tables * bits) >= 0).reshape(-1, tables, bits) for x in (a, b)]
        assert (sides[0] == sides[1]).all(2).any(1).mean() > 0.999


def test_query_as_brute_force(spark):
    sf_dir = "/root/testdata/sf0.1"
    t = table(spark, sf_dir, "embeddings").toPandas()
    x = np.stack(t.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.9
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([label[row].min() for row in hit])
    ids = t.vec_id.to_numpy()
    first = {c: ids[label == c].min() for c in set(label.tolist())}
    got = {r.vec_id: r for r in queries()["op12_embedding_dedup"](spark, sf_dir).collect()}
    assert len(got) == len(x)
    for k, row, c in zip(ids.tolist(), hit, label.tolist(), strict=True):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (row.sum() - 1, first[c], first[c] == k)
