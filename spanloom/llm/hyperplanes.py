"""Near-duplicate vectors by random-hyperplane signs in several tables, exact cosines and components.

1. One pass gives each vector a fingerprint and, for each of ``tables`` tables, the signs of its products
   with ``bits`` random vectors. Equal vectors form a class, which goes on as one row with its size.
2. Classes of equal signs in a table are a bucket. All pairs of a bucket are compared by products of
   blocks in double precision. A pair counts in the first table that brings it together: both rows carry
   their signs of all tables, so nothing need be remembered. No pair leaves its block: a block gives the
   links of each of its vectors and, of each of its components, a star.
3. A bucket of more than ``PART`` classes is dealt in parts, each compared with each.
4. Components by large-star and small-star.

Two vectors at the threshold agree in a sign with a probability of p = 1 - acos(threshold) / pi. With the
number of vectors the signs of a table grow, so that a bucket of unrelated vectors keeps about ``BUCKET`` of
them, and the tables, so that a pair at the threshold shares none with a probability of ``MISS``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import map_batches, ready
from spanloom.llm.components import connected_components
from spanloom.runtime import Scratch, written

THRESHOLD = 0.9
#: Unrelated vectors in a bucket, about.
BUCKET = 512
#: Probability that a pair at the threshold shares no bucket.
MISS = 1e-5
#: Classes of a bucket that one task compares with each other, or with as many others.
PART = 1 << 12
#: Crowded buckets (some 40 bytes each) that are sent to all tasks at most.
CROWDED = 1 << 18
_SEED = 0x5EED
_BLOCK = 512
#: Cosines so near to the threshold are computed once more, one by one, so that blocks of any size agree.
_NEAR = 1e-12


def layout(n: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """Tables and bits for n vectors."""
    bits = max(1, math.ceil(math.log2(max(n, 1) / bucket)))
    shared = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-shared))), bits


@lru_cache(2)
def planes(dims: int, n: int) -> np.ndarray:
    return np.random.default_rng([_SEED, dims]).standard_normal((dims, n))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by a power of two near their largest component (cosines stay, nothing overflows), and their norms."""
    _, power = np.frexp(np.abs(x).max(1, initial=0))
    x = np.ldexp(x, -power[:, None])
    return x, np.sqrt((x * x).sum(1))


def sketched(vectors: DataFrame, tables: int, bits: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, fp1, fp2 (fingerprint), vec (its doubles), codes of every row; fp1 to codes are null where a vector can link with nothing."""
    schema = pa.schema([("vec_id", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("vec", pa.binary()), ("codes", pa.list_(pa.int64()))])
    weight = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys = batch.column("v"), batch.column("k")
            n, flat = np.asarray(lists.value_lengths().fill_null(0)), lists.flatten()
            x = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64) + 0.0  # nulls are NaN; no negative zeros
            edge = np.concatenate([[0], np.cumsum(n)])
            out: list = [(None, None, None, None)] * batch.num_rows
            named = np.asarray(keys.is_valid())
            for dims in np.unique(n[named & (n > 0)]).tolist():
                at = np.flatnonzero(named & (n == dims))
                rows = x[edge[at][:, None] + np.arange(dims)]
                fine = np.isfinite(rows).all(1) & (rows != 0).any(1)
                at, rows = at[fine], rows[fine]
                code = ((scaled(rows)[0] @ planes(dims, tables * bits) >= 0).reshape(-1, tables, bits) * weight).sum(2) if len(at) else []
                for k, row, c in zip(at.tolist(), rows, code, strict=True):
                    raw = row.tobytes()
                    fp = xxhash.xxh3_128_intdigest(raw)
                    out[k] = (*(h - (1 << 64) if h >> 63 else h for h in (fp >> 64, fp & (1 << 64) - 1)), raw, c)
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    rows = vectors.select(F.col(id_col).cast("long").alias("k"), F.col(vec_col).alias("v"))
    return map_batches(rows, run, "vec_id long, fp1 long, fp2 long, vec binary, codes array<long>")


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a component) after more links."""
    while True:
        a, b = label[u], label[v]
        on = a != b
        if not on.any():
            return label
        a, b, u, v = a[on], b[on], u[on], v[on]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label != (up := label[label])).any():
            label = up


def compared(x: np.ndarray, codes: np.ndarray, size: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector that count in this table, weighted by the classes' sizes, and labels of their components.

    ``side`` tells the two parts that are compared; with one part, all its pairs are.
    """
    x, norm = scaled(x)
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    first = np.flatnonzero(side == side.min())
    other = np.flatnonzero(side == side.max())
    one = len(first) == len(x)
    for lo in range(0, len(first), _BLOCK):
        a = first[lo : lo + _BLOCK]
        b = other[lo:] if one else other
        cosine = x[a] @ x[b].T
        cosine /= norm[a][:, None]
        cosine /= norm[b][None]
        hit = cosine >= threshold
        for r, c in np.argwhere(np.abs(cosine - threshold) < _NEAR).tolist():
            i, j = sorted((a[r], b[c]))
            hit[r, c] = math.fsum(x[i] * x[j]) / norm[i] / norm[j] >= threshold
        u, v = np.nonzero(np.triu(hit, 1) if one else hit)
        u, v = a[u], b[v]
        for t in range(table):  # counted there
            on = codes[u, t] != codes[v, t]
            u, v = u[on], v[on]
        if len(u):
            np.add.at(links, u, size[v])
            np.add.at(links, v, size[u])
            label = _merge(label, u, v)
    return links, label


def _blocks(members: DataFrame, threshold: float) -> DataFrame:
    """fp1, fp2, links, vec_id, root of each vector with links in a block of (dims, table, code, i, j)."""
    ready(members.sparkSession)
    schema = pa.schema([("fp1", pa.int64()), ("fp2", pa.int64()), ("links", pa.int64()), ("vec_id", pa.int64()), ("root", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        if rows.num_rows < 2:
            return schema.empty_table()
        rows = rows.sort_by([("vec_id", "ascending"), ("fp1", "ascending"), ("fp2", "ascending")]).combine_chunks()
        x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(rows.num_rows, -1)
        codes = np.asarray(rows.column("codes").combine_chunks().flatten()).reshape(rows.num_rows, -1)
        size, part, ids = (rows.column(c).to_numpy() for c in ("size", "part", "vec_id"))
        if rows.column("i")[0].as_py() != rows.column("j")[0].as_py() and part.min() == part.max():
            return schema.empty_table()  # the other part has no row
        links, label = compared(x, codes, size, part, rows.column("table")[0].as_py(), threshold)
        some = np.flatnonzero(links)
        return pa.table([rows.column("fp1").take(some), rows.column("fp2").take(some), pa.array(links[some]), pa.array(ids[some]), pa.array(ids[label[some]])], schema=schema)

    return members.groupBy("dims", "table", "code", "i", "j").applyInArrow(run, "fp1 long, fp2 long, links long, vec_id long, root long")


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS, part: int = PART, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors are linked where their cosine reaches the threshold. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do rows without an id (component null,
    kept) or vectors of different length. Each row is a vector; rows of one id are one node of the
    components. Equal vectors are linked. An empty table gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    tables, bits = layout(vectors.count(), threshold, bucket, miss)
    sketch = written(spark, sketched(vectors, tables, bits, id_col, vec_col), "vectors")
    some = sketch.where("fp1 IS NOT NULL")
    with Scratch(spark) as scratch:
        one = F.min_by(F.struct("vec", "codes"), "vec_id").alias("x")
        classes = scratch(some.groupBy("fp1", "fp2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size"), one).select("fp1", "fp2", "vec_id", "size", F.length("x.vec").alias("dims"), "x.vec", "x.codes"), "vector-classes")
        bucketed = classes.select("*", F.posexplode("codes").alias("table", "code"))
        sizes = bucketed.groupBy("dims", "table", "code").agg(F.count("*").alias("n")).where("n > 1")
        crowded = scratch(sizes.where(F.col("n") > part).select("dims", "table", "code", F.ceil(F.col("n") / part).alias("parts")), "vector-buckets")
        small = crowded.limit(CROWDED + 1).count() <= CROWDED
        dealt = bucketed.join(F.broadcast(crowded) if small else crowded, ["dims", "table", "code"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp1", "fp2"), "parts")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        members = dealt.select("dims", "table", "code", F.least("part", "q").alias("i"), F.greatest("part", "q").alias("j"), "part", "fp1", "fp2", "vec_id", "size", "vec", "codes")
        found = scratch(_blocks(members, threshold), "vector-links")
        label = connected_components(found.select("vec_id", "root"))
        own = found.groupBy("fp1", "fp2").agg(F.sum("links").alias("links"))
        named = classes.select("fp1", "fp2", "size", F.col("vec_id").alias("top"))
        named = named.join(own, ["fp1", "fp2"], "left").join(label, named.top == label.node, "left").select("fp1", "fp2", "top", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "top").alias("component_id"))
        named = written(spark, named, "vector-components")
    # Rows of one id in several classes are in one component.
    twice = some.groupBy("vec_id").agg(F.count_distinct("fp1", "fp2").alias("n")).where("n > 1")
    if twice.limit(1).count():
        members = some.join(twice, "vec_id", "left_semi").join(named, ["fp1", "fp2"]).select(F.col("vec_id").alias("a"), F.col("component_id").alias("b"))
        label = connected_components(members.unionByName(members.groupBy("a").agg(F.min("b").alias("b"))))
        named = named.join(label, named.component_id == label.node, "left").select("fp1", "fp2", "n_links", F.coalesce("component", "component_id").alias("component_id"))
    out = sketch.select("vec_id", "fp1", "fp2").join(named.select("fp1", "fp2", "n_links", "component_id"), ["fp1", "fp2"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
