"""Packing documents into sequences: cutting stock solved by column generation.

A document of n ids is cut into pieces of ``capacity`` ids and one remainder. Whole pieces fill
sequences of their own; the remainders are items of a cutting-stock problem. Their lengths are
rounded up to classes of ``grain`` ids, a linear program over patterns (how many items of each class
share a sequence) is solved on the histogram of classes, a knapsack by dynamic programming prices new
patterns from the duals until none improves, and the solution is rounded down; the few items left
over are packed first-fit decreasing into further patterns. Documents are ranked within their class,
and each rank maps to one slot of one sequence by arithmetic, so no group is gathered anywhere.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.llm.bpe import encoder, tokenizer_path
from spanloom.runtime import written

CAPACITY, GRAIN = 1024, 4


# -- the linear program --------------------------------------------------------------------------


def best_pattern(value: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack: the pattern of classes 1..len(value) (class = size) of the largest total value."""
    n = len(value)
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    worth = np.where(demand > 0, value, -1.0)
    for w in range(1, capacity + 1):
        m = min(w, n)
        got = worth[:m] + best[w - 1 :: -1][:m] if w > 1 else worth[:1] + best[:1]
        k = int(np.argmax(got))
        best[w], pick[w] = (got[k], k + 1) if got[k] > best[w - 1] else (best[w - 1], 0)
    pattern, w = np.zeros(n, np.int64), capacity
    while w > 0:
        if pick[w]:
            pattern[pick[w] - 1] += 1
            w -= pick[w]
        else:
            w -= 1
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, rounds: int = 5000, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (rows) and how often the linear program uses each.

    ``demand[k]`` items of size k + 1. Starts from patterns of one class each and stops when the dual
    bound (value of the program divided by the best pattern's worth) is within ``tolerance``; if
    ``rounds`` end first, a warning tells the gap that is left.
    """
    live = np.flatnonzero(demand)
    m = len(live)
    if not m:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    sizes = live + 1
    basis = np.zeros((m, m))  # columns are patterns, in the order of live, or surplus of one class (cost 0)
    np.fill_diagonal(basis, np.maximum(capacity // sizes, 1))
    cost = np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    times = lambda a, b: np.einsum("ij,j->i", a, b)  # noqa: E731  einsum: the driver shares its cores with the JVM, and threads of BLAS would spin on them
    need = demand[live].astype(float)
    x = times(inverse, need)
    centre, bound = None, 0.0
    for turn in range(rounds):
        dual = times(inverse.T, cost)
        k = int(np.argmin(dual))
        if dual[k] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[k] = -1
        else:
            total = float((cost * x).sum())
            # The duals jump about; pricing a mean of them with the best so far settles sooner.
            for mixed in ((0.7 * centre + 0.3 * dual, dual) if centre is not None else (dual,)):
                value = np.zeros(len(demand))
                value[live] = np.maximum(mixed, 0)
                worth, pattern = best_pattern(value, demand, capacity)
                column, price = pattern[live].astype(float), 1.0
                if (low := float((value[live] * need).sum()) / max(worth, 1.0)) > bound:
                    bound, centre = low, value[live] / max(worth, 1.0)
                if (gain := float((dual * column).sum())) > 1 + 1e-9:
                    break
            if gain <= 1 + 1e-9 or bound >= total * (1 - tolerance):
                break
        d = times(inverse, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * d, 0)
        x[out] = ratio[out]
        basis[:, out], cost[out] = column, price
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        if turn % 100 == 99:
            error = np.einsum("ij,jk->ik", basis, inverse)  # a Newton step takes out what rounding has added up
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, error)
            x = np.maximum(times(inverse, need), 0)
    else:
        warnings.warn(f"{rounds} rounds left a gap of {float((cost * x).sum()) / max(bound, 1e-9) - 1:.2%} to the bound", stacklevel=2)
    used = cost > 0
    patterns = np.zeros((int(used.sum()), len(demand)), np.int64)
    patterns[:, live] = basis[:, used].T.astype(np.int64)
    return patterns, x[used]


def first_fit(rest: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that hold ``rest[k]`` items of size k + 1, largest first."""
    bins: list[list] = []
    for k in range(len(rest) - 1, -1, -1):
        left = int(rest[k])
        for b in bins:
            n = min(left, b[0] // (k + 1))
            if n:
                b[0] -= n * (k + 1)
                b[1][k] += n
                left -= n
            if not left:
                break
        while left:
            n = min(left, max(capacity // (k + 1), 1))
            one = np.zeros(len(rest), np.int64)
            one[k] = n
            bins.append([capacity - n * (k + 1), one])
            left -= n
    return [b[1] for b in bins]


def plan(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and their number of sequences; together they hold exactly ``demand``."""
    patterns, x = solve(demand, capacity)
    left, out = demand.copy(), []
    for p, times in sorted(zip(patterns, np.floor(x + 1e-6).astype(np.int64), strict=True), key=lambda t: -t[1]):
        used = p > 0
        times = min(int(times), int((left[used] // p[used]).min()) if used.any() else 0)
        if times:
            left -= p * times
            out.append((p, times))
    return out + [(p, 1) for p in first_fit(left, capacity)]


# -- pieces ---------------------------------------------------------------------------------------

PIECES = "part int, size_class int, idx long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, *, tokenizer: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, numbered within their class and task: one pass, no shuffle."""
    path = tokenizer or tokenizer_path()
    schema = pa.schema([("part", pa.int32()), ("size_class", pa.int32()), ("idx", pa.int64()), ("doc_id", pa.int64()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        seen = np.zeros(capacity // grain + 1, np.int64)
        for b in batches:
            keys, texts, parts = columns(b, "k", "text", "part")
            if not keys:
                continue
            ids, counts = enc.encode(texts)
            size = counts + 1
            per = -(-size // capacity)
            doc = np.repeat(np.arange(len(keys)), per)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * capacity
            length = np.minimum(capacity, size[doc] - start)
            flat = np.insert(ids.astype("<u4"), np.cumsum(counts), end_id)
            at = (np.cumsum(size) - size)[doc] + start
            crc = [zlib.crc32(flat[a:e]) for a, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
            group = -(-length // grain)
            order = np.argsort(group, kind="stable")
            n = np.bincount(group, minlength=len(seen))
            idx = np.empty(len(doc), np.int64)
            idx[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(seen, n)
            seen += n
            yield batch_of(schema, part=np.array(parts, np.int32)[doc], size_class=group.astype(np.int32), idx=idx, doc_id=pa.array(keys, pa.int64()).take(pa.array(doc)), start=start, length=length, ids_crc32=crc, doc_tokens=size[doc])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text"), F.spark_partition_id().alias("part"))
    return map_batches(rows, cut, PIECES)


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, grain: int = GRAIN, **options) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row a piece. Null
    texts are empty documents of one id; null and repeated doc_ids stay rows of their own; an empty
    table gives no rows; other columns aren't read.
    """
    if capacity % grain:
        raise ValueError("grain must divide capacity")
    spark = docs.sparkSession
    cut = written(spark, pieces(docs, capacity=capacity, grain=grain, **options), "pieces")
    n_classes = capacity // grain
    counted = written(spark, cut.groupBy("size_class", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = np.zeros(n_classes, np.int64)
    for r in counted.groupBy("size_class").agg(F.sum("n").alias("n")).collect():  # at most n_classes rows
        histogram[r.size_class - 1] = r.n
    full, open_classes = int(histogram[-1]), histogram.copy()
    open_classes[-1] = 0
    slots, sequence = [], 0
    if full:
        slots.append((n_classes, 0, full, sequence, 1, 0))
        sequence += full
    taken = np.zeros(n_classes, np.int64)
    for p, times in plan(open_classes, n_classes):
        slot = 0
        for k in np.flatnonzero(p)[::-1]:
            a = int(p[k])
            slots.append((int(k) + 1, int(taken[k]), int(taken[k]) + a * times, sequence, a, slot))
            taken[k] += a * times
            slot += a
        sequence += times
    # rank = pieces of the class in earlier tasks + number within the task
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("size_class").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(before, ["size_class", "part"]).withColumn("rank", F.col("before") + F.col("idx"))
    names = ("lo", "hi", "sequence", "each", "slot")
    by_class: dict[int, list] = {}
    for k, *rest in slots:
        by_class.setdefault(k, []).append(dict(zip(names, rest, strict=True)))
    # Bounded by the number of classes, not by the data: a basis has a pattern for each class at most.
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
    ranges = spark.createDataFrame(pa.table({"size_class": pa.array(list(by_class), pa.int32()), "ranges": pa.array(list(by_class.values()), kind)}))
    first_of = F.expr("filter(ranges, r -> r.lo <= rank AND rank < r.hi)[0]")
    placed = ranked.join(F.broadcast(ranges), "size_class").withColumn("r", first_of)
    step = F.col("rank") - F.col("r.lo")
    placed = placed.withColumn("sequence_id", F.col("r.sequence") + F.floor(step / F.col("r.each"))).withColumn("slot", F.col("r.slot") + step % F.col("r.each"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    whole = placed.where(F.col("size_class") == n_classes).where("length = %d" % capacity).select(*keep, F.lit(0).cast("long").alias("offset"))
    w = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    part = placed.where((F.col("size_class") != n_classes) | (F.col("length") < capacity)).select(*keep, F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
    return whole.unionByName(part)
