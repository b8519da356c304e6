"""Benchmark decontamination by greedy string tiling.

A benchmark item is found in a document if non-overlapping passages of the document, each at least
``min_match`` words long, together cover enough of the item, in whatever order they stand. Seeds (runs
of ``min_match`` words, by a rolling hash) say which documents share anything with which item; for
those pairs, running Karp-Rabin matching marks the longest passages first, then shorter ones, down to
``min_match`` words.

A benchmark of up to ``SMALL`` characters, which is counted first, goes to the tasks as one index, and
the documents are read once, without a shuffle. A larger one is joined by seeds: a filter of fixed size
keeps the documents' seeds that the benchmark can hold, each item takes part with its rarest seeds (as
many as it needs that no document which covers enough of it is missed), and the texts of the pairs that
share one are brought together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.llm.hashing import code_points, folded, span_hashes
from spanloom.llm.lookup import Sorted
from spanloom.llm.shingles import shingle_hashes
from spanloom.runtime import Scratch, written

MIN_MATCH, COVERAGE = 5, 0.5
#: Characters of a benchmark that is sent to all tasks; its index takes some 10 bytes for each.
SMALL = 8 << 20
#: Bits of the filter of seeds, whatever the benchmark's size (a power of two).
FILTER = 1 << 27
#: Pairs of equal windows that are looked at together.
PAIRS = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word (letters and digits in a row, case ignored)."""
    cps = code_points(text)
    low, kind = folded(cps)
    is_word = np.concatenate([[False], kind > 0, [False]])
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    return span_hashes(low, start, end), start, end


class _Windows:
    """Karp-Rabin hashes of the windows of any length over a word sequence."""

    def __init__(self, seq: np.ndarray):
        power = np.full(len(seq) + 1, _BASE, np.uint64)
        power[0] = 1
        self.power = np.multiply.accumulate(power)
        self.inverse = np.full(len(seq) + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
        self.inverse[0] = 1
        self.inverse = np.multiply.accumulate(self.inverse)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seq * self.power[:-1], dtype=np.uint64)])

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) * self.inverse[at]


def tiles(a: np.ndarray, b: np.ndarray, min_match: int, shut: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, length), longest first. shut: places of b that match nothing."""
    done_a, done_b = np.zeros(len(a), bool), np.zeros(len(b), bool) if shut is None else shut.copy()
    wa, wb = _Windows(a), _Windows(b)
    out: list[tuple[int, int, int]] = []
    size = min(max(len(a) // 2, min_match), min(len(a), len(b)))
    if size < min_match:
        return out

    def free(done: np.ndarray, size: int) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(done)])
        return np.flatnonzero(upto[size:] == upto[:-size]) if len(done) >= size else np.zeros(0, np.int64)

    def scan(size: int) -> list[tuple[int, int, int]]:
        """Maximal unmarked matches of at least ``size`` words."""
        ia, ib = free(done_a, size), free(done_b, size)
        if not len(ia) or not len(ib):
            return []
        ha, hb = wa.hashes(ia, size), wb.hashes(ib, size)
        order = np.argsort(ha, kind="stable")
        lo, hi = np.searchsorted(ha[order], hb), np.searchsorted(ha[order], hb, "right")
        upto, found, at = np.cumsum(hi - lo), [], 0
        while at < len(ib):  # windows that occur very often in both give very many pairs: some at a time
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            n = (hi - lo)[at:stop]
            j = np.repeat(ib[at:stop], n)
            i = ia[order[np.repeat(lo[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            # A match that could begin one word earlier is part of that one.
            back = (i > 0) & (j > 0)
            back[back] = (a[i[back] - 1] == b[j[back] - 1]) & ~done_a[i[back] - 1] & ~done_b[j[back] - 1]
            for x, y in zip(i[~back].tolist(), j[~back].tolist(), strict=True):
                most = min(len(a) - x, len(b) - y)
                same = (a[x : x + most] == b[y : y + most]) & ~done_a[x : x + most] & ~done_b[y : y + most]
                k = most if same.all() else int(np.argmin(same))
                if k >= size:  # else the hashes were equal by chance
                    found.append((k, x, y))
            at = stop
        return found

    while True:
        found = scan(size)
        longest = max((k for k, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        heap = [(-k, x, y) for k, x, y in found]
        heapq.heapify(heap)
        while heap:
            k, x, y = heapq.heappop(heap)
            taken = done_a[x : x - k] | done_b[y : y - k]
            if not taken.any():
                done_a[x : x - k] = done_b[y : y - k] = True
                out.append((x, y, -k))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
            for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # what longer tiles left of it
                if hi - lo >= size:
                    heapq.heappush(heap, (lo - hi, x + lo, y + lo))
        if size <= min_match:
            return out
        size = max(size // 2, min_match)


# -- the benchmark --------------------------------------------------------------------------------


@dataclass
class Block:
    ids: list
    items: list[np.ndarray]
    seeds: dict[int, tuple[Sorted, np.ndarray, np.ndarray]]  # by length: hashes, first entry of each, (item, place) entries


def block_of(rows: list[tuple[int, str]], min_match: int) -> Block:
    items = [words(t or "")[0] for _, t in rows]
    by: dict[int, list] = {}
    for k, w in enumerate(items):
        if len(w):
            size = min(min_match, len(w))
            h = shingle_hashes(w, size)
            by.setdefault(size, []).append(np.stack([h, np.full(len(h), k, np.uint64), np.arange(len(h), dtype=np.uint64)], 1))
    seeds = {}
    for size, parts in by.items():
        every = np.concatenate(parts)
        every = every[np.argsort(every[:, 0], kind="stable")]
        index = Sorted(every[:, 0])
        seeds[size] = (index, np.append(np.searchsorted(every[:, 0], index.keys[:-1]), len(every)), every[:, 1:].astype(np.int64))
    return Block([i for i, _ in rows], items, seeds)


def _covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of ``size`` that begins at one of ``at``."""
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + size, minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def matches(text: str, block: Block, min_match: int, coverage: float) -> list[dict]:
    """Items of the block that the text holds: item, tiles, words matched, words of the item, coverage, spans."""
    seq, start, end = words(text)
    out = []
    for size, (index, first, entries) in block.seeds.items():
        if len(seq) < size:
            continue
        row = index.find(shingle_hashes(seq, size))
        some = np.unique(row[row >= 0])
        if not len(some):
            continue
        n = first[some + 1] - first[some]
        entry = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, place, seed = entries[entry, 0], entries[entry, 1], np.repeat(some, n)
        order = np.argsort(item, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
            k = int(item[mine[0]])
            whole = block.items[k]
            # Tiles are made of seeds, so they cover no more than the seeds do.
            if _covered(place[mine], size, len(whole)).sum() < coverage * len(whole):
                continue
            live = _covered(np.flatnonzero(np.isin(row, seed[mine])), size, len(seq))
            # Only the stretches that seeds cover matter; a shut word keeps them apart.
            keep = np.flatnonzero(live)
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            at, shut = np.insert(keep, gap, keep[gap - 1] + 1), np.insert(np.zeros(len(keep), bool), gap, True)
            got = tiles(whole, seq[at], min(min_match, len(whole)), shut)
            found = sum(t[2] for t in got)
            if found and found >= coverage * len(whole):
                spans = sorted((int(start[at[y]]), int(end[at[y + long - 1]])) for _, y, long in got)
                out.append({"item": k, "tiles": len(got), "matched": found, "words": len(whole), "coverage": found / len(whole), "spans": ",".join(f"{a}:{b}" for a, b in spans)})
    return sorted(out, key=lambda m: m["item"])


# -- Spark ----------------------------------------------------------------------------------------

_RESULT = {"item_id": pa.int64(), "n_tiles": pa.int64(), "matched_words": pa.int64(), "item_words": pa.int64(), "coverage": pa.float64(), "spans": pa.string()}
_RESULT_DDL = "item_id long, n_tiles long, matched_words long, item_words long, coverage double, spans string"


def _searched(n_words: int, min_match: int, short_items: bool) -> bool:
    return n_words >= (1 if short_items else min_match)


def skipped_items(benchmark: DataFrame, *, min_match: int = MIN_MATCH, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, n_words of the items that aren't searched by default: those of fewer than ``min_match`` words, null ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, n) for i, t in zip(*columns(b, "i", "t"), strict=True) if not _searched(n := len(words(t)[0]), min_match, False)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["item_id", "n_words"])

    return map_batches(benchmark.select(F.col(item_col).cast("long").alias("i"), text_of(item_text_col).alias("t")), run, "item_id long, n_words long")


def _small(benchmark: DataFrame, min_match: int, short_items: bool, item_col: str, item_text_col: str) -> Block | None:
    """The benchmark as an index, if it has at most ``SMALL`` characters."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t <> ''")
    if (items.agg(F.sum(F.length("t") + F.lit(16))).first()[0] or 0) > SMALL:
        return None
    return block_of([tuple(r) for r in items.collect() if _searched(len(words(r.t)[0]), min_match, short_items)], min_match)


def _results(keys: str, got: list[tuple], ids: list) -> pa.RecordBatch:
    """A row for each (key, match)."""
    schema = pa.schema([(keys, pa.string() if keys == "key" else pa.int64()), *_RESULT.items()])
    return batch_of(schema, **{keys: [k for k, _ in got]}, item_id=[ids[m["item"]] for _, m in got], n_tiles=[m["tiles"] for _, m in got], matched_words=[m["matched"] for _, m in got], item_words=[m["words"] for _, m in got], coverage=[m["coverage"] for _, m in got], spans=[m["spans"] for _, m in got])


def _item_seeds(items: DataFrame, min_match: int, short_items: bool) -> DataFrame:
    """item, words of its seeds, seed (distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(*columns(b, "item", "t"), strict=True):
                w = words(t)[0]
                if not _searched(len(w), min_match, short_items):
                    continue
                size = min(min_match, len(w))
                seeds = np.unique(shingle_hashes(w, size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seeds), key)), pa.array(np.full(len(seeds), size)), pa.array(seeds)], names=["item", "size", "seed"])

    return map_batches(items.select("item", "t"), run, "item long, size long, seed long")


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bits by the seeds' leading bits: FILTER / 64 numbers at most, however many seeds there are."""
    slot = F.pmod("seed", F.lit(FILTER))
    got = seeds.select(F.floor(slot / 64).alias("word"), F.expr("shiftleft(1L, CAST(pmod(seed, 64) AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def _document_seeds(texts: DataFrame, lengths: list[int], bits: np.ndarray) -> DataFrame:
    """key, seed (distinct in each text) of the seeds of these lengths that pass the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)  # FILTER bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for key, t in zip(*columns(b, "key", "t"), strict=True):
                w = words(t)[0]
                h = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_hashes(w, n) for n in lengths if n <= len(w))]))
                at = h & np.uint64(FILTER - 1)
                h = h[(bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["key", "seed"])

    return map_batches(texts, run, "key string, seed long")


def _chosen(items: DataFrame, counted: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """item, seed: of each item its rarest seeds; the others together cover less than it takes."""
    rows = items.join(counted.groupBy("item").agg(F.collect_list(F.struct("seed", "n")).alias("counts")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t, counts in zip(*columns(b, "item", "t", "counts"), strict=True):
                w = words(t)[0]
                size = min(min_match, len(w))
                h, n = shingle_hashes(w, size).view(np.int64), {c["seed"]: c["n"] for c in counts}
                place: dict[int, list[int]] = {}
                for j, x in enumerate(h.tolist()):
                    if x in n:  # else no document has it
                        place.setdefault(x, []).append(j)
                common = sorted(place, key=lambda x: (-n[x], x))
                covered, total, k = np.zeros(len(w), bool), 0, 0
                for k, x in enumerate(common):  # noqa: B007
                    for j in place[x]:
                        total += size - int(covered[j : j + size].sum())
                        covered[j : j + size] = True
                    if total >= coverage * len(w):
                        break
                else:
                    k = len(common)  # all of them together don't cover enough
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(common) - k, item)), pa.array(common[k:], pa.int64())], names=["item", "seed"])

    return map_batches(rows, run, "item long, seed long")


def _joined(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, short_items: bool, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    with Scratch(docs.sparkSession) as scratch:
        return _found(docs, benchmark, min_match, coverage, short_items, text_col, item_col, item_text_col, scratch)


def _found(docs: DataFrame, benchmark: DataFrame, min_match: int, coverage: float, short_items: bool, text_col: str, item_col: str, item_text_col: str, scratch: Scratch) -> DataFrame:
    """key (MD5 of the text) and the columns of a result, for each text and item found in it; by a join of seeds."""
    spark = docs.sparkSession
    items = scratch(benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"), F.monotonically_increasing_id().alias("item")).where("t <> ''"), "tiling-items")
    texts = docs.select(F.md5(F.col(text_col)).alias("key"), F.col(text_col).alias("t")).where("t <> ''")
    held = scratch(_item_seeds(items, min_match, short_items), "tiling-item-seeds")
    seeds = scratch(_document_seeds(texts, [r["size"] for r in held.select("size").distinct().collect()], _seed_filter(held)).distinct(), "tiling-seeds")
    counted = held.join(seeds.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    chosen = _chosen(items, counted, min_match, coverage)
    pairs = scratch(seeds.join(chosen, "seed").select("key", "item").distinct(), "tiling-pairs")
    once = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    rows = pairs.join(items.withColumnRenamed("t", "item_text"), "item").join(once, "key").select("key", "t", "i", "item_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, ids = [], []
            for key, t, i, item in zip(*columns(b, "key", "t", "i", "item_text"), strict=True):
                got += [(key, m | {"item": len(ids)}) for m in matches(t, block_of([(i, item)], min_match), min_match, coverage)]
                ids.append(i)
            yield _results("key", got, ids)

    return written(spark, map_batches(rows, run, f"key string, {_RESULT_DDL}"), "tiling-found")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE, short_items: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_tiles, matched_words, item_words, coverage, spans: a row for each item found.

    Items of fewer than ``min_match`` words are left out (``skipped_items`` lists them): a word or two stand in
    any text. With ``short_items`` they are searched, and must occur whole. Items and documents that are
    null or have no words match nothing. Repeated rows of either table give repeated results; an empty table of
    either kind gives none; other columns aren't read. Texts and words are taken whole; memory follows
    the lengths of a text and an item, however often their words repeat.
    """
    block = _small(benchmark, min_match, short_items, item_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    if block is None:
        found = _joined(docs, benchmark, min_match, coverage, short_items, text_col, item_col, item_text_col)
        return rows.select("doc_id", F.md5("text").alias("key")).join(found, "key").drop("key")
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            yield _results("doc_id", [(key, m) for key, text in zip(*columns(b, "doc_id", "text"), strict=True) for m in matches(text, block, min_match, coverage)], block.ids)

    return map_batches(rows, run, f"doc_id long, {_RESULT_DDL}")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE, short_items: bool = False, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found.

    Null and empty texts stay, and so do repeated rows; no other column is looked at.
    """
    names = docs.columns
    block = _small(benchmark, min_match, short_items, item_col, item_text_col)
    if block is None:
        found = _joined(docs, benchmark, min_match, coverage, short_items, text_col, item_col, item_text_col).select("key").distinct()
        return docs.join(found, F.md5(F.col(text_col)) == found["key"], "left_anti").select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [not matches(t or "", shared.value, min_match, coverage) for t in columns(b, text_col)[0]]
            yield b.select(names).filter(pa.array(clean, pa.bool_()))

    return map_batches(docs, run, docs.schema)
