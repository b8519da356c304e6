"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 characters decides where chunks end, so equal passages fall into
equal chunks wherever they stand, and an insertion moves the cuts near it only. Rows of neighbouring
chunks that are just long enough are counted by digest; a passage is repeated where each of its chunks
stands in such a row that another document holds in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, fresh_name, map_batches, text_of
from spanloom.llm.hashing import CHUNK, code_point_keys, code_points, groups, mix, span_hashes
from spanloom.runtime import written

#: Characters of a chunk: at least, at most; leading bits of the gear hash that must be 0 at a cut.
LEAST, MOST, BITS = 16, 96, 4
#: Characters that repeated chunks in a row must have to count as a passage.
RUN = 100
_WINDOW = 16
_P = np.uint64(0x9E3779B97F4A7C15)


def gear(cps: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + key(c[i]) in 16 bits: a hash of the last 16 characters."""
    h = (code_point_keys(cps) >> np.uint64(40)).astype(np.uint16)
    for step in (1, 2, 4, 8):  # joins hashes of the last step characters to those of twice as many
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def cuts(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> np.ndarray:
    """Ends of chunks of several texts that stand in a row; ``least`` is at least the hash's window.

    Where ``most`` characters have no cut, the first place of the smallest hash among those allowed is
    one: it depends on the content too, so texts of one repeated word or line fall into equal chunks.
    """
    if least < _WINDOW:
        raise ValueError("least must cover the rolling hash's window")
    h = gear(cps)
    place = np.flatnonzero(h >> np.uint16(16 - bits) == 0) + 1
    edge = np.searchsorted(place, starts), np.searchsorted(place, ends)
    out: list[int] = []
    places = place.tolist()
    for a, b, k, stop in zip(starts.tolist(), ends.tolist(), edge[0].tolist(), edge[1].tolist(), strict=True):
        at = a
        for p in places[k:stop]:
            if p - at < least:
                continue
            while p - at > most:
                at += least + int(h[at + least - 1 : at + most].argmin())
                out.append(at)
            if p - at >= least:
                at = p
                out.append(at)
        while b - at > most:
            at += least + int(h[at + least - 1 : at + most].argmin())
            out.append(at)
        if at < b:
            out.append(b)
    return np.array(out, np.int64)


def _digests(cps: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits of each span, as two columns."""
    return np.stack([span_hashes(cps, start, stop), span_hashes(cps, start, stop, seed=1)], 1)


def chunks(texts: list[str], **sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and digest (two columns) of every chunk."""
    parts = []
    for a, b in groups(texts):
        if b - a == 1 and len(texts[a]) > CHUNK:
            parts += _long(texts[a], a, sizes)
            continue
        size = np.array([len(t) for t in texts[a:b]], np.int64)
        end = np.cumsum(size)
        cps = code_points("".join(texts[a:b]))
        stop = cuts(cps, end - size, end, **sizes)
        start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
        which = np.searchsorted(end, start, "right")
        parts.append((which + a, start - (end - size)[which], stop - (end - size)[which], _digests(cps, start, stop)))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros((0, 2), np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _long(text: str, number: int, sizes: dict) -> list:
    """A long text in slices; each goes on from the last sure cut of the one before."""
    out, at = [], 0
    while at < len(text):
        part = text[at : at + CHUNK]
        cps = code_points(part)
        stop = cuts(cps, np.zeros(1, np.int64), np.array([len(part)]), **sizes)
        if at + len(part) < len(text):
            stop = stop[stop <= len(part) - sizes.get("most", MOST)]  # the last ones depend on what follows
        start = np.concatenate([[0], stop[:-1]])
        out.append((np.full(len(stop), number), start + at, stop + at, _digests(cps, start, stop)))
        at += int(stop[-1])
    return out


def stretches(texts: list[str], run: int = RUN, **sizes) -> tuple[np.ndarray, ...]:
    """Text number, start, end, number of the first chunk, chunks and digest (two columns) of rows of chunks.

    From every chunk the shortest row onwards, and to every chunk the shortest row up to it, that has
    ``run`` characters: the ones within a passage of that length together hold all of its chunks.
    """
    which, start, end, digest = chunks(texts, **sizes)
    place = np.concatenate([[0], np.cumsum(end - start)])
    n = np.arange(len(which))
    begin, stop = np.searchsorted(which, which, "left"), np.searchsorted(which, which, "right")
    onwards = np.searchsorted(place, place[:-1] + run, "left")
    back = np.searchsorted(place, place[1:] - run, "right") - 1
    on = onwards <= stop
    up = back >= begin
    up[up] = onwards[back[up]] != n[up] + 1  # the others are there already
    lo, hi = np.concatenate([n[on], back[up]]), np.concatenate([onwards[on], n[up] + 1])
    h = np.repeat((hi - lo).astype(np.uint64)[:, None], 2, 1)
    for k in range(int((hi - lo).max(initial=0))):
        more = np.flatnonzero(lo + k < hi)
        h[more] = mix(h[more] * _P + digest[lo[more] + k])
    return which[lo], start[lo], end[hi - 1], lo - begin[lo], hi - lo, h


# -- Spark ----------------------------------------------------------------------------------------


def stretch_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, **sizes) -> DataFrame:
    """doc_id, start, end (code points), chunk, chunks, digest, more (its other 64 bits), again of every row of chunks.

    ``again``: the text has the same row further up.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("digest", pa.int64()), ("more", pa.int64()), ("again", pa.bool_())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = columns(b, "k", "text")
            which, start, end, chunk, count, h = stretches(texts, run, **sizes)
            order = np.lexsort((start, h[:, 0], which))
            again = np.zeros(len(which), bool)
            again[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (h[order[1:]] == h[order[:-1]]).all(1)
            for lo in range(0, len(which), 100_000):
                s = slice(lo, lo + 100_000)
                small = {k: v[s].astype(np.int32) for k, v in (("start", start), ("end", end), ("chunk", chunk), ("chunks", count))}
                yield batch_of(schema, doc_id=pa.array(keys, pa.int64()).take(pa.array(which[s])), **small, digest=h[s, 0].view(np.int64), more=h[s, 1].view(np.int64), again=again[s])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text")).where("text <> ''")
    return map_batches(rows, find, "doc_id long, start int, end int, chunk int, chunks int, digest long, more long, again boolean")


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by``, and the smallest document, of the rows of chunks that several documents hold; whether their digests differ."""
    held = rows.groupBy(*by).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), (F.min("more") != F.max("more")).alias("mixed"))
    return held.where("first < last").select(*by, "first", "mixed")


def _hits(rows: DataFrame, within: bool) -> DataFrame:
    """Rows of chunks that another document holds, with the smallest document that does.

    Half of the digest deals the rows; the smallest and largest other half is kept with its count.
    Where these differ, as they do by chance for some of 10^12 rows, whole digests are compared.
    """
    shared = written(rows.sparkSession, _shared(rows, ["digest"]), "shared-rows")
    keep = ["doc_id", "start", "end", "chunk", "chunks", "again"]
    how = "left" if within else "inner"
    sure = shared.where("NOT mixed").select("digest", "first")
    out = rows.select("digest", *keep).join(sure, "digest", how).where("again OR first IS NOT NULL" if within else "first IS NOT NULL").select(*keep, "first")
    mixed = shared.where("mixed").select("digest")
    if mixed.limit(1).count():
        some = rows.join(mixed, "digest", "left_semi")
        out = out.unionByName(some.join(_shared(some, ["digest", "more"]).drop("mixed"), ["digest", "more"]).select(*keep, "first"))
    return out


def repeated_passages(docs: DataFrame, *, run: int = RUN, within: bool = False, **options) -> DataFrame:
    """doc_id, start, end, n_chunks, first_doc_id, is_first of every passage that other documents hold too.

    Every chunk of a passage stands in a row of chunks of at least ``run`` characters that one other
    document holds in the same order. The passage is split where this document begins or ceases to be
    the first holder of all such rows about a chunk; a first part shorter than ``run`` beside a repeat
    stays in the text and isn't reported. ``first_doc_id`` is the smallest id among the holders of the
    part's rows, and this document where it ``is_first``: where the others are cut, every passage
    stays in a document that holds it first. With ``within``, what a text holds further up is a repeat
    too, whether other documents hold it or not. Null and empty texts and rows without an id have no
    passages; rows of one id are one document; an empty table gives no rows; other columns aren't
    read. A digest has 128 bits.
    """
    rows = stretch_rows(docs, run=run, **options).where("doc_id IS NOT NULL")
    again = F.col("again") if within else F.lit(False)
    later = F.when((F.col("first") < F.col("doc_id")) | again, 1).otherwise(0)
    hits = _hits(rows, within).withColumn("later", later).withColumn("first", F.coalesce("first", "doc_id")).repartition("doc_id")
    # Along each document: how many rows that it holds first, or later, are open from here on.
    edge = lambda place, chunk, sign, first: F.struct(place.cast("long").alias("at"), chunk.alias("chunk"), (F.lit(sign) * (1 - F.col("later"))).alias("own"), (F.lit(sign) * F.col("later")).alias("later"), first.alias("first"))
    edges = F.array(edge(F.col("start"), F.col("chunk"), 1, F.when(F.col("later") == 1, F.col("first"))), edge(F.col("end"), F.col("chunk") + F.col("chunks"), -1, F.lit(None).cast("long")))
    steps = hits.select("doc_id", F.explode(edges).alias("e")).groupBy("doc_id", "e.at").agg(F.min("e.chunk").alias("chunk"), F.sum("e.own").alias("own"), F.sum("e.later").alias("later"), F.min("e.first").alias("first"))
    order = Window.partitionBy("doc_id").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    is_first = F.when(F.sum("later").over(so_far) > 0, False).when(F.sum("own").over(so_far) > 0, True)
    open_ = steps.select("doc_id", "at", "chunk", "first", is_first.alias("is_first"), F.lead("at").over(order).alias("to"), F.lead("chunk").over(order).alias("next"))
    part = F.sum((~F.col("is_first").eqNullSafe(F.col("was"))).cast("int")).over(so_far)
    parts = open_.withColumn("was", F.lag("is_first").over(order)).withColumn("part", part).where("is_first IS NOT NULL")
    out = parts.groupBy("doc_id", "part", "is_first").agg(F.min("at").alias("start"), F.max("to").alias("end"), (F.max("next") - F.min("chunk")).cast("long").alias("n_chunks"), F.coalesce(F.min("first"), F.col("doc_id")).alias("first_doc_id"))
    return out.where(~F.col("is_first") | (F.col("end") - F.col("start") >= run)).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "is_first")


def _keyed(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``docs`` with a key for each document: its id, or, if an id stands with several texts, the first row of the id and text."""
    h = F.xxhash64(F.coalesce(text_col, F.lit("")))
    own = docs.withColumn(key, F.col(id_col).cast("long"))
    mixed = own.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high")
    if not mixed.limit(1).count():
        return own
    row, text, one, same, first = (fresh_name(n, own.columns) for n in ("row", "text_hash", "one", "same", "first"))
    rows = written(docs.sparkSession, own.withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.md5(F.coalesce(text_col, F.lit("")))), "numbered-documents")
    least = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(one), F.col(text).alias(same)).agg(F.min(row).alias(first))
    both = rows.join(least, (F.col(key) == F.col(one)) & (F.col(text) == F.col(same)), "left")
    return written(docs.sparkSession, both.select(*docs.columns, F.col(first).alias(key)), "keyed-documents")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every repeated passage cut out of all documents but the first that holds it.

    All columns stay, whatever their names; so do rows without an id, null texts and repeated rows. Rows of
    one id and one text are one document; rows of one id and several texts are as many documents, and the first
    is the one whose row stands first.
    """
    key, held, own = (fresh_name(n, docs.columns) for n in ("key", "spans", "own"))
    keyed = _keyed(docs, id_col, text_col, key)
    plain = keyed.select(F.col(key).alias("doc_id"), F.col(text_col).alias("text"))
    found = repeated_passages(plain, **options).where("NOT is_first")
    spans = found.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("start", "end")).alias(held))
    joined = keyed.join(spans, F.col(key) == F.col(own), "left").select(*docs.columns, held)
    names, place = docs.columns, docs.columns.index(text_col)

    def cut(text: str | None, spans: list[dict] | None) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, b in sorted((x["start"], x["end"]) for x in spans):
            out.append(text[at:a])
            at = b
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *cols, spans = b.columns
            cols[place] = pa.array([cut(t, x) for t, x in zip(cols[place].to_pylist(), spans.to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return map_batches(joined, run, docs.schema)
