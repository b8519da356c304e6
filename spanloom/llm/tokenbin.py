"""Token ids in binary shards: Simple-8b word-aligned coding.

A 64-bit word holds a selector (4 bits) and as many ids of one width as fit into the other 60 bits.
Ids of more than 60 bits are escapes: the stream has 0 in their place, and the block lists position
and value. A shard is

    magic, format version, block size, ids, documents, blocks, escapes     7 unsigned 64-bit numbers
    first word of each block                                               blocks + 1 numbers
    id, first id and end of ids of each document                           3 x documents numbers
    block, position and value of each escape                               3 x escapes numbers
    words

all little-endian. Every block starts a new word, so any block decodes by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.llm.bpe import encoder, tokenizer_path
from spanloom.runtime import fresh_path, plan_bytes, written

# Fixed values of the public Simple-8b format: ids in a word, and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

MAGIC, VERSION, BLOCK = int.from_bytes(b"S8BTOKEN", "little"), 1, 4096
#: Ids of a shard; a partition writes as many shards as it needs.
SHARD = 1 << 22
#: Bytes of input for a range of ids; ranges are as many as the input needs.
RANGE = 128 << 20


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, from the exponent of its floating-point form where that is exact."""
    n = (ids.astype(np.float64).view(np.int64) >> 52) - 1022
    n[ids == 0] = 0
    for k in np.flatnonzero(ids >> np.uint64(53)).tolist():
        n[k] = int(ids[k]).bit_length()
    return n.astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the end), escapes as (block, position, value) rows."""
    ids = ids.astype(np.uint64)
    n_blocks = -(-len(ids) // block)
    escape = np.flatnonzero(ids >> np.uint64(60))
    escapes = np.stack([(escape // block).astype(np.uint64), (escape % block).astype(np.uint64), ids[escape]], 1) if len(escape) else np.zeros((0, 3), np.uint64)
    padded = np.zeros(n_blocks * block, np.uint64)
    padded[: len(ids)] = ids
    padded[escape] = 0
    grid = np.zeros((n_blocks, block + 240), np.uint64)
    grid[:, :block] = padded.reshape(n_blocks, block)
    flat = grid.reshape(-1)
    widest = {1: _bits(flat)}
    # Largest width among the next n ids, by joining two shorter windows.
    for n, a in ((2, 1), (3, 2), (4, 2), (5, 4), (6, 4), (7, 4), (8, 4), (10, 8), (12, 8), (15, 8), (20, 12), (30, 15), (60, 30), (120, 60), (240, 120)):
        w = widest[a].copy()
        np.maximum(w[: len(w) - a], widest[n - a][a:], out=w[: len(w) - a])
        widest[n] = w
    # Where a selector fits, all later ones do: the first that fits is the number of those that don't.
    choice = np.zeros(len(flat), np.uint8)
    for s in range(15):
        choice += widest[int(COUNTS[s])] > np.uint8(WIDTHS[s])
    # All blocks walk from word to word in step.
    step, size = COUNTS[choice], block + 240
    length = np.minimum(block, len(ids) - np.arange(n_blocks) * block)
    at, alive, taken = np.zeros(n_blocks, np.int64), np.arange(n_blocks), []
    while len(alive):
        where = alive * size + at[alive]
        taken.append(where)
        at[alive] += step[where]
        alive = alive[at[alive] < length[alive]]
    where = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    sel = choice[where]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        n, w = int(COUNTS[s]), int(WIDTHS[s])
        if w:
            mine = np.flatnonzero(sel == s)
            for k in range(n):
                words[mine] |= flat[where[mine] + k] << np.uint64(w * k)
    return words, np.searchsorted(where, np.arange(n_blocks + 1) * size), escapes


def unpack(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids again; every selector's words are decoded at once."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[sel]
    upto = np.concatenate([[0], np.cumsum(count)])
    n_blocks = len(first) - 1
    block_of = np.repeat(np.arange(n_blocks), np.diff(first))
    place = block_of * (block + 240) + (upto[:-1] - upto[first[:-1]][block_of])
    out = np.zeros(n_blocks * (block + 240), np.uint64)
    for s in np.unique(sel):
        n, w = int(COUNTS[s]), int(WIDTHS[s])
        if w:
            mine = np.flatnonzero(sel == s)
            mask = np.uint64((1 << w) - 1)
            for k in range(n):
                out[place[mine] + k] = (words[mine] >> np.uint64(w * k)) & mask
    grid = out.reshape(n_blocks, block + 240)[:, :block]
    if len(escapes):
        grid[escapes[:, 0].astype(np.int64), escapes[:, 1].astype(np.int64)] = escapes[:, 2]
    return grid.reshape(-1)[:n_ids]


def shard_bytes(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    words, first, escapes = pack(ids, block)
    docs = np.stack([doc_ids.astype(np.int64).view(np.uint64), np.concatenate([[0], ends[:-1]]).astype(np.uint64), ends.astype(np.uint64)], 1) if len(doc_ids) else np.zeros((0, 3), np.uint64)
    head = np.array([MAGIC, VERSION, block, len(ids), len(docs), len(first) - 1, len(escapes)], np.uint64)
    return b"".join(x.astype("<u8").tobytes() for x in (head, first.astype(np.uint64), docs, escapes, words))


def parse_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc ids, (start, end) of each document within the shard, all ids."""
    raw = np.frombuffer(data, "<u8")
    magic, version, block, n_ids, n_docs, n_blocks, n_escapes = (int(x) for x in raw[:7])
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token shard")
    a = 7 + n_blocks + 1
    b = a + 3 * n_docs
    c = b + 3 * n_escapes
    docs = raw[a:b].reshape(-1, 3)
    ids = unpack(raw[c:], raw[7:a].astype(np.int64), raw[b:c].reshape(-1, 3), n_ids, block) if n_ids else np.zeros(0, np.uint64)
    return docs[:, 0].view(np.int64), docs[:, 1:].astype(np.int64), ids


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, target: str, *, tokenizer: str | None = None, end_id: int = 0, partitions: int | None = None, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write shards in ascending ``id_col`` order below ``target``; the manifest.

    Rows are dealt by ranges of the id, one for each ``RANGE`` bytes of input at least. Each task writes files of its own name and renames nothing:
    the manifest lists the files of the attempt that was kept, and only those are read. Null texts
    count as empty, null ids come first (written as the smallest integer), repeated rows are kept,
    an empty table gives an empty manifest. Other columns aren't read.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(docs) // RANGE), 1)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
    end = np.array([end_id], np.uint64)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        enc, seq, held = encoder(path), 0, 0
        part, doc_ids, ids = 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            fs, base = pafs.FileSystem.from_uri(target)
            fs.create_dir(base, recursive=True)
            name = f"{part:06d}-{seq:05d}-{uuid.uuid4().hex[:8]}.s8b"
            data = shard_bytes(np.array(doc_ids, np.int64), np.cumsum([len(x) for x in ids]), np.concatenate(ids))
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(data)
            out = batch_of(schema, part=[part], seq=[seq], path=[f"{target}/{name}"], n_docs=[len(ids)], n_tokens=[held], n_bytes=[len(data)])
            seq, held = seq + 1, 0
            doc_ids.clear()
            ids.clear()
            return out

        for b in batches:
            keys, texts, parts = columns(b, "k", "text", "part")
            got, counts = enc.encode(texts)
            for key, p, x in zip(keys, parts, np.split(got, np.cumsum(counts)[:-1]) if len(counts) else [], strict=True):
                part = p
                doc_ids.append(-(1 << 63) if key is None else key)
                ids.append(np.append(x.astype(np.uint64), end))
                held += len(ids[-1])
                if held >= shard:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text"))
    rows = rows.repartitionByRange(n, "k").sortWithinPartitions("k", "text").withColumn("part", F.spark_partition_id())
    return written(spark, map_batches(rows, shards, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the shards listed.

    The manifest has one row for each shard of millions of ids. Totals run along the shards of each
    range, and along the ranges.
    """
    from pyspark.sql import Window

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*columns(b, "path", "base"), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name) as f:
                    doc_ids, spans, ids = parse_shard(f.read())
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:e]) for a, e in spans.tolist()]
                null = doc_ids == -(1 << 63)
                yield batch_of(schema, doc_id=pa.array(doc_ids, mask=null), start=spans[:, 0] + base, n_tokens=spans[:, 1] - spans[:, 0], ids_crc32=crc)

    earlier = (Window.unboundedPreceding, -1)
    ranges = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*earlier)), F.lit(0))
    listed = manifest.withColumn("own", own).join(ranges, "part").withColumn("base", F.col("before") + F.col("own"))
    return map_batches(listed.select("path", "base").repartition(n, "path"), rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as token shards in the shared folder and read them back."""
    return read_tokens(write_tokens(docs, fresh_path(docs.sparkSession, "tokens"), **options))
