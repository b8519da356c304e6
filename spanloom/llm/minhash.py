"""Near-duplicates by MinHash: universal hash minima, banding, verification, components.

1. One pass makes each document's shingle set, its fingerprint, the minima of ``bands * rows``
   universal hash functions, and a key for each band. Documents of equal sets form a class; from here
   on a class is its smallest document.
2. Classes that share a band key are candidates. A bucket isn't expanded to pairs: each member meets
   the smallest and the largest member of its bucket. Candidates are verified by their signatures
   (far below the threshold: dropped), then on full sets.
3. The links found join classes to components. Only buckets that still hold several components have
   candidates left that could join any. A bucket with few such pairs gives them; the members of
   crowded ones go through an exact prefix filter instead: of two sets that overlap enough, the
   rarest shingles of one occur among the rarest of the other. These candidates are verified likewise.
4. Components by large-star and small-star.

A pair at the threshold of 0.8 shares none of 40 bands of 5 rows with a probability of 1.2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.llm.hashing import groups, mix
from spanloom.llm.components import connected_components
from spanloom.llm.shingles import shingle_sets
from spanloom.runtime import Scratch, written

BANDS, ROWS = 40, 5
#: Ids that are broadcast at most (16 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_IDS = 1 << 18
#: Standard deviations below the threshold at which a signature rules a pair out.
SIGMAS = 6.0
#: Pairs between components that a bucket gives by itself; beyond it, its members take the prefix filter.
LIGHT = 32
#: Members of a shingle that one task of the prefix filter joins.
PART = 1 << 10
#: Counters that rank shingles by how rare they are; any ranking gives all pairs.
COUNTERS = 1 << 18
_BLOCK = 1 << 14


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of n universal hash functions x -> (a x + b) mod 2^64."""
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of n hash functions over each (non-empty) set, as unsigned 32-bit numbers."""
    a, b = hash_functions(n)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    start = np.cumsum(size) - size
    out = np.full((len(sets), n), 2**32 - 1, np.uint32)
    at = 0
    while at < len(sets):
        end = max(at + 1, int(np.searchsorted(start + size, start[at] + _BLOCK, "right")))  # sets that fit a block together
        for lo in range(int(start[at]), int(start[end - 1] + size[end - 1]), _BLOCK * 4):  # a large set in parts
            x = flat[lo : min(lo + _BLOCK * 4, int(start[end - 1] + size[end - 1]))]
            edge = start[at:end] - lo if end - at > 1 else np.zeros(1, np.int64)
            tmp = np.empty_like(x)
            for k in range(n):
                np.multiply(x, a[k], out=tmp)
                np.add(tmp, b[k], out=tmp)
                out[at:end, k] = np.minimum(out[at:end, k], np.minimum.reduceat(tmp, edge) >> np.uint64(32))
        at = end
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(sig), 0)
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def sketched(docs: DataFrame, *, shingle: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (fingerprint of the set), bands, sig of every row."""
    names = ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sig"]
    schema = pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = columns(b, "k", "text")
            for lo, hi in groups(texts):
                sets = shingle_sets(texts[lo:hi], shingle)
                some = [k for k, s in enumerate(sets) if len(s)]
                fp = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                band, sig = [None] * len(sets), [None] * len(sets)
                if some:
                    full = signatures([sets[k] for k in some], bands * rows)
                    for k, x, y in zip(some, band_keys(full, bands, rows).view(np.int64), full, strict=True):
                        band[k], sig[k] = x, y.tobytes()
                half = lambda x: x - (1 << 64) if x >> 63 else x
                yield batch_of(schema, doc_id=keys[lo:hi], n_shingles=[len(s) for s in sets], fp1=[half(x >> 64) for x in fp], fp2=[half(x & (1 << 64) - 1) for x in fp], bands=pa.array(band, pa.list_(pa.int64())), sig=sig)

    rows_ = docs.select(F.col(id_col).cast("long").alias("k"), text_of(text_col).alias("text"))
    return map_batches(rows_, run, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary")


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids: broadcast if they are few enough, else joined by a shuffle."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids.withColumnRenamed(ids.columns[0], key), key, "left_semi")


class _Verifier:
    def __init__(self, docs: DataFrame, sketch: DataFrame, shingle: int, percent: int, n: int, id_col: str, text_col: str, scratch: Scratch):
        self.scratch = scratch
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
        self.sketch, self.shingle, self.percent, self.n = sketch, shingle, percent, n

    def sets(self, ids: DataFrame) -> DataFrame:
        """doc_id, members (sorted hashes, packed) of the documents with these ids; a written table."""
        shingle, schema = self.shingle, pa.schema([("doc_id", pa.int64()), ("members", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys, texts = columns(b, "doc_id", "text")
                for lo, hi in groups(texts):
                    yield batch_of(schema, doc_id=keys[lo:hi], members=[s.tobytes() for s in shingle_sets(texts[lo:hi], shingle)])

        return self.scratch(map_batches(_only(self.docs, ids, "doc_id"), run, "doc_id long, members binary"), "minhash-sets")

    def prefix_pairs(self, named: DataFrame) -> DataFrame:
        """u, v of every pair of ``named`` (doc_id, c) of different c that could overlap enough.

        Shingles are ranked rarest first. Two sets of x and y shingles overlap enough if they share at
        least o = ceil(t (x + y) / (1 + t)) of them; then the first x - o + 1 of the one and the first
        y - o + 1 of the other have one in common. The rank comes from counters over these sets, a table
        of fixed size.
        """
        spark, percent = named.sparkSession, self.percent
        sets = self.sets(named.select("doc_id"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(COUNTERS, np.int64)
            for b in batches:
                for x in columns(b, "members")[0]:
                    total += np.bincount(np.frombuffer(x, np.uint64) % np.uint64(COUNTERS), minlength=COUNTERS)
            slot = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

        got = map_batches(sets.select("members"), count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # COUNTERS rows at most
        rank = np.zeros(COUNTERS, np.int64)
        rank[got.slot.to_numpy()] = got.n.to_numpy()
        shared = spark.sparkContext.broadcast(rank)

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, x in zip(*columns(b, "doc_id", "members"), strict=True):
                    x = np.frombuffer(x, np.uint64)
                    n = len(x)
                    x = x[np.lexsort((x, shared.value[x % np.uint64(COUNTERS)]))]
                    x = x[: n + (-percent * n // 100) + 1].view(np.int64)  # no partner needs more of it
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), key)), pa.array(x), pa.array(np.full(len(x), n)), pa.array(np.arange(len(x)))], names=["doc_id", "token", "n", "at"])

        rows = self.scratch(map_batches(sets, prefixes, "doc_id long, token long, n long, at long").join(named, "doc_id"), "minhash-prefixes")
        # A token that one component alone has joins nothing; a pair has a member outside its main one.
        sizes = rows.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "c")).alias("main"), F.sum("k").alias("all"), F.count("*").alias("several")).where("several > 1")
        mixed = self.scratch(sizes.select("token", F.col("main.c").alias("main"), F.ceil(F.col("all") / PART).alias("parts")), "minhash-tokens")
        held = self.scratch(rows.join(mixed, "token"), "minhash-held")
        # A frequent token is dealt in parts: each member outside the main component to one, all members to every one.
        y, x = (held.select("token", "main", "parts", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "n", "c", "at"))) for s in "yx")
        y = y.where("c_y <> main").withColumn("part", F.pmod(F.xxhash64("doc_id_y"), F.col("parts"))).drop("main", "parts")
        x = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("main", "parts")
        need = F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / (100 + percent) - 1e-9)
        close = (F.col("c_y") != F.col("c_x")) & (F.col("at_x") <= F.col("n_x") - need) & (F.col("at_y") <= F.col("n_y") - need)
        return y.join(x, ["token", "part"]).where(close).select(F.greatest("doc_id_y", "doc_id_x").alias("u"), F.least("doc_id_y", "doc_id_x").alias("v")).distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """The (u, v) of ``pairs`` whose sets overlap enough; a written table."""
        t = self.percent / 100
        least = int(np.floor(self.n * t - SIGMAS * np.sqrt(self.n * t * (1 - t))))
        ids = lambda p: p.select(F.explode(F.array("u", "v")).alias("id")).distinct()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, y = (np.frombuffer(b"".join(c), np.uint32).reshape(b.num_rows, -1) for c in columns(b, "su", "sv"))
                yield b.select(["u", "v"]).filter(pa.array(((x == y).sum(1) >= least) if b.num_rows else [], pa.bool_()))

        sig = self.scratch(_only(self.sketch.select("doc_id", "sig"), ids(pairs), "doc_id"), "minhash-sig")
        joined = pairs.join(sig.select(F.col("doc_id").alias("u"), F.col("sig").alias("su")), "u").join(sig.select(F.col("doc_id").alias("v"), F.col("sig").alias("sv")), "v")
        likely = self.scratch(map_batches(joined, near, "u long, v long"), "minhash-likely")

        percent = self.percent

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for x, y in zip(*columns(b, "mu", "mv"), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
                yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

        full = self.sets(ids(likely))
        joined = likely.join(full.select(F.col("doc_id").alias("u"), F.col("members").alias("mu")), "u").join(full.select(F.col("doc_id").alias("v"), F.col("members").alias("mv")), "v")
        return self.scratch(map_batches(joined, exact, "u long, v long"), "minhash-links")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents are linked where 100 * |A & B| >= percent * |A | B|. Texts that are null or have no words
    link with nothing, not even with each other; a null doc_id isn't part of any link and is kept.
    Ids name documents: rows of one id are one document, which has the links of all its texts; each row
    is returned. An empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    sketch = written(spark, sketched(docs, shingle=shingle, bands=bands, rows=rows, id_col=id_col, text_col=text_col), "minhash-sketch")
    some = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("top"))
    with Scratch(spark) as scratch:
        heads = classes.select(F.col("top").alias("doc_id"))
        banded = some.select("doc_id", "bands").join(heads, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key"))
        shared = banded.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        members = scratch(banded.join(shared, "key"), "minhash-buckets")
        check = _Verifier(docs, some, shingle, percent, bands * rows, id_col, text_col, scratch)

        stars = members.select(F.explode(F.array(F.struct(F.col("doc_id").alias("u"), F.col("lo").alias("v")), F.struct(F.col("hi").alias("u"), F.col("doc_id").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        stars = scratch(stars, "minhash-stars")
        first = check.links(stars)
        label = connected_components(first)

        named = members.join(label, members.doc_id == label.node, "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
        named = scratch(named, "minhash-named")
        sizes = named.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("several"), F.sum("n").alias("m"), F.max(F.struct("n", "c")).alias("main")).where("several > 1")
        sizes = scratch(sizes.select("key", F.col("main.c").alias("main"), ((F.col("m") - F.col("main.n")) * F.col("m") <= LIGHT).alias("light")), "minhash-mixed")
        left = named.join(sizes, "key")
        # Pairs between components have a member outside the main one.
        x = left.where("light AND c <> main").select("key", F.col("doc_id").alias("d1"), F.col("c").alias("c1"))
        y = left.where("light").select("key", F.col("doc_id").alias("d2"), F.col("c").alias("c2"))
        across = x.join(y, "key").where("c1 <> c2").select(F.greatest("d1", "d2").alias("u"), F.least("d1", "d2").alias("v")).distinct()
        crowded = scratch(left.where("NOT light").select("doc_id", "c").distinct(), "minhash-crowded")
        if crowded.limit(1).count():
            across = across.unionByName(check.prefix_pairs(crowded)).distinct()
        across = across.join(stars, ["u", "v"], "left_anti")
        second = check.links(scratch(across, "minhash-across"))
        label = connected_components(first.unionByName(second))

    heads = classes.join(label, classes.top == label.node, "left").select("fp1", "fp2", F.coalesce("component", "top").alias("c"))
    out = sketch.select("doc_id", "n_shingles", "fp1", "fp2").join(heads, ["fp1", "fp2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
