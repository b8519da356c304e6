"""Alignment of two tokenizers' tokens over the same whole texts.

Both tokenizers see a space and the text. Their tokens are intervals of its bytes. The intervals of B
are a static index (their ends in order); a bisection for each end of an A token gives the B tokens that
it overlaps; where no token of either spans a gap, a group ends.

Neither tokenizer merges across a space that follows a character other than white space: such places cut
a text into units, whose tokens stand in a row. A worker keeps the aligned units that it has met, in a
table of bounded size, so a unit that repeats is encoded once. Tests hold this against whole texts.

1. One pass aligns the texts and writes each document's numbers and the pair of ids of every link.
2. From that table the documents of each pair are counted, added up in the tasks before the shuffle.
3. Each link is compared with these counts. They are sent to all tasks if they are no more than
   ``PAIRS`` (counted first); beyond it, the links of each document are joined with them.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.llm.bpe import tokenizer_path
from spanloom.llm.hashing import CHUNK, groups
from spanloom.runtime import Scratch, written

#: Pairs of ids (16 bytes each) that are sent to all tasks at most.
PAIRS = 2_000_000
#: Units, and characters of them, that a worker keeps; beyond either the table starts anew.
UNITS, UNIT_CHARS = 300_000, 6_000_000
#: Units of a long text handled at once.
BLOCK = 1 << 16
#: Pairs that a task adds up before it hands them on.
HELD = 1 << 21

# A unit ends before a space that follows something other than white space.
_UNIT = re.compile(r"\s*\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?|\s+")
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_level() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Ids and bytes of tokenizer A (a file of the ``tokenizers`` library, byte-level) and B (a ``sentencepiece`` model)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte, special = _byte_level(), {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        entries = [special.get(i) or self.a.id_to_token(i) or "" for i in range(max(self.a.get_vocab_size(), *special, 0) + 1)]
        self.bytes_a = [e.encode() if i in special else bytes(byte[c] for c in e) for i, e in enumerate(entries)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Whether texts can be cut into units: no entry of B may go on after a space that follows something else.
        self.by_unit = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.b.piece_to_id("▁")

    @property
    def pair_type(self) -> type:
        """Type of the number a * (entries of B) + b of a pair."""
        return np.uint32 if len(self.bytes_a) * len(self.bytes_b) <= 1 << 32 else np.uint64

    def encode(self, spaced: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that begins with a space, which B adds itself (but to an empty text)."""
        a, b = self.a.encode(spaced, add_special_tokens=False).ids, self.b.encode(spaced[1:], num_threads=1)
        return np.array(a, np.int64), np.array(b or [self.space], np.int64)

    def same(self, raw: bytes, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the tokens' bytes, joined, are these bytes."""
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist()))


@lru_cache(1)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the B tokens from ``lo`` to before ``hi`` that it overlaps. Tokens stand in a row from 0; none is empty."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    return np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left") + 1


def _upto(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many tokens end at or before each place, with 0 in front."""
    return np.concatenate([[0], np.searchsorted(ends, at, "right")])


class Aligner:
    """Aligned units of a worker: their numbers, the pairs of their links, and their groups as text."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        # By unit: 1 if its tokens give its bytes back, and NUMBERS; where its pairs end.
        self.numbers, self.edge, self.pairs = np.zeros((1 << 10, 5), np.int64), np.zeros((1 << 10) + 1, np.int64), np.zeros(1 << 12, self.tok.pair_type)
        self.text, self.chars = [], 0

    def measure(self, spaced: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Numbers of texts that begin with a space, the pairs of all their links in a row, and each text's groups.

        The texts are encoded as one where that gives them back with an end of both at each of their ends.
        """
        joined = "".join(spaced)
        raw, a, b = joined.encode(), *self.tok.encode(joined)
        ends_a, ends_b, ends = np.cumsum(self.tok.size_a[a]), np.cumsum(self.tok.size_b[b]), np.cumsum([len(t.encode()) for t in spaced])
        out = np.zeros((len(spaced), 5), np.int64)
        if not (self.tok.same(raw, a, b) and np.isin(ends, ends_a).all() and np.isin(ends, ends_b).all()):
            if len(spaced) == 1:  # other bytes: no tokens
                return out, self.pairs[:0], [""]
            half = len(spaced) // 2
            one, two = self.measure(spaced[:half]), self.measure(spaced[half:])
            return np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), one[2] + two[2]
        lo, hi = overlaps(ends_a, ends_b)
        n = hi - lo
        first = np.cumsum(n) - n
        pairs = np.repeat(a, n) * len(self.tok.bytes_b) + b[np.repeat(lo - first, n) + np.arange(int(n.sum()))]
        both = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        edge_a, edge_group = _upto(ends_a, ends), _upto(both, ends)
        out[:, 0], out[:, 1], out[:, 2], out[:, 3] = 1, np.diff(edge_a), np.diff(_upto(ends_b, ends)), np.diff(edge_group)
        out[:, 4] = np.diff(np.append(first, len(pairs))[edge_a])
        str_a, str_b, texts, x, y = list(map(str, a.tolist())), list(map(str, b.tolist())), [], 0, 0
        for to_a, to_b in zip(_upto(ends_a, both)[1:].tolist(), _upto(ends_b, both)[1:].tolist(), strict=True):
            texts.append(f"{str_a[x] if to_a == x + 1 else ','.join(str_a[x:to_a])}|{str_b[y] if to_b == y + 1 else ','.join(str_b[y:to_b])}")
            x, y = to_a, to_b
        edge_group = edge_group.tolist()
        return out, pairs.astype(self.tok.pair_type), [";".join(texts[x:y]) for x, y in zip(edge_group, edge_group[1:], strict=False)]

    def _rows(self, units: list[str]) -> np.ndarray:
        if len(self.known) > UNITS or self.chars > UNIT_CHARS:
            self._clear()
        new = list(set(units).difference(self.known))
        if new:
            # Units that end in white space, at the end of a text, don't stand before others.
            last = [u for u in new if u[-1].isspace()]
            if last:
                new = [u for u in new if not u[-1].isspace()]
            for part in ([new] if new else []) + [[u] for u in last]:
                self._add(part, *self.measure(part))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _add(self, new: list[str], numbers: np.ndarray, pairs: np.ndarray, text: list[str]) -> None:
        at, upto = len(self.known), len(self.known) + len(new)
        while upto > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
            self.edge = np.concatenate([self.edge, np.zeros(len(self.edge) - 1, np.int64)])
        self.numbers[at:upto] = numbers
        self.edge[at + 1 : upto + 1] = self.edge[at] + np.cumsum(numbers[:, 4])
        while self.edge[upto] > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[self.edge[at] : self.edge[upto]] = pairs
        self.known.update(zip(new, range(at, upto), strict=True))
        self.text += text
        self.chars += sum(map(len, new))

    def _pairs(self, rows: np.ndarray) -> np.ndarray:
        n = self.numbers[rows, 4]
        first = np.cumsum(n) - n
        return self.pairs[np.repeat(self.edge[rows] - first, n) + np.arange(int(n.sum()))]

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """Of each whole text its NUMBERS, the pairs of its links (sorted), and the hash of its groups ('' without tokens)."""
        for lo, hi in groups(texts):
            if hi - lo == 1 and len(texts[lo]) > CHUNK or not self.tok.by_unit:
                for t in texts[lo:hi]:
                    yield self._long(t)
                continue
            units = [_UNIT.findall(" " + t) if t else [] for t in texts[lo:hi]]
            rows = np.split(self._rows([u for x in units for u in x]), np.cumsum([len(x) for x in units])[:-1])
            for t, r in zip(texts[lo:hi], rows, strict=True):
                numbers = self.numbers[r]
                if not numbers[:, 0].all():
                    yield self._whole(t)
                else:
                    yield numbers.sum(0)[1:], np.sort(self._pairs(r)), hashlib.sha256(";".join(map(self.text.__getitem__, r.tolist())).encode()).hexdigest() if t else ""

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        """The same, in blocks of units."""
        if not text or not self.tok.by_unit:
            return self._whole(text)
        total, pairs, digest = np.zeros(4, np.int64), [], hashlib.sha256()
        found = (m.group() for m in _UNIT.finditer(" " + text))
        while units := list(islice(found, BLOCK)):
            rows = self._rows(units)
            if not self.numbers[rows, 0].all():
                return self._whole(text)
            digest.update((";" if pairs else "").encode() + ";".join(map(self.text.__getitem__, rows.tolist())).encode())
            total += self.numbers[rows].sum(0)[1:]
            pairs.append(self._pairs(rows))
        return total, np.sort(np.concatenate(pairs)), digest.hexdigest()

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        """A text that isn't cut; if some unit doesn't come back as it was, whether the whole text does decides."""
        if not text:
            return np.zeros(4, np.int64), self.pairs[:0], ""
        numbers, pairs, found = self.measure([" " + text])
        return numbers[0, 1:], np.sort(pairs), hashlib.sha256(found[0].encode()).hexdigest() if numbers[0, 0] else ""


def _packed(pairs: np.ndarray) -> bytes:
    """Sorted numbers as their differences."""
    return np.diff(pairs, prepend=pairs.dtype.type(0)).tobytes()


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, kind), dtype=np.uint64)


_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def aligned(docs: DataFrame, *, id_col: str, text_col: str, path_a: str, path_b: str) -> DataFrame:
    """doc_id, NUMBERS, groups_sha256, links (the pairs of all links, packed) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in NUMBERS), ("groups_sha256", pa.string()), ("links", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(path_a, path_b))
        for batch in batches:
            keys, texts = columns(batch, "doc_id", "text")
            got = list(aligner.align(texts))
            numbers = np.array([x[0] for x in got], np.int64).reshape(-1, 4)
            yield batch_of(schema, doc_id=keys, **{c: pa.array(numbers[:, k]) for k, c in enumerate(NUMBERS)}, groups_sha256=[x[2] for x in got], links=[_packed(x[1]) for x in got])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), run, _ALIGNED)


def pair_counts(rows: DataFrame, kind: type) -> DataFrame:
    """pair, n_docs: how many rows hold a link of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n_docs"])

        def add_up():
            flat = np.concatenate([pair, *held])
            got, where = np.unique(flat, return_inverse=True)
            return got, np.bincount(where, np.concatenate([n, np.ones(len(flat) - len(pair))]), len(got)).astype(np.int64)

        for batch in batches:
            for packed in columns(batch, "links")[0]:
                held.append(np.unique(_unpacked(packed, kind)))
                size += len(held[-1])
                if size >= HELD:
                    pair, n = add_up()
                    held, size = [], 0
                    if len(pair) >= HELD:
                        yield out()
                        pair, n = pair[:0], n[:0]
        pair, n = add_up()
        yield out()

    return map_batches(rows.select("links"), run, "pair long, n_docs long").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"))


def _scored(rows: DataFrame, counts: DataFrame, kind: type, entries: int) -> DataFrame:
    """Rows with n_best and count_sum, the counts sent to all tasks."""
    got = counts.toArrow()
    pair, n = got.column("pair").to_numpy(), got.column("n_docs").to_numpy()
    order = np.argsort(pair)
    shared = rows.sparkSession.sparkContext.broadcast((pair[order], n[order]))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*NUMBERS, "n_best", "count_sum")), ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = shared.value
        first = pair // entries
        most = np.zeros(int(first[-1]) + 1 if len(pair) else 1, np.int64)
        np.maximum.at(most, first, n)
        best = n == most[first]
        for batch in batches:
            each = [_unpacked(x, kind).astype(np.int64) for x in columns(batch, "links")[0]]
            at = np.searchsorted(pair, np.concatenate(each or [pair[:0]]))
            edge = np.cumsum([0] + [len(x) for x in each])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)])[edge]) for x in (best, n)]
            yield batch_of(schema, **{c: batch.column(c) for c in ("doc_id", *NUMBERS, "groups_sha256")}, n_best=pa.array(sums[0]), count_sum=pa.array(sums[1]))

    return map_batches(rows, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _joined(rows: DataFrame, counts: DataFrame, kind: type, entries: int, scratch: Scratch) -> DataFrame:
    """Rows with n_best and count_sum, by a join of each row's distinct pairs with the counts."""
    schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, packed in zip(*columns(batch, "row", "links"), strict=True):
                pair, n = np.unique(_unpacked(packed, kind).astype(np.int64), return_counts=True)
                yield batch_of(schema, row=pa.array(np.full(len(pair), row)), pair=pa.array(pair), links=pa.array(n))

    # Rows get a number of their own, which stays as it is once written: ids can repeat.
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()), "alignment-rows")
    held = map_batches(rows.select("row", "links"), run, "row long, pair long, links long")
    own = F.expr(f"pair div {entries}")
    ranked = counts.withColumn("a", own).join(counts.groupBy(own.alias("a")).agg(F.max("n_docs").alias("most")), "a")
    sums = held.join(ranked, "pair").groupBy("row").agg(F.sum(F.when(F.col("n_docs") == F.col("most"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n_docs") * F.col("links")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", *NUMBERS, zero("n_best"), zero("count_sum"), "groups_sha256")


def align(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, most_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    ``n_best`` counts links whose pair no other pair of its A id outnumbers in documents, and ``count_sum``
    adds up the documents of each link's pair. Each row is a document, rows with the same or no id too.
    Texts that are null, empty, or that don't come back from either tokenizer's tokens as they were have no
    tokens: zeros and ''. An empty table gives no rows; other columns aren't read. A text of any length is
    aligned whole, in blocks of its units.
    """
    spark = docs.sparkSession
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    tok = tokenizers(path_a, path_b)
    kind, entries = tok.pair_type, len(tok.bytes_b)
    with Scratch(spark) as scratch:
        rows = written(spark, aligned(docs, id_col=id_col, text_col=text_col, path_a=path_a, path_b=path_b), "alignment")
        counts = scratch(pair_counts(rows, kind), "pair-counts")
        if counts.limit(most_pairs + 1).count() <= most_pairs:
            return _scored(rows, counts, kind, entries)
        return written(spark, _joined(rows, counts, kind, entries, scratch), "alignment-counts")


def aligned_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, group (from 0), a, b: the ids of each group of every text, in order; texts without tokens give no rows."""
    path_a, path_b = path_a or tokenizer_path(), path_b or tokenizer_path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(tokenizers(path_a, path_b))
        for batch in batches:
            for key, text in zip(*columns(batch, "doc_id", "text"), strict=True):
                if text and (found := aligner.measure([" " + text]))[0][0, 0]:
                    yield batch_of(schema, doc_id=[key], groups=found[2])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    sides = F.split("x", r"\|")
    ids = lambda k: F.split(sides[k], ",").cast("array<int>")
    return map_batches(rows, run, "doc_id long, groups string").select("doc_id", F.posexplode(F.split("groups", ";")).alias("group", "x")).select("doc_id", "group", ids(0).alias("a"), ids(1).alias("b"))
