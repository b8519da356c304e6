"""Phrase collocations, by language: counts of all frequent phrases, scored by their weakest cut.

1. Sketch: each task counts the phrases of 1 to ``WORDS`` words by cells of a hash and hands on, for each
   block of cells, those that it met. The sums of a block bound the count of each of its phrases from
   above. The number of cells follows the length of all texts, so a block holds much the same at any size.
2. Candidates: phrases whose cell holds ``least`` or more. The cells are sent to the tasks ``CELLS`` at a
   time, a pass over the texts each.
3. Counts: candidates are compiled to automata, ``PHRASES`` at a time, whose symbols are words. Each task
   scans its texts, whose words stand between single spaces, for all overlapping matches: it goes on from all
   words of a text at once, so no state needs a failure link. The counts are added up by blocks of states and
   only then compared with ``least``, so the sketch decides nothing.
4. Scores by joins of the counts with themselves, in integers of 38 digits.

Words are runs of other characters than space and tab, A-Z lower-cased, in pieces between ``.,;:!?`` and
line ends; no phrase reaches over the end of a piece.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, map_batches, ready, text_of
from spanloom.llm.hashing import CHUNK, code_points, groups, mix, span_hashes
from spanloom.llm.lookup import Sorted
from spanloom.runtime import Scratch, plan_bytes, written

#: Words of a phrase at most.
WORDS = 4
LEAST, SHARE, TOP = 30, 80, 2000
#: Cells of the sketch for a character of text, as a power of two. A character gives some 0.6 phrases, so few cells are shared.
CELLS_CHAR = 2
#: Cells of a block, as a power of two.
BLOCK = 20
#: Phrases that a task counts before it hands them on.
HELD = 1 << 22
#: Cells (8 bytes each) that are sent to all tasks at once, and phrases (some 25 bytes each) of the automata that a worker holds.
#: Both grow more slowly than the texts; each time that they don't suffice, texts are read once more.
CELLS, PHRASES = 1 << 23, 1 << 21
#: Hashes of phrases that a task remembers to have handed on, as a power of two.
REMEMBERED = 22
#: States whose counts are added up together.
STATES = 1 << 16
#: Bytes of input of a task that hands on phrases: the fewer tasks, the fewer copies of a phrase.
TASK = 256 << 20
#: Phrases of a language that one task ranks.
RANKED = 1 << 18

#: By byte; those of other characters stay as they are.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_GAP, _END = re.compile(b"  +"), re.compile(b" ?\n[ \n]*")
_STEP = 0xC2B2AE3D27D4EB4F


def folded(text: str) -> str:
    """The words of a text between single spaces, its pieces between `` \\n ``; a space at either end, or ``\\n`` there."""
    return _END.sub(b" \n ", _GAP.sub(b" ", b" %b " % text.encode().translate(_FOLD))).decode()


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode())


class Phrases:
    """Hashes of all phrases of some folded texts of one language, by the number of words."""

    def __init__(self, texts: list[str], lang: str):
        self.codes = codes = code_points("\n".join(texts))
        inside = np.concatenate([[False], (codes != 32) & (codes != 10), [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.piece = np.searchsorted(np.flatnonzero(codes == 10), self.starts)
        self.word = span_hashes(codes, self.starts, self.ends, seed=0)
        self.seed = np.uint64(_seed(lang) * 0x9E3779B97F4A7C15 % (1 << 64))

    def hashes(self, n: int, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each phrase of n words, and its hash. ``inner``: where phrases of n - 1 words begin that may be part of it; by default all."""
        count = len(self.word) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = self.piece[:count] == self.piece[n - 1 :]
        if inner is not None:
            whole &= inner[:count] & inner[1 : count + 1] if n > 1 else inner
        at = np.flatnonzero(whole)
        total, power = np.full(len(at), self.seed), 1
        for k in range(n):
            total = total + self.word[at + k] * np.uint64(power)
            power = power * _STEP % (1 << 64)
        return at, mix(total + np.uint64(n))

    def texts(self, first: np.ndarray, n: np.ndarray) -> pa.Array:
        """The phrases of n words that begin at these."""
        at, size = self.starts[first], self.ends[first + n - 1] - self.starts[first]
        ends = np.cumsum(size)
        codes = self.codes[np.repeat(at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        # Bytes of each character in UTF-8.
        width = np.cumsum(1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF))
        edge = np.append(np.zeros(1, np.int32), width[ends - 1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(edge), pa.py_buffer(codes.tobytes().decode("utf-32-le").encode()))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Folded texts of a batch, some ``CHUNK`` characters of one language at a time; a longer text stands alone."""
    kept: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        kept.setdefault(lang, []).append(folded(text))
    for lang, texts in kept.items():
        for lo, hi in groups(texts):
            if hi - lo > 1 or len(texts[lo]) <= 4 * CHUNK:
                yield lang, texts[lo:hi]
            else:
                yield from ((lang, [part]) for part in _parts(texts[lo]))


def _parts(text: str) -> Iterator[str]:
    """A long folded text by pieces; a piece longer than that stays whole."""
    at = 0
    while len(text) - at > 2 * CHUNK and (cut := text.find("\n", at + CHUNK)) >= 0:
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _bits(docs: DataFrame) -> int:
    """Bits of a cell's number."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(BLOCK, int(chars << CELLS_CHAR).bit_length())


def _tasks(df: DataFrame) -> DataFrame:
    """In one partition for each ``TASK`` bytes of input, two for each core at least."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-plan_bytes(df) // TASK)))


class Cells:
    """Some cells of the sketch."""

    def __init__(self, cells: np.ndarray, bits: int):
        self.shift, keys = np.uint64(64 - bits), mix(cells)
        self.table, self.some = Sorted(keys), np.zeros(1 << 24, bool)
        self.some[keys >> np.uint64(40)] = True  # most other cells end here

    def hold(self, hashes: np.ndarray) -> np.ndarray:
        keys = mix(hashes >> self.shift)
        out = self.some[keys >> np.uint64(40)]
        near = np.flatnonzero(out)
        out[near] = self.table.find(keys[near]) >= 0
        return out


def frequent_cells(docs: DataFrame, bits: int, least: int) -> DataFrame:
    """cell: where the phrases of 1 to ``WORDS`` words of one hash occur ``least`` times or more together."""
    ready(docs.sparkSession)
    shift, block = np.uint64(64 - bits), np.uint64(BLOCK)

    def handed_on(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        edge = np.flatnonzero(np.diff(cell >> block, prepend=np.uint64(1 << 63)))
        edge = np.append(edge, len(cell))
        low, n = (cell & np.uint64((1 << BLOCK) - 1)).astype(np.uint32), np.minimum(n, least).astype(np.uint8 if least < 256 else np.uint32)
        for lo in range(0, len(edge) - 1, 1 << 12):
            e = edge[lo : lo + (1 << 12) + 1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array((cell[e[:-1]] >> block).astype(np.int64)), *(pa.array([x[a:b].tobytes() for a, b in zip(e, e[1:], strict=False)], pa.binary()) for x in (low, n))], names=["block", "low", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for lang, texts in _by_language(batch):
                phrases = Phrases(texts, lang)
                for k in range(1, WORDS + 1):
                    held.append(phrases.hashes(k)[1] >> shift)
                    size += len(held[-1])
                if size >= HELD:
                    yield from handed_on(held)
                    held, size = held[:1], 0
        yield from handed_on(held)

    def add_up(rows: pa.Table) -> pa.Table:
        # A count is held at ``least``, so that it fits a byte: a sum reaches it all the same.
        low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(rows.column("n").to_pylist()), np.uint8 if least < 256 else np.uint32)
        some = np.flatnonzero(np.bincount(low, n, 1 << BLOCK) >= least)
        return pa.table({"cell": pa.array((rows.column("block")[0].as_py() << BLOCK) + some)})

    blocks = map_batches(docs, count, "block long, low binary, n binary")
    return blocks.groupBy("block").applyInArrow(add_up, "cell long")


def candidates(docs: DataFrame, cells: DataFrame, bits: int, every: bool = True) -> DataFrame:
    """lang, phrase, n: phrases in these cells (sent to all tasks) and how many words they have, some of them more than once; with a null phrase, words of texts. ``every``: whether these are all frequent cells."""
    shared = docs.sparkSession.sparkContext.broadcast(cells.toArrow().column("cell").to_numpy().astype(np.uint64))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, mask = Cells(shared.value, bits), Counter(), np.uint64((1 << REMEMBERED) - 1)
        # Each place holds the last hash that ends in its number; at first one that doesn't.
        seen = np.arange(1, (1 << REMEMBERED) + 1, dtype=np.uint64)
        for batch in batches:
            out: list[tuple[str, pa.Array, np.ndarray]] = []
            for lang, texts in _by_language(batch):
                phrases = Phrases(texts, lang)
                words[lang] += len(phrases.word)
                held, firsts, sizes = None, [], []
                for k in range(1, WORDS + 1):
                    # What is frequent has frequent parts. With some of the cells only, its parts may be in others.
                    at, h = phrases.hashes(k, held if every else None)
                    hit = table.hold(h)
                    at, h, held = at[hit], h[hit], np.zeros(len(phrases.word), bool)
                    held[at] = True
                    new = np.flatnonzero(seen[h & mask] != h)
                    h, first = np.unique(h[new], return_index=True)
                    seen[h & mask] = h
                    firsts.append(at[new[first]])
                    sizes.append(np.full(len(h), k))
                n = np.concatenate(sizes)
                out.append((lang, phrases.texts(np.concatenate(firsts), n), n))
            if out:
                yield batch_of(schema, lang=pa.array([lang for lang, _, _ in out]).take(pa.array(np.repeat(np.arange(len(out)), [len(n) for _, _, n in out]))), phrase=pa.concat_arrays([x for _, x, _ in out]), n=pa.array(np.concatenate([n for _, _, n in out])))
        yield batch_of(schema, lang=list(words), phrase=[None] * len(words), n=list(words.values()))

    return map_batches(_tasks(docs), run, "lang string, phrase string, n long")


def _keys(state: np.ndarray, word: np.ndarray, words: int) -> np.ndarray:
    """A state and the word that follows as one number, mixed: no two are equal."""
    return mix(state.astype(np.uint64) * np.uint64(words) + word.astype(np.uint64))


def compiled(phrases: pa.Array) -> tuple[int, pa.Array, list[tuple[np.ndarray, np.ndarray]]]:
    """The number of these phrases, their words, and for each number of words the states: their keys in order, and which phrase each is.

    A phrase whose first words aren't a phrase has no state: it can't be frequent.
    """
    split = pc.split_pattern(phrases, " ")
    n, words = pc.list_value_length(split).to_numpy(zero_copy_only=False), pc.unique(split.flatten())
    ids, starts = pc.index_in(split.flatten(), words).to_numpy(zero_copy_only=False), np.cumsum(n) - n
    state, levels = np.zeros(len(phrases), np.int64), []
    for k in range(1, WORDS + 1):
        some = np.flatnonzero((n >= k) & (state >= 0))
        keys, whole = _keys(state[some], ids[starts[some] + (k - 1)], len(words)), n[some] == k
        order = np.argsort(keys[whole])
        levels.append((keys[whole][order], some[whole][order]))
        state[some] = Sorted(keys[whole]).find(keys)
    return len(phrases), words, levels


class Automaton:
    """Counts of compiled phrases in folded texts."""

    def __init__(self, size: int, words: pa.Array, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.size, self.ids, self.levels = size, {word: k for k, word in enumerate(words.to_pylist())}, levels
        self.tables, self.total = [Sorted(keys) for keys, _ in levels], np.zeros(size, np.int64)
        self.met: list[list[np.ndarray]] = [[] for _ in levels]
        self.held = 0

    def count(self, text: str) -> None:
        """Add all matches, overlapping ones too."""
        words = text.split(" ")
        ids = np.append(np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words)), -1)
        at = np.flatnonzero(ids >= 0)
        state = np.zeros(len(at), np.int64)
        for table, met in zip(self.tables, self.met, strict=True):
            state = table.find(_keys(state, ids[at], len(self.ids)))
            hit = np.flatnonzero(state >= 0)
            at, state = at[hit] + 1, state[hit]
            met.append(state.astype(np.int32))
            self.held += len(state)
            more = np.flatnonzero(ids[at] >= 0)
            at, state = at[more], state[more]
        if self.held > max(HELD, self.size):
            self._add()

    def _add(self) -> None:
        for (_, phrase), met in zip(self.levels, self.met, strict=True):
            if met:
                self.total[phrase] += np.bincount(np.concatenate(met), minlength=len(phrase))
                met.clear()
        self.held = 0

    def counts(self) -> np.ndarray:
        """The count of each phrase."""
        self._add()
        return self.total


def scanned(docs: DataFrame, phrases: dict[tuple[str, int], tuple[tuple, np.ndarray]], least: int) -> DataFrame:
    """lang, part, block, k, a: matches of the k-th phrase of each block in the texts of its language, if there are ``least``.

    ``phrases`` has those of each (lang, part) compiled, and where its blocks begin.
    """
    shared = docs.sparkSession.sparkContext.broadcast(phrases)
    schema = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("block", pa.int64()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {key: Automaton(*held) for key, (held, _) in shared.value.items()}
        for batch in batches:
            for lang, texts in _by_language(batch):
                text = "\n".join(texts)
                for key, found in made.items():
                    if key[0] == lang:
                        found.count(text)
        for (lang, part), found in made.items():
            for block, n in enumerate(np.split(found.counts(), shared.value[lang, part][1][1:])):
                if n.any():
                    yield batch_of(schema, lang=[lang], part=[part], block=[block], n=[n.tobytes()])

    def add_up(rows: pa.Table) -> pa.Table:
        a = reduce(np.add, (np.frombuffer(n, np.int64) for n in rows.column("n").to_pylist()))
        k = np.flatnonzero(a >= least)
        same = rows.select(["lang", "part", "block"]).take(pa.array(np.zeros(len(k), np.int64)))
        return same.append_column("k", pa.array(k)).append_column("a", pa.array(a[k]))

    some = map_batches(_tasks(docs.where(F.col("lang").isin(*{key[0] for key in phrases}))), run, "lang string, part long, block long, n binary")
    return some.groupBy("lang", "part", "block").applyInArrow(add_up, "lang string, part long, block long, k long, a long")


def _shifts(sizes: dict[tuple[str, int], int], most: int) -> Iterator[list[tuple[str, int]]]:
    """The parts in groups of ``most`` phrases together, languages side by side."""
    group, held = [], 0
    for key in sorted(sizes):
        if group and held + sizes[key] > most:
            yield group
            group, held = [], 0
        group.append(key)
        held += sizes[key]
    if group:
        yield group


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def phrase_counts(docs: DataFrame, scratch: Scratch, *, least: int = LEAST, cells: int = CELLS, phrases: int = PHRASES) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, a of every phrase of 1 to ``WORDS`` words that occurs ``least`` times in a language; and lang, n, its words.

    ``docs`` has lang and text, neither null. The languages (one row each) go to the driver, and candidates
    ``phrases`` at a time.
    """
    bits = _bits(docs)
    found = scratch(frequent_cells(docs, bits, least), "sketch-cells")
    passes = max(1, -(-found.count() // cells))
    own = lambda k: found if passes == 1 else found.where(F.pmod(F.xxhash64("cell"), F.lit(passes)) == k)
    rows = [scratch(candidates(docs, own(k), bits, passes == 1), "phrase-rows") for k in range(passes)]
    words = rows[0].where("phrase IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    every = scratch(_union(rows).where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.first("n").cast("int").alias("words")), "phrase-texts")
    # Parts of a language of some ``phrases`` phrases, each beside its first words; blocks of a part, numbered within.
    n = F.count("*")
    parts = every.groupBy("lang").agg(F.ceil(n / phrases).alias("parts"), F.ceil(n / F.ceil(n / phrases) / STATES).alias("blocks"))
    dealt = every.join(parts, "lang").withColumn("part", F.pmod(F.xxhash64(F.substring_index("phrase", " ", 1)), "parts")).withColumn("block", F.pmod(F.xxhash64("phrase", "words"), "blocks"))
    numbered = scratch(dealt.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part", "block").orderBy("phrase")).cast("long") - 1).drop("parts", "blocks"), "phrases")
    sizes = {(r.lang, r.part): r.n for r in numbered.groupBy("lang", "part").agg(n.alias("n")).collect()}
    matches = []
    for group in _shifts(sizes, phrases):
        taken = {}
        for lang, part in group:
            some = numbered.where((F.col("lang") == lang) & (F.col("part") == part)).select("block", "k", "phrase").toArrow().sort_by([("block", "ascending"), ("k", "ascending")])
            held = np.bincount(some.column("block").to_numpy())
            taken[lang, part] = compiled(some.column("phrase").combine_chunks()), np.cumsum(held) - held
        matches.append(scratch(scanned(docs, taken, least), "phrase-matches"))
    none = numbered.select("lang", "part", "block", "k", F.lit(0).cast("long").alias("a")).limit(0)
    counts = numbered.join(_union(matches or [none]), ["lang", "part", "block", "k"])
    return scratch(counts.select("lang", "phrase", "words", "a"), "phrase-counts"), words


def scored(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    several, w = counts.where("words > 1"), F.split("phrase", " ")
    joined = lambda start, n: F.array_join(F.slice(w, start, n), " ")
    k = F.col("k")
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select("lang", "phrase", "a", "k", joined(F.lit(1), k).alias("one"), joined(k + 1, F.col("words") - k).alias("two"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    both = cuts.join(part("one", "l"), ["lang", "one"]).join(part("two", "r"), ["lang", "two"])
    both = both.withColumns({"a_": wide("a") * 2_000_000, "b_": wide("l") + wide("r")}).withColumn("score", F.expr("a_ div b_"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))")
    longer = counts.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("most")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most") * 100 < wide("a") * share))
    return left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, *, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text", cells: int = CELLS, phrases: int = PHRASES, ranked: int = RANKED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    A phrase has 2 to ``WORDS`` words and ``a`` >= ``least`` occurrences, overlaps included. Cut in two
    parts that occur ``l`` and ``r`` times it scores floor(2,000,000 a / (l + r)); its lowest-scoring cut
    counts, of equal ones the first. It is dropped if a longer one that holds it has ``share`` % of its
    occurrences. Order: score and a descending, then the phrase by its bytes; no two are equal. ``n`` counts
    the language's words. A null language is ``und``, a null text empty; repeated rows count each; an empty
    table gives no rows; other columns aren't read. A text of any length counts as a whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    with Scratch(spark) as scratch:
        counts, words = phrase_counts(rows, scratch, least=least, cells=cells, phrases=phrases)
        held = scratch(scored(counts, share), "phrase-scores")
        order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
        # A language's phrases are ranked in parts, then what each part leaves.
        deal = F.pmod(F.xxhash64("phrase"), F.lit(max(1, -(-held.count() // ranked))))
        for by in (["lang", deal], ["lang"]):
            held = held.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return written(spark, held.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
