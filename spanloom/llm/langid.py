"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model of character n-grams. The models of all languages
share one sorted array of n-gram hashes for each order, with a row of log-probabilities (one for each
language) beside it, and one of context hashes with back-off weights. A text goes to the language of
the lowest cross-entropy per character. Held-back labelled texts calibrate two things: how sure a
difference in cross-entropy makes the choice (``score``), and how high the cross-entropy of a genuine
text of a language can be for its length; beyond it, and predicted worse than by a uniform guess among
the language's own letters, the text is ``rejected``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import columns, fresh_name, map_batches, ready, text_of
from spanloom.llm.hashing import code_point_keys, folded, groups, mix
from spanloom.llm.lookup import Sorted

if TYPE_CHECKING:
    import pandas as pd  # imported where it is used: scoring does without it

#: Characters of a language's labelled texts that are learned from, about, and as many for calibration.
SAMPLE_CHARS = 1_000_000
#: Texts of a language that the sample aims at, at least; no text gives more than its share of the characters.
SAMPLE_TEXTS = 64
ORDER = 4
UND = "und"
_P = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 18


def normalised(text: str) -> np.ndarray:
    """Code points of the lower-case text, runs of other characters than letters as one space."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cps = np.where(folded(cps)[1] == 1, cps, np.uint32(32))
    return cps[(cps != 32) | np.append(True, cps[:-1] != 32)] if len(cps) else cps


def grams(cps: np.ndarray, order: int) -> list[np.ndarray]:
    """g[m][i]: hash of the m characters that end at i; g[0] is 0. Entries that reach before the start aren't used."""
    key = code_point_keys(cps)
    out, power, total = [np.zeros(len(cps), np.uint64)], np.uint64(1), np.zeros(len(cps), np.uint64)
    for m in range(1, order + 1):
        total = total.copy()
        total[m - 1 :] += key[: len(key) - m + 1] * power
        power = np.uint64((int(power) * int(_P)) % (1 << 64))
        out.append(mix(total + np.uint64(m)))
    return out


def padded(parts: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each after ``order`` - 1 spaces; where each text's own characters start and end."""
    pad = np.full(order - 1, 32, np.uint32)
    size = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(size + order - 1) - size
    return np.concatenate([x for p in parts for x in (pad, p)] or [pad]), np.stack([start, start + size], 1)


def count_grams(texts: list[str], order: int, block: int = 1 << 17) -> pd.DataFrame:
    """Distinct n-grams of every order: hash, hash of the context, hash of the suffix, count.

    Counts are occurrences at the highest order and distinct characters to the left below it. Texts are
    counted in blocks, so memory follows the number of distinct n-grams.
    """
    import pandas as pd

    found: list[list[np.ndarray]] = [[] for _ in range(order + 1)]

    def merge(parts: list[np.ndarray]) -> list[np.ndarray]:
        """Rows (gram, context, suffix, count), one for each gram."""
        rows = np.concatenate(parts)
        keys, first, where = np.unique(rows[:, 0], return_index=True, return_inverse=True)
        out = rows[first]
        out[:, 3] = np.bincount(where, rows[:, 3], len(keys)).astype(np.uint64)
        return [out]

    for a, b in groups(texts, block):
        cps, spans = padded([normalised(t) for t in texts[a:b]], order)
        own = np.zeros(len(cps), bool)
        for x, y in spans.tolist():
            own[x:y] = True
        for lo in range(0, len(cps), 4 * block):  # a long text in slices that overlap by a context
            part = cps[max(0, lo - order + 1) : lo + 4 * block]
            here = np.flatnonzero(own[lo : lo + 4 * block]) + min(lo, order - 1)
            if not len(here):
                continue
            g = grams(part, order)
            for m in range(1, order + 1):
                keys, first, n = np.unique(g[m][here], return_index=True, return_counts=True)
                at = here[first]
                found[m].append(np.stack([keys, g[m - 1][at - 1] if m > 1 else np.zeros(len(at), np.uint64), g[m - 1][at], n.astype(np.uint64)], 1))
                if len(found[m]) > 15:
                    found[m] = merge(found[m])
    out, longer = [], None
    for m in range(order, 0, -1):
        rows = merge(found[m])[0] if found[m] else np.zeros((0, 4), np.uint64)
        if longer is not None:  # distinct characters to the left: distinct longer n-grams that end in this one
            ends, n = np.unique(longer[:, 2], return_counts=True)
            rows[:, 3] = n[np.searchsorted(ends, rows[:, 0])]
        longer = rows
        out.append(pd.DataFrame({"m": m, "gram": rows[:, 0].view(np.int64), "context": rows[:, 1].view(np.int64), "suffix": rows[:, 2].view(np.int64), "n": rows[:, 3].astype(np.int64)}))
    return pd.concat(out, ignore_index=True)


# -- the model -----------------------------------------------------------------------------------


@dataclass
class Model:
    langs: list[str]
    order: int
    index: list[Sorted] = field(default_factory=list)  # by order; [0] unused
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[Sorted] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0  # log-probability of an unknown character
    centre: np.ndarray = None
    spread: np.ndarray = None
    limit: np.ndarray = None
    chance: np.ndarray = None  # bits per character of a uniform guess among a language's letters
    heat: float = 1.0

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and characters; texts without letters: 0 characters."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for a, b in groups(texts, _SLICE):
            parts = [normalised(t) for t in texts[a:b]]
            has = [bool((p != 32).any()) for p in parts]
            parts = [p if h else p[:0] for p, h in zip(parts, has, strict=True)]
            size[a:b] = [len(p) for p in parts]
            if b - a == 1 and len(parts[0]) > 2 * _SLICE:  # a long text, in slices that overlap by a context
                p, o = np.concatenate([np.full(self.order - 1, 32, np.uint32), parts[0]]), self.order - 1
                for s in range(0, len(parts[0]), _SLICE):
                    total[a] += self._rows(part := p[s : s + o + _SLICE], np.arange(o, len(part))).sum(0)
            else:
                cps, spans = padded(parts, self.order)
                own = np.ones(len(cps), bool)
                for k in range(1, self.order):
                    own[spans[:, 0] - k] = False
                rows = self._rows(cps, np.flatnonzero(own))
                edge = np.concatenate([[0], np.cumsum(size[a:b])])
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(rows, 0, dtype=np.float64)])
                total[a:b] = sums[edge[1:]] - sums[edge[:-1]]
        return -total / np.maximum(size, 1)[:, None], size

    def _rows(self, cps: np.ndarray, own: np.ndarray) -> np.ndarray:
        if not len(own):
            return np.zeros((0, len(self.langs)), np.float32)
        g = grams(cps, self.order)
        row = self.index[self.order].find(g[self.order][own])
        out = self.logp[self.order][row]
        left = np.flatnonzero(row < 0)
        if len(left):
            at, weight = own[left], np.zeros((len(left), len(self.langs)), np.float32)
            for m in range(self.order, 0, -1):
                # back off: the weight of this order's context, then the next lower order
                row = self.contexts[m].find(g[m - 1][at - 1])
                weight += np.where(row[:, None] >= 0, self.backoff[m][row], 0)
                if m == 1:
                    out[left] = weight + self.base
                    break
                row = self.index[m - 1].find(g[m - 1][at])
                hit = row >= 0
                out[left[hit]] = weight[hit] + self.logp[m - 1][row[hit]]
                left, at, weight = left[~hit], at[~hit], weight[~hit]
                if not len(left):
                    break
        return out

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether rejected, bits per character."""
        h, size = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(texts)), best]
        odds = np.exp2(np.maximum(-(h - low[:, None]) * np.sqrt(size)[:, None] * self.heat, -1000))
        score = np.where(size > 0, 1 / odds.sum(1), 0.0)
        z = (low - self.centre[best]) * np.sqrt(size) / self.spread[best]
        # A genuine text of mixed languages can deviate far; none is predicted worse than by chance.
        rejected = (size == 0) | (z > self.limit[best]) & (low > self.chance[best])
        return [self.langs[k] if n else UND for k, n in zip(best, size, strict=True)], score, rejected, np.where(size > 0, low, 0.0)


def build(counts: dict[str, pd.DataFrame], order: int) -> Model:
    """Interpolated Kneser-Ney models from the counts of each language."""
    import pandas as pd

    langs = sorted(counts)
    model = Model(langs, order, [None], [None], [None], [None])
    u64 = lambda s: s.to_numpy().view(np.uint64)
    everything = pd.concat(counts.values(), ignore_index=True)
    alphabet = everything[everything.m == 1].gram.nunique() + 1
    model.base = -float(np.log2(alphabet))
    lower = np.full((1, len(langs)), model.base)
    for m in range(1, order + 1):
        every = everything[everything.m == m].drop_duplicates("gram")
        index, contexts = Sorted(u64(every.gram)), Sorted(u64(every.context))
        every = every.sort_values("gram", key=lambda s: s.astype(np.uint64))
        ctx = contexts.find(u64(every.context))
        suffix = model.index[m - 1].find(u64(every.suffix)) if m > 1 else np.zeros(len(every), np.int64)
        logp, backoff = np.empty((len(index), len(langs))), np.zeros((len(contexts), len(langs)))
        for k, lang in enumerate(langs):
            own = counts[lang]
            own = own[own.m == m]
            n = np.zeros(len(index))
            n[index.find(u64(own.gram))] = own.n
            total, kinds = np.bincount(ctx, n, len(contexts)), np.bincount(ctx, n > 0, len(contexts))
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            share = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            p = np.where(total[ctx] > 0, np.maximum(n - d, 0) / np.maximum(total[ctx], 1), 0) + share[ctx] * np.exp2(lower[suffix, k])
            logp[:, k], backoff[:, k] = np.log2(p), np.log2(share)
        model.index.append(index)
        model.contexts.append(contexts)
        # find() gives -1 for what isn't there: the last row stands for it and is masked
        model.logp.append(np.append(logp, np.zeros((1, len(langs))), 0).astype(np.float32))
        model.backoff.append(np.append(backoff, np.zeros((1, len(langs))), 0).astype(np.float32))
        lower = logp
    model.chance = np.array([np.log2(counts[k][counts[k].m == 1].gram.nunique() + 1) for k in langs])
    model.centre, model.spread, model.limit = np.zeros(len(langs)), np.ones(len(langs)), np.full(len(langs), np.inf)
    return model


def calibrate(model: Model, texts: list[str], labels: list[str], slack: float = 1.3, quantile: float = 0.99) -> Model:
    """Set the rejection limits and the heat of the score from held-back labelled texts.

    The deviation from a language's usual cross-entropy shrinks with the square root of the length;
    the limit is ``slack`` times a high quantile of the deviations seen, so that single texts with a
    wrong label don't set it.
    """
    if not texts:
        return model
    h, size = model.entropies(texts)
    truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in labels])
    ok = (size > 0) & (truth >= 0)
    h, size, truth = h[ok], size[ok], truth[ok]
    if not len(h):
        return model
    own = h[np.arange(len(h)), truth]
    for k in range(len(model.langs)):
        mine = truth == k
        if mine.sum() >= 2:
            model.centre[k] = np.average(own[mine], weights=size[mine])
            dev = (own[mine] - model.centre[k]) * np.sqrt(size[mine])
            model.spread[k] = max(np.sqrt((dev**2).mean()), 1e-6)
            model.limit[k] = slack * max(np.quantile(dev, quantile) / model.spread[k], 3.0)
    margin = (h - own[:, None]) * np.sqrt(size)[:, None]
    heats = 2.0 ** np.arange(-6, 5)
    loss = [np.log(np.exp2(np.clip(-margin * t, -1000, 60)).sum(1)).mean() for t in heats]
    model.heat = float(heats[int(np.argmin(loss))])
    return model


# -- Spark ----------------------------------------------------------------------------------------


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Learn from labelled rows: a sample of about ``sample_chars`` characters of each language.

    The sample takes distinct texts by their hash, so copies count once and rows of any place in
    the table have the same chance. A text gives one stretch of at most 1 / ``SAMPLE_TEXTS`` of the
    characters, at a place that its hash tells, and about ``SAMPLE_TEXTS`` texts are drawn at least,
    so neither long texts nor copies can keep a language out. Half of the sample calibrates. Rows
    without text or language are left out; without any others, there is no model (None). The model
    has a column for each label: languages are meant to be few.
    """
    spark = docs.sparkSession
    ready(spark)
    most = max(2 * sample_chars // SAMPLE_TEXTS, 1)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0").withColumn("h", F.xxhash64("text"))
    once = rows.groupBy("lang", "h").agg(F.first(F.least(F.length("text"), F.lit(most))).alias("n"))
    totals = {r.lang: (r.chars, r.texts) for r in once.groupBy("lang").agg(F.sum("n").alias("chars"), F.count("*").alias("texts")).collect()}  # one row a language
    if not totals:
        return None
    share = F.create_map(*(F.lit(x) for k, (chars, texts) in totals.items() for x in (k, min(1.0, max(2 * sample_chars / chars, 2 * SAMPLE_TEXTS / texts)))))
    drawn = rows.withColumn("u", F.pmod("h", F.lit(1 << 30)) / float(1 << 30)).where(F.col("u") < share[F.col("lang")])
    begin = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - most, F.lit(0)) + 1).cast("int") + 1
    drawn = drawn.select("lang", "h", F.substring("text", begin, F.lit(most)).alias("text")).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        pdf = pdf.sort_values("h")
        odd = np.arange(len(pdf)) % 2 == 1
        out = count_grams(pdf.text[~odd].tolist(), order).assign(lang=key[0], text=None)
        back = pd.DataFrame({"lang": key[0], "m": 0, "gram": 0, "context": 0, "suffix": 0, "n": 0, "text": pdf.text[odd]})
        return pd.concat([out, back], ignore_index=True)[["lang", "m", "gram", "context", "suffix", "n", "text"]]

    got = drawn.groupBy("lang").applyInPandas(count, "lang string, m int, gram long, context long, suffix long, n long, text string").toPandas()
    held = got[got.m == 0]
    model = build({k: x for k, x in got[got.m > 0].groupby("lang")}, order)
    return calibrate(model, held.text.tolist(), held.lang.tolist())


def identify(docs: DataFrame, model: Model | None, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default), lang_pred, score, rejected, bits_per_char.

    Texts that are null or have no letters get ``und``, score 0, and are rejected; so does every
    text if there is no model. A column of the table that has a result's name gives way to it.
    """
    new = ["lang_pred", "score", "rejected", "bits_per_char"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    if model is None:
        return docs.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(0.0).alias("bits_per_char"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    text = fresh_name("text", docs.columns)
    rows = docs.select(*keep, text_of(text_col).alias(text))
    out_schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean").add("bits_per_char", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected, bits = shared.value.decide(columns(b, text)[0])
            cols = [b.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=keep + new)

    return map_batches(rows, run, out_schema)


def accepted(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, all columns as they are."""
    if model is None:
        return docs.limit(0)
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rejected = shared.value.decide([t or "" for t in columns(b, text_col)[0]])[2]
            yield b.select(names).filter(pa.array(~rejected))

    return map_batches(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that aren't learned from; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
