"""Personal data: patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. Every distinct value is a
protected entity. Words beside it may disclose it though they match no pattern: from the whole corpus
we count the documents that hold an entity e, a term t, and both of them anywhere, and take

    disclosure(t, e) = PMI(t; e) / IC(e),   PMI = log(n_te N / (n_t n_e)),   IC = log(N / n_e),

the share of the information of e that knowing t reveals. A term of a disclosure over the threshold,
seen with the entity in enough different texts (copies of one text count once), is marked wherever it
stands in a document that holds the entity. Entities of little information are left out: of one that most
documents hold, any word would seem to tell. ``sanitise`` replaces patterns by their kind and removes such
terms, leaving ``[TERM]``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.arrow import columns, map_batches, text_of
from spanloom.llm.hashing import CHUNK, code_points, folded, groups, span_hashes
from spanloom.runtime import written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Share of an entity's information that a term may reveal; different texts needed to say so.
DISCLOSURE, SUPPORT = 0.8, 3
#: Information (in bits) of an entity that is worth protecting: one that more than half of the documents hold has less.
LEAST_IC = 1.0

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = str.maketrans("", "", " -")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        # The name before the sign is the whole run of its characters since the last match.
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _EMAIL.match(text, s) if s < at else None
        if m:
            yield s, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    if "." not in text:
        return
    for m in _DOTTED.finditer(text):
        # In a run of numbers between dots, every four in a row are one match.
        if text.find(".", m.start(), m.end()) < 0:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().translate(_DIGITS)
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    for kind, find in zip(KINDS, (_emails, _ips, _cards, _phones), strict=True):
        out += [(kind, a, b) for a, b in find(text)]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# -- terms ----------------------------------------------------------------------------------------


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word (letters in a row, case ignored); for texts of moderate length."""
    cps = code_points(text)
    low, kind = folded(cps)
    is_word = np.concatenate([[False], kind == 1, [False]])
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    return start, end, span_hashes(low, start, end)


def word_slices(text: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``words`` of a text of any length, a slice at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        if end < len(text):  # cut where no word is
            back = end
            while back > at and text[back].isalpha():
                back -= 1
            end = back if back > at else end
        s, e, h = words(text[at:end])
        yield s + at, e + at, h
        at = end


def terms_outside(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and hash of the words that no entity covers or overlaps, a slice at a time."""
    a, b = np.sort([x for _, x, _ in base]), np.sort([y for _, _, y in base])
    for s, e, h in word_slices(text):
        # As many spans must have ended by the word's start as have begun before its end.
        free = np.searchsorted(a, e, "left") == np.searchsorted(b, s, "right")
        yield s[free], e[free], h[free]


def places(text: str, base: list[tuple[str, int, int]], terms: list[int]) -> list[dict]:
    """Where words of these hashes stand outside the entities."""
    wanted, out = np.array(terms, np.int64).view(np.uint64), []
    for s, e, h in terms_outside(text, base):
        at = np.isin(h, wanted)
        out += [{"start": x, "end": y} for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)]
    return out


def entities_of(text: str, base: list[tuple[str, int, int]]) -> list[int]:
    return sorted({xxhash.xxh3_64_intdigest(f"{kind}:{text[a:b].lower()}") - (1 << 63) for kind, a, b in base})


def _spans(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]


_FOUND = "__row long, __base string, __counts array<long>, __context long, __entities array<long>, __words array<long>, __held string"


def _found(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, and of each row its spans; where there are any, also a hash of the text, the entities,
    the distinct words outside them, and the text."""
    rows = docs.select(*keep, text_of(text_col).alias("__text"), F.monotonically_increasing_id().alias("__row"))
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(_FOUND).fields])
    long = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, counts, context, entities, terms, held = [], [], [], [], [], []
            for text in columns(b, "__text")[0]:
                spans = base_spans(text)
                base.append(joined(spans))
                counts.append([sum(k == kind for k, _, _ in spans) for kind in KINDS])
                context.append(xxhash.xxh3_64_intdigest(text) - (1 << 63) if spans else None)
                entities.append(entities_of(text, spans))
                terms.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h in terms_outside(text, spans))])).view(np.int64) if spans else [])
                held.append(text if spans else None)
            new = [pa.array(base, pa.string()), pa.array(counts, long), pa.array(context, pa.int64()), pa.array(entities, long), pa.array(terms, long), pa.array(held, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in [*keep, "__row"]] + new, names=[*keep, "__row", "__base", "__counts", "__context", "__entities", "__words", "__held"])

    return map_batches(rows, run, schema)


def document_frequencies(docs: DataFrame, text_col: str = "text", most: int = 1 << 21) -> DataFrame:
    """term, n_term: in how many documents each word occurs, over the whole corpus.

    A task adds up its own documents before anything is shuffled; it holds ``most`` terms at a time.
    """

    def distinct(text: str) -> np.ndarray:
        if len(text) <= CHUNK:
            return np.unique(words(text)[2])
        return np.unique(np.concatenate([np.unique(h) for _, _, h in word_slices(text)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

        def out() -> pa.RecordBatch:
            keys, n = summed()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["term", "n"])

        for b in batches:
            texts = columns(b, "__text")[0]
            for a, e in groups(texts):
                got = np.concatenate([np.zeros(0, np.uint64), *(distinct(t) for t in texts[a:e])])
                keys, n = np.unique(got, return_counts=True)
                held.append((keys, n.astype(np.float64)))
                size += len(keys)
                if size > most:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    rows = docs.select(text_of(text_col).alias("__text"))
    return map_batches(rows, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def own_words(found: DataFrame) -> DataFrame:
    """__row, __context, __entities, term: a row for each distinct word of each document that holds an entity."""
    return found.where(F.size("__entities") > 0).select("__row", "__context", "__entities", F.explode("__words").alias("term"))


def disclosing(found: DataFrame, frequencies: DataFrame, n_docs: int, *, disclosure: float = DISCLOSURE, support: int = SUPPORT, least_ic: float = LEAST_IC) -> DataFrame:
    """entity, term, disclosure of the pairs over the threshold."""
    held = found.where(F.size("__entities") > 0).select("__row", "__context", F.explode("__entities").alias("entity"))
    # A pair has no more contexts than its entity: most entities go before any word is looked at, and so do those
    # that are in so many documents that there is little to disclose.
    n = F.lit(float(n_docs))
    entities = held.groupBy("entity", "__context").agg(F.count("*").alias("n")).groupBy("entity").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_entity"))
    entities = entities.where((F.col("contexts") >= support) & (F.log2(n / F.col("n_entity")) >= least_ic)).select("entity", "n_entity")
    # With n_pair <= n_entity, PMI reaches its share of IC only up to this many documents of the term. So of a
    # document's words few meet its entities.
    most = F.pow(n, F.lit(1.0 - disclosure)) * F.pow(F.col("n_entity"), F.lit(disclosure))
    named = held.join(entities, "entity").groupBy("__row", "__context").agg(F.collect_set(F.struct("entity", "n_entity")).alias("__held"), F.max(most).alias("__most"))
    words = found.where(F.size("__entities") > 0).select("__row", "__words").join(named, "__row").select("__context", "__held", "__most", F.explode("__words").alias("term"))
    near = words.join(frequencies, "term").where(F.col("n_term") <= F.col("__most") * (1 + 1e-9)).select("term", "n_term", "__context", F.inline("__held"))
    # A document has one row for each entity and term; copies share a context.
    pairs = near.groupBy("entity", "n_entity", "term", "n_term", "__context").agg(F.count("*").alias("n")).groupBy("entity", "n_entity", "term", "n_term").agg(F.count("*").alias("contexts"), F.sum("n").alias("n_pair")).where(F.col("contexts") >= support)
    pmi = F.log2(F.col("n_pair") * n / (F.col("n_term") * F.col("n_entity")))
    return pairs.withColumn("disclosure", pmi / F.log2(n / F.col("n_entity"))).where(F.col("disclosure") >= disclosure).select("entity", "term", "disclosure")


def terms_to_mark(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """__row, term: of each document its own words that disclose an entity which it holds; no more rows than it has words."""
    # A term's entities are joined only where the term stands, and one of them must be the document's.
    terms = pairs.groupBy("term").agg(F.collect_set("entity").alias("__of"))
    return own_words(found).join(terms, "term").where(F.arrays_overlap("__entities", "__of")).select("__row", "term")


def _marked(docs: DataFrame, text_col: str, keep: list[str], **options) -> DataFrame:
    """``keep``, __base, __counts, __held (the text, if it holds an entity) and __disclosing: hashes of the terms to mark."""
    spark = docs.sparkSession
    found = written(spark, _found(docs, text_col, keep), "pii-found")
    pairs = written(spark, disclosing(found, document_frequencies(docs, text_col), found.count(), **options), "pii-pairs")
    some = F.size("__entities") > 0
    terms = terms_to_mark(found, pairs).groupBy("__row").agg(F.collect_set("term").alias("__disclosing"))
    out = [*keep, "__base", "__counts", "__held"]
    # Documents without an entity disclose none: they don't take part in the join.
    plain = found.where(~some).select(*out, F.lit(None).cast("array<long>").alias("__disclosing"))
    return plain.unionByName(found.where(some).join(terms, "__row", "left").select(*out, "__disclosing"))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for each row.

    Null texts count as empty; repeated rows stay; an empty table gives no rows; other columns
    aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = _marked(rows, "text", ["doc_id"], **options)
    keep = ["doc_id", "__base", "__counts"]
    schema = T.StructType([*marked.select(*keep).schema.fields, *T.StructType.fromDDL("__terms array<struct<start:int,end:int>>").fields])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [places(t, _spans(s), d) if d else [] for t, s, d in zip(*columns(b, "__held", "__base", "__disclosing"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(at, kind)], names=[*keep, "__terms"])

    got = map_batches(marked, run, schema)
    extra = F.array_join(F.transform("__terms", lambda x: F.concat_ws(":", F.lit(TERM), x["start"], x["end"])), ",")
    spans = F.array_join(F.filter(F.array("__base", extra), lambda s: s != ""), ",")
    return got.select("doc_id", *(F.col("__counts")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(F.col("__base"), 256).alias("base_sha256"), spans.alias("spans"), F.size("__terms").cast("long").alias("n_term"))


def replaced(text: str, base: str, terms: list[tuple[int, int]]) -> str:
    """The text with every span replaced; of overlapping ones the first, then the longest, counts."""
    spans = [(a, b, k) for k, a, b in _spans(base)] + [(a, b, TERM) for a, b in terms]
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        elif b > at:
            at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the found spans replaced in the text; all columns stay, whatever their names.

    A null text stays null; repeated rows stay; an empty table gives no rows.
    """
    names, place = docs.columns, docs.columns.index(text_col)
    rows = docs.toDF(*(f"c{k}" for k in range(len(names))))  # no name of a column of this table clashes with ours
    keep = rows.columns
    marked = _marked(rows, keep[place], keep, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, base, terms = columns(b, keep[place], "__base", "__disclosing")
            new = [t if t is None or not s else replaced(t, s, [(x["start"], x["end"]) for x in places(t, _spans(s), d)] if d else []) for t, s, d in zip(texts, base, terms, strict=True)]
            cols = [b.column(c) for c in keep]
            cols[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=keep)

    return map_batches(marked.select(*keep, "__base", "__disclosing"), run, rows.schema).toDF(*names)
