"""Phrase collocations, held against a count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import collocations as co

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, share=80, top=2000):
    """All rows of (lang, text) documents."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in held.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= share * a and inside(q) for q, b in held.items()):
                continue
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=2):
    r = random.Random(seed)
    words = ["a", "A", "b", "the", "of", "é", "É", "x\xa0y", "\x1c", "|", "日本", "z" * 70, "\U0001f600", "w\0"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "\x0b", "? !"]
    text = lambda: r.choice(gaps[3:]) * r.randint(0, 1) + "".join(r.choice(words) + r.choice(gaps) for _ in range(r.randint(0, 40)))
    rows = [(r.choice(["en", "de", None, "und", ""]), text()) for _ in range(250)]
    return rows + [("en", None), ("en", ""), (None, " . "), ("fr", "one two"), *[("de", "new york city is new york city")] * 40, ("en", "a " * 500)]


@pytest.mark.parametrize(("least", "cells", "phrases", "ranked", "chunk"), [(30, co.CELLS, co.PHRASES, co.RANKED, co.CHUNK), (5, 50, 40, 30, 60)])
def test_as_brute_force(spark, monkeypatch, least, cells, phrases, ranked, chunk):
    rows = corpus()
    df = spark.createDataFrame([(k, lang, text, "x", 1) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, n int").repartition(5)
    out = co.collocations(df, least=least, cells=cells, phrases=phrases, ranked=ranked, top=2000 if least == 30 else 25)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    expected = brute(rows, least, top=2000 if least == 30 else 25)
    assert expected and sorted(tuple(r) for r in out.collect()) == expected


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 50)
    text = co.folded("\n".join(f"some words {k} in a line" for k in range(100)))
    parts = list(co._parts(text))
    assert len(parts) > 20 and "\n".join(parts) == text


def test_empty_and_rare(spark):
    schema = "lang string, text string"
    assert co.collocations(spark.createDataFrame([], schema)).collect() == []
    assert co.collocations(spark.createDataFrame([("en", "just a few words")], schema)).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 9 * 10**17
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 7)], "lang string, phrase string, words int, a long")
    assert [tuple(r) for r in co.scored(counts).collect()] == [("en", "a b", big - 7, big, big - 1, 2000000 * (big - 7) // (2 * big - 1))]


@pytest.mark.parametrize("block", [8, 20])
def test_the_sketch_bounds_every_count(spark, monkeypatch, block):
    """Even with cells that many phrases share, no frequent phrase is lost."""
    monkeypatch.setattr(co, "BLOCK", block)
    docs = spark.createDataFrame(corpus(4), "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    cells = co.frequent_cells(docs, co.BLOCK, 3).cache()
    few = {r.cell for r in cells.collect()}
    got, rest = ({(r.lang, r.phrase) for r in co.candidates(docs, cells, co.BLOCK, every).collect() if r.phrase is not None} for every in (True, False))
    assert got <= rest
    every = defaultdict(Counter)
    for lang, text in docs.collect():
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                every[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert few and {(lang, p) for lang, c in every.items() for p, n in c.items() if n >= 3} <= got


def test_an_automaton_of_words_counts_overlapping_phrases():
    r = random.Random(5)
    text = co.folded(" ".join(r.choice(["a", "b", "é", "日本", "of", "z" * 70, "rare."]) for _ in range(4000)))
    words = [p.split() for p in text.split("\n")]
    every = Counter(" ".join(w[i : i + k]) for w in words for k in range(1, 5) for i in range(len(w) - k + 1))
    # Of "z of z b" the first words are missing: it can't be frequent, and has no state. The last phrase isn't in the text.
    missing = {"z" * 70 + " of", "of a b", "a é"}
    phrases = [p for p in sorted(every) if p not in missing and not any(p.startswith(m + " ") for m in missing)] + ["b never"]
    made = co.Automaton(*co.compiled(pa.array([*phrases, "a é of"])))
    for part in (text[: text.index("\n", 9000)], text[text.index("\n", 9000) + 1 :]):
        made.count(part)
    assert made.counts().tolist() == [every[p] for p in phrases] + [0]


def test_texts_are_read_once_for_many_candidates():
    """States are two numbers each, so one scan counts what took five of 250,000 phrases."""
    phrases = pa.array([f"w{i} w{j}" for i in range(1000) for j in range(299)] + [f"w{i}" for i in range(1000)])
    size, words, levels = co.compiled(phrases)
    assert size == 300_000 and len(words) == 1000 and sum(x.nbytes for level in levels for x in level) == 16 * size
    assert len(list(co._shifts({(lang, 0): size for lang in "abcd"}, co.PHRASES))) == 1
