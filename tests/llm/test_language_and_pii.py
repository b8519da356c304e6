"""Language identification and personal data."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid, pii
from spanloom.llm.lookup import Sorted

WORDS = {"en": "the of and to in that it was for on are with as his they at be this from".split(), "fr": "le de un être et à il avoir ne je son que se qui ce dans en du elle".split(), "es": "el la de que y a en un ser se no haber por con su para como estar".split()}


def sentences(n, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(5, 60))), lang) for k in range(n) for lang in [rng.choice(list(WORDS))]]


def test_sorted_lookup():
    keys = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    s = Sorted(keys)
    assert (s.keys[s.find(keys)] == keys).all() and (s.find(keys + np.uint64(1)) == -1).all() and len(Sorted(keys[:0])) == 0


def test_kneser_ney_is_a_distribution():
    """Over all next characters, probabilities after any context add up to 1 (unknown ones included)."""
    texts = {"en": [t for _, t, x in sentences(60, 1) if x == "en"], "fr": [t for _, t, x in sentences(60, 1) if x == "fr"]}
    model = langid.build({k: langid.count_grams(t, 4) for k, t in texts.items()}, 4)
    alphabet = sorted({c for t in texts.values() for s in t for c in s.lower() if c.isalpha()} | {" "})
    for context in ("the", " of", "xqz", "   ", "hat"):
        total = np.zeros(2)
        for c in [*alphabet, "ж"]:
            cps = np.array([ord(x) for x in context + c], np.uint32)
            total += np.exp2(model._rows(cps, np.array([3])).astype(float))[0]
        assert np.allclose(total, 1, atol=2e-3), context


def brute_bits(model, text):
    """Cross-entropy position by position."""
    cps = np.concatenate([np.full(3, 32, np.uint32), langid.normalised(text)])
    return -sum(model._rows(cps[max(0, i - 3) : i + 1], np.array([3]))[0].astype(float) for i in range(3, len(cps))) / (len(cps) - 3)


def test_entropy_does_not_depend_on_the_slices(monkeypatch):
    model = langid.build({k: langid.count_grams([t for _, t, x in sentences(50, 2) if x == k], 4) for k in WORDS}, 4)
    some = ["le chat et the dog", "", "123", "été " * 40, "of the"]
    whole, size = model.entropies(some)
    assert size.tolist()[1:3] == [0, 0]
    assert np.allclose(whole[0], brute_bits(model, some[0]), atol=1e-4)
    monkeypatch.setattr(langid, "_SLICE", 16)
    assert np.allclose(model.entropies(some)[0], whole, atol=1e-4)


def test_identify(spark):
    rows = [(k, t, lang, "clash") for k, t, lang in sentences(400, 3)] + [(1000, None, "en", ""), (1001, "12 !", "en", ""), (1002, "日本語の文章です" * 30, None, ""), (1003, "the of and that", None, ""), (None, "le de un et que", None, ""), (1004, "", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = df.withColumn("held_out", langid.held_out())
    model = langid.fit(held.where("doc_id IS NOT NULL AND NOT held_out"))
    got = langid.identify(held, model, keep=["doc_id", "held_out", "lang"]).collect()
    test = [r for r in got if r.held_out and r.lang and r.doc_id < 1000]
    assert len(test) > 50 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert not any(r.rejected for r in test) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1004)] == ["und"] * 3 and by[1001].rejected and by[1001].score == 0
    assert by[1002].rejected and by[1003].lang_pred == "en" and by[None].lang_pred == "fr" and by[None].held_out is False
    assert langid.identify(df.limit(0), model).count() == 0
    assert "score" in langid.identify(df, model).columns
    none = langid.identify(df, langid.fit(df.where("lang = 'xx'"))).select("lang_pred", "rejected").distinct().collect()
    assert [tuple(r) for r in none] == [("und", True)]


def test_accepted_keeps_all_columns(spark):
    rows = [(k, t, lang, k + 100, "keep", k, 5) for k, t, lang in sentences(100, 7)] + [(500, None, None, 1, "x", 1, 5), (501, "日本語" * 50, None, 1, "x", 1, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, rejected string, __text int, n_chars int")
    model = langid.fit(df)
    got = langid.accepted(df, model)
    assert got.schema == df.schema and sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] < 500)
    assert langid.identify(df, model).where("doc_id < 500").agg(F.sum("__text")).first()[0] == sum(range(100))
    assert langid.accepted(df, None).count() == 0 and langid.accepted(df.limit(0), model).count() == 0


def test_garbage_of_a_large_alphabet_is_rejected(spark):
    """A learned language of many letters doesn't lift the floor of the others; one wrong label doesn't either."""
    rng = random.Random(8)
    han = [chr(0x4E00 + k) for k in range(3000)]
    rows = [(t, lang) for _, t, lang in sentences(900, 9)] + [("".join(rng.choice(han) for _ in range(200)), "zh") for _ in range(300)]
    rows.append(("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(300)), "en"))
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    garbage = ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(200)) for _ in range(20)]
    assert all(model.decide(garbage)[2])
    assert not any(model.decide([t for t, _ in rows[:300]])[2])


def test_long_texts_and_copies_leave_all_languages_in(spark):
    rows = [("the of and " * 30_000 + str(k), "en") for k in range(3)] + [("le de un " * 20, "fr")] * 3000 + [(f"el la de que y {'a ' * k}", "es") for k in range(40)]
    got = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(4), sample_chars=64_000)
    assert got.langs == ["en", "es", "fr"] and got.decide(["the of and the", "le de un le de"])[0] == ["en", "fr"]


def test_fit_keeps_its_bound_and_ignores_copies(spark):
    df = spark.createDataFrame([(t, lang) for _, t, lang in sentences(200, 4)] + [("the " * 50, "en")] * 500, "text string, lang string")
    model = langid.fit(df, sample_chars=2000)
    assert model.langs == ["en", "es", "fr"]


# -- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    def ok(kind, s):
        d = re.sub(r"\D", "", s)
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return 9 <= len(d) <= 15 if kind == "phone" else True

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok(k, m.group())]


def test_patterns_are_brute_force():
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@+- (9)25_4") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute(t), t
    for t in ("card 4111 1111 1111 1111 and 4111-1111-1111-1112", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.004", "x@y.z,a.b+c@d-e.co.uk @a.b c@d", "+1 (555) 123-4567 +12", "٣.1.2.3.4"):
        assert pii.base_spans(t) == brute(t)
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("a" * 200_000 + "@") == []


def rows_with_secrets():
    rng = random.Random(6)
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    out = []
    for k in range(60):
        words = [rng.choice(plain) for _ in range(30)]
        if k % 10 == 0:
            words[10:12] = ["Zorblax", "ann@corp.example.com"]  # the word gives the address away
        if k % 10 == 5:
            words[12] = f"u{k}@corp.example.com"
        out.append((k, " ".join(words)))
    return out


def test_find(spark):
    rows = rows_with_secrets() + [(100, None), (101, ""), (7, "Zorblax alone +1 555 123 4567"), (None, "10.0.0.1"), (102, "10.0.0.1"), (102, "10.0.0.1")]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, spans string").repartition(3)
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), hashlib.sha256(pii.joined(brute(t or "")).encode()).hexdigest()) for k, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        terms = [x.split(":") for x in r.spans.split(",") if x.startswith("term:")]
        assert r.n_term == len(terms)
        marked = {text[int(a) : int(b)] for _, a, b in terms}
        assert marked <= {"Zorblax"} and bool(marked) == ("ann@" in text), (r.doc_id, marked)
    assert pii.find(df.limit(0)).count() == 0


def test_copies_are_one_context(spark):
    df = spark.createDataFrame([(k, "rare Quux me@corp.example.com words") for k in range(20)] + [(k + 100, f"other text {k}") for k in range(20)], "doc_id long, text string")
    assert pii.find(df).agg(F.sum("n_term")).first()[0] == 0


def test_one_line_in_different_texts(spark):
    """A signature counts once for each text that it stands in."""
    line = "Contact Quux Roe, quux@corp.example.com"
    df = spark.createDataFrame([(k, f"some text of number{chr(97 + k)}\n{line}\nmore words") for k in range(5)] + [(k + 100, f"other text {k}") for k in range(60)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("Quux" not in got[k] and "Roe" not in got[k] for k in range(5))


def test_words_in_slices_are_the_words(monkeypatch):
    text = "Quux wrote x@corp.example.com, and Émile's 10.0.0.1 quux. " * 20
    base = pii.base_spans(text)
    whole = [np.concatenate(x) for x in zip(*pii.terms_outside(text, base), strict=True)]
    monkeypatch.setattr(pii, "CHUNK", 40)
    parts = list(pii.terms_outside(text, base))
    assert len(parts) > 20 and all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), whole, strict=True))
    want = [m.span() for m in re.finditer(r"[^\W\d_]+", text) if not any(m.start() < b and a < m.end() for _, a, b in base)]
    assert list(zip(whole[0].tolist(), whole[1].tolist(), strict=True)) == want
    at = pii.places(text, base, [int(pii.words("quux")[2].view(np.int64)[0])])
    assert [text[x["start"] : x["end"]] for x in at] == ["Quux", "quux"] * 20


def test_terms_far_from_the_entity(spark):
    """A term lines away from the entity counts, and is marked at all its places."""
    text = lambda k: f"Quux wrote number{chr(97 + k)}\nwith many words in between them all and more\nmail q@corp.example.com now\nbest, quux"
    df = spark.createDataFrame([(k, text(k)) for k in range(5)] + [(k + 100, f"with many words in between them all and more wrote mail now best {k}") for k in range(60)] + [(200, "Quux alone"), (201, "other@corp.example.com with")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for k in range(5):
        assert got[k] == text(k).replace("Quux", "[TERM]").replace("q@corp.example.com", "[EMAIL]").replace("quux", "[TERM]")
    assert got[200] == "Quux alone" and got[201] == "[EMAIL] with"
    found = {r.doc_id: r for r in pii.find(df).collect()}
    assert [found[k].n_term for k in (0, 4, 100, 200, 201)] == [2, 2, 0, 0, 0]


def test_disclosure_is_the_formula(spark):
    rows = rows_with_secrets()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii._found(df, "text", ["doc_id"]).cache()
    freq = {r.term: r.n_term for r in pii.document_frequencies(df).collect()}
    _, _, h = pii.words("zorblax")
    assert freq[int(h[0].astype(np.int64))] == 6
    got = pii.disclosing(found, pii.document_frequencies(df), len(rows), disclosure=0.0, support=3).collect()
    e = 6 / 60
    zorblax = [r for r in got if r.term == int(h[0].astype(np.int64))]
    assert len(zorblax) == 1 and abs(zorblax[0].disclosure - np.log2(6 * 60 / 36) / np.log2(1 / e)) < 1e-9


def plain_terms(rows, disclosure=0.8, support=3, least_ic=1.0):
    """Marked words of each row, by plain counting over all documents."""
    docs = []
    for _, text in rows:
        base = brute(text or "")
        words = [m for m in re.finditer(r"[^\W\d_]+", text or "")]
        own = {m.group().lower() for m in words if not any(m.start() < b and a < m.end() for _, a, b in base)}
        docs.append((text or "", {f"{k}:{text[a:b].lower()}" for k, a, b in base}, own, {m.group().lower() for m in words}))
    n = len(docs)
    out = [set() for _ in docs]
    for e in {e for d in docs for e in d[1]}:
        holders = [d for d in docs if e in d[1]]
        ic = np.log2(n / len(holders))
        if len({d[0] for d in holders}) < support or ic < least_ic:
            continue
        for t in {t for d in holders for t in d[2]}:
            both = [d for d in holders if t in d[2]]
            pmi = np.log2(len(both) * n / (sum(t in d[3] for d in docs) * len(holders)))
            if len({d[0] for d in both}) >= support and pmi / ic >= disclosure - 1e-12:
                for k, d in enumerate(docs):
                    if e in d[1] and t in d[2]:
                        out[k].add(t)
    return out


@pytest.mark.parametrize("disclosure", [0.8, 0.5])
def test_find_is_brute_force(spark, disclosure):
    """Documents with several entities each, shared terms, copies, and entities that most documents hold."""
    rng = random.Random(12)
    plain = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    secret = {f"m{k}@corp.example.com": [f"Zorb{chr(97 + k)}", f"Quux{chr(97 + k)}"] for k in range(6)}
    rows = []
    for k in range(300):
        text = [rng.choice(plain) for _ in range(25)]
        for mail, terms in rng.sample(sorted(secret.items()), rng.choice([0, 0, 0, 1, 2])):
            text += [mail, *[t for t in terms if rng.random() < 0.9]]
        if rng.random() < 0.6:
            text += ["all@corp.example.com", "everyone"]
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, rows[k][1]) for k in range(20)] + [(2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {k: t for (k, _), t in zip(rows, plain_terms(rows, disclosure), strict=True)}
    text = dict(rows)
    for r in pii.find(df, disclosure=disclosure).collect():
        marked = {text[r.doc_id][int(a) : int(b)].lower() for _, a, b in (x.split(":") for x in r.spans.split(",") if x.startswith("term:"))}
        assert marked == want[r.doc_id], r.doc_id
    assert any("zorb" in t for w in want.values() for t in w) and not any("everyone" in w for w in want.values())


def test_an_address_in_every_other_document(spark):
    """What is carried follows the words of the documents, not the vocabulary times the documents."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    own = [word() for _ in range(3000)]
    rows = [(k, " ".join(rng.choice(own) for _ in range(40)) + " me@corp.example.com") for k in range(1500)] + [(9000 + k, f"other words {k}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii._found(df, "text", ["doc_id"]).cache()
    pairs = pii.disclosing(found, pii.document_frequencies(df), len(rows)).cache()
    marked = pii.terms_to_mark(found, pairs)
    assert pairs.count() > 2000 and marked.count() <= sum(len(set(t.split())) for _, t in rows[:1500])
    assert pii.own_words(found).count() <= 1500 * 42


def test_sanitise(spark):
    rows = [*rows_with_secrets(), (200, None), (201, "call +1 555 123 4567 or 4111 1111 1111 1111!")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert len(got) == len(rows) and got[200].text is None and got[201].text == "call [PHONE] or [CARD]!"
    assert "[TERM] [EMAIL]" in got[0].text and "Zorblax" not in got[0].text and got[1].text == rows[1][1]
    clash = df.selectExpr("doc_id AS __row", "text", "source AS __base", "source AS __text", "source AS __held", "1 AS __entities")
    again = pii.sanitise(clash)
    assert again.schema == clash.schema and {r["__row"]: r.text for r in again.collect()} == {k: r.text for k, r in got.items()}
    assert {tuple(r)[2:] for r in again.collect()} == {("s", "s", "s", 1)} and pii.sanitise(clash.limit(0)).count() == 0
    assert pii.replaced("abcdef", "x:1:3,y:2:5", []) == "a[X]f"
