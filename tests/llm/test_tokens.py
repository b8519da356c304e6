"""Encoding, token counts, token shards, packing."""

import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from spanloom.llm import bpe, hashing, packing, tokenbin, tokencount  # noqa: E402

ODD = ["", "'s", " 's", "x's y'll z're", "it'sabc 'll!!'s", "\n\n a  b \n", "a\n\n", "  ", "\t x", "日本語 123½ ²", "''s", "a'", " '", "<|endoftext|> hi", "é  b", "don't!!", "'Sx", "a 'd'd'll", " x　y", "x" * 3000 + "  \n '", "😀 \U0010ffff", "a​b", "٣٤ ١", "a <|endoftext|><|endoftext|>\n <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x" * 64 + " " + "y" * 65 + "z" * 5000 + "!" * 70 + " " * 90 + "q"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    out = list(ODD)
    for _ in range(n):
        out.append("".join(rng.choice(" \n\t'stmdrevl!1é日 AB.") for _ in range(rng.randint(0, 40))))
    return out


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.tokenizer_path())


OWN: dict = {}


def direct(enc, t):
    """By a tokenizer that nothing else has touched."""
    name = "byte_bpe_50k.json" if enc.fast else "word_bpe_49k.json"
    if name not in OWN:
        OWN[name] = tokenizers.Tokenizer.from_file(bpe.tokenizer_path(name))
    return OWN[name].encode(t, add_special_tokens=False).ids


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return [a, b]


def test_encoding_is_the_library_on_whole_texts(enc, monkeypatch):
    every = texts()
    for chunk in (bpe.CHUNK, 50):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(hashing, "CHUNK", max(chunk, 70))
        ids, counts = enc.encode(every)
        at = 0
        for t, n in zip(every, counts, strict=True):
            assert ids[at : at + n].tolist() == direct(enc, t), t[:50]
            at += n
    assert enc.encode([])[0].tolist() == []


def test_very_long_words(enc):
    """Words that a polynomial hash can't tell apart, and one of a million letters."""
    every = [*thue_morse(11), " ".join(thue_morse(12)), "w" * 1_000_000, "<|endoftext|> hi"]
    ids, counts = enc.encode(every)
    for t, part in zip(every, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert part.tolist() == direct(enc, t), t[:20]
    assert direct(enc, every[-1]) == [50256, 23105] and int(enc.id_bytes[50256]) == 13


def test_table_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 1 << 11)
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    e = bpe.Encoder(bpe.tokenizer_path())
    for seed in range(4):
        every = texts(200, seed)[len(ODD) :]
        ids, _ = e.encode(every)
        assert ids.tolist() == [i for t in every for i in direct(e, t)]


def test_other_tokenizers_are_given_whole_texts():
    e = bpe.Encoder(bpe.tokenizer_path("word_bpe_49k.json"))
    ids, counts = e.encode(["Hello there", "", "x"])
    assert not e.fast and ids[: counts[0]].tolist() == direct(e, "Hello there")


# -- token counts


def brute_attribution(ends, bounds, rule):
    out, crosses, start = [0.0] * len(bounds), [0] * len(bounds), 0
    for e in ends:
        share = []
        low = 0
        for k, b in enumerate(bounds):
            share.append(max(0, min(e, b) - max(start, low)))
            crosses[k] += start < b < e
            low = b
        touched = [k for k, s in enumerate(share) if s]
        if rule == "start":
            out[touched[0]] += 1
        elif rule == "end":
            out[touched[-1]] += 1
        elif rule == "most":
            out[max(touched, key=lambda k: (share[k], -k))] += 1
        else:
            for k in touched:
                out[k] += share[k] / (e - start)
        start = e
    return out, crosses


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_attribution_rules(rule):
    rng = random.Random(4)
    for _ in range(300):
        ends = np.cumsum([rng.randint(1, 6) for _ in range(rng.randint(1, 12))])
        total = int(ends[-1])
        bounds = np.array(sorted(rng.choices(range(total + 1), k=rng.randint(0, 6))) + [total])
        got = tokencount.attribute(ends, bounds, rule)
        want = brute_attribution(ends.tolist(), bounds.tolist(), rule)
        assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1], (ends, bounds)
    with pytest.raises(ValueError):
        tokencount.attribute(ends, bounds, "other")


def test_section_tokens(spark, enc):
    docs = [(1, "one line\ntwo  \n\nend é", 0), (2, None, 0), (None, "x\n", 0), (2, "", 0), (3, "日本\n語", 0), (1, "one line\ntwo  \n\nend é", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, section int")
    got = tokencount.section_tokens(df).collect()
    brute = lambda t, rule: brute_attribution(np.cumsum([int(enc.id_bytes[i]) for i in direct(enc, t)]).tolist(), np.cumsum([len(x) for x in t.encode().splitlines(keepends=True)] or [0]).tolist(), rule)
    for key, text in ((1, docs[0][1]), (3, docs[4][1])):  # as registered
        rows = sorted({(r.section, r.n_tokens, r.crosses) for r in got if r.doc_id == key})
        assert [r[1:] for r in rows] == list(zip(*brute(text, "most"), strict=True))
    for rule in ("start", "end", "share"):
        rows = tokencount.section_tokens(df, rule=rule).collect()
        assert len(rows) == len(got) and abs(sum(r.n_tokens for r in rows) - sum(r.n_tokens for r in got)) < 1e-9
    first = sorted({(r.section, r.start, r.end) for r in got if r.doc_id == 1})
    assert first == [(0, 0, 9), (1, 9, 15), (2, 15, 16), (3, 16, 21)]
    assert [(r.section, r.start, r.end, r.n_tokens, r.doc_tokens) for r in got if r.doc_id == 2] == [(0, 0, 0, 0, 0)] * 2
    # Against the library's own offsets.
    for key, text in ((1, docs[0][1]), (3, docs[4][1])):
        own = {r.section: r.n_tokens for r in tokencount.section_tokens(df, rule="start").collect() if r.doc_id == key}
        raw = text.encode()
        ends = np.cumsum([enc.id_bytes[i] for i in direct(enc, text)])
        starts = [0, *ends[:-1]]
        lines = np.cumsum([len(x) + 1 for x in raw.split(b"\n")])
        want = [sum(1 for s in starts if (lines[k - 1] if k else 0) <= s < lines[k]) for k in range(len(lines))]
        assert [own[k] for k in sorted(own)] == want
    assert tokencount.section_tokens(df.limit(0)).count() == 0


def test_field_tokens(spark, enc):
    df = spark.createDataFrame([("a title", "body text", None), ("", None, "x")], "a string, b string, c string")
    for r in tokencount.field_tokens(df, ["a", "b", "c"]).collect():
        whole = "\n".join(x or "" for x in (r.a, r.b, r.c))
        assert r.tokens_a + r.tokens_b + r.tokens_c == r.tokens_all == len(direct(enc, whole))
    with pytest.raises(ValueError):
        tokencount.field_tokens(df.withColumnRenamed("c", "tokens_a"), ["a"])


def test_other_tokenizer_offsets():
    ends, counts = tokencount.token_ends(["Hello there, you", ""], bpe.tokenizer_path("word_bpe_49k.json"))
    assert counts[1] == 0 and ends[-1] == 16 and len(ends) == counts[0]


# -- shards


@pytest.mark.parametrize(
    "ids",
    [np.zeros(0), np.zeros(9999), np.arange(7), np.array([2**62, 1, 2**60 - 1, 2**60, 0, 2**63 + 5], np.uint64)] + [np.random.default_rng(b).integers(0, 2**b, 5000, dtype=np.uint64) for b in (1, 2, 5, 9, 16, 17, 33, 61)],
)
def test_simple8b_round_trip(ids):
    ids = ids.astype(np.uint64)
    cut = len(ids) // 3
    data = tokenbin.shard_bytes(np.array([3, -9]), np.array([cut, len(ids)]), ids)
    doc_ids, spans, got = tokenbin.parse_shard(data)
    assert doc_ids.tolist() == [3, -9] and spans.tolist() == [[0, cut], [cut, len(ids)]] and (got == ids).all()


def test_simple8b_packs_greedily():
    words, first, _ = tokenbin.pack(np.array([0] * 240 + [1] * 60 + [3] * 30 + [2**60 - 1], np.uint64))
    assert (words >> np.uint64(60)).tolist() == [0, 2, 3, 15] and first.tolist() == [0, 4]
    with pytest.raises(ValueError):
        tokenbin.parse_shard(b"\0" * 64)


DOCS = [(5, "hello <|endoftext|> world"), (2, None), (9, "'s don't\n\n x"), (2, ""), (None, "null id"), (7, "word " * 700), (5, "hello <|endoftext|> world")]


def token_rows(enc):
    return [(k, [*direct(enc, t or ""), 0]) for k, t in DOCS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("shard", [1, 1 << 20])
def test_token_ids(spark, enc, shard):
    df = spark.createDataFrame([(k, t, 1) for k, t in DOCS], "doc_id long, text string, n_tokens int").repartition(3)
    got = tokenbin.token_ids(df, shard=shard).collect()
    want = sorted(token_rows(enc), key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    assert sorted((r.n_tokens, r.ids_crc32, str(r.doc_id)) for r in got) == sorted((len(i), crc(i), str(k)) for k, i in want)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [k for k, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert tokenbin.token_ids(df.limit(0)).count() == 0


# -- packing


def check_packing(rows, want, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    pieces = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    due = sorted((str(k), a, min(capacity, len(i) - a), crc(i[a : a + capacity]), len(i)) for k, i in want for a in range(0, len(i), capacity))
    assert pieces == due
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq), by_doc


def test_packing_holds_every_id_once(spark, enc):
    df = spark.createDataFrame([(k, t, 1) for k, t in DOCS * 3], "doc_id long, text string, start int").repartition(3)
    check_packing(packing.pack_documents(df).collect(), token_rows(enc) * 3, 1024)
    check_packing(packing.pack_documents(df, capacity=64, grain=1).collect(), token_rows(enc) * 3, 64)
    assert packing.pack_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, capacity=10, grain=4)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(2)
    for mean in (0.3, 20, 900):
        demand = rng.poisson(mean, 64)
        plan = packing.plan(demand, 64)
        assert (sum(p * n for p, n in plan) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in plan)
        used, least = sum(n for _, n in plan), -(-int((demand * np.arange(1, 65)).sum()) // 64)
        assert used <= least * 1.02 + 8
    assert packing.plan(np.zeros(8, np.int64), 8) == []


def test_pricing_is_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(20):
        value, demand = rng.random(4), rng.integers(0, 2, 4)
        got, pattern = packing.best_pattern(value, demand, 7)
        want = max(sum(v * k for v, k in zip(value, c, strict=True)) for c in product(range(8), repeat=4) if sum(k * (s + 1) for s, k in enumerate(c)) <= 7 and all(d or not k for d, k in zip(demand, c, strict=True)))
        assert abs(got - want) < 1e-9 and abs((pattern * value).sum() - want) < 1e-9 and (pattern * np.arange(1, 5)).sum() <= 7
