"""Near-duplicates, repeated passages, benchmark passages, components."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import chunking, hashing, minhash, shingles, tiling
from spanloom.llm.components import connected_components

VOCABULARY = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


# -- shingles


def plain_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


ODD = ["", "  \t\n", "one", "One tWo", "É é É", "a\x0bb\x0cc\rd", "a a a a a", "x" * 500 + " y", " nbsp nbsp ", "日本 語 日本 語", "a b c d e f g " * 50, "Long" * 30 + " x " + "lONG" * 30, "w" * 64 + " " + "w" * 65]


def thue_morse(n):
    """Two words of 2^n letters that polynomials modulo 2^64 can't tell apart from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("chunk", [None, 70])
def test_shingle_sets_are_the_plain_sets(chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        monkeypatch.setattr(hashing, "CHUNK", chunk)
    rng = random.Random(1)
    texts = ODD + [prose(rng, rng.randint(1, 60)) for _ in range(50)]
    for k in (1, 2, 5):
        got = shingles.shingle_sets(texts, k)
        names: dict = {}
        for t, s in zip(texts, got, strict=True):
            want = plain_set(t, k)
            assert len(s) == len(want)
            names.setdefault(frozenset(want), s.tobytes())
            assert names[frozenset(want)] == s.tobytes()
        assert len({x for x in names.values()}) == len(names)
        a, b = plain_set(texts[-1], k), plain_set(texts[-2], k)
        assert len(np.intersect1d(got[-1], got[-2])) == len(a & b)


def test_tables_by_code_point():
    """Beyond the tables too."""
    every = np.arange(0x110000, dtype=np.uint32)
    low, kind = hashing.folded(every)
    for c in [*range(0x3000), 0x10400, 0x1D7CE, 0x1F600, 0x2F00, 0x323AF, 0x323B0, 0xE0100, 0x10FFFF]:
        x = chr(c)
        assert kind[c] == (1 if x.isalpha() else 2 if x.isalnum() else 0)
        assert not kind[c] or chr(low[c]) == (x.lower() if len(x.lower()) == 1 else x)
    keys = hashing.code_point_keys(every)
    assert len(np.unique(keys)) == 0x110000 and (hashing.code_point_keys(every[:500]) == keys[:500]).all() and (hashing.code_point_keys(every, 1) != keys).all()


def test_words_of_any_length_have_one_hash():
    """Whatever stands beside them, and however long they are."""
    x, y = thue_morse(11)
    long = "z" * 300_000
    alone = shingles.word_hashes([long, x, y])
    beside = shingles.word_hashes([f"{'q ' * 200_000}{long.upper()} {x}", f"{y} {long} {'r' * 600_000}"])
    assert beside[0][-2] == beside[1][1] == alone[0][0] and beside[0][-1] == alone[1][0] and beside[1][0] == alone[2][0] != alone[1][0]
    (h, *_), middle = tiling.words(f"{long}m{long}"), tiling.words(f"{long}n{long}")[0]
    assert h[0] != middle[0] and tiling.words(x)[0][0] != tiling.words(y)[0][0]
    assert (tiling.words(f"a {long} {x.upper()}")[0][1:] == [tiling.words(long)[0][0], tiling.words(x)[0][0]]).all()


def test_signatures_are_plain_minima(monkeypatch):
    monkeypatch.setattr(minhash, "_BLOCK", 8)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 100, 2, 40)]
    a, b = minhash.hash_functions(10)
    want = [[min((int(x) * int(a[k]) + int(b[k])) % 2**64 for x in s) >> 32 for k in range(10)] for s in sets]
    assert minhash.signatures(sets, 10).tolist() == want


# -- components


def brute_components(edges):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_connected_components(spark):
    rng = random.Random(3)
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(5, k) for k in range(200, 260)]
    noise = [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)]
    edges = path + star + noise + [(7, 8), (8, 7), (7, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in brute_components(edges).items() if any(k in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- near-duplicates


def brute_links(rows, k, percent):
    sets = [(i, plain_set(t, k)) for i, t in rows if i is not None]
    edges = [(i, i) for i, _ in sets]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                edges.append((i, j))
    return brute_components(edges)


def corpus(seed, families=8, copies=12):
    rng = random.Random(seed)
    rows = [(k, t) for k, t in enumerate([*ODD, None, "one", "a a a a a"])]
    n = 100
    for _ in range(families):
        base = prose(rng, rng.randint(20, 80))
        for c in range(copies):
            rows.append((n, base if c == 0 or rng.random() < 0.2 else edited(rng, base, rng.randint(1, 14))))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("light", [minhash.LIGHT, 0])
def test_near_duplicates_are_brute_force(spark, monkeypatch, light):
    """Also with every mixed bucket taking the prefix filter (light = 0)."""
    monkeypatch.setattr(minhash, "LIGHT", light)
    monkeypatch.setattr(minhash, "COUNTERS", 1 << 8)
    rows = corpus(4) + [(None, "one"), (None, None), (100, dict(corpus(4))[100])]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = minhash.near_duplicates(df, shingle=2, percent=80).collect()
    assert len(got) == len(rows)
    want = brute_links(rows, 2, 80)
    text = dict(rows)
    for r in got:
        assert r.n_shingles == len(plain_set(text[r.doc_id] if r.doc_id is not None else ("one" if r.n_shingles else None), 2))
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True)), r
    assert any(not r.kept for r in got)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(df).collect())
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_shuffled_ids_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 1)
    rows = corpus(5, families=3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).collect()}
    assert got == brute_links(rows, 5, 80)


# -- chunks


def plain_cuts(text, least, most, bits):
    """One character at a time."""
    key = [int(x) for x in (chunking.code_point_keys(np.array([ord(c) for c in text], np.uint32)) >> np.uint64(40)).astype(np.uint16)] if text else []
    out, at, h, seen = [], 0, 0, []
    for k, g in enumerate(key):
        h = ((h << 1) + g) & 0xFFFF
        seen.append(h)
        if h >> (16 - bits) == 0 and k + 1 - at >= least:
            at = k + 1
            out.append(at)
        elif k + 1 - at == most and k + 1 < len(text):  # no cut: the first of the smallest hashes
            at = min(range(at + least, at + most + 1), key=lambda c: seen[c - 1])
            out.append(at)
    return out + [len(text)] * (at < len(text))


@pytest.mark.parametrize("chunk", [None, 400])
def test_chunks_are_the_plain_ones(chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr(chunking, "CHUNK", chunk)
        monkeypatch.setattr(chunking, "groups", lambda t, most=chunk: hashing.groups(t, most))
    rng = random.Random(6)
    texts = ["", "short", "x" * 1000, "日本語" * 80] + [prose(rng, rng.randint(1, 300)) for _ in range(20)]
    which, start, end, digest = chunking.chunks(texts)
    for k, t in enumerate(texts):
        mine = which == k
        assert end[mine].tolist() == plain_cuts(t, chunking.LEAST, chunking.MOST, chunking.BITS), k
        assert start[mine].tolist() == [0, *end[mine].tolist()[:-1]][: mine.sum()]
    seen = defaultdict(set)
    for k, a, b, h in zip(which, start, end, digest, strict=True):
        seen[h.tobytes()].add(texts[k][a:b])
    assert all(len(s) == 1 for s in seen.values())
    with pytest.raises(ValueError):
        chunking.cuts(np.zeros(3, np.uint32), np.zeros(1, np.int64), np.array([3]), least=4)


def test_passages_of_one_word_or_line_share_chunks():
    """Forced cuts go by the content: they fall into place wherever such a passage begins.

    Passages with cuts of their own are left to the plain rule: several in one period needn't meet.
    """
    rng, forced = random.Random(15), 0
    for _ in range(60):
        unit = prose(rng, rng.choice([1, 1, 3, 8]))
        passage = "\n".join([unit] * (60 // len(unit.split()) + 1))
        if (chunking.gear(np.array([ord(c) for c in passage], np.uint32))[16:] >> np.uint16(16 - chunking.BITS) == 0).any():
            continue
        forced += 1
        which, _, _, digest = chunking.chunks([f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)}", f"{prose(rng, 37)}\n{passage}\n{prose(rng, 21)}"])
        first, second = ({h.tobytes() for h in digest[which == k]} for k in (0, 1))
        assert first & second
    assert forced > 5


def test_repeated_passages(spark):
    rng = random.Random(7)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(51)) for _ in range(6)]
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows, holds = [], {}
    for k in range(60):
        p = rng.choice([None, None, *range(6)])
        holds[k] = p
        rows.append((k, own(rng.randint(5, 80)) + (" " + passages[p] + " " if p is not None else " ") + own(rng.randint(5, 80))))
    line = "All rights reserved."
    rows += [(k, f"{line} {own(40)}") for k in range(100, 110)] + [(200, (own(20) + " ") * 3), (201, None), (202, ""), (None, rows[0][1])]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, start int").repartition(4)
    got = chunking.repeated_passages(df).collect()
    text, times = dict(rows), [v for v in holds.values() if v is not None]
    assert {r.doc_id for r in got} == {k for k, p in holds.items() if p is not None and times.count(p) > 1}
    for r in got:
        p = holds[r.doc_id]
        first = min(k for k, v in holds.items() if v == p)
        assert text[r.doc_id][r.start : r.end] in text[first] and r.first_doc_id == first and r.is_first == (r.doc_id == first)
    clean = {r.doc_id: r.text for r in chunking.without_repeats(df).collect()}
    assert len(clean) == len(rows)
    for r in got:
        part = text[r.doc_id][r.start : r.end]
        assert (part in clean[r.doc_id]) == r.is_first
    assert clean[201] is None and clean[100] == text[100]
    assert chunking.repeated_passages(df.limit(0)).count() == 0


def test_repeats_stay_in_their_first_holder(spark):
    """P / P+Q / Q, and copies of a text whose smallest id has an edit."""
    rng = random.Random(8)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    p, q, base = own(60), own(60), own(120)
    near = base.split()
    near[60] = "edited"
    rows = [(1, f"{own(20)} {p} {own(20)}"), (2, f"{own(20)} {p} {q} {own(20)}"), (3, f"{own(20)} {q} {own(20)}"), (4, f"{q} {own(20)}")]
    rows += [(10, " ".join(near)), (11, base), (12, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in chunking.without_repeats(df).collect()}
    which, start, end, _ = chunking.chunks([t for _, t in rows])
    for k, a, b in zip(which, start, end, strict=True):
        piece = rows[k][1][a:b]
        assert any(piece in t for t in clean.values()), (rows[k][0], piece)
    inner = lambda t: t[100:-100]
    assert [inner(p) in clean[k] for k in (1, 2)] == [True, False] and [inner(q) in clean[k] for k in (2, 3, 4)] == [True, False, False]
    assert clean[12] == "" and base.split()[60] in clean[11] and len(clean[11]) < 250
    got = chunking.repeated_passages(df).collect()
    for r in got:
        assert r.is_first == (r.first_doc_id == r.doc_id)


def test_repeats_within_a_text(spark):
    """Only when asked for: what stands further up stays, later places go."""
    rng = random.Random(12)
    own = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    p, q = own(60), own(60)
    rows = [(1, f"{own(20)} {p} {own(20)} {p} {own(9)}"), (2, f"{own(20)} {p} {own(9)}"), (3, f"{q} {own(9)} {q}"), (4, own(80))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in chunking.repeated_passages(df).collect()} == {1, 2}
    got = chunking.repeated_passages(df, within=True).collect()
    assert {(r.doc_id, r.first_doc_id, r.is_first) for r in got} == {(1, 1, True), (1, 1, False), (2, 1, False), (3, 3, False)}
    clean = {r.doc_id: r.text for r in chunking.without_repeats(df, within=True).collect()}
    inner = lambda t: t[100:-100]
    assert [clean[k].count(inner(p)) for k in (1, 2)] == [1, 0] and clean[3].count(inner(q)) == 1 and clean[4] == rows[3][1]


def test_digests_that_agree_by_half(spark, monkeypatch):
    """Rows of one first half and different second halves are told apart."""
    rng = random.Random(13)
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(4)]
    rows = [*enumerate(texts), (10, texts[0]), (11, texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, chunking.repeated_passages(df).collect()))
    real = chunking.stretch_rows
    monkeypatch.setattr(chunking, "stretch_rows", lambda *a, **k: real(*a, **k).selectExpr("doc_id", "start", "end", "chunk", "chunks", "chunk % 3L AS digest", "digest ^ more AS more", "again"))
    assert sorted(map(tuple, chunking.repeated_passages(df).collect())) == want and {r[0] for r in want} == {0, 2, 10, 11}


def test_columns_of_other_names_stay(spark):
    rows = [(1, "same words " * 30, 7, 8), (2, "same words " * 30, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __spans int, __id int")
    got = chunking.without_repeats(df).orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [(7, 8)] * 2 and got[0].text == rows[0][1] != got[1].text


def test_chance_chunks_are_no_passage(spark):
    """Chunks in a row that other documents hold one by one, or in another order."""
    rng = random.Random(9)
    texts = [" ".join(f"u{rng.randrange(10**9)}" for _ in range(60)) for _ in range(12)]
    which, start, end, _ = chunking.chunks(texts)
    pieces = [[texts[k][a:b] for w, a, b in zip(which, start, end, strict=True) if w == k] for k in range(12)]
    rows = [*enumerate(texts), (50, "".join(p[3] for p in pieces)), (51, "".join(reversed(pieces[0][:12]))), (52, "".join(pieces[1][2:12]))]
    got = chunking.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.is_first, r.n_chunks, r.first_doc_id) for r in got) == [(1, True, 10, 1), (52, False, 10, 1)]


def test_stretches_hold_every_chunk_of_a_long_run():
    rng = random.Random(10)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(10)] + ["", "x" * 500]
    which, start, end, _ = chunking.chunks(texts)
    names = defaultdict(set)
    spans = set()
    for w, a, b, chunk, n, h in zip(*chunking.stretches(texts), strict=True):
        mine = np.flatnonzero(which == w)[chunk : chunk + n]
        assert (start[mine[0]], end[mine[-1]]) == (a, b) and b - a >= chunking.RUN
        names[h.tobytes()].add(tuple(texts[w][start[k] : end[k]] for k in mine))
        spans.add((w, a, b))
    assert all(len(x) == 1 for x in names.values())
    for w in range(len(texts)):
        mine = np.flatnonzero(which == w)
        for x in range(len(mine)):
            for y in range(x, len(mine)):
                a, b = start[mine[x]], end[mine[y]]
                if b - a >= chunking.RUN:
                    inside = [s for s in spans if s[0] == w and a <= s[1] and s[2] <= b]
                    assert all(any(s[1] <= start[k] and end[k] <= s[2] for s in inside) for k in mine[x : y + 1])


# -- tiling


def plain_tiles(a, b, k):
    done_a, done_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not done_a[i + n] and not done_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n and n == best:
                    found.append((i, j))
        if best < k:
            return out
        for i, j in found:
            if not any(done_a[i : i + best]) and not any(done_b[j : j + best]):
                done_a[i : i + best] = done_b[j : j + best] = [True] * best
                out.append((i, j, best))


def test_tiles_are_the_plain_ones():
    rng = random.Random(8)
    for _ in range(400):
        v, k = rng.choice([2, 4, 12]), rng.choice([2, 3, 5])
        a = np.array([rng.randrange(v) for _ in range(rng.randint(0, 22))], np.uint64)
        b = np.array([rng.randrange(v) for _ in range(rng.randint(0, 32))], np.uint64)
        assert sorted(tiling.tiles(a, b, k)) == sorted(plain_tiles(a.tolist(), b.tolist(), k))


def plain_contamination(doc, item, k, coverage):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    a, b = w(item), w(doc)
    got = sum(t[2] for t in plain_tiles(a, b, min(k, len(a)))) if a and b else 0
    return bool(got) and got >= coverage * len(a)


@pytest.mark.parametrize("small", [tiling.SMALL, 0])
def test_contamination_is_brute_force(spark, small, monkeypatch):
    """Whole, upper-case, reordered, partial and short items; also by a join of seeds."""
    monkeypatch.setattr(tiling, "SMALL", small)
    monkeypatch.setattr(tiling, "FILTER", 1 << 12)
    rng = random.Random(9)
    items = [(k, prose(rng, n)) for k, n in enumerate([12, 30, 18, 40])] + [(10, "three words here"), (11, None), (12, ""), (13, "...")]
    docs = [(k, prose(rng, 60)) for k in range(20)]
    for k, (_, t) in enumerate(items[:4]):
        w = t.split()
        docs += [(100 + k, f"{prose(rng, 9)} {t.upper()}! {prose(rng, 9)}"), (200 + k, " ".join([*w[len(w) // 2 :], prose(rng, 7), *w[: len(w) // 2]])), (300 + k, " ".join(w[: len(w) // 3]))]
    docs += [(400, "He said: Three words, here."), (401, "three words"), (402, None), (403, ""), (None, items[0][1]), (100, items[0][1])]
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(d), i) for d, t in docs for i, x in items if plain_contamination(t, x, 5, 0.5))
    got = tiling.contaminated(df, bench, short_items=True).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == want and {i for _, i in want} == {0, 1, 2, 3, 10}
    text = {}
    for k, t in docs:
        text.setdefault(k, []).append(t)
    for r in got:
        assert r.matched_words == sum(len(re.findall(r"[^\W_]+", t[int(a) : int(b)])) for a, b in (s.split(":") for s in r.spans.split(",")) for t in text[r.doc_id][:1]) or len(text[r.doc_id]) > 1
    for short in (True, False):
        some = [x for _, x in items if x and (short or len(x.split()) > 4)]
        kept = tiling.decontaminated(df, bench, short_items=short).collect()
        assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for d, t in docs if not any(plain_contamination(t, x, 5, 0.5) for x in some))
    assert sorted((str(r.doc_id), r.item_id) for r in tiling.contaminated(df, bench).collect()) == [x for x in want if x[1] != 10]
    assert {r.item_id: r.n_words for r in tiling.skipped_items(bench).collect()} == {10: 3, 11: 0, 12: 0, 13: 0}
    assert tiling.contaminated(df, bench.limit(0)).count() == 0 and tiling.contaminated(df.limit(0), bench).count() == 0
    assert tiling.decontaminated(df, bench.limit(0)).count() == len(docs)


def test_null_and_short_items_alone(spark, monkeypatch):
    """They are counted out before anything is gathered, and no document goes for a word."""
    df = spark.createDataFrame([(1, "alpha1 " * 3000), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, None) for k in range(50)] + [(99, "alpha1"), (100, "")], "item_id long, text string")
    for small in (tiling.SMALL, 0):
        monkeypatch.setattr(tiling, "SMALL", small)
        assert tiling.contaminated(df, bench).count() == 0 and tiling.decontaminated(df, bench).count() == 2
    nulls = bench.where("text IS NULL")
    assert tiling._small(nulls, 5, True, "item_id", "text").items == []


def test_words_that_repeat_take_little_memory():
    """A text and an item of one word, and of two in turn."""
    import tracemalloc

    block = tiling.block_of([(1, "same " * 1000), (2, "one two " * 300), (3, "other words that are not there at all")], 5)
    tracemalloc.start()
    for text in ("same " * 20_000, "one two " * 8_000):
        found = tiling.matches(text, block, 5, 0.5)
        assert [(m["item"], m["matched"] == m["words"]) for m in found] == [(0 if "same" in text else 1, True)]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


@pytest.mark.parametrize("part", [minhash.PART, 2])
def test_frequent_shingles_are_split(spark, monkeypatch, part):
    """Every bucket through the prefix filter, frequent shingles dealt in parts; tables between the steps go."""
    from spanloom.runtime import shared_dir

    monkeypatch.setattr(minhash, "LIGHT", 0)
    monkeypatch.setattr(minhash, "PART", part)
    rng = random.Random(14)
    base = prose(rng, 30)
    rows = [(k, edited(rng, base, rng.randint(1, 9))) for k in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()}
    assert got == brute_links(rows, 2, 80)
    import pathlib

    left = {p.name.rsplit("-", 1)[0] for p in pathlib.Path(shared_dir(spark).removeprefix("file://"), spark.sparkContext.applicationId).glob("minhash-*")}
    assert left <= {"minhash-sketch"}


def test_repeats_of_ids_with_several_texts(spark):
    """A text isn't cut by the offsets of another text of its id; rows of one id and text stay both."""
    rng = random.Random(21)
    one, other, third = prose(rng, 120), prose(rng, 120), prose(rng, 90)
    rows = [(1, one), (2, other), (2, one), (3, third + " " + one), (3, third + " " + one), (4, None), (None, one)]
    df = spark.createDataFrame([(k, t, j) for j, (k, t) in enumerate(rows)], "doc_id long, text string, start int").coalesce(1)
    got = {r.start: r.text for r in chunking.without_repeats(df).collect()}
    assert len(got) == len(rows) and [got[k] for k in (0, 1, 5, 6)] == [one, other, None, one]
    assert len(got[2]) < 100 and len(got[3]) < len(third) + 100 and got[3].startswith(third[:-100]) and got[3] == got[4]
