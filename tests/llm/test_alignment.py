"""Alignment of tokenizers, held against whole texts and all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from spanloom.llm import alignment as al
from spanloom.llm.bpe import tokenizer_path
from spanloom.runtime import table

PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "日本", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "'s", "!", "  \n ", "\xa0", "　", "x1", "🙂", "\x1c", "\x85", "ｆ", "the", "ing", "\0", "\r\n", "don't", "  word"]


@pytest.fixture(scope="module")
def tok():
    return al.tokenizers(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def spans(sizes):
    at = 0
    for n in sizes:
        yield at, at + n
        at += n


def brute(tok, text):
    """Numbers, links and groups of a whole text, every A token compared with every B token."""
    none = [0, 0, 0, 0], [], ""
    if not text:
        return none
    raw = (" " + text).encode()
    a, b = tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)
    if b"".join(tok.bytes_a[i] for i in a) != raw or b"".join(tok.bytes_b[i] for i in b) != raw:
        return none
    at_a, at_b = list(spans(len(tok.bytes_a[i]) for i in a)), list(spans(len(tok.bytes_b[i]) for i in b))
    links = [(x, y) for x, (p, q) in zip(a, at_a, strict=True) for y, (r, s) in zip(b, at_b, strict=True) if p < s and r < q]
    groups, at = [], 0
    for end in sorted({q for _, q in at_a} & {s for _, s in at_b}):
        side = lambda ids, where, at=at, end=end: ",".join(str(i) for i, (p, q) in zip(ids, where, strict=True) if at <= p and q <= end)
        groups.append(f"{side(a, at_a)}|{side(b, at_b)}")
        at = end
    return [len(a), len(b), len(groups), len(links)], links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(tok, rows):
    each = [(key, *brute(tok, text)) for key, text in rows]
    docs = Counter(pair for _, _, links, _ in each for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return sorted(((key, *numbers, sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest) for key, numbers, links, digest in each), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts():
    r = random.Random(3)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(300)]


ROWS = [*enumerate(texts()), (300, None), (301, ""), (302, "a▁b"), (303, " "), (304, "  two  "), (305, "x" * 5000), (1, "the same id"), (None, "no id"), (306, "the same id"), (307, "the same id")]


@pytest.mark.parametrize("most_pairs", [al.PAIRS, 5])
def test_align_as_brute_force(spark, tok, most_pairs):
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in ROWS], "doc_id long, text string, n_a int, pair string").repartition(5)
    out = al.align(docs, most_pairs=most_pairs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(out) == expected(tok, ROWS)


def test_query_as_brute_force(spark, tok):
    from spanloom.llm.queries import queries

    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents").collect()
    got = {r.doc_id: r for r in queries()["op11_token_alignment"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in docs:
        if len(r.text or "") < 1500:
            numbers, _, digest = brute(tok, r.text)
            assert [*got[r.doc_id][1:5]] == numbers and got[r.doc_id].groups_sha256 == digest


def test_long_texts_and_a_table_that_starts_anew(tok, monkeypatch):
    text = " ".join(texts() * 3)
    numbers, pairs, digest = al.Aligner(tok)._whole(text)
    for block, units in ((al.BLOCK, al.UNITS), (7, 20), (1000, 3)):
        monkeypatch.setattr(al, "BLOCK", block)
        monkeypatch.setattr(al, "UNITS", units)
        aligner = al.Aligner(tok)
        for got in (aligner._long(text), *aligner.align([text, text])):
            assert (got[0] == numbers).all() and (got[1] == pairs).all() and got[2] == digest


def test_empty_table_and_groups(spark, tok):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert al.align(empty).collect() == [] and al.aligned_groups(empty).collect() == []
    docs = spark.createDataFrame([(1, "Some words, alignéd."), (2, None), (3, "a▁b")], "doc_id long, text string")
    rows = al.aligned_groups(docs).orderBy("group").collect()
    text = ";".join(f"{','.join(map(str, r.a))}|{','.join(map(str, r.b))}" for r in rows)
    assert {r.doc_id for r in rows} == {1} and hashlib.sha256(text.encode()).hexdigest() == brute(tok, "Some words, alignéd.")[2]
