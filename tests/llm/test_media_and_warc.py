"""Matroska and WARC."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from spanloom.llm import matroska as mk
from spanloom.llm import warc


@pytest.mark.parametrize("size", [64, 448, 512, 4096, 4160, 5000, 300_000])
def test_payload_comes_back(size):
    payload = random.Random(size).randbytes(size)
    data = mk.mux(payload)
    found, about = mk.packets(data)
    assert mk.demux(data) == payload == b"".join(data[p.start : p.end] for p in found)
    assert about["doc_type"] == "matroska" and about["tracks"] == [{"number": 1, "codec": "A_PCM/INT/LIT", "bits": 8}]
    assert about["clusters"] == [c[2] for c in about["cues"]] and len(about["clusters"]) == -(-size // (512 * 8 * 64))
    assert [p.timestamp for p in found] == sorted(p.timestamp for p in found)
    for p in (0, size // 2, size - 1):  # cues lead to the cluster of a time
        assert mk.SAMPLE_RATE * found[min(p // 512, len(found) - 1)].timestamp // 1000 <= p


@pytest.mark.parametrize("kind", [mk.XIPH, mk.FIXED, mk.EBML_LACING])
def test_lacing(kind):
    rng = random.Random(kind)
    for _ in range(50):
        n = rng.randint(2, 9)
        frames = [rng.randbytes(7)] * n if kind == mk.FIXED else [rng.randbytes(rng.choice([0, 1, 5, 254, 255, 256, 700, 20000])) for _ in range(n)]
        block = mk.element(mk.SIMPLE_BLOCK, mk.vint(300) + (-5).to_bytes(2, "big", signed=True) + bytes([kind << 1]) + mk.lace(frames, kind))
        group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.vint(2) + b"\0\0\0" + b"z"))
        data = mk.element(mk.SEGMENT, mk.element(mk.CLUSTER, mk.uint(mk.TIMESTAMP, 100) + block + group))
        found, _ = mk.packets(data)
        assert [data[p.start : p.end] for p in found] == [*frames, b"z"]
        assert {p.track for p in found[:-1]} == {300} and found[0].timestamp == 95 and not found[0].keyframe


def test_unknown_sizes():
    cluster = lambda t, x: mk.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + mk.uint(mk.TIMESTAMP, t) + mk.element(mk.SIMPLE_BLOCK, mk.vint(1) + b"\0\0\x80" + x)
    data = mk.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster(1, b"ab") + cluster(9, b"cd")
    found, about = mk.packets(data)
    assert [(p.timestamp, data[p.start : p.end]) for p in found] == [(1, b"ab"), (9, b"cd")] and len(about["clusters"]) == 2
    other = [mk.element(x, b"not to be read") for x in (mk.TAGS, mk.SEEK_HEAD, mk.CHAPTERS, mk.ATTACHMENTS)]
    for x in (*other, mk.element(mk.CUES, b"")):  # each ends a cluster
        found, about = mk.packets(mk.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster(1, b"ab") + x + cluster(9, b"cd") + x)
        assert len(found) == 2 and len(about["clusters"]) == 2 and about["clusters"][1] - about["clusters"][0] == len(cluster(1, b"ab") + x)
    found, about = mk.packets(data + mk.mux(b"z" * 64))  # another file ends the segment
    assert len(found) == 3 and about["doc_type"] == "matroska"


def test_variable_length_numbers():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**48):
        b = mk.vint(n)
        assert mk._vint(b, 0) == (n, len(b), False)
    assert mk._vint(b"\xff", 0)[2]
    for bad in (b"", b"\0", b"\x40"):
        with pytest.raises(mk.Damaged):
            mk._vint(bad, 0)


def test_media_columns(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (2, "hello"), (None, "é" * 5000), (4, "x" * 64)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, media int")
    media = mk.store_texts(df).cache()
    got = mk.media_features(media).collect()
    assert len(got) == len(rows)
    files = {r.doc_id: r.media for r in media.collect()}
    got.sort(key=lambda r: (str(r.doc_id), r.n_bytes))
    for r, (key, t) in zip(got, sorted(rows, key=lambda r: (str(r[0]), len((r[1] or "").encode()))), strict=True):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (key, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        if key != 2:
            assert (r.media_bytes, r.media_sha256) == (len(files[key]), hashlib.sha256(files[key]).hexdigest())
        x = np.frombuffer(padded, np.uint8).astype(int) - 128
        assert f"sum={x.sum()};energy={(x * x).sum()};" in r.feature and "cues=match" in r.feature
    assert len({r.media_sha256 for r in got if r.n_bytes == 5}) == 1 == len({r.media_sha256 for r in got if r.n_bytes == 0}) and len({r.media_sha256 for r in got}) == 4
    table = mk.packet_table(media.union(spark.createDataFrame([(8, 0, bytearray(b"junk")), (9, 0, None)], media.schema))).collect()
    assert {r.doc_id: r.error for r in table if r.error}.keys() == {8, 9}
    one = [r for r in table if r.doc_id == 1]
    assert b"".join(files[1][r.start : r.end] for r in one) == b"hello" + bytes(59) and one[0].timestamp_ns == 0
    assert mk.media_features(media.limit(0)).count() == 0


# -- WARC


def archive(*records):
    return b"".join(warc.member(r) for r in records)


def test_reader_frames_and_digests():
    payload = random.Random(1).randbytes(300_000)
    digest = warc.sha1_base32(payload)
    info = warc.record([("WARC-Type", "warcinfo")], b"software: x\r\n")
    data = archive(info, warc.response("7", "http://a/\r\nX: y", payload, digest), warc.revisit("8", "http://b/", len(payload), digest, "7"))
    got = list(warc.read_records(io.BytesIO(data)))
    assert [r.headers["warc-type"] for r in got] == ["warcinfo", "response", "revisit"]
    assert got[1].payload == payload and got[1].headers["warc-target-uri"] == "http://a/ X: y" and got[0].http == {}
    assert got[2].payload == b"" and got[2].http["content-length"] == "300000" and got[2].headers["warc-refers-to"] == "<urn:page:7>"
    # Each record is a member of its own: reading can start at its offset.
    again = next(warc.read_records(io.BytesIO(data[got[2].offset :])))
    assert again.headers == got[2].headers
    assert digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_damaged_archives():
    good = warc.response("1", "u", b"abc", warc.sha1_base32(b"abc"))
    cases = [archive(good)[:-12], archive(good.replace(b"abc", b"abd")), archive(good[:-1]), archive(b"junk\r\n\r\n"), archive(good[:30]), archive(good.replace(b"\r\n\r\nabc", b"\r\n\r\n"))]
    for data in cases:
        with pytest.raises(warc.BadArchive):
            list(warc.read_records(io.BytesIO(data)))
    assert list(warc.read_records(io.BytesIO(b""))) == []


@pytest.mark.parametrize(("least", "size", "few"), [(0, 1, 0), (4, 1 << 20, 1 << 10)])
def test_archives(spark, least, size, few, monkeypatch):
    monkeypatch.setattr(warc, "REPEATED", few)
    rows = [(5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "http://c/", "é"), (6, "x", None), (7, "y", ""), (8, "http://d/", "é"), (10, "z", "own" * 10_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, first int").repartition(3)
    got = {r.page_id: r for r in warc.archive_pages(df, min_revisit_bytes=least, archive=size).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        raw = (html or "").encode()
        equal = [k for k, _, h in rows if (h or "").encode() == raw]
        first = min(equal) if len(raw) >= least else key
        r = got[key]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if key == first else ("revisit", first)), key


def test_archives_with_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "v", "b")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.archive_pages(df).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]
    assert warc.archive_pages(df.limit(0)).count() == 0
