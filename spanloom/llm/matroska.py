"""Media columns: Matroska files as binary columns, with a packet table.

``mux`` stores a payload as 8-bit PCM samples of one audio track: EBML header, one segment of info,
tracks, clusters of SimpleBlocks with laced frames, and cues. ``packets`` parses any Matroska file
made of EBML elements with known or unknown sizes: clusters, SimpleBlocks and BlockGroups, all four
kinds of lacing, and cues; each frame becomes a packet with track, timestamp and byte range, so the
payload can be read again by range without parsing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.arrow import batch_of, columns, map_batches, text_of
from spanloom.runtime import written

# Fixed values of the public Matroska and EBML formats: element ids.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
AUDIO_TRACK, PCM = 2, b"A_PCM/INT/LIT"
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

SAMPLE_RATE, FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8000, 512, 8, 64
#: What a segment consists of: any of these ends a cluster of unknown size; a new file ends a segment of one.
_TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, CHAPTERS, TAGS, ATTACHMENTS}
_ENDS = {CLUSTER: _TOP | {EBML, SEGMENT}, SEGMENT: {EBML, SEGMENT}}
_PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}


# -- writing --------------------------------------------------------------------------------------


def vint(n: int, width: int = 0) -> bytes:
    """A variable-length size: the number of leading zero bits tells the width."""
    w = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * w).to_bytes(w, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(ident: int, x: float) -> bytes:
    return element(ident, np.float64(x).astype(">f8").tobytes())


def lace(frames: list[bytes], kind: int) -> bytes:
    """Block payload of several frames."""
    if kind == NO_LACING:
        return frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            w = next(w for w in range(1, 9) if abs(b - a) < 1 << (7 * w - 1))
            head += vint(b - a + (1 << (7 * w - 1)) - 1, w)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def mux(payload: bytes, *, frame: int = FRAME, per_block: int = FRAMES_PER_BLOCK, per_cluster: int = BLOCKS_PER_CLUSTER) -> bytes:
    """A Matroska file whose one PCM track holds ``payload``, a byte a sample."""
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    ms = lambda at: at * 1000 // SAMPLE_RATE
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / SAMPLE_RATE) + element(MUXING_APP, b"spanloom") + element(WRITING_APP, b"spanloom"))
    audio = element(AUDIO, real(RATE, SAMPLE_RATE) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, AUDIO_TRACK) + uint(FLAG_LACING, 1) + element(CODEC_ID, PCM) + audio))
    body, at, cues = [info, tracks], len(info) + len(tracks), []
    block, cluster = frame * per_block, frame * per_block * per_cluster
    for c in range(0, max(len(payload), 1), cluster):
        blocks = [uint(TIMESTAMP, ms(c))]
        for b in range(c, min(c + cluster, len(payload)), block):
            data = payload[b : b + block]
            frames = [data[k : k + frame] for k in range(0, len(data), frame)]
            kind = NO_LACING if len(frames) == 1 else FIXED if len(data) % frame == 0 else EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1) + (ms(b) - ms(c)).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace(frames, kind)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ms(c)) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


# -- reading --------------------------------------------------------------------------------------


@dataclass
class Packet:
    track: int
    timestamp: int  # of its block, in units of the timestamp scale
    start: int
    end: int
    lace: int
    keyframe: bool


class Damaged(ValueError):
    pass


def _vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, next place, whether the size is unknown (all ones)."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no variable-length number at {at}")
    w = 9 - data[at].bit_length()
    if at + w > len(data):
        raise Damaged(f"cut off at {at}")
    n = int.from_bytes(data[at : at + w], "big")
    if keep_marker:
        return n, at + w, False
    n &= (1 << 7 * w) - 1
    return n, at + w, n == (1 << 7 * w) - 1


def elements(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the bodies of elements in a row; an unknown size reaches to the end."""
    end = len(data) if end is None else end
    while at < end:
        ident, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at)
        stop = end if unknown else at + size
        if stop > end:
            raise Damaged(f"element {ident:#x} at {at} is cut off")
        if unknown and ident in _ENDS:  # ends where the next one of its level begins
            stop = _stop(data, at, end, _ENDS[ident])
        yield ident, at, stop
        at = stop


def _stop(data: bytes, at: int, end: int, ends: set[int]) -> int:
    """Where the first element of these ids begins, in a row of elements; an unknown size within goes by its own rule."""
    while at < end:
        begin = at
        ident, at, _ = _vint(data, at, True)
        if ident in ends:
            return begin
        size, at, unknown = _vint(data, at)
        at = (_stop(data, at, end, _ENDS[ident]) if ident in _ENDS else end) if unknown else at + size
    return end


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, at: int, end: int, cluster_time: int) -> list[Packet]:
    track, at, _ = _vint(data, at)
    if at + 3 > end:
        raise Damaged("block header is cut off")
    time, flags, at = cluster_time + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], at + 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        sizes = [end - at]
    else:
        n, at = data[at] + 1, at + 1
        if kind == FIXED:
            if (end - at) % n:
                raise Damaged("fixed lacing doesn't divide the block")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if kind == XIPH:
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    size, at = size + data[at], at + 1
                else:
                    before = at
                    size, at, _ = _vint(data, at)
                    if k:
                        size += sizes[-1] - (1 << (7 * (at - before) - 1)) + 1
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("lacing exceeds the block")
    out = []
    for k, n in enumerate(sizes):
        out.append(Packet(track, time, at, at + n, k, bool(flags & 0x80)))
        at += n
    return out


def packets(data: bytes) -> tuple[list[Packet], dict]:
    """All frames of a file in order, and what else it says: scale, doc type, tracks, cues."""
    found: list[Packet] = []
    about: dict = {"scale": 1_000_000, "doc_type": "", "tracks": [], "cues": [], "segment": 0, "clusters": []}

    def walk(at: int, end: int, parent: int, clock: list[int], cue: dict) -> None:
        begin = at
        for ident, a, b in elements(data, at, end):
            if ident == SEGMENT:
                about["segment"] = a
            if ident == CLUSTER:
                about["clusters"].append(begin - about["segment"])
                walk(a, b, ident, [0], cue)
            elif ident in _PARENTS:
                inner = {} if ident == CUE_POINT else cue
                if ident == TRACK:
                    about["tracks"].append({})
                walk(a, b, ident, clock, inner)
                if ident == CUE_POINT:
                    about["cues"].append((inner.get(CUE_TIME, 0), inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER, 0)))
            elif ident == TIMESTAMP:
                clock[0] = _number(data, a, b)
            elif ident in (SIMPLE_BLOCK, BLOCK):
                found.extend(_frames(data, a, b, clock[0]))
            elif ident == TIMESTAMP_SCALE:
                about["scale"] = _number(data, a, b)
            elif ident == DOC_TYPE:
                about["doc_type"] = data[a:b].decode("ascii", "replace")
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                cue[ident] = _number(data, a, b)
            elif ident == CODEC_ID and about["tracks"]:
                about["tracks"][-1]["codec"] = data[a:b].decode("ascii", "replace")
            elif ident == TRACK_NUMBER and about["tracks"]:
                about["tracks"][-1]["number"] = _number(data, a, b)
            elif ident == BIT_DEPTH and about["tracks"]:
                about["tracks"][-1]["bits"] = _number(data, a, b)
            begin = b

    walk(0, len(data), 0, [0], {})
    return found, about


def demux(data: bytes, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.end] for p in packets(data)[0] if p.track == track)


def feature(samples: bytes, found: list[Packet], about: dict) -> str:
    """Whole-number features of the samples read back: level, energy, zero crossings, shape of the file."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    good = about["clusters"] == [c[2] for c in about["cues"]]
    return f"samples={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};min={int(x.min())};max={int(x.max())};crossings={crossings};packets={len(found)};clusters={len(about['clusters'])};cues={'match' if good else 'differ'};codec={about['tracks'][0]['codec']}"


# -- Spark ----------------------------------------------------------------------------------------


#: Bytes of files that a batch holds, about.
_BATCH = 4 << 20


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media binary: each text as UTF-8, zero bytes up to a positive multiple of 64, as a file.

    The table is written to the shared folder and read again. Null and empty texts give 64 zero bytes;
    repeated rows and null ids stay; an empty table gives no rows; other columns aren't read. A long
    text is one cell; batches are cut by bytes.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            size = 0
            for key, text in zip(*columns(b, "doc_id", "text"), strict=True):
                raw = text.encode()
                rows.append((key, len(raw), mux(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))))
                size += len(rows[-1][2])
                if size >= _BATCH:
                    yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
                    rows, size = [], 0
            if rows:
                yield batch_of(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return written(docs.sparkSession, map_batches(rows, run, "doc_id long, n_bytes long, media binary"), "media")


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet: id, packet number, track, timestamp (ns), byte range, lace, keyframe.

    Null or damaged files give no packets but one row with ``error``.
    """
    names = ["doc_id", "packet", "track", "timestamp_ns", "start", "end", "lace", "keyframe", "error"]
    kinds = [pa.int64()] * 7 + [pa.bool_(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(*columns(b, "doc_id", "media"), strict=True):
                try:
                    found, about = packets(data or b"")
                    error = None if found else "no packets"
                except (Damaged, IndexError) as e:
                    found, about, error = [], {"scale": 1}, str(e) or "cut off"
                if error:
                    yield pa.RecordBatch.from_pylist([{"doc_id": key, "error": error}], schema)
                else:
                    yield batch_of(schema, doc_id=[key] * len(found), packet=list(range(len(found))), track=[p.track for p in found], timestamp_ns=[p.timestamp * about["scale"] for p in found], start=[p.start for p in found], end=[p.end for p in found], lace=[p.lace for p in found], keyframe=[p.keyframe for p in found], error=[None] * len(found))

    return map_batches(media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")), run, "doc_id long, packet long, track long, timestamp_ns long, start long, end long, lace long, keyframe boolean, error string")


def media_features(media: DataFrame) -> DataFrame:
    """Read each stored file back: digests of payload and file, and the features.

    For columns doc_id, n_bytes, media as ``store_texts`` makes them. Equal files give equal values;
    repeated rows stay; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for key, n, data in zip(*columns(b, "doc_id", "n_bytes", "media"), strict=True):
                found, about = packets(data)
                payload = b"".join([data[p.start : p.end] for p in found])
                for col, v in zip(rows, (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload, found, about)), strict=True):
                    col.append(v)
            yield batch_of(schema, **dict(zip(names, rows, strict=True)))

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
