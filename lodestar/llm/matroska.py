"""Matroska: EBML elements, clusters, lacing and cues as packet tables; 8-bit PCM tracks."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import mapped, saved

# Fixed values of the Matroska and EBML specifications: element ids.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = (
    0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383)
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements of the segment's top level: one of them ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE = 8000
FRAME = 512  # samples in a frame
LACED = 8  # frames in a block
CLUSTER_SAMPLES = 32768 - FRAME * LACED  # relative times are signed 16-bit
PAD = 64


# --- writing -------------------------------------------------------------------------

def _size(n: int) -> bytes:
    """``n`` as the shortest EBML size; all ones is kept for unknown sizes."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def number(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, time: int, frames: list[bytes], lacing: str | None = None) -> bytes:
    """A SimpleBlock. lacing: none, xiph, fixed or ebml; by default fixed for equal sizes, else EBML."""
    sizes = [len(f) for f in frames]
    if lacing is None:
        lacing = "none" if len(frames) == 1 else "fixed" if len(set(sizes)) == 1 else "ebml"
    kind = ("none", "xiph", "fixed", "ebml").index(lacing)
    head = _size(track) + struct.pack(">hB", time, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == "ebml":
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            d, k = b - a, 1
            while abs(d) > (1 << 7 * k - 1) - 1:
                k += 1
            head += (d + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return element(SIMPLE_BLOCK, head + b"".join(frames))


_HEAD = element(EBML, b"".join([
    number(EBML_VERSION, 1), number(EBML_READ_VERSION, 1), number(EBML_MAX_ID, 4), number(EBML_MAX_SIZE, 8),
    element(DOC_TYPE, b"matroska"), number(DOC_TYPE_VERSION, 4), number(DOC_TYPE_READ_VERSION, 2),
]))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, b"".join([
    number(TRACK_NUMBER, 1), number(TRACK_UID, 1), number(TRACK_TYPE, 2), number(FLAG_LACING, 1),
    number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE), element(CODEC_ID, b"A_PCM/INT/LIT"),
    element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8)),
])))


def mux(samples: bytes) -> bytes:
    """A Matroska file with ``samples`` as one track of unsigned 8-bit PCM, cued by cluster.

    A tick is one sample. It depends on the samples alone: equal payloads, equal files.
    """
    info = element(INFO, b"".join([
        number(TIMESTAMP_SCALE, 1_000_000_000 // RATE), element(DURATION, struct.pack(">d", len(samples))),
        element(MUXING_APP, b"lodestar"), element(WRITING_APP, b"lodestar"),
    ]))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for start in range(0, len(samples), CLUSTER_SAMPLES):
        body = [number(TIMESTAMP, start)]
        stop = min(start + CLUSTER_SAMPLES, len(samples))
        for b in range(start, stop, FRAME * LACED):
            frames = [samples[f: min(f + FRAME, stop)] for f in range(b, min(b + FRAME * LACED, stop), FRAME)]
            body.append(block(1, b - start, frames))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(
            CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


# --- reading -------------------------------------------------------------------------

def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, next position and whether all value bits are ones. keep: with the marker, as ids are."""
    k = 9 - data[at].bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    v = int.from_bytes(data[at: at + k], "big")
    low = v & ((1 << 7 * k) - 1)
    return (v if keep else low), at + k, low == (1 << 7 * k) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of each element's body. One of unknown size runs to ``end``
    or, as a cluster, to the next element of the segment's top level."""
    while at < end:
        name, at, _ = _vint(data, at, keep=True)
        n, at, unknown = _vint(data, at)
        stop = min(at + n, end)
        if unknown:
            stop = end
            if name == CLUSTER:
                inner = at
                while inner < end:
                    k, body, _ = _vint(data, inner, keep=True)
                    if k in TOP:
                        stop = inner
                        break
                    size, body, _ = _vint(data, body)
                    inner = body + size
        yield name, at, stop
        at = stop


def _laces(data: bytes, at: int, end: int) -> tuple[int, int, bool, str, list[int], int]:
    """Track, relative time, key flag, lacing, frame sizes and first frame's byte of a block."""
    track, at, _ = _vint(data, at)
    time, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, time, bool(flags & 0x80), "none", [end - at], at
    n = data[at] + 1
    at += 1
    if kind == 2:
        return track, time, bool(flags & 0x80), "fixed", [(end - at) // n] * n, at
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            s = 0
            while data[at] == 255:
                s, at = s + 255, at + 1
            sizes.append(s + data[at])
            at += 1
    else:
        for i in range(n - 1):
            before = at
            v, at, _ = _vint(data, at)
            sizes.append(v if not i else sizes[-1] + v - ((1 << 7 * (at - before) - 1) - 1))
    sizes.append(end - at - sum(sizes))
    return track, time, bool(flags & 0x80), ("", "xiph", "", "ebml")[kind], sizes, at


def packets(data: bytes) -> list[tuple[int, int, bool, int, int, str, int]]:
    """The packet table: (track, timestamp in ticks, key, first byte, bytes, lacing, cluster's byte).

    A laced frame's timestamp adds the track's default duration per earlier frame.
    """
    rows, scale, spans = [], 1_000_000, {}
    for name, a, b in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        for kind, c, d in elements(data, a, b):
            if kind == INFO:
                scale = next((int.from_bytes(data[x:y], "big") for k, x, y in elements(data, c, d) if k == TIMESTAMP_SCALE), scale)
            elif kind == TRACKS:
                for _, x, y in elements(data, c, d):
                    entry = {k: int.from_bytes(data[p:q], "big") for k, p, q in elements(data, x, y) if k in (TRACK_NUMBER, DEFAULT_DURATION)}
                    spans[entry.get(TRACK_NUMBER)] = entry.get(DEFAULT_DURATION, 0)
            elif kind == CLUSTER:
                base = 0
                for k, x, y in elements(data, c, d):
                    key = True
                    if k == TIMESTAMP:
                        base = int.from_bytes(data[x:y], "big")
                        continue
                    if k == BLOCK_GROUP:
                        inner = {n: (p, q) for n, p, q in elements(data, x, y)}
                        key = REFERENCE_BLOCK not in inner
                        if BLOCK not in inner:
                            continue
                        x, y = inner[BLOCK]
                    elif k != SIMPLE_BLOCK:
                        continue
                    track, time, flag, lacing, sizes, at = _laces(data, x, y)
                    step = spans.get(track, 0) // scale
                    for i, n in enumerate(sizes):
                        rows.append((track, base + time + i * step, flag if k == SIMPLE_BLOCK else key, at, n, lacing, c))
                        at += n
    return rows


def cues(data: bytes) -> list[tuple[int, int, int]]:
    """(time, track, first byte of the cluster element) of each cue."""
    out = []
    for name, a, b in elements(data, 0, len(data)):
        if name == SEGMENT:
            for kind, c, d in elements(data, a, b):
                for point, x, y in elements(data, c, d) if kind == CUES else ():
                    time = next((int.from_bytes(data[p:q], "big") for k, p, q in elements(data, x, y) if k == CUE_TIME), 0)
                    for k, p, q in elements(data, x, y):
                        if k == CUE_TRACK_POSITIONS:
                            at = {n: int.from_bytes(data[u:v], "big") for n, u, v in elements(data, p, q)}
                            out.append((time, at[CUE_TRACK], a + at[CUE_CLUSTER_POSITION]))
    return out


def track_bytes(data: bytes, track: int = 1) -> bytes:
    """The frames of ``track`` put together."""
    return b"".join(data[r[3]: r[3] + r[4]] for r in packets(data) if r[0] == track)


# --- operators -----------------------------------------------------------------------

#: Bytes of media in one output batch, beyond which a batch is passed on.
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[dict], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if weight > BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and bytes filled up with zeros to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (PAD - len(raw) if len(raw) < PAD else -len(raw) % PAD)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text as the samples of a Matroska file.

    A null text is an empty one: 64 zero samples. A file is as large as its text and a
    few bytes per 512 samples, and only one batch of them is in memory.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def write(batches):
        def rows():
            for b in batches:
                for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"]):
                    n, samples = payload(text.as_py())
                    yield {"doc_id": doc_id, "n_bytes": n, "media": mux(samples)}
        yield from _batches(rows(), schema, lambda r: len(r["media"]))

    return mapped(docs.select("doc_id", "text"), write, "doc_id long, n_bytes long, media binary")


PACKETS = "track int, timestamp long, keyframe boolean, byte_start long, n_bytes long, lacing string, cluster_start long"


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of each file: track, timestamp, byte range, lacing, cluster. Null media: no rows."""
    names = [p.split()[0] for p in PACKETS.split(", ")]
    schema = pa.schema([(key, pa.int64()), ("track", pa.int32()), ("timestamp", pa.int64()), ("keyframe", pa.bool_()),
                        ("byte_start", pa.int64()), ("n_bytes", pa.int64()), ("lacing", pa.string()), ("cluster_start", pa.int64())])

    def read(batches):
        def rows():
            for b in batches:
                for k, m in zip(b[key].to_pylist(), b[column]):
                    for p in packets(m.as_py()) if m.is_valid else ():
                        yield {key: k, **dict(zip(names, p))}
        yield from _batches(rows(), schema, lambda r: 64)

    return mapped(media.select(key, column), read, f"{key} long, {PACKETS}")


def features(table: list[tuple], n_cues: int, samples: bytes) -> str:
    """Counts of the packet table and statistics of the samples, as JSON of integers."""
    v = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    return json.dumps({
        "packets": len(table), "clusters": len({p[6] for p in table}), "cues": n_cues,
        "laced": sum(p[5] != "none" for p in table), "ticks": max((p[1] + p[4] for p in table), default=0),
        "min": int(v.min(initial=255)), "max": int(v.max(initial=0)), "sum": int(v.sum()), "energy": int((v * v).sum()),
        "crossings": int(np.count_nonzero(np.diff(v >= 128))), "steps": int(np.abs(np.diff(v)).sum()),
    }, separators=(",", ":"))


def media_features(media: DataFrame) -> DataFrame:
    """Parses each stored file and computes payload digests and features from what it holds.

    A null file gives nulls but for doc_id and n_bytes. One that is cut off or damaged is an
    error that stops the job: what it held is lost, and no row would say so.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def read(batches):
        def rows():
            for b in batches:
                for doc_id, n, m in zip(b["doc_id"].to_pylist(), b["n_bytes"].to_pylist(), b["media"]):
                    data = m.as_py()
                    if data is None:
                        yield dict.fromkeys(names) | {"doc_id": doc_id, "n_bytes": n}
                        continue
                    table = packets(data)
                    samples = b"".join(data[p[3]: p[3] + p[4]] for p in table)
                    yield dict(zip(names, (
                        doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-PAD:]),
                        len(data), hashlib.sha256(data).hexdigest(), features(table, len(cues(data)), samples),
                    )))
        yield from _batches(rows(), pa.schema(list(zip(names, kinds))), lambda r: 500)

    return mapped(
        media, read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """Every document's text through a stored Matroska file and back.

    The files are binary values of a Parquet table in the shared folder, which is read
    again. A null text is an empty one; equal texts give equal values; a null doc_id stays
    null; repeated rows come back each. No rows: no rows.
    """
    return media_features(saved(with_media(docs)))
