"""Matroska columns: EBML elements, clusters, lacing and cues, as packet tables.

`mux` stores a payload as 8-bit PCM in SimpleBlocks; `parse` reads any Matroska file with
SimpleBlocks or BlockGroups, all four lacings and elements of unknown size, and gives a row
per packet: track, timestamp (in units of the file's scale), offset and size in the file.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

# EBML and Matroska element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ, EBML_ID_SIZE, EBML_SIZE_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, MUXING_APP, WRITING_APP, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4D80, 0x5741, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, BLOCK_GROUP, INFO, TRACKS, TRACK_ENTRY, AUDIO, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES}

RATE = 8000
FRAME, LACED, BLOCKS = 2048, 4, 3  # samples a frame, frames a block, blocks a cluster


def vint(n: int, size: int = 0) -> bytes:
    size = size or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: str = "auto") -> bytes:
    """Body of a SimpleBlock; lacing: none, xiph, fixed, ebml, or auto."""
    sizes = [len(f) for f in frames]
    if lacing == "auto":
        lacing = "none" if len(frames) == 1 else "fixed" if len(set(sizes)) == 1 else "ebml"
    kind = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}[lacing]
    head = vint(track) + struct.pack(">hB", relative, 0x80 | kind << 1)
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            k = next(k for k in range(1, 9) if abs(b - a) < 1 << 7 * k - 1)
            head += vint(b - a + (1 << 7 * k - 1) - 1, k)
    return head + b"".join(frames)


def mux(payload: bytes, lacing: str = "auto") -> bytes:
    header = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_ID_SIZE, 4) + uint(EBML_SIZE_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
    audio = element(AUDIO, element(FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    body = [
        element(INFO, uint(SCALE, 10**9 // RATE) + element(MUXING_APP, b"tessella") + element(WRITING_APP, b"tessella")),
        element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)),
    ]
    at, cues, span = len(body[0]) + len(body[1]), [], FRAME * LACED
    for start in range(0, len(payload), span * BLOCKS):
        blocks = [uint(TIMESTAMP, start)]
        for k in range(start, min(start + span * BLOCKS, len(payload)), span):
            part = payload[k : min(k + span, len(payload))]
            blocks.append(element(SIMPLE_BLOCK, block(1, k - start, [part[j : j + FRAME] for j in range(0, len(part), FRAME)], lacing)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return header + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int]] = field(default_factory=list)  # track, timestamp, offset, size
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's offset in the file


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML number at {at}")
    size = 9 - data[at].bit_length()
    n = int.from_bytes(data[at : at + size], "big")
    if keep:
        return n, at + size
    n &= (1 << 7 * size) - 1
    return (None if n == (1 << 7 * size) - 1 else n), at + size


def _block(data: bytes, at: int, end: int, base: int, media: Media) -> None:
    track, at = _vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, kind, sizes = at + 3, flags >> 1 & 3, []
    if kind:
        n, at = data[at], at + 1
        if kind == 1:
            for _ in range(n):
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                sizes.append(size + data[at])
                at += 1
        elif kind == 3:
            size, at = _vint(data, at)
            sizes = [size][:n]
            for _ in range(n - 1):
                first = at
                step, at = _vint(data, at)
                size += step - ((1 << 7 * (at - first) - 1) - 1)
                sizes.append(size)
        else:
            sizes = [(end - at) // (n + 1)] * n
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"the frames of the block that ends at {end} are longer than it")
    when = base + relative
    for size in sizes:
        media.packets.append((track, when, at, size))
        at, when = at + size, when + (size if media.tracks.get(track, "").startswith("A_PCM") else 0)


def parse(data: bytes) -> Media:
    """The packets, clusters and cues of a file; a cue without a cluster's place is left out.

    ValueError says that the file is damaged, and where."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError(f"the file ends inside a block: {e}") from e


def _parse(data: bytes) -> Media:
    media, state = Media(), {"segment": 0, "base": 0, "number": 0, "cue": [0, 0], "cluster": None}

    def walk(at: int, end: int, inside: int) -> int:
        while at < end:
            start = at
            name, at = _vint(data, at, keep=True)
            if inside == CLUSTER and name in TOP:
                return start  # ends a cluster of unknown size
            size, at = _vint(data, at)
            stop = end if size is None else at + size
            if stop > end:
                raise ValueError(f"element {name:#x} at {start} runs over its parent")
            if name == SEGMENT:
                state["segment"] = at
            elif name == CLUSTER:
                media.clusters.append(start)
            if name in MASTERS:
                at = walk(at, stop, name if size is None or name != CLUSTER else 0)
                if name == CUE_POSITIONS:
                    if state["cluster"] is not None:
                        media.cues.append((*state["cue"], state["cluster"] + state["segment"]))
                    state["cue"][1], state["cluster"] = 0, None
                continue
            body = data[at:stop] if name not in (SIMPLE_BLOCK, BLOCK) else b""
            number = int.from_bytes(body[:8], "big")
            if name in (SIMPLE_BLOCK, BLOCK):
                _block(data, at, stop, state["base"], media)
            elif name == TIMESTAMP:
                state["base"] = number
            elif name == SCALE:
                media.scale = number
            elif name == TRACK_NUMBER:
                state["number"] = number
                media.tracks.setdefault(number, "")
            elif name == CODEC_ID:
                media.tracks[state["number"]] = body.decode("ascii", "replace")
            elif name == CUE_TIME:
                state["cue"][0] = number
            elif name == CUE_TRACK:
                state["cue"][1] = number
            elif name == CUE_CLUSTER:
                state["cluster"] = number
            at = stop
        return at

    walk(0, len(data), 0)
    return media


def to_payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def feature(media: Media, payload: bytes) -> str:
    """packets:clusters:cues:last timestamp:sum:sum of squares:mean crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    above = x * len(x) > x.sum()
    return ":".join(map(str, (len(media.packets), len(media.clusters), len(media.cues), media.packets[-1][1], x.sum(), (x * x).sum(), (above[1:] != above[:-1]).sum())))


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text stored as a Matroska file."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                made = [to_payload(t) for t in texts[a : a + 256]]
                yield pa.RecordBatch.from_arrays([ids[a : a + 256], pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, packet, track, timestamp, offset, size, error) of every packet of a media column.

    Null and empty media have no row; a damaged file has one, with nulls and what is wrong."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "packet", "track", "timestamp", "offset", "size", "error"]
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(doc_id, k, *p, None) for k, p in enumerate(parse(data).packets)] if data else []
                except ValueError as e:
                    rows = [(doc_id, None, None, None, None, None, str(e))]
                if rows:
                    kinds = [pa.int64()] * 6 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet long, track long, timestamp long, offset long, size long, error string")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every whole text, reads the stored bytes back and returns what was read.

    Null text is empty (64 zero bytes); a long text is stored whole, in one task's memory;
    repeated rows are kept and give equal values; an empty table gives no rows; columns other
    than doc_id and text are ignored, clashing names too."""

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                media = parse(data)
                payload = b"".join([data[at : at + size] for _, _, at, size in media.packets])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media_column(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
