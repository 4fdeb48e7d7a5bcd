"""Matroska files in binary columns: writing 8-bit samples, and reading files into packet tables."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from roadlens.llm.common import ids_of, map_slices, query, table, texts_of

#: Element ids of the container format, in hexadecimal as its specification lists them.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

_PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CUES, CUE_POINT, CUE_POSITIONS}
_LEVEL_ONE = {CLUSTER, CUES, TRACKS, INFO, SEGMENT}

#: Of the files written here: samples a second and in a packet, packets in a block, blocks in a cluster.
RATE, PACKET, LACED, BLOCKS = 8000, 800, 8, 32
TICK_MS = 1000 * PACKET // RATE


# Writing


def size_field(n: int, width: int = 0) -> bytes:
    """A variable-length size: leading zero bits tell how many bytes follow."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(code: int, data: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + size_field(len(data)) + data


def number(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(code: int, x: float) -> bytes:
    return element(code, np.array(x, ">f8").tobytes())


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames of one block behind their size table. kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3:
        head += size_field(len(frames[0])) if len(frames) > 1 else b""
        for a, b in zip(frames, frames[1:-1]):
            step = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(step) < 1 << 7 * w - 1)
            head += size_field(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_samples(payload: bytes) -> bytes:
    """A file with one 8-bit sound track that holds the payload as samples, byte for byte.

    Full blocks use lacing of equal sizes; the last block of an uneven payload uses EBML lacing.
    """
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, 1000.0 * len(payload) / RATE) + element(MUXING_APP, b"llm") + element(WRITING_APP, b"llm"))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, TICK_MS * 1_000_000)
    tracks = element(TRACKS, element(TRACK_ENTRY, track + element(AUDIO, real(SAMPLING, RATE) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))
    body, points, at = [info, tracks], [], len(info) + len(tracks)
    step = PACKET * LACED
    for first in range(0, len(payload), step * BLOCKS):
        start = first // PACKET * TICK_MS
        parts = [number(TIMESTAMP, start)]
        for k in range(first, min(first + step * BLOCKS, len(payload)), step):
            frames = [payload[i : i + PACKET] for i in range(k, min(k + step, len(payload)), PACKET)]
            kind = 0 if len(frames) == 1 else 2 if len(frames[-1]) == PACKET else 3
            head = size_field(1) + (k // PACKET * TICK_MS - start).to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
            parts.append(element(SIMPLE_BLOCK, head + lace(frames, kind)))
        cluster = element(CLUSTER, b"".join(parts))
        points.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(points)))
    head = number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(EBML_MAX_ID, 4) + number(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(body))


# Reading


def variable(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """The variable-length number at ``at`` and the position behind it; -1 if all its bits are set (unknown size)."""
    first = data[at]
    width = 9 - first.bit_length()
    if first == 0 or at + width > len(data):
        raise ValueError(f"no variable-length number at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of the elements in a range. An element of unknown size ends before the next of its own level."""
    while at < end:
        code, at = variable(data, at, True)
        size, at = variable(data, at, False)
        if size >= 0:
            stop = at + size
            if stop > end:
                raise ValueError(f"element {code:x} ends at {stop}, its parent at {end}")
        elif code == SEGMENT:
            stop = end
        else:
            stop = at
            while stop < end:
                inner, behind = variable(data, stop, True)
                if inner in _LEVEL_ONE:
                    break
                length, behind = variable(data, behind, False)
                stop = end if length < 0 else behind + length
        yield code, at, stop
        at = stop


@dataclass
class Media:
    """What a file holds. Packets: (track, timestamp in ns, begin, size, key frame, lacing kind, cluster)."""

    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float | None = None
    segment: int = 0
    clusters: int = 0
    clusters_at: dict[int, int] = field(default_factory=dict)


def _int(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    return float(np.frombuffer(data[a:b], ">f4" if b - a == 4 else ">f8")[0]) if b > a else 0.0


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(begin, size) of the frames of a block's data."""
    if kind == 0:
        return [(at, end - at)]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3 and n > 1:
        size, at = variable(data, at, False)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at = variable(data, at, False)
            if step < 0:
                step = (1 << 7 * width) - 1
            size += step - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    elif kind == 2:
        if (end - at) % n:
            raise ValueError("laced frames of uneven size")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def read_media(data: bytes) -> Media:
    """Parse a whole file; a damaged one raises ValueError."""
    media = Media()
    try:
        kinds = [c for c, _, _ in elements(data, 0, len(data))]
        if not kinds or kinds[0] != EBML or SEGMENT not in kinds:
            raise ValueError("not a Matroska file")
        for code, a, b in elements(data, 0, len(data)):
            if code == SEGMENT:
                media.segment = a
                _segment(data, a, b, media)
    except IndexError as e:
        raise ValueError("the file ends inside an element") from e
    return media


def _segment(data: bytes, a: int, b: int, media: Media) -> None:
    begin = a
    for code, c, d in elements(data, a, b):
        if code == INFO:
            for k, x, y in elements(data, c, d):
                if k == TIMESTAMP_SCALE:
                    media.scale = _int(data, x, y)
                elif k == DURATION:
                    media.duration = _float(data, x, y)
        elif code == TRACKS:
            for k, x, y in elements(data, c, d):
                if k == TRACK_ENTRY:
                    _track(data, x, y, media)
        elif code == CLUSTER:
            media.clusters_at[begin - media.segment] = media.clusters
            _cluster(data, c, d, media)
            media.clusters += 1
        elif code == CUES:
            for k, x, y in elements(data, c, d):
                if k == CUE_POINT:
                    _cue(data, x, y, media)
        begin = d


def _track(data: bytes, a: int, b: int, media: Media) -> None:
    track = {"number": 0, "type": 0, "codec": "", "frame_ns": 0, "rate": 8000.0, "channels": 1, "bits": 0}
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}
    todo = [(a, b)]
    while todo:
        for code, x, y in elements(data, *todo.pop()):
            if code == AUDIO:
                todo.append((x, y))
            elif code in names:
                track[names[code]] = _int(data, x, y)
            elif code == CODEC_ID:
                track["codec"] = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif code == SAMPLING:
                track["rate"] = _float(data, x, y)
    media.tracks[track["number"]] = track


def _cue(data: bytes, a: int, b: int, media: Media) -> None:
    time, found = 0, []
    for code, x, y in elements(data, a, b):
        if code == CUE_TIME:
            time = _int(data, x, y)
        elif code == CUE_POSITIONS:
            track = place = 0
            for k, v, w in elements(data, x, y):
                if k == CUE_TRACK:
                    track = _int(data, v, w)
                elif k == CUE_CLUSTER:
                    place = _int(data, v, w)
            found.append((track, place))
    media.cues += [(time, t, p) for t, p in found]


def _cluster(data: bytes, a: int, b: int, media: Media) -> None:
    base = 0
    for code, x, y in elements(data, a, b):
        if code == TIMESTAMP:
            base = _int(data, x, y)
        elif code == SIMPLE_BLOCK:
            _block(data, x, y, base, bool(data[_behind_track(data, x) + 2] & 0x80), media)
        elif code == BLOCK_GROUP:
            inner = list(elements(data, x, y))
            key = all(k != 0xFB for k, _, _ in inner)  # no reference to another block
            for k, v, w in inner:
                if k == BLOCK:
                    _block(data, v, w, base, key, media)


def _behind_track(data: bytes, at: int) -> int:
    return variable(data, at, False)[1]


def _block(data: bytes, a: int, b: int, base: int, key: bool, media: Media) -> None:
    track, at = variable(data, a, False)
    time = (base + int.from_bytes(data[at : at + 2], "big", signed=True)) * media.scale
    kind = data[at + 2] >> 1 & 3
    step = media.tracks.get(track, {}).get("frame_ns", 0)
    for i, (begin, size) in enumerate(_frames(data, at + 3, b, kind)):
        media.packets.append((track, time + i * step, begin, size, key, kind, media.clusters))


def track_bytes(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p[2] : p[2] + p[3]] for p in media.packets if p[0] == track])


def features(media: Media, samples: bytes) -> str:
    """Counts of the container and shape of the signal as one line."""
    x = np.frombuffer(samples, np.uint8)
    n = max(1, len(x))
    histogram = np.bincount(x, minlength=256)
    mean = float(histogram @ np.arange(256)) / n
    power = float(histogram @ np.arange(256) ** 2) / n
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    lacing = np.bincount([p[5] for p in media.packets] or [0], minlength=4)
    bands = histogram.reshape(16, 16).sum(1)
    cued = sum(place in media.clusters_at for _, _, place in media.cues)
    return f"packets={len(media.packets)} clusters={media.clusters} cues={cued} lacing={'/'.join(map(str, lacing[:4]))} ms={(media.duration or 0.0):.3f} mean={mean:.4f} rms={np.sqrt(power):.4f} crossings={crossings} bands={'/'.join(map(str, bands))}"


# Columns


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text as UTF-8, filled with 0 to a positive multiple of 64 bytes, in a file.

    A null text counts as empty (64 zero samples); null and repeated ids are kept, other columns are not
    read, an empty table gives an empty result. Equal texts give equal files.
    """

    def make():
        def work(part):
            texts = texts_of(part)
            return {"doc_id": ids_of(part), "n_bytes": [len(t.encode()) for t in texts], "media": [write_samples(payload_of(t)) for t in texts]}

        return work

    return map_slices(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), make, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: ``doc_id, packet, track, codec, time_ns, start, size, key, lacing, cluster, cued``.

    ``start`` and ``size`` are the packet's bytes in the file. A null file has no packets; one that cannot
    be parsed gives a single row that holds only ``error``.
    """
    names = "packet track codec time_ns start size key lacing cluster cued error".split()

    def make():
        def work(part):
            ids, out = ids_of(part).to_pylist(), {n: [] for n in ["doc_id", *names]}
            for key, data in zip(ids, texts_of(part, media_col)):
                for row in _packet_rows(data):
                    for n, v in zip(out, (key, *row)):
                        out[n].append(v)
            return out

        return work

    rows = media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias(media_col))
    return map_slices(rows, make, "doc_id long, packet int, track int, codec string, time_ns long, start long, size long, key boolean, lacing int, cluster int, cued boolean, error string")


def _packet_rows(data: bytes) -> Iterator[tuple]:
    if not data:
        return
    try:
        media = read_media(data)
    except ValueError as e:
        yield (*[None] * 10, str(e))
        return
    cued = {media.clusters_at.get(place) for _, _, place in media.cues}
    for i, (track, time, begin, size, key, kind, cluster) in enumerate(media.packets):
        yield i, track, media.tracks.get(track, {}).get("codec"), time, begin, size, key, kind, cluster, cluster in cued, None


def stored_features(media: DataFrame) -> DataFrame:
    """Features of what the files of ``media_column`` hold, read back from their packets."""

    def make():
        def work(part):
            out = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in texts_of(part, "media"):
                parsed = read_media(data)
                samples = track_bytes(data, parsed)
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(parsed, samples))
                for column, v in zip(out.values(), row):
                    column.append(v)
            return {"doc_id": ids_of(part), "n_bytes": ids_of(part, "n_bytes"), **out}

        return work

    return map_slices(media, make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


@query("op4_matroska")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_features(media_column(table(spark, sf_dir, "documents")))
