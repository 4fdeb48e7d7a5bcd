import hashlib
import zlib

import pytest
from roadlens.llm import matroska as m

SCHEMA = "doc_id long, text string, media string"
TEXTS = ["", None, "x", "é" * 32, "a" * 63, "a" * 64, "word " * 200, "z" * 6400, "long text " * 40000, "same", "same"]


@pytest.mark.parametrize("kind", [1, 3])
@pytest.mark.parametrize("sizes", [[3, 5], [0, 255, 510, 1], [70000, 1, 16000], [5] * 256])
def test_lacing_round_trip(kind, sizes):
    frames = [bytes([i % 251]) * n for i, n in enumerate(sizes)]
    block = m.lace(frames, kind)
    assert [block[a : a + n] for a, n in m._frames(block, 0, len(block), kind)] == frames


@pytest.mark.parametrize("text", [t or "" for t in TEXTS])
def test_file_round_trip(text):
    payload = m.payload_of(text)
    assert len(payload) % 64 == 0 and payload and payload.rstrip(b"\0") == text.encode().rstrip(b"\0")
    data = m.write_samples(payload)
    media = m.read_media(data)
    assert m.track_bytes(data, media) == payload
    assert media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    times = [p[1] for p in media.packets]
    assert times == [i * m.TICK_MS * 1_000_000 for i in range(len(times))]
    assert [media.clusters_at[p] for _, _, p in media.cues] == list(range(media.clusters))


def test_unknown_sizes_and_groups():
    block = m.size_field(1) + (-5).to_bytes(2, "big", signed=True) + b"\0" + b"abc"
    cluster = m.number(m.TIMESTAMP, 20) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block) + m.number(m.BLOCK_DURATION, 4))
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + unknown
    media = m.read_media(data)
    assert media.clusters == 2
    assert [(p[0], p[1], p[3], p[4], p[6]) for p in media.packets] == [(1, 15_000_000, 3, True, 0), (1, 15_000_000, 3, True, 1)]


def test_columns(spark):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)], SCHEMA)
    rows = m.stored_features(m.media_column(docs)).collect()
    assert len(rows) == len(TEXTS)
    want = sorted((hashlib.sha256(m.payload_of(t or "")).hexdigest(), zlib.crc32(m.payload_of(t or "")[-64:]), len((t or "").encode())) for t in TEXTS)
    assert sorted((r.payload_sha256, r.tail_crc32, r.n_bytes) for r in rows) == want
    assert len({r.media_sha256 for r in rows if r.doc_id in (9, 10)}) == 1
    assert m.stored_features(m.media_column(docs.limit(0))).collect() == []


def test_packet_table(spark):
    files = [(1, m.write_samples(m.payload_of("long text " * 40000))), (2, None), (3, b"junk"), (4, m.write_samples(bytes(64))[:-9])]
    rows = m.packet_table(spark.createDataFrame(files, "doc_id long, media binary")).collect()
    packets = [r for r in rows if r.doc_id == 1]
    assert len(packets) == 500 and sum(r.size for r in packets) == 400000 and all(r.cued for r in packets)
    assert [r.doc_id for r in rows if r.error] == [3, 4]
