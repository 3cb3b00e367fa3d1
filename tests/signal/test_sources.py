import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.functions import bits
from sonolith.sources import containers as c
from sonolith.sources import sinks, wav


def page(body, lacing, *, serial=7, sequence=0, granule=0, flags=0, crc=None):
    head = b"OggS\0" + struct.pack("<BqIII", flags, granule, serial, sequence, 0) + bytes([len(lacing)]) + bytes(lacing)
    raw = head + body
    return raw[:22] + struct.pack("<I", c.ogg_crc(raw) if crc is None else crc) + raw[26:]


def tags(vendor, *pairs):
    out = struct.pack("<I", len(vendor)) + vendor.encode() + struct.pack("<I", len(pairs))
    return out + b"".join(struct.pack("<I", len(p)) + p.encode() for p in pairs)


def opus(packets):
    head = b"OpusHead\1" + struct.pack("<BHIhB", 2, 312, 44100, -512, 0)
    data = page(head, [len(head)], flags=2)
    t = b"OpusTags" + tags("lib 1", "title=x", "TITLE=y")
    data += page(t, [len(t)], sequence=1)
    for k, p in enumerate(packets):
        lacing = [255] * (len(p) // 255) + [len(p) % 255]
        data += page(p, lacing, sequence=2 + k, granule=960 * (k + 1) + 312)
    return data


def binary(spark, data):
    return spark.createDataFrame([("f", bytearray(data))], "path string, content binary")


def test_ogg_and_opus(spark):
    packets = [bytes([0b01111000]) + b"x" * n for n in (10, 254, 255, 600)] + [bytes([0b00000011, 3]) + b"y" * 20]
    data = b"junk" + opus(packets)
    pages = c.read_ogg_pages(binary(spark, data)).orderBy("offset").collect()
    assert len(pages) == 7 and all(p.crc_ok for p in pages)
    rows = c.read_opus_packets(binary(spark, data)).orderBy("number").collect()
    assert [r.bytes for r in rows] == [len(p) for p in packets]
    assert (rows[0].mode, rows[0].frame_ms, rows[0].stereo, rows[0].frames) == ("hybrid", 20.0, False, 1) and (rows[4].mode, rows[4].frames) == ("silk", 3)
    head = c.read_xiph_headers(binary(spark, data)).first()
    assert (head.codec, head.channels, head.pre_skip, head.gain_db, head.vendor, head.seconds) == ("opus", 2, 312, -2.0, "lib 1", 0.1)
    assert c.read_opus_packets(binary(spark, b"no such file")).count() == 0


def test_packets_over_pages_and_damage():
    long = bytes(range(256)) * 2
    data = page(b"aa" + long[:255], [2, 255]) + page(long[255:] + b"bb", [255, 2, 2], flags=1, sequence=1)
    assert [p for p, _ in c.ogg_packets(c.ogg_pages(data))] == [b"aa", long[:510] + long[510:512], b"bb"]
    lead = page(b"tail" + b"cc", [4, 2], flags=1) + page(b"zz", [2], serial=9) + page(b"dd", [2], sequence=1)
    assert [p for p, _ in c.ogg_packets(c.ogg_pages(lead))] == [b"cc", b"dd"]
    assert [p["crc_ok"] for p in c.ogg_pages(page(b"aa", [2], crc=1))] == [False]
    assert list(c.ogg_pages(page(b"aaaa", [4])[:-1])) == []


def test_resynchronisation():
    """After a gap a page counts only with a good checksum, whatever its number; a false header past the end stops nothing."""
    pages = [c.ogg_page(b"x" * (k * 13 % 300), serial=1, sequence=k) for k in range(24)]
    false = b"OggS\0" + bytes(17) + struct.pack("<IB", 12345, 1) + b"\3abc"
    past = b"OggS\0" + bytes(17) + struct.pack("<IB", 12345, 255) + b"\xff" * 255
    for junk in (b"garbage" + false, past, b"OggS", b"OggS" + past):
        found = list(c.ogg_pages(b"".join(pages[:20]) + junk + b"".join(pages[20:])))
        assert [p["sequence"] for p in found] == list(range(24)), junk
        assert [p["crc_ok"] for p in found] == [True] * 16 + [None] * 4 + [True] + [None] * 3
    damaged = bytearray(b"".join(pages[:3]))
    damaged[len(pages[0]) + 30] ^= 1
    assert [p["crc_ok"] for p in c.ogg_pages(bytes(damaged))] == [True, False, True]
    assert list(c.ogg_pages(false)) != [] and list(c.ogg_pages(b"x" + false)) == [] and list(c.ogg_pages(b"")) == []


def test_fast_checksum():
    def slow(page):
        crc = 0
        for byte in page[:22] + bytes(4) + page[26:]:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
        return crc

    for n in (27, 28, 100, 1000):
        page = bytes(k * k % 251 for k in range(n))
        assert c.ogg_crc(page) == slow(page)


def test_toc_of_any_number_of_frames(spark):
    packets = [(byte, second) for byte in range(256) for second in (None, 0, 1, 48, 64 + 3)]
    rows = spark.createDataFrame(packets, "b int, s int").select("b", "s", bits.toc(F.col("b"), F.col("s")).alias("t")).collect()
    for r in rows:
        want = c.opus_toc(bytes([r.b] if r.s is None else [r.b, r.s]))
        assert (r.t and (r.t.mode, r.t.frame_ms, r.t.stereo, r.t.frames)) == want


def test_vorbis(spark):
    head = b"\1vorbis" + struct.pack("<IBiiiB", 0, 2, 44100, 0, -1, 0) + b"\xb8\1"
    head = b"\1vorbis" + struct.pack("<I", 0) + struct.pack("<BiiiiB", 2, 44100, 0, 128000, -1, 0xB8) + b"\1"
    t = b"\3vorbis" + tags("v")
    data = page(head, [len(head)]) + page(t, [len(t)], sequence=1) + page(b"s" * 9, [9], sequence=2) + page(b"a" * 9, [9], sequence=3, granule=88200)
    r = c.read_xiph_headers(binary(spark, data)).first()
    assert (r.codec, r.nominal, r.short_block, r.long_block, r.seconds) == ("vorbis", 128000, 256, 2048, 2.0)


def test_flac(spark):
    packed = (44100 << 44) | (1 << 41) | (15 << 36) | 123456
    info = struct.pack(">HH", 4096, 4096) + bytes(6) + packed.to_bytes(8, "big") + bytes(range(16))
    block = lambda kind, body, last=False: bytes([kind | 128 * last]) + len(body).to_bytes(3, "big") + body
    data = b"ID3\4\0\0" + bytes([0, 0, 1, 2]) + bytes(130) + b"fLaC" + block(0, info) + block(4, tags("reference lib")) + block(1, bytes(8), True) + b"frames"
    r = c.read_flac(binary(spark, data)).first()
    assert (r.sample_rate, r.channels, r.depth, r.samples, r.vendor, r.blocks) == (44100, 2, 16, 123456, "reference lib", [0, 4, 1])
    assert c.read_flac(binary(spark, b"RIFF")).count() == 0


def test_mp3(spark):
    frame = lambda index, extra=b"": (lambda h: (h + extra).ljust(c.mp3_header(h, 0)["size"], b"\0"))(bytes([0xFF, 0xFB, index << 4, 0]))
    xing = bytes(32) + b"Xing" + struct.pack(">III", 3, 500, 99999) + b"LAME3.99r" + bytes([0, 160]) + bytes(10) + ((576 << 12) | 1000).to_bytes(3, "big")
    data = b"\xff\xfb\x90junk" + frame(9, xing) + frame(9) + frame(11) + frame(9)
    rows = c.read_mp3(binary(spark, data)).orderBy("number").collect()
    assert [r.kbps for r in rows] == [128, 192, 128]
    assert (rows[0].xing_frames, rows[0].lowpass_hz, rows[0].delay, rows[0].padding) == (500, 16000, 576, 1000)
    assert c.read_mp3(binary(spark, bytes(5000))).count() == 0


def wav_bytes(x, rate=8000, kind=1, depth=16):
    data = x.tobytes()
    fmt = struct.pack("<HHIIHH", kind, x.shape[1], rate, 0, 0, depth)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_blocks_and_windows(spark):
    x = (np.arange(2000).reshape(1000, 2) - 1000).astype("<i2")
    for block in (1, 79, 1000, 4096):
        got = wav.samples(wav.read_blocks(binary(spark, wav_bytes(x)), block=block)).orderBy("pos").collect()
        assert np.allclose([r.channels for r in got], x / 32768)
    part = wav.read_blocks(binary(spark, wav_bytes(x)), start_s=0.01, duration_s=0.02)
    frames = wav.samples(part)
    assert frames.agg(F.min("pos"), F.max("pos")).first()[:] == (80, 239)
    assert wav.window(frames, 230, 100).count() == 10
    with pytest.raises(ValueError):
        wav.window(frames, -1, 2)
    y = np.array([[0.5], [np.nan], [np.inf]], "<f4")
    r = wav.read_blocks(binary(spark, wav_bytes(y, kind=3, depth=32))).first()
    assert r.nonfinite == 2 and [v for f in r.pcm for v in f] == [0.5, 0.0, 0.0]
    with pytest.raises(Exception, match="cut off"):
        wav.read_blocks(binary(spark, wav_bytes(x)[:-1])).count()


def test_depths(spark):
    """8 and 24 bits: zero, both ends of the scale and a quarter of it."""
    for depth, raw in ((8, bytes([128, 0, 255, 160])), (24, b"\x00\x00\x00" + b"\x00\x00\x80" + b"\xff\xff\x7f" + b"\x00\x00\x20")):
        x = wav.decoded(raw, wav._KINDS[1, depth], 4, 0)
        assert np.allclose(x, [0, -1, 1, 0.25], atol=1 / (1 << (depth - 1)) + 1e-12)


def test_discover(spark, tmp_path):
    for name in ("a/b.FLAC", "a/.hidden/c.flac", "d.txt", "e.mp3", "f.wave", "g.x.aifc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in wav.discover(spark, str(tmp_path)).select("path").collect()) == ["b.FLAC", "f.wave", "g.x.aifc"]


def test_guarded_write(spark, tmp_path):
    good = spark.createDataFrame([("fine data:image/png;base64,QzovVXNlcnMv",)], "text string")
    sinks.write_guarded(good, str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
    with pytest.raises(Exception, match="personal traces"):
        sinks.write_guarded(good.union(spark.createDataFrame([(r"at C:\x\y.flac",)], "text string")), str(tmp_path / "bad"))


def test_names_and_logs(spark):
    jobs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, base string")
    taken = spark.createDataFrame([("a.mp3",), ("a_4.mp3",), ("b.ogg",)], "name string")
    got = {r.id: r.name for r in sinks.unique_names(jobs, taken, F.col("base"), F.lit("mp3"), order="id").collect()}
    assert got == {1: "a_2.mp3", 2: "a_3.mp3", 3: "b.mp3"}
    more = spark.createDataFrame([(k, "a") for k in range(4)], "id long, base string")
    assert [r.name for r in sinks.unique_names(more, taken.union(spark.createDataFrame([("a_2.mp3",)], "name string")), F.col("base"), F.lit("mp3"), order="id").orderBy("id").collect()] == ["a_3.mp3", "a_5.mp3", "a_6.mp3", "a_7.mp3"]
    s = spark.createDataFrame([(1, "fixed"), (2, "practice")], "id long, mode string")
    assert [r.value for r in sinks.session_log(s).collect()] == ['{"id":1,"mode":"fixed"}']
    scan = spark.createDataFrame([("/m/x.flac", "lossy", 16512.0, 1, "cutoff", 1.234), ("y.mp3", "error", None, 0, None, None)], "path string, bucket string, cutoff_hz double, stage int, reason string, seconds double")
    assert [tuple(r) for r in sinks.csv_rows(scan).collect()][0] == ("x.flac", "lossy", "16.51", 1, "cutoff", "1.23")
