"""WAV files by byte ranges: windows, filters, long files, round trips."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.sources import ranges


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    r = np.random.default_rng(1)
    data = {}
    for name, frames, channels in (("a", 100_000, 2), ("sub/b", 777, 1), ("c", 0, 1)):
        x = r.integers(-32768, 32767, (frames, channels)).astype("<i2")
        (d / name).parent.mkdir(exist_ok=True)
        (d / f"{name}.wav").write_bytes(ranges.header(frames, channels, 8000) + x.tobytes())
        data[f"{d}/{name}.wav"] = x / 32768
    return str(d), data


def joined(rows):
    """path -> (pos, samples) of the blocks of each file in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.pos)):
        out.setdefault(r.path, []).append((r.pos, np.array(r.pcm)))
    return {k: (v[0][0], np.concatenate([x for _, x in v])) for k, v in out.items()}


@pytest.mark.parametrize(("block", "split"), [(1000, 1 << 26), (999, 5000), (1, 1 << 26), (1 << 20, 1000), (250, 1000)])
def test_any_block_and_split_gives_the_file(spark, folder, block, split):
    root, data = folder
    rows = ranges.read_pcm(spark, root if block > 1 else f"{root}/sub", block=block, split_bytes=split).collect()
    got = joined(rows)
    assert set(got) == {p for p, x in data.items() if len(x) and (block > 1 or "/sub/" in p)}
    for path, (pos, x) in got.items():
        assert pos == 0 and np.allclose(x, data[path], atol=1e-7)
    assert len({(r.path, r.pos) for r in rows}) == len(rows)


def test_a_window_reads_its_own_bytes(spark, folder):
    root, data = folder
    path = f"{root}/a.wav"
    window = ranges.read_pcm(spark, path, start_s=5.0, duration_s=0.125, block=100)
    assert window.rdd.getNumPartitions() == 1
    rows = window.collect()
    (pos, x) = joined(rows)[path]
    assert pos == 40_000 and np.allclose(x, data[path][40_000:41_000], atol=1e-7)
    assert sum(r.bytes for r in rows) == 1000 * 4  # one percent of the file
    assert [r.pos for r in ranges.read_pcm(spark, path, first=99_950, count=1000, block=20).orderBy("pos").collect()] == [99_950, 99_970, 99_990]
    assert ranges.read_pcm(spark, path, start_s=99.0).count() == 0
    mono = ranges.read_pcm(spark, path, first=10, count=5, mono="true").first()
    assert np.allclose(np.array(mono.pcm)[:, 0], data[path][10:15].mean(axis=1), atol=1e-7)
    with pytest.raises(Exception, match="does not start before"):
        ranges.read_pcm(spark, path, first=-1).count()


def test_what_is_left_out_is_not_read(spark, folder):
    root, _ = folder
    every = ranges.read_pcm(spark, root, block=1000, split_bytes=40_000)
    some = ranges.read_pcm(spark, root, [f"{root}/a.wav", f"{root}/none.wav"], block=1000, split_bytes=40_000, first=51_000, count=9000)
    assert sorted(r.pos for r in some.collect()) == list(range(51_000, 60_000, 1000))
    assert some.agg(F.sum("bytes")).first()[0] == 9000 * 4
    assert every.rdd.getNumPartitions() > 5 and some.rdd.getNumPartitions() == 1
    late = every.where(F.col("start_s") > 12.0)
    assert sorted(r.pos for r in late.collect()) == [97_000, 98_000, 99_000] and every.count() == 101
    assert ranges.read_pcm(spark, root, []).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        ranges.read_pcm(spark, f"{root}/nowhere").count()


def test_a_file_beyond_two_and_four_gib(spark, tmp_path):
    frames = 1 << 31  # of two channels and 16 bits: 8 GiB, of which nothing but the ends is on disk
    head = ranges.header(frames, 2, 48_000)
    assert head[:4] == b"RF64"
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(head)
        f.seek(len(head) + (frames - 3) * 4)
        f.write(struct.pack("<6h", *range(100, 106)))
    rows = ranges.read_pcm(spark, str(tmp_path), first=frames - 3, block=2).orderBy("pos").collect()
    assert [r.pos - frames for r in rows] == [-3, -1] and sum(r.bytes for r in rows) == 12
    assert np.allclose(np.concatenate([r.pcm for r in rows]).ravel() * 32768, range(100, 106))
    assert ranges.read_pcm(spark, str(tmp_path)).rdd.getNumPartitions() == 129


def test_layouts():
    def of(data, size=None):
        return ranges.layout(lambda at, n: data[at : at + n], size or len(data))

    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16)
    riff = lambda *chunks: b"RIFF\0\0\0\0WAVE" + b"".join(chunks)
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    assert of(riff(odd, form, b"data", struct.pack("<I", 4), b"\0" * 4)) == (8000, 1, "<i2", 12 + 12 + 24 + 8, 2)
    assert of(riff(form, b"data", struct.pack("<I", 0xFFFFFFFF), b"\0" * 6)).frames == 3
    assert of(riff(form, b"data", struct.pack("<I", 100), b"\0" * 6)).frames == 3
    for wrong, why in ((b"RIFX" + b"\0" * 20, "no WAV"), (riff(form), "no samples"), (riff(b"data\4\0\0\0abcd"), "before their format"), (riff(form, b"data\3\0\0\0abc"), "cut off")):
        with pytest.raises(ValueError, match=why):
            of(wrong)
    bad = bytearray(form)
    bad[8] = 7
    with pytest.raises(ValueError, match="not supported"):
        of(riff(bytes(bad), b"data\0\0\0\0"))


def test_written_files_are_read_back(spark, tmp_path):
    blocks = spark.range(40).selectExpr("concat('f', id % 4) name", "(id div 4) * 5L pos", "transform(sequence(0, 4), k -> array(float((id + k) / 64), float(-2))) pcm")
    ranges.write_wav(blocks, f"file://{tmp_path}/out", 16_000)
    ranges.write_wav(blocks, f"file://{tmp_path}/out", 16_000)  # once more gives the same files
    got = joined(ranges.read_pcm(spark, f"file://{tmp_path}/out", block=7).collect())
    assert sorted(p.rsplit("/", 1)[1] for p in got) == ["f0.wav", "f1.wav", "f2.wav", "f3.wav"]
    want = np.array([(4 * b + 1 + k) / 64 for b in range(10) for k in range(5)])
    assert np.allclose(next(x for p, (_, x) in got.items() if p.endswith("f1.wav")), np.stack([want.clip(max=32767 / 32768), np.full(50, -1.0)], 1), atol=1e-6)
    with pytest.raises(Exception, match="is due"):
        ranges.write_wav(blocks.where("pos <> 5"), f"file://{tmp_path}/gap", 16_000)
