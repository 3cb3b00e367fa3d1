"""Headers and packets of audio containers, parsed from bytes in Arrow batches.

Each parser takes one file's bytes (or the region that was read) and returns plain rows, so a
Spark job is `binaryFile` or any binary column, one of the functions at the end, and ordinary
DataFrame operations on what comes out.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Extensions that a directory scan takes; fixed values.
EXTENSIONS = ("flac", "wav", "wave", "w64", "aif", "aiff", "aifc", "m4a", "alac", "ape", "wv", "tta", "tak", "caf", "mka")
_SYNC_WINDOW = 1 << 20
#: Parsed rows of a file that a task holds at a time.
_ROWS = 1024


#: Bytes with their bits in reverse.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def ogg_crc(page: bytes) -> int:
    """Checksum of a page whose own checksum field counts as zero: CRC-32 with polynomial 0x04C11DB7.

    It reads bits from the other end than zlib's and starts and ends with zero; so bits are turned.
    """
    turned = (page[:22] + bytes(4) + page[26:]).translate(_REVERSED)
    return int(f"{zlib.crc32(turned, 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def ogg_page(body: bytes, *, serial: int, sequence: int, granule: int = 0, flags: int = 0) -> bytes:
    """A page with one whole packet of at most 65,024 bytes."""
    lacing = bytes([255] * (len(body) // 255) + [len(body) % 255])
    if len(lacing) > 255:
        raise ValueError("a page holds 255 parts at most")
    page = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", ogg_crc(page)) + page[26:]


def ogg_pages(data: bytes, *, check_first: int = 16, check_every: int = 64) -> Iterator[dict]:
    """Pages in order. The checksum of the first pages and of some later ones is verified.

    A page that does not begin where the one before it ends is taken only if its version and its
    checksum are right, whatever its number, since its marker may be chance; what looks like a page
    and is none is passed by, also if it would run past the end.
    """
    at, number, seeking = 0, 0, False
    while at < len(data):
        if seeking and (at := data.find(b"OggS", at)) < 0:
            return
        head = data[at : at + 27]
        lacing = data[at + 27 : at + 27 + head[26]] if len(head) == 27 else b""
        body = at + 27 + len(lacing)
        end = body + sum(lacing)
        sound = len(head) == 27 and head[:4] == b"OggS" and len(lacing) == head[26] and end <= len(data)
        good = None
        if sound and (seeking or number < check_first or number % check_every == 0):
            good = struct.unpack_from("<I", head, 22)[0] == ogg_crc(data[at:end])
        if not sound or seeking and not (good and head[4] == 0):
            at, seeking = at + 1, True
            continue
        flags, granule, serial, sequence = struct.unpack_from("<BqII", head, 5)
        yield {"offset": at, "flags": flags, "granule": granule, "serial": serial, "sequence": sequence, "crc_ok": good, "lacing": list(lacing), "body": data[body:end]}
        at, number, seeking = end, number + 1, False


def ogg_packets(pages: Iterator[dict]) -> Iterator[tuple[bytes, int]]:
    """(packet, granule of its page) of the first stream; parts of packets that are not whole go."""
    serial, parts, open_ = None, [], False
    for page in pages:
        if serial is None:
            serial = page["serial"]
        if page["serial"] != serial:
            continue
        if not page["flags"] & 1:  # a fresh packet: what was open before lost its end
            parts, open_ = [], True
        elif not parts:
            open_ = False  # a continuation without a beginning
        at = 0
        for size in page["lacing"]:
            parts.append(page["body"][at : at + size])
            at += size
            if size < 255:
                if open_:
                    yield b"".join(parts), page["granule"]
                parts, open_ = [], True


def comments(data: bytes, at: int, most: int = 1024) -> dict[str, str]:
    """Vendor (under "") and tags of a little-endian comment block; keys in upper case, the last one holds."""
    out: dict[str, str] = {}
    (n,) = struct.unpack_from("<I", data, at)
    out[""] = data[at + 4 : at + 4 + n].decode("utf-8", "replace")
    at += 4 + n
    (count,) = struct.unpack_from("<I", data, at)
    at += 4
    for _ in range(min(count, most)):
        if at + 4 > len(data):
            break
        (n,) = struct.unpack_from("<I", data, at)
        key, eq, value = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        if eq:
            out[key.upper()] = value
        at += 4 + n
    return out


def opus_toc(packet: bytes) -> tuple[str, float, bool, int] | None:
    """(mode, frame milliseconds, stereo, frames), None if the packet can't be decoded."""
    if not packet:
        return None
    config, stereo, code = packet[0] >> 3, bool(packet[0] & 4), packet[0] & 3
    mode = "silk" if config < 12 else "hybrid" if config < 16 else "celt"
    ms = ((10.0, 20.0, 40.0, 60.0)[config % 4], (10.0, 20.0)[config % 2], (2.5, 5.0, 10.0, 20.0)[config % 4])[("silk", "hybrid", "celt").index(mode)]
    frames = (1, 2, 2, packet[1] & 63 if len(packet) > 1 else 0)[code]
    return (mode, ms, stereo, frames) if frames else None


def id3_length(data: bytes) -> int:
    """Bytes of a leading tag: ten and a length of four seven-bit bytes; 0 without one."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    return 10 + sum((data[6 + k] & 0x7F) << (21 - 7 * k) for k in range(4))


def flac_blocks(data: bytes) -> tuple[int, list[tuple[int, bytes]]] | None:
    """(offset of the marker, blocks of (type, body)); None if this is no such file."""
    start = id3_length(data)
    if data[start : start + 4] != b"fLaC":
        return None
    at, out = start + 4, []
    while at + 4 <= len(data):
        head, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        out.append((head & 0x7F, data[at + 4 : at + 4 + size]))
        at += 4 + size
        if head & 0x80:
            break
    return start, out


def flac_info(data: bytes) -> dict | None:
    """Stream parameters, checksum, vendor and block types of a FLAC file."""
    found = flac_blocks(data)
    if found is None or not found[1] or found[1][0][0] != 0 or len(found[1][0][1]) < 34:
        return None
    body = found[1][0][1]
    packed = int.from_bytes(body[10:18], "big")
    tags = next((comments(b, 0) for k, b in found[1] if k == 4), {})
    return {
        "min_block": int.from_bytes(body[0:2], "big"), "max_block": int.from_bytes(body[2:4], "big"), "sample_rate": packed >> 44, "channels": ((packed >> 41) & 7) + 1, "depth": ((packed >> 36) & 31) + 1,
        "samples": packed & ((1 << 36) - 1), "md5": body[18:34].hex() if any(body[18:34]) else None, "vendor": tags.get("") or None, "blocks": [k for k, _ in found[1]],
    }


#: Bitrates in kbit/s of layer III and sample rates, by version; fixed values.
_MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MP3_HZ = {3: (44_100, 48_000, 32_000), 2: (22_050, 24_000, 16_000), 0: (11_025, 12_000, 8_000)}


def mp3_header(data: bytes, at: int) -> dict | None:
    """Fields of a layer III frame header, None where none starts."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = (data[at + 1] >> 3) & 3, (data[at + 1] >> 1) & 3
    index, hz = data[at + 2] >> 4, (data[at + 2] >> 2) & 3
    if version == 1 or layer != 1 or index in (0, 15) or hz == 3:
        return None
    kbps, rate, pad = _MP3_RATES[3 if version == 3 else 2][index], _MP3_HZ[version][hz], (data[at + 2] >> 1) & 1
    return {"version": version, "kbps": kbps, "sample_rate": rate, "mono": data[at + 3] >> 6 == 3, "size": (144 if version == 3 else 72) * kbps * 1000 // rate + pad}


def mp3_xing(data: bytes, at: int, head: dict) -> dict | None:
    """The optional index frame: frames, bytes and what the encoder appended."""
    side = (17 if head["mono"] else 32) if head["version"] == 3 else (9 if head["mono"] else 17)
    p = at + 4 + side
    if data[p : p + 4] not in (b"Xing", b"Info") or p + 8 > len(data):
        return None
    flags = int.from_bytes(data[p + 4 : p + 8], "big")
    out, q = {"kind": data[p : p + 4].decode(), "frames": None, "bytes": None, "encoder": None, "lowpass_hz": None, "delay": None, "padding": None}, p + 8
    for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, None, 100), (8, None, 4)):
        if flags & bit:
            if name:
                out[name] = int.from_bytes(data[q : q + size], "big")
            q += size
    if data[q : q + 4] == b"LAME" and q + 24 <= len(data):
        gap = int.from_bytes(data[q + 21 : q + 24], "big")
        out |= {"encoder": data[q : q + 9].decode("latin-1").rstrip("\0 "), "lowpass_hz": data[q + 10] * 100 or None, "delay": gap >> 12, "padding": gap & 0xFFF}
    return out


def mp3_frames(data: bytes, most: int = 400) -> tuple[dict | None, list[dict]]:
    """(index frame, headers): the first header counts only if another of its rate follows."""
    at = id3_length(data)
    for at in range(at, min(len(data), at + _SYNC_WINDOW)):
        head = mp3_header(data, at)
        after = mp3_header(data, at + head["size"]) if head else None
        if after and after["sample_rate"] == head["sample_rate"]:
            break
    else:
        return None, []
    xing, out = mp3_xing(data, at, head), []
    if xing:
        at += head["size"]
    while len(out) < most and (head := mp3_header(data, at)):
        out.append(head)
        at += head["size"]
    return xing, out


def _rows(files: DataFrame, parse: Callable[[bytes], Iterator[dict]], fields: list[tuple[str, pa.DataType, str]], path_col: str, data_col: str) -> DataFrame:
    wanted = [f for f, _, _ in fields]
    names = ["path", *wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["data"], strict=True):
                rows = iter(parse(data.as_py() or b""))
                while found := [tuple(map(r.get, wanted)) for r in itertools.islice(rows, _ROWS)]:  # nothing else of a row is held
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), *(pa.array(c, t) for c, (_, t, _) in zip(zip(*found, strict=True), fields, strict=True))], names)

    source = files.selectExpr(f"cast({path_col} as string) path", f"{data_col} data")
    return source.mapInArrow(run, "path string, " + ", ".join(f"`{f}` {k}" for f, _, k in fields))


_LONG, _TEXT = (pa.int64(), "long"), (pa.string(), "string")


def read_ogg_pages(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """A row for each page: (path, offset, flags, granule, serial, sequence, crc_ok, lacing)."""
    fields = [(f, *_LONG) for f in ("offset", "flags", "granule", "serial", "sequence")] + [("crc_ok", pa.bool_(), "boolean"), ("lacing", pa.list_(pa.int64()), "array<long>")]
    return _rows(files, ogg_pages, fields, path_col, data_col)


def read_opus_packets(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """A row for each audio packet: (path, number, bytes, mode, frame_ms, stereo, frames)."""

    def parse(data: bytes) -> Iterator[dict]:
        for k, (packet, _) in enumerate(ogg_packets(ogg_pages(data))):
            if k == 0 and packet[:8] != b"OpusHead":
                return
            if k >= 2:
                toc = opus_toc(packet) or (None,) * 4
                yield {"number": k - 2, "bytes": len(packet)} | dict(zip(("mode", "frame_ms", "stereo", "frames"), toc, strict=True))

    return _rows(files, parse, [("number", *_LONG), ("bytes", *_LONG), ("mode", *_TEXT), ("frame_ms", pa.float64(), "double"), ("stereo", pa.bool_(), "boolean"), ("frames", *_LONG)], path_col, data_col)


def read_xiph_headers(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """Identification headers of Opus and Vorbis streams, one row a file that has one.

    (path, codec, channels, sample_rate, pre_skip, gain_db, nominal, short_block, long_block, vendor, seconds)
    """

    def parse(data: bytes) -> Iterator[dict]:
        packets = list(ogg_packets(ogg_pages(data)))
        if len(packets) < 2:
            return
        head, tags = packets[0][0], packets[1][0]
        last = max((g for _, g in packets if g >= 0), default=None)
        if head[:8] == b"OpusHead" and len(head) >= 19:
            channels, skip, rate, gain = struct.unpack_from("<BHIh", head, 9)
            yield {"codec": "opus", "channels": channels, "sample_rate": rate, "pre_skip": skip, "gain_db": gain / 256, "vendor": comments(tags, 8).get(""), "seconds": None if last is None else max(0, last - skip) / 48_000}
        elif head[:7] == b"\x01vorbis" and len(head) >= 29:
            channels, rate, _, nominal, _, blocks = struct.unpack_from("<BIiiiB", head, 11)
            yield {"codec": "vorbis", "channels": channels, "sample_rate": rate, "nominal": nominal if nominal > 0 else None, "short_block": 1 << (blocks & 15), "long_block": 1 << (blocks >> 4), "vendor": comments(tags, 7).get(""), "seconds": last / rate if last and rate else None}

    fields = [("codec", *_TEXT), ("channels", *_LONG), ("sample_rate", *_LONG), ("pre_skip", *_LONG), ("gain_db", pa.float64(), "double"), ("nominal", *_LONG), ("short_block", *_LONG), ("long_block", *_LONG), ("vendor", *_TEXT), ("seconds", pa.float64(), "double")]
    return _rows(files, parse, fields, path_col, data_col)


def read_flac(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """Stream parameters of FLAC files, one row each; others give none."""
    fields = [(f, *_LONG) for f in ("min_block", "max_block", "sample_rate", "channels", "depth", "samples")] + [("md5", *_TEXT), ("vendor", *_TEXT), ("blocks", pa.list_(pa.int64()), "array<long>")]
    return _rows(files, lambda data: filter(None, [flac_info(data)]), fields, path_col, data_col)


def read_mp3(files: DataFrame, path_col: str = "path", data_col: str = "content") -> DataFrame:
    """A row for each of the first 400 frames: (path, number, kbps, sample_rate, mono, size, xing_frames, lowpass_hz, delay, padding)."""

    def parse(data: bytes) -> Iterator[dict]:
        xing, frames = mp3_frames(data)
        extra = {"xing_frames": xing["frames"], **{k: xing[k] for k in ("lowpass_hz", "delay", "padding")}} if xing else {}
        for k, f in enumerate(frames):
            yield f | {"number": k} | extra

    return _rows(files, parse, [("number", *_LONG), ("kbps", *_LONG), ("sample_rate", *_LONG), ("mono", pa.bool_(), "boolean"), ("size", *_LONG)] + [(f, *_LONG) for f in ("xing_frames", "lowpass_hz", "delay", "padding")], path_col, data_col)
