"""Integer fields of container headers, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frame lengths in milliseconds by packet configuration, and the modes they belong to; fixed values.
SILK_MS, HYBRID_MS, CELT_MS = (10.0, 20.0, 40.0, 60.0), (10.0, 20.0), (2.5, 5.0, 10.0, 20.0)


def synchsafe(b0: Column, b1: Column, b2: Column, b3: Column) -> Column:
    """28 bits from four bytes of seven bits each."""
    part = lambda b, k: F.shiftleft(b.cast("long").bitwiseAND(F.lit(0x7F)), k)
    return part(b0, 21) + part(b1, 14) + part(b2, 7) + part(b3, 0)


def to_synchsafe(value: Column) -> list[Column]:
    return [F.shiftright(value.cast("long"), k).bitwiseAND(F.lit(0x7F)) for k in (21, 14, 7, 0)]


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value.cast("long"), shift).bitwiseAND(F.lit((1 << width) - 1))


def toc(byte: Column, second: Column) -> Column:
    """struct(mode, frame_ms, stereo, code, frames) of a packet's first two bytes.

    Codes 0 to 2 stand for one or two frames; with code 3 the low six bits of the second byte count
    them. A packet of none, or without that byte, can't be decoded: NULL.
    """
    config = bits(byte, 3, 5)
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    mode = F.when(config < 12, "silk").when(config < 16, "hybrid").otherwise("celt")
    ms = F.when(config < 12, pick(SILK_MS, config % 4)).when(config < 16, pick(HYBRID_MS, config % 2)).otherwise(pick(CELT_MS, config % 4))
    code = bits(byte, 0, 2)
    frames = F.when(code == 0, F.lit(1).cast("long")).when(code < 3, F.lit(2).cast("long")).otherwise(bits(second, 0, 6))
    return F.when(frames > 0, F.struct(mode.alias("mode"), ms.alias("frame_ms"), (bits(byte, 2, 1) == 1).alias("stereo"), code.alias("code"), frames.alias("frames")))
