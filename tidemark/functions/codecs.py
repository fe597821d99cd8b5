"""Packing of a block's values by XOR with the value before.

Format: the number of values (32 bits, big-endian), the first value's 64 bits, then for each further value a control byte: 255 where it
equals the one before, else 8 * (leading zero bytes) + (trailing zero bytes) of the XOR, followed by the bytes between them.
The control byte of a differing value is at most 8 * 7 + 7, so it can't be taken for 255.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SAME = 255


def pack_values(values: list[float]) -> bytes:
    """One block."""
    out, before = [struct.pack(">I", len(values))], b""
    for i, v in enumerate(values):
        raw = struct.pack(">d", v)
        if i == 0:
            out.append(raw)
        else:
            xor = bytes(a ^ b for a, b in zip(raw, before, strict=True))
            kept = xor.strip(b"\0")
            if not kept:
                out.append(bytes([SAME]))
            else:
                lead, trail = len(xor) - len(xor.lstrip(b"\0")), len(xor) - len(xor.rstrip(b"\0"))
                out.append(bytes([8 * lead + trail]) + kept)
        before = raw
    return b"".join(out)


def unpack_values(block: bytes) -> list[float]:
    (n,) = struct.unpack_from(">I", block)
    out, at, before = [], 4, b"\0" * 8
    for i in range(n):
        if i == 0:
            before, at = block[at : at + 8], at + 8
        else:
            control, at = block[at], at + 1
            if control != SAME:
                lead, trail = divmod(control, 8)
                n_kept = 8 - lead - trail
                xor = b"\0" * lead + block[at : at + n_kept] + b"\0" * trail
                before, at = bytes(a ^ b for a, b in zip(before, xor, strict=True)), at + n_kept
        out.append(struct.unpack(">d", before)[0])
    return out


def _packed(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else pack_values([float(x) for x in b]))


def _unpacked(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda b: None if b is None else unpack_values(b))


def packed(values: Column) -> Column:
    """An array of doubles (no nulls in it) as one binary value."""
    return F.pandas_udf(_packed, "binary")(values)


def unpacked(block: Column) -> Column:
    """The inverse of `packed`."""
    return F.pandas_udf(_unpacked, "array<double>")(block)
