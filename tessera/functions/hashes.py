"""Hash functions of flow tables that Spark has no built-in for, vectorized over batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def toeplitz(key: bytes, source: Column, target: Column, source_port: Column, target_port: Column) -> Column:
    """The receive-side scaling hash of an IPv4 flow: for every set bit, the key's 32 bits from there, xored."""
    bits = int.from_bytes(key, "big")
    size = 8 * len(key)
    window = np.array([(bits >> (size - 32 - i)) & 0xFFFFFFFF for i in range(96)], np.int64)

    @F.pandas_udf(LongType())
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int64)
        at = 0
        for values, width in ((a, 32), (b, 32), (c, 16), (d, 16)):
            x = values.to_numpy(np.int64)
            for k in range(width - 1, -1, -1):
                out ^= np.where(x >> k & 1, window[at], 0)
                at += 1
        return pd.Series(out)

    return run(source, target, source_port, target_port)


def crc32c(value: Column) -> Column:
    """CRC-32C (Castagnoli polynomial) of binary values."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    steps = table.tolist()

    @F.pandas_udf(LongType())
    def run(v: pd.Series) -> pd.Series:
        out = []
        for x in v:
            crc = 0xFFFFFFFF
            for byte in x or b"":
                crc = steps[(crc ^ byte) & 255] ^ (crc >> 8)
            out.append(crc ^ 0xFFFFFFFF)
        return pd.Series(out)

    return run(value.cast("binary"))


def jenkins(a: Column, b: Column, c: Column, seed: int = 0) -> Column:
    """Jenkins' lookup3 hash of three 32-bit words, as flow tables use it."""
    mask = np.uint32(0xFFFFFFFF)

    def turn(x: np.ndarray, k: int) -> np.ndarray:
        return (x << np.uint32(k) | x >> np.uint32(32 - k)) & mask

    @F.pandas_udf(LongType())
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        start = np.uint32((0xDEADBEEF + 12 + seed) & 0xFFFFFFFF)
        a, b, c = ((v.to_numpy(np.int64) & 0xFFFFFFFF).astype(np.uint32) + start for v in (x, y, z))
        for target, k in (("c", 14), ("a", 11), ("b", 25), ("c", 16), ("a", 4), ("b", 14), ("c", 24)):
            if target == "c":
                c = (c ^ b) - turn(b, k)
            elif target == "a":
                a = (a ^ c) - turn(c, k)
            else:
                b = (b ^ a) - turn(a, k)
        return pd.Series(c.astype(np.int64))

    return run(a.cast("long"), b.cast("long"), c.cast("long"))
