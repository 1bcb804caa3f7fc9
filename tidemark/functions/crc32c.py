"""CRC-32C routing of keys, which Spark has no function for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def table() -> np.ndarray:
    """The 256 entries of the byte-wise table of the reflected Castagnoli polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def crc32c(keys: list[bytes]) -> np.ndarray:
    """Checksums of all keys side by side, one byte of each at a time."""
    steps = table()
    n = np.array([len(k) for k in keys], np.int64)
    out = np.full(len(keys), 0xFFFFFFFF, np.uint32)
    if len(keys) and n.max():
        wide = np.zeros((len(keys), int(n.max())), np.uint8)
        wide[np.arange(wide.shape[1]) < n[:, None]] = np.frombuffer(b"".join(keys), np.uint8)
        for i in range(wide.shape[1]):
            out = np.where(i < n, steps[(out ^ wide[:, i]) & 0xFF] ^ (out >> 8), out)
    return out ^ np.uint32(0xFFFFFFFF)


def partition_of(key, n: int) -> Column:
    """Partition of a text key: CRC-32C of its UTF-8 bytes modulo ``n``; null stays null."""

    @pandas_udf("long")
    def route(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series([None] * len(s), dtype="Int64")
        out[known.to_numpy()] = (crc32c([x.encode() for x in s[known]]).astype(np.int64) % n)
        return out

    return route(key if isinstance(key, Column) else F.col(key))
