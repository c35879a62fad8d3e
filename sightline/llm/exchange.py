"""Packed exchange: blocks of documents send sorted 64-bit keys to shards of the key space and get an answer for each key.

A message is one row for a block and a shard, so a shuffle moves arrays, not rows. A key range never
holds more than one entry for each block and key, however often the key occurs.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa

_CODEC = "lz4"


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: sorted keys share their high bytes."""
    width = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec=_CODEC, asbytes=True)


def unpack(raw: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n, codec=_CODEC), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal width; rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def cuts(sorted_keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first, last) of the shards that have keys."""
    at = np.searchsorted(shard_of(sorted_keys, shards), np.arange(shards + 1))
    return [(s, int(at[s]), int(at[s + 1])) for s in range(shards) if at[s] < at[s + 1]]


def release(spark) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results stand in a checkpoint.

    The gateway passes dropped references on from a thread of its own and plans die in two rounds, so the collector waits and runs twice.
    """
    gc.collect()
    for _ in range(2):
        time.sleep(0.5)
        spark.sparkContext._jvm.System.gc()
