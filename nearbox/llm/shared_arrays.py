"""Arrays in the shared folder, written by tasks and memory-mapped by workers; and packed runs of sorted keys."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame


#: Bytes of input that a shard's arrays are made from.
SHARD_INPUT = 4 << 20


def shards_for(texts: DataFrame) -> int:
    """Shards by the input's bytes as its plan counts them, a power of two: so a shard's memory doesn't grow with the input.

    65,536 at most, which is 256 GB of input; beyond, shards grow.
    """
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < 1 << 60 else 0  # what isn't known is given as next to infinite
    return 1 << min(16, max(3, (max(texts.rdd.getNumPartitions(), size // SHARD_INPUT) - 1).bit_length()))


def local(path: str) -> str | None:
    """The path in this machine's file system, if it is in a mounted folder."""
    u = urlparse(path)
    return u.path if u.scheme in ("", "file") else None


def put(path: str, data: bytes | memoryview) -> None:
    """Write a file whole or not at all; a task that runs twice writes the same again."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    if (to := local(path)) is not None:
        os.makedirs(os.path.dirname(to), exist_ok=True)
        with open(local(part), "wb") as f:
            f.write(data)
        os.replace(local(part), to)
        return
    fs, at = pyarrow.fs.FileSystem.from_uri(part)
    fs.create_dir(os.path.dirname(at), recursive=True)
    with fs.open_output_stream(at) as f:
        f.write(data)
    fs.move(at, at.removesuffix(part[len(path) :]))


def mapped(path: str, dtype) -> np.ndarray:
    """A file of put() as a memory-mapped array. From a remote store it is fetched to a file that has no name any more."""
    if (own := local(path)) is not None:
        return np.memmap(own, dtype, "r") if os.path.getsize(own) else np.zeros(0, dtype)
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with tempfile.TemporaryFile() as f, fs.open_input_stream(at) as source:
        while chunk := source.read(1 << 24):
            f.write(chunk)
        f.flush()
        return np.memmap(f, dtype, "r") if f.tell() else np.zeros(0, dtype)


OPEN: dict[tuple[str, str], np.ndarray] = {}


def forget(folder: str) -> None:
    """Let go of the arrays of all folders but this; workers outlive a query, and what they have mapped counts as theirs."""
    for key in [k for k in OPEN if k[0].rsplit("/", 1)[0] != folder]:
        with contextlib.suppress(KeyError):
            del OPEN[key]


def opened(path: str, dtype: str) -> np.ndarray:
    """mapped(), once for each process; arrays of other models are let go."""
    if (path, dtype) not in OPEN:
        forget(path.rsplit("/", 1)[0])
        OPEN[path, dtype] = mapped(path, dtype)
    return OPEN[path, dtype]


def merged(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of each one's values (columns)."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values[order], first, axis=0)


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys as differences and values, byte plane by byte plane, compressed."""
    planes = np.concatenate([np.diff(keys, prepend=np.uint64(0))[:, None], values.reshape(len(keys), -1)], axis=1).astype("<u8")
    return zstandard.compress(np.ascontiguousarray(planes.view(np.uint8).reshape(len(keys), -1).T).tobytes(), 1)


def unpack(data: bytes, columns: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    planes = np.ascontiguousarray(raw.reshape(8 * (columns + 1), -1).T).view("<u8").reshape(-1, columns + 1)
    return np.cumsum(planes[:, 0], dtype=np.uint64), planes[:, 1:]


def unpacked(blobs: list[bytes], columns: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b, columns) for b in blobs]
    return merged(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
