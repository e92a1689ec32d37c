"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers.

A store is a folder of parts; part p holds arrays of its own keys in ascending order, one
file each. A task writes a file under a name of its own and then renames it, so a repeated
or speculative attempt leaves the same file. Parts grow in number with the input, so each
stays small enough for one task, and a worker maps only those it asks.

Mapping needs the folder of ``spark.checkpoint.dir`` as a path that all executors mount
(``file:`` or plain); for any other scheme ``folder`` raises.
"""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np

from logweave.session import checkpoint_dir


def folder(spark) -> str:
    """A new folder for one store."""
    root = checkpoint_dir(spark)
    path = root.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise RuntimeError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted path, not {root}")
    return os.path.join(path, "arrays", uuid.uuid4().hex)


def write(root: str, name: str, part: int, values: np.ndarray) -> None:
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, f"{name}-{part}.npy")
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, values)
    os.replace(own, path)


@functools.lru_cache(maxsize=256)
def read(root: str, name: str, part: int) -> np.ndarray:
    path = os.path.join(root, f"{name}-{part}.npy")
    if not os.path.exists(path):
        return np.zeros(0, np.uint64)
    whole = np.load(path, mmap_mode="r")
    return whole if len(whole) else np.zeros(0, whole.dtype)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of each hash: equal ranges of the upper 32 bits."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, -1 where it is not there."""
    if not len(sorted_keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(sorted_keys, wanted)
    at[at == len(sorted_keys)] = 0
    return np.where(sorted_keys[at] == wanted, at, -1)


def runs(part: np.ndarray):
    """(part, first, end) of each run of a non-decreasing array."""
    if len(part):
        cut = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, e in zip([0, *cut], [*cut, len(part)]):
            yield int(part[a]), int(a), int(e)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: sorted keys then compress well in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def add_up(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    k, v = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(first)
    return k[at], np.add.reduceat(v, at) if len(at) else v
