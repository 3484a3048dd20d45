"""Sorted hash arrays: counts by 64-bit hash in 4 bytes a key and 1 byte a value, one file of arrays for workers to map."""

from __future__ import annotations

import os

import numpy as np

MAGIC = b"SHAR"
KINDS = ("u1", "<u2", "<u4", "<u8", "<i8", "<f8")
_OPEN: dict[str, list[np.ndarray]] = {}


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several."""
    x = np.uint64(0x9E3779B97F4A7C15)
    for part in parts:
        x = (x ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(29))
    return x


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ascending distinct keys, the place of one row of each, and the sums of counts."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return (ordered[starts], order[starts], *(np.add.reduceat(c[order].astype(np.int64), starts) if len(keys) else np.zeros(0, np.int64) for c in counts))


def build(keys: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """Arrays for ascending distinct keys with rows of counts.

    A key's leading bits choose one of about n / 8 buckets, the 32 bits behind them are stored: a key that is not there
    is taken for another with chance 8 / 2**32. Value rows are codes into a table of the 255 most frequent; rows with
    code 255 stand in a list of their own, by place.
    """
    n, columns = len(keys), values.shape[1]
    bits = max(0, (n // 8).bit_length())
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    start = np.zeros((1 << bits) + 1, np.int64)
    np.cumsum(np.bincount(bucket, minlength=1 << bits), out=start[1:])
    low = (keys << np.uint64(bits)) >> np.uint64(32)
    _, first, inverse, times = np.unique(mixed(*values.T.astype(np.uint64)), return_index=True, return_inverse=True, return_counts=True)
    top = np.argsort(-times, kind="stable")[:255]
    code_of = np.full(len(first), 255, np.uint8)
    code_of[top] = np.arange(len(top))
    code = code_of[inverse]
    rest = np.flatnonzero(code == 255)
    return [np.array([n, bits, columns], "<i8"), start.astype("<u4"), low.astype("<u4"), code, values[first[top]].astype("<i8").ravel(), rest.astype("<u4"), values[rest].astype("<i8").ravel()]


def look_up(arrays: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of counts, zeros for keys that are not there; which keys are there)."""
    about, start, low, code, table, rest, many = arrays
    n, bits, columns = (int(x) for x in about)
    out = np.zeros((len(keys), columns), np.int64)
    if not n:
        return out, np.zeros(len(keys), bool)
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    wanted = ((keys << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    a, end = start[bucket].astype(np.int64), start[bucket + 1].astype(np.int64)
    b = end.copy()
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        middle = (a + b) >> 1
        less = (a < b) & (low[np.minimum(middle, n - 1)] < wanted)
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
    hit = a < end
    hit[hit] = low[a[hit]] == wanted[hit]
    at = a[hit]
    codes = code[at]
    found = table.reshape(-1, columns)[np.minimum(codes, max(len(table) // columns - 1, 0))]
    large = np.flatnonzero(codes == 255)
    if len(large):
        found[large] = many.reshape(-1, columns)[np.searchsorted(rest, at[large])]
    out[hit] = found
    return out, hit


def save(path: str, arrays: list[np.ndarray]) -> None:
    """Written aside and moved into place, so a repeated task leaves the same whole file."""
    arrays = [np.ascontiguousarray(a) for a in arrays]
    head = np.array([len(arrays), *(x for a in arrays for x in ([np.dtype(k) for k in KINDS].index(a.dtype), a.size))], "<i8").tobytes()
    partial = f"{path}.{os.getpid()}.{id(arrays)}"
    with open(partial, "wb") as f:
        f.write(MAGIC.ljust(8, b"\0") + head)
        for a in arrays:
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    os.replace(partial, path)


def mapped(path: str, most_bytes: int = 128 << 20, most_files: int = 1000) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped, not much over most_bytes at a time; a file that is not there holds no keys."""
    found = _OPEN.get(path)
    if found is None:
        if len(_OPEN) >= most_files or sum(a.nbytes for held in _OPEN.values() for a in held) > most_bytes:
            _OPEN.clear()
        if not os.path.exists(path):
            return []
        raw = np.memmap(path, np.uint8, "r")
        if bytes(raw[:4]) != MAGIC:
            raise ValueError(f"{path} is not a file of arrays")
        n = int(raw[8:16].view("<i8")[0])
        head = raw[16 : 16 + 16 * n].view("<i8")
        at, found = 16 + 16 * n, []
        for kind, size in head.reshape(n, 2).tolist():
            width = np.dtype(KINDS[kind]).itemsize * size
            found.append(raw[at : at + width].view(KINDS[kind]))
            at += width + -width % 8
        _OPEN[path] = found
    return found
