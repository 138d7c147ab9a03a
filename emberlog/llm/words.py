"""Hashes of words, lines and runs of words of many texts at once, as arrays."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

from .base import ASCII_SPACE


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of which every bit depends on all bits of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    steps = np.full(n, base % (1 << 64), np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


#: Bytes of texts that are hashed at once in a task, unless one text has more.
BLOCK_BYTES = 1_000_000
_BASE = 0x100000001B3
_byte_numbers = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_space = np.zeros(256, bool)
_space[list(ASCII_SPACE)] = True
_grown: list[tuple[np.ndarray, np.ndarray]] = []


def base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for a task's usual blocks."""
    if n > 2 * BLOCK_BYTES:
        return powers(_BASE, n), powers(pow(_BASE, -1, 1 << 64), n)
    if not _grown:
        _grown.append((powers(_BASE, 2 * BLOCK_BYTES), powers(pow(_BASE, -1, 1 << 64), 2 * BLOCK_BYTES)))
    return _grown[0]


class Hashed:
    """A block of bytes with the hash of any run in it."""

    def __init__(self, raw: np.ndarray):
        up, self.back = base_powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_byte_numbers[raw] * up[: len(raw)], out=self.sums[1:])

    def run(self, at: np.ndarray, length) -> np.ndarray:
        salt = mixed(np.asarray(length).astype(np.uint64) + np.uint64(1))
        return mixed((self.sums[at + length] - self.sums[at]) * self.back[at] + salt)


class Words:
    """The words of some texts (runs without ASCII white space): a 64-bit number of each, its text, and its line in the text."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        first = np.cumsum(sizes) - sizes
        space = _space[raw]
        start = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        self.numbers = Hashed(raw).run(start, end - start)
        self.text = np.searchsorted(first, start, side="right") - 1
        lines = np.cumsum(raw == 10)
        before = np.concatenate(([0], lines))[first]
        self.line = lines[start] - before[self.text]
        self.counts = np.bincount(self.text, minlength=len(texts))


def text_bytes(texts: pa.Array) -> list[bytes]:
    """Each text as bytes; a null text is empty."""
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Returns this worker's freed memory to the system. Workers outlive tasks and stages, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(sizes: list[int], order: list[int], most: int = BLOCK_BYTES) -> list[list[int]]:
    """The numbers in `order` in groups of at most about `most` bytes."""
    out: list[list[int]] = []
    size = most
    for i in order:
        if size >= most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += sizes[i]
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
