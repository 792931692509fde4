"""Hashes of a text's words, whole arrays at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_EDGE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of text looked at in one go, so that a very long text takes no more memory than a long one; longer words are hashed whole.
BLOCK, _LONG = 1 << 18, 512
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse, up to twice a block: 8 MB, made once."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            some = np.full(2 * BLOCK + 1, base, np.uint64)
            some[0] = 1
            _POWERS.append(np.multiply.accumulate(some))
    return _POWERS


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def blocks(data: bytes) -> Iterator[bytes]:
    """``data`` cut at white space once a block is full; longer than two blocks only where a word is longer than one."""
    at = 0
    while at < len(data):
        found = _EDGE.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end]
        at = end


def edges(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    edge = np.diff(np.concatenate([[True], _SPACE[codes], [True]]).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def sums(codes: np.ndarray) -> np.ndarray:
    """Sums of a polynomial of all bytes up to each place; between() makes hashes of any stretches of it."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers()[0][: len(codes)], out=out[1:])
    return out


def between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch: the polynomial of its bytes, mixed with its length."""
    return mixed((total[ends] - total[starts]) * powers()[1][starts] + (ends - starts).astype(np.uint64) * ODD[2])


def stretches(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of ``codes``."""
    return between(sums(codes), starts, ends)


def _of_block(data: bytes) -> np.ndarray:
    import xxhash

    if len(data) > 2 * BLOCK:  # there is a word as long as a block
        return np.array([xxhash.xxh64_intdigest(w) if len(w) > _LONG else int(_of_block(w)[0]) for w in data.split()], np.uint64)
    codes = np.frombuffer(data, np.uint8)
    starts, ends = edges(codes)
    out = stretches(codes, starts, ends)
    for i in np.flatnonzero(ends - starts > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, in order. Words over 512 bytes get xxHash64."""
    out = [_of_block(b) for b in blocks(data)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)
