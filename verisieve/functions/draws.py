"""Random numbers that depend on a key only, the same in every engine and on every retry."""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the Poisson(1) distribution for 0, 1, 2, ... events (fixed values).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def uniform(*key: Column | str) -> Column:
    """A number in [0, 1) from the key's MD5."""
    text = F.concat_ws("-", *key)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson(u: Column) -> Column:
    """Poisson(1) draw of a uniform number."""
    return reduce(lambda a, b: a + b, ((u >= F.lit(c)).cast("int") for c in POISSON))


def order_key(seed: int, *key: Column | str) -> Column:
    """A hash to shuffle by."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *key))


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def heads(seed: str, resamples: int, key: str | None) -> np.ndarray:
    """The numbers that ``uniform(seed, b, key)`` divides by 2 ** 32, for b = 0, 1, ... at once: MD5 over arrays."""
    end = b"" if key is None else b"-" + key.encode()
    begin = seed.encode() + b"-"
    if len(begin) + len(str(resamples)) + len(end) > 55:  # more than one block
        return np.array([int(hashlib.md5(begin + str(b).encode() + end).hexdigest()[:8], 16) for b in range(resamples)], np.uint32)
    digits = _digits(len(begin), resamples)
    m: list = [None] * 16
    blocks, size = [], 1
    while 10 ** (size - 1) < max(2, resamples):
        n = len(begin) + size + len(end)
        block = begin + bytes(size) + end + b"\x80" + bytes(55 - n) + (8 * n).to_bytes(8, "little")
        blocks.append((0 if size == 1 else 10 ** (size - 1), 10**size, np.frombuffer(block, "<u4")))
        size += 1
    for j in range(16):
        if j not in digits and len({int(x[j]) for _, _, x in blocks}) == 1:
            m[j] = int(blocks[0][2][j])
            continue
        m[j] = np.empty(resamples, np.uint32)
        for low, high, x in blocks:
            m[j][low:high] = x[j]
        if j in digits:
            m[j] |= digits[j]
    a, b, c, d = (np.full(resamples, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty(resamples, np.uint32)
    for i in range(61):  # the first word of the result changes no more after these
        turn, at = i >> 4, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i >> 4] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        if isinstance(m[at], int):
            f += np.uint32((_SINES[i] + m[at]) & 0xFFFFFFFF)
        else:
            f += m[at]
            f += np.uint32(_SINES[i])
        by = _TURNS[turn][i % 4]
        np.left_shift(f, np.uint32(by), out=a)
        f >>= np.uint32(32 - by)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


@lru_cache(8)
def _digits(start: int, resamples: int) -> dict[int, np.ndarray]:
    """By word of an MD5 block, the digits of 0, 1, ... that begin at byte ``start``."""
    out: dict[int, np.ndarray] = {}
    text = np.arange(resamples).astype("S")
    chars = text.view(np.uint8).reshape(resamples, -1).astype(np.uint32)
    for k in range(chars.shape[1]):
        at = start + k
        out[at // 4] = out.get(at // 4, np.zeros(resamples, np.uint32)) | chars[:, k] << np.uint32(8 * (at % 4))
    return out


@lru_cache(4096)
def weights(seed: str, resamples: int, key: str | None) -> np.ndarray:
    """``poisson(uniform(seed, b, key))`` of all resamples b."""
    x = heads(seed, resamples, key)
    out = np.zeros(resamples, np.uint8)
    for c in POISSON:
        out += x >= np.uint32(math.ceil(c * 4294967296.0))
    return out


@lru_cache(4096)
def lower_half(seed: str, resamples: int, key: str | None) -> np.ndarray:
    """``uniform(seed, b, key) < 0.5`` of all resamples b."""
    return heads(seed, resamples, key) < np.uint32(1 << 31)
