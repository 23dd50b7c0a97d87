"""CRC-32 of any stretch of a text from the running CRCs at its two ends.

A CRC is linear over GF(2): the CRC of ``text[i:j]`` is that of ``text[:j]``, exclusive-or the CRC
of ``text[:i]`` carried over ``j - i`` zero bytes. Carrying over a number of zero bytes is a 32 x 32
bit matrix; it is applied to whole arrays by one table for each byte of the CRC.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Stretches of fewer bytes take one table lookup per byte of the CRC.
_NEAR = 64
_SPACE = 0x20


@functools.cache
def _zero_byte() -> np.ndarray:
    """Images of the 32 bits under one zero byte."""
    # crc32 undoes its own conditioning: crc(b"\0", x ^ 1s) ^ 1s is the plain step; it is linear.
    ones = 0xFFFFFFFF
    return np.array([zlib.crc32(b"\0", (1 << bit) ^ ones) ^ ones for bit in range(32)], np.uint32)


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Images of ``values`` under the map that sends bit ``b`` to ``matrix[b]``."""
    out = np.zeros(values.shape, np.uint32)
    for bit in range(32):
        out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _byte_tables(matrix: np.ndarray) -> np.ndarray:
    """``(4, 256)``: images of each value of each byte."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([_times(matrix, values << np.uint32(8 * byte)) for byte in range(4)])


@functools.cache
def _near_tables() -> np.ndarray:
    """``(4, 64 * 256)``: byte tables of 0 to 63 zero bytes, one after another."""
    power = np.uint32(1) << np.arange(32, dtype=np.uint32)
    tables = []
    for _ in range(_NEAR):
        tables.append(_byte_tables(power))
        power = _times(_zero_byte(), power)
    return np.concatenate(tables, axis=1)


@functools.lru_cache(maxsize=64)
def _far_tables(doublings: int) -> np.ndarray:
    """Byte tables of ``64 << doublings`` zero bytes."""
    power = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(_NEAR):
        power = _times(_zero_byte(), power)
    for _ in range(doublings):
        power = _times(power, power)
    return _byte_tables(power)


def carried(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC carried over its number of zero bytes."""
    near = _near_tables()
    row = (lengths % _NEAR) << 8
    out = near[0][row + (crcs & np.uint32(255))]
    for byte in range(1, 4):
        out = out ^ near[byte][row + (crcs >> np.uint32(8 * byte) & np.uint32(255))]
    far = lengths // _NEAR
    doublings = 0
    while far.any():
        at = np.flatnonzero(far & 1)
        if len(at):
            tables, old = _far_tables(doublings), out[at]
            out[at] = functools.reduce(
                np.bitwise_xor,
                [tables[byte][old >> np.uint32(8 * byte) & np.uint32(255)] for byte in range(4)],
            )
        far = far >> 1
        doublings += 1
    return out


def running(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ends, crc_starts, crc_ends)`` of the words of a text joined by single spaces.

    ``ends`` are places after each word in bytes; the CRCs are those of the text before each
    word, and up to its end. The text is scanned once.
    """
    crc = 0
    after_space = [crc := zlib.crc32(b" ", zlib.crc32(word, crc)) for word in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    after = np.array(after_space, np.uint32)
    starts = np.concatenate([np.zeros(1, np.uint32), after[:-1]]) if len(words) else after
    return ends, starts, _without_space(after)


@functools.cache
def _before_space() -> tuple[np.ndarray, np.ndarray]:
    """By the high byte of a CRC: the table entry that made it, and the byte that chose it."""
    table = np.array([zlib.crc32(bytes([byte]), 0xFFFFFFFF) ^ 0xFFFFFFFF for byte in range(256)], np.uint32)
    place = np.empty(256, np.uint32)
    place[table >> np.uint32(24)] = np.arange(256, dtype=np.uint32)
    return table[place], place


def _without_space(crcs: np.ndarray) -> np.ndarray:
    """CRCs of texts from those of the same texts with a space after them."""
    entry, place = _before_space()
    plain = ~crcs
    high = plain >> np.uint32(24)
    return ~(((plain ^ entry[high]) << np.uint32(8)) | (place[high] ^ np.uint32(_SPACE)))


def gram_crcs(words: list[bytes], longest: int) -> np.ndarray:
    """CRC-32 of every run of 1 to ``longest`` words joined by one space, shorter runs first."""
    ends, crc_starts, crc_ends = running(words)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1]) if len(words) else ends
    n = len(words)
    parts = [
        crc_ends[size - 1 :] ^ carried(crc_starts[: n - size + 1], ends[size - 1 :] - starts[: n - size + 1])
        for size in range(1, min(longest, n) + 1)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
