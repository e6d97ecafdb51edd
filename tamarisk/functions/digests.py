"""MD5 of many short messages at a time: each step of its 64 is one operation over a column of messages."""

from __future__ import annotations

import math

import numpy as np

#: Bytes that a message may have, and messages that are digested together.
SHORT, TOGETHER = 55, 1 << 13
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_PLACE = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]


def md5_heads(messages: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words, little-endian, of the digest of each row of a zero-filled (n, 64) array of bytes; ``sizes`` are ``SHORT`` at most."""
    n = len(messages)
    messages[np.arange(n), sizes] = 0x80
    words = messages.view("<u4")
    words[:, 14] = sizes * 8
    out = np.empty((2, n), np.uint32)
    for at in range(0, n, TOGETHER):
        m = np.ascontiguousarray(words[at : at + TOGETHER].T)
        a, b, c, d = (np.full(m.shape[1], x) for x in _START)
        f, g = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            kind = i // 16
            if kind == 0:
                np.bitwise_xor(c, d, f), np.bitwise_and(b, f, f), np.bitwise_xor(d, f, f)
            elif kind == 1:
                np.bitwise_xor(b, c, f), np.bitwise_and(d, f, f), np.bitwise_xor(c, f, f)
            elif kind == 2:
                np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
            else:
                np.invert(d, f), np.bitwise_or(b, f, f), np.bitwise_xor(c, f, f)
            turn = _TURNS[kind][i % 4]
            np.add(f, a, f), np.add(f, _SINES[i], f), np.add(f, m[_PLACE[kind](i)], f)
            np.left_shift(f, np.uint32(turn), g), np.right_shift(f, np.uint32(32 - turn), f), np.bitwise_or(f, g, f)
            np.add(f, b, a)  # the new b, in the place of a, which is not needed any more
            a, b, c, d = d, a, b, c
        out[0, at : at + TOGETHER], out[1, at : at + TOGETHER] = a + _START[0], b + _START[1]
    return out[0], out[1]
