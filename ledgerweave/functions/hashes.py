"""MD5 of many texts at once, in numpy: the rounds run over columns of words, so a hash costs array operations and no call of its own."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
#: Hashes that are worked on together: their words stay in the processor's cache.
TOGETHER = 16_384


def _first_word(words: list, shape: tuple[int, int]) -> np.ndarray:
    """First word of the digest; ``words`` are whole blocks of numbers or of arrays that go with ``shape``."""
    u = np.uint32
    t, f = np.empty(shape, u), np.empty(shape, u)
    h = [np.full(shape, x, u) for x in _START]
    for at in range(0, len(words), 16):
        last = at + 16 == len(words)
        a, b, c, d = (x.copy() for x in h)
        for i in range(61 if last else 64):  # the last three steps don't change the first word
            if i < 16:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif i < 32:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif i < 48:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            np.add(a, f, out=a)
            w = words[at + _WORD[i]]
            if isinstance(w, int):
                np.add(a, u((_ADD[i] + w) & 0xFFFFFFFF), out=a)
            else:
                np.add(a, w, out=a), np.add(a, u(_ADD[i]), out=a)
            np.left_shift(a, u(_TURN[i]), out=t), np.right_shift(a, u(32 - _TURN[i]), out=a), np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        if last:
            return np.add(h[0], b, out=h[0])
        for x, y in zip(h, (a, b, c, d)):
            np.add(x, y, out=x)
    raise ValueError("no block")


def md5_heads(texts: pa.Array, ends: list[bytes]) -> np.ndarray:
    """(ends, texts): the first 32 bits, as a number, of the MD5 of each text followed by each of ``ends``; null texts count as empty."""
    raw = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8) if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8) if len(raw) and raw.buffers()[2] else np.empty(0, np.uint8)
    sizes = np.diff(offsets)
    if raw.null_count:
        sizes = np.where(raw.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    out = np.empty((len(ends), len(raw)), np.uint32)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        whole = -(-size // 4)
        for length in sorted({len(e) for e in ends}):
            own = [i for i, e in enumerate(ends) if len(e) == length]
            total = size + length
            count = ((total + 8) // 64 + 1) * 16
            tail = np.zeros((len(own), count * 4), np.uint8)
            for k, i in enumerate(own):
                tail[k, size : total + 1] = np.frombuffer(ends[i] + b"\x80", np.uint8)
            tail[:, -8:] = np.frombuffer((total * 8).to_bytes(8, "little"), np.uint8)
            tail = tail.view("<u4").astype(np.uint32)
            step = max(1, TOGETHER // len(own))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                head = np.zeros((len(r), whole * 4), np.uint8)
                head[:, :size] = data[offsets[r][:, None] + np.arange(size)]
                head = np.ascontiguousarray(head.view("<u4").T).astype(np.uint32, copy=False)
                words = [head[j] | tail[:, j : j + 1] if j < whole and tail[:, j].any() else head[j] if j < whole else int(tail[0, j]) if (tail[:, j] == tail[0, j]).all() else tail[:, j : j + 1] for j in range(count)]
                out[np.ix_(own, r)] = _first_word(words, (len(own), len(r))).byteswap()
    return out
