"""MD5 of texts whose pieces lie in different tables.

``hashlib`` cannot hand an unfinished digest to another process. Here it is a short value of a row: the four words of
the state, the number of bytes read and the rest of the last block. So a digest goes to the texts, and no text is moved or
held once for each digest that needs it. Many digests read on at once, a block each, in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

BLOCK = 64
#: Digests that read on together: their words stay in a core's cache.
LANES = 4_096
#: State of a digest that has read nothing: four words, a length, no rest.
NEW = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, 0], "<u4").tobytes()
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_TURNS = [np.uint32(t) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def _mix(state: np.ndarray, words: np.ndarray) -> None:
    """One block for every column of ``state`` (4 words) from ``words`` (16 words), in place."""
    a, b, c, d = state.copy()
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += _SINES[i]
        f += words[at]
        np.left_shift(f, _TURNS[i], out=g)
        f >>= np.uint32(32) - _TURNS[i]
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    for k, v in enumerate((a, b, c, d)):
        state[k] += v


def _read_blocks(state: np.ndarray, data: bytes, at: np.ndarray, n: np.ndarray) -> None:
    """``n`` blocks of ``data`` from byte ``at`` on for each column of ``state``; equal lengths go together."""
    if not len(n) or not n.max():
        return
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), BLOCK)
    order = np.argsort(-n, kind="stable")
    for lo in range(0, len(order), LANES):
        rows = order[lo : lo + LANES]
        left, begin, held = -n[rows], at[rows], state[:, rows]
        for t, live in enumerate(np.searchsorted(left, -np.arange(-left[0])).tolist()):
            words = np.ascontiguousarray(windows[begin[:live] + BLOCK * t].view("<u4").T)
            _mix(held[:, :live], words)
        state[:, rows] = held


def read_on(states: Sequence[bytes], leads: Sequence[bytes], texts: Sequence[bytes], of: Sequence[int]) -> list[bytes]:
    """Each state after its lead and ``texts[of]``."""
    words = np.frombuffer(b"".join([s[:16] for s in states]), "<u4").reshape(-1, 4).T.astype(np.uint32)
    done = np.frombuffer(b"".join([s[16:24] for s in states]), "<i8")
    begin, own, rests = [], [], []
    for s, lead, k in zip(states, leads, of):
        text, head = texts[k], s[24:] + lead
        fill = -len(head) % BLOCK
        head += text[:fill]
        cut, rest = len(head) % BLOCK, (len(text) - fill) % BLOCK if fill < len(text) else 0  # a text that cannot fill the head's block has none of its own
        own.append(head[: len(head) - cut])
        rests.append(head[len(head) - cut :] + text[len(text) - rest :])
        begin.append(fill)
    of, sizes, long = np.asarray(of, np.int64), np.array([len(x) for x in own], np.int64), np.array([len(t) for t in texts], np.int64)
    _read_blocks(words, b"".join(own), np.cumsum(sizes) - sizes, sizes // BLOCK)
    begin = np.array(begin, np.int64)
    _read_blocks(words, b"".join(texts), (np.cumsum(long) - long)[of] + begin, np.maximum(0, long[of] - begin) // BLOCK)
    heads = np.concatenate([words.T.astype("<u4").view("<i8"), (done + [len(x) for x in leads] + long[of]).astype("<i8")[:, None]], axis=1).tobytes()
    return [heads[24 * i : 24 * i + 24] + rest for i, rest in enumerate(rests)]


def closed(states: Sequence[bytes]) -> list[bytes]:
    """The digests (16 bytes) of states that have read everything."""
    sizes = [int.from_bytes(s[16:24], "little") for s in states]
    pads = [b"\x80" + bytes(-(n + 9) % BLOCK) + (8 * n % 2**64).to_bytes(8, "little") for n in sizes]
    return [s[:16] for s in read_on(states, pads, [b""], [0] * len(pads))]


@F.arrow_udf(BinaryType())
def md5_opened(text: pa.Array) -> pa.Array:
    """State of a new digest that has read ``text``."""
    texts = [t.encode() for t in text.to_pylist()]
    return pa.array(read_on([NEW] * len(texts), [b""] * len(texts), texts, range(len(texts))), pa.binary())
