"""Sorted runs of strings: front coding, and merging them without comparing a known prefix again.

A run holds sorted strings, each as the length of the prefix that it shares with
the one before and the bytes after that.  A loser tree merges runs: each loser
remembers how long a prefix it shares with the string that beat it, which is the
last one that went out.  Of two candidates the one that shares more with that
string is the smaller; only where both share equally much are bytes compared,
from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CODEC = "zstd"


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree in their first ``start`` bytes."""
    n, i = min(len(a), len(b)), start
    while i < n and a[i : i + 64] == b[i : i + 64]:
        i += 64
    if i >= n:
        return n
    x, y = a[i : min(i + 64, n)], b[i : min(i + 64, n)]
    if x == y:
        return n
    return i + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_code(keys: list[bytes], ids: list[int]) -> bytes:
    """A run of sorted ``keys`` of at most 65535 bytes with a 64-bit number each."""
    n = len(keys)
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=n)
    width = int(sizes.max())
    rows = np.zeros((n, width), dtype=np.uint8)
    place = np.arange(width)[None, :] < sizes[:, None]
    rows[place] = np.frombuffer(b"".join(keys), dtype=np.uint8)
    shared = np.zeros(n, dtype=np.int64)
    if n > 1:
        other = rows[1:] != rows[:-1]
        shared[1:] = np.where(other.any(axis=1), other.argmax(axis=1), width)
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    rest = rows[place & (np.arange(width)[None, :] >= shared[:, None])]
    parts = (np.array(ids, dtype=np.int64).tobytes(), shared.astype(np.uint16).tobytes(), (sizes - shared).astype(np.uint16).tobytes(), rest.tobytes())
    raw = n.to_bytes(4, "little") + b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, int]]:
    """(key, id, length of the prefix shared with the key before)."""
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec=_CODEC, asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    at = 4 + 12 * n
    ids = np.frombuffer(raw, np.int64, n, 4).tolist()
    shared = np.frombuffer(raw, np.uint16, n, 4 + 8 * n).tolist()
    rest = np.frombuffer(raw, np.uint16, n, 4 + 10 * n).tolist()
    key = b""
    for i, s, r in zip(ids, shared, rest, strict=True):
        key = key[:s] + raw[at : at + r]
        at += r
        yield key, i, s


def merge(runs: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """All strings of the runs in order: (key, id, length of the prefix shared with the key that came out before)."""
    k = len(runs)
    heads: list[tuple[bytes, int] | None] = [None] * k
    shared = [0] * k  # of each head with the last key that came out, as far as it is known

    def advance(r: int) -> None:
        got = next(runs[r], None)
        heads[r] = None if got is None else (got[0], got[1])
        shared[r] = -1 if got is None else got[2]

    def beats(a: int, b: int) -> bool:
        """Whether the head of run ``a`` comes before that of ``b``; the loser then knows what it shares with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return x > y
        if x < 0:
            return a < b  # both at their end
        p, q = heads[a][0], heads[b][0]
        n = common_prefix(p, q, x)
        first = len(p) <= n or (len(q) > n and p[n] < q[n])
        shared[b if first else a] = n
        return first

    losers = [-1] * k
    for r in range(k):
        advance(r)
        if heads[r] is not None:
            shared[r] = 0

    def play(node: int) -> int:
        """The winner below an inner node; leaves are k to 2k - 1."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b

    top = play(1) if k > 1 else 0
    while k and heads[top] is not None:
        yield heads[top][0], heads[top][1], shared[top]
        advance(top)
        node = (top + k) // 2
        while node >= 1:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2
