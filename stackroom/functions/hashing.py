"""FNV-1a of many texts at a time, for Python workers."""

from __future__ import annotations

BASIS, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def code_points(texts: list[str]):
    """(code points of all texts one after the other, where each starts, how many it has)."""
    import numpy as np

    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.cumsum(size) - size, size


def fnv1a(codes, first, size, start: int = BASIS):
    """The 32-bit hashes of runs of code points, from a start that may hold a prefix. One step takes a character of each."""
    import numpy as np

    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    h = np.full(len(size), start, np.uint64)
    longer = len(size) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
    for i, n in enumerate(longer.tolist()):
        h[:n] = ((h[:n] ^ codes[first[:n] + i]) * np.uint64(PRIME)) & np.uint64(MASK)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a_texts(texts: list[str]):
    return fnv1a(*code_points(texts))


def prefix(text: str) -> int:
    """The start that stands for a text before what is hashed."""
    h = BASIS
    for c in text:
        h = ((h ^ ord(c)) * PRIME) & MASK
    return h
