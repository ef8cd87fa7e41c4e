"""Characters of UTF-8 batches as small codes, for character n-gram kernels."""

from __future__ import annotations

import numpy as np

_TABLES: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Code point -> code point of its lower-case letter; everything that is no letter -> blank."""
    if "letters" not in _TABLES:
        t = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _TABLES["letters"] = t
    return _TABLES["letters"]


def byte_table() -> np.ndarray:
    """Code point -> one byte: ASCII letters (lower-cased) and digits are kept,
    other letters and digits share the upper half, the rest is a blank."""
    if "bytes" not in _TABLES:
        t = np.full(0x110000, 32, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalnum():
                low = c.lower()
                low = ord(low) if len(low) == 1 else cp
                t[cp] = low if low < 128 else 128 + (low * 167 >> 2) % 128
        _TABLES["bytes"] = t
    return _TABLES["bytes"]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, character offsets) of a UTF-8 buffer with byte offsets."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint32), off
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    text = data.tobytes().decode("utf-8", "replace").encode("utf-32-le")
    return np.frombuffer(text, "<u4"), lead[off]


def mapped(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters through a code table, runs of blanks inside a document made one."""
    if len(data) and data.max() < 128:
        x = table[:128][data]
    else:
        cp, off = code_points(data, off)
        x = table[cp]
    blank = x == 32
    keep = np.ones(len(x) + 1, bool)
    keep[1:-1] = ~(blank[1:] & blank[:-1])
    keep[off] = True
    keep = keep[:-1]
    at = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return x[keep], at[off]
