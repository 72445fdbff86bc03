"""Code points of whole batches: letters, lower case and scripts by table."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

#: First and last code points of the scripts that narrow languages; letters elsewhere are of script 0.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),), "hebrew": ((0x590, 0x5FF),), "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),), "bengali": ((0x980, 0x9FF),), "tamil": ((0xB80, 0xBFF),), "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),), "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)), "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x3FFFF)),
}
POINTS = 0x110000


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is a letter, lower case, script) of each code point."""
    letter = np.fromiter((chr(c).isalpha() for c in range(POINTS)), bool, POINTS)
    lower = np.arange(POINTS, dtype=np.uint32)
    for c in range(0x10000):
        if letter[c] and len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    script = np.zeros(POINTS, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, lower, script


@cache
def marks() -> np.ndarray:
    """Is each code point a combining mark (vowel sign, accent)?"""
    return np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(POINTS)), bool, POINTS)


def points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes and the offsets of the rows in them."""
    own = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begun = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    return own, begun[offsets]
