"""Letters of a text as an array: lower case, everything else a single space."""

from __future__ import annotations

import numpy as np

SPACE = 32
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For every code point, its lower-case letter, or a space; made once per process."""
    if not _FOLD:
        points = np.arange(0x110000, dtype=np.uint32)
        out = np.full(0x110000, SPACE, np.uint32)
        for p in points.tolist():
            if not 0xD800 <= p < 0xE000 and (c := chr(p)).isalpha():
                out[p] = ord(c.lower()[0])
        _FOLD.append(out)
    return _FOLD[0]


def folded(text: str) -> np.ndarray:
    """Code points of the text's letters in lower case, runs of others as one space.

    It begins and ends with a space, if it has a letter at all; else it is empty.
    """
    raw = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = raw != SPACE
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first space after a letter
    out = raw[keep]
    return np.concatenate(([SPACE], out, [] if out[-1] == SPACE else [SPACE])).astype(np.uint32)


def words(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return folded(text).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split(" ")[1:-1]
