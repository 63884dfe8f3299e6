"""Arrow helpers: the UTF-8 bytes of a batch of texts, and classes of characters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Letters a-z (0-25), A-Z (26), digits (27), space (28), line ends (29), other ASCII (30), beyond ASCII (31).
CLASSES = 32
UPPER, DIGIT, SPACE, LINE, MARK, WIDE = range(26, 32)
SKIP = 255  # the later bytes of a character beyond ASCII


def _classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(26)
    out[ord("A") : ord("Z") + 1] = UPPER
    out[ord("0") : ord("9") + 1] = DIGIT
    out[[0x20, 0x09]] = SPACE
    out[[0x0A, 0x0B, 0x0C, 0x0D]] = LINE
    out[0x80:0xC0] = SKIP
    out[0xC0:] = WIDE
    return out


CLASS_OF = _classes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and the n + 1 offsets of its texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each character, and the offsets of the texts in characters."""
    cls = CLASS_OF[data]
    keep = cls != SKIP
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return cls[keep], before[offsets]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each text's values; 0 for an empty text."""
    out = np.zeros(len(offsets) - 1, np.float64)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out
