"""Whole numbers as bytes of seven bits each, the low ones first; the highest bit says that more bytes follow."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each value ends among them) of numbers from 0 up."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    shift = 7
    while shift < 64 and (more := values >> np.uint64(shift) != 0).any():
        width += more
        shift += 7
    ends = np.cumsum(width)
    begins = ends - width
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > k)
        out[begins[has] + k] = (values[has] >> np.uint64(7 * k) & np.uint64(127)) | ((width[has] > k + 1).astype(np.uint64) << np.uint64(7))
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    """The numbers of whole packed values."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.int64)
    begins = np.append(0, ends[:-1] + 1)
    shifts = 7 * (np.arange(len(data)) - np.repeat(begins, ends - begins + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shifts, begins)
