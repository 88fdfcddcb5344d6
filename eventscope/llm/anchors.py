"""Content-chosen anchors: every window of ``length`` bytes names one place inside it.

The anchor of a window is the leftmost least hash of its ``k``-byte pieces, so equal
windows have equal anchors at equal distances.  Consecutive windows mostly share theirs;
such a *run* of windows is the unit that is compared.
"""

from __future__ import annotations

import numpy as np

from eventscope.llm.common import mix64, powers, prefix_hash

PLACE_BITS = 22     # blocks are shorter than this; a longer text is cut into pieces


def runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int
         ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window start, last window start, anchor hash and text number of all runs."""
    return placed_runs(data, offsets, length, k)[:4]


def placed_runs(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """The :func:`runs`, and where the anchor of each lies."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, np.zeros(0, np.uint64), empty, empty
    _, down = powers(len(data) + 1)
    prefix = prefix_hash(data)
    n = len(data) - k + 1
    h = prefix[k:] - prefix[:n]
    h *= down[:n]
    h = mix64(h)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, span = length - k + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    anchor = (least & low).astype(np.int64)
    # windows that lie in one text
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    inside = np.arange(len(anchor)) + length <= offsets[1:][text]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
    last = inside.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:] | (text[1:] != text[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    return lo, hi, h[anchor[lo]], text[lo], anchor[lo]
