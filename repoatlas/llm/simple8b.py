"""Simple-8b: unsigned integers packed into 64-bit words.

The top four bits of a word are its selector, which says how many integers the other sixty
bits hold and how wide each is; the first integer has the lowest bits. Selector 15 is a run of
240 zeros. Selector 0 is an escape: the integer needs more than sixty bits and is the next one
of a list kept beside the words. Packing is greedy, so a word takes as many integers as fit.
The last word may have room for more integers than there are; a reader knows their number.

Both directions work on whole arrays: an array of words is split by selector, and the words of
one selector are packed or unpacked together.
"""

from __future__ import annotations

import numpy as np

ESCAPE, ZEROS = 0, 15
#: Fixed values of the format: (integers in a word, bits of each), by selector.
LAYOUTS = (
    (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7),
    (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (240, 0),
)
COUNTS = np.array([count for count, _ in LAYOUTS], np.int64)
SELECTOR_AT = np.uint64(60)
#: Selectors from the narrowest integers to the widest, and the first integer too wide for each.
BY_WIDTH = (ZEROS, *range(1, 15), ESCAPE)
LIMITS = np.array([1 << LAYOUTS[s][1] for s in BY_WIDTH[:-1]], np.uint64)
#: Place in BY_WIDTH of every integer below this is looked up.
TABLE = 1 << 17
WIDTH_CLASS = np.searchsorted(LIMITS, np.arange(TABLE, dtype=np.uint64), "right").astype(np.uint8)


def width_classes(values: np.ndarray) -> np.ndarray:
    """Per integer the place in BY_WIDTH of the narrowest selector that holds it."""
    if len(values) and int(values.max()) < TABLE:
        return WIDTH_CLASS[values]
    return np.searchsorted(LIMITS, values, "right").astype(np.uint8)


def _windows(fits: np.ndarray, count: int) -> np.ndarray:
    """Whether all of the next ``count`` places fit; places beyond the end do."""
    n, out, have = len(fits), fits.copy(), 1
    while have < count:
        step = min(have, count - have)  # two windows of ``have`` places make one of ``have + step``
        if step < n:
            out[: n - step] &= out[step:].copy()
        have += step
    return out


def word_starts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and its selector: at every place the most integers that fit."""
    n = len(values)
    kinds = width_classes(values)
    best = np.full(n, ESCAPE, np.uint8)
    for place in range(len(BY_WIDTH) - 2, int(kinds.min()) - 1, -1):
        fits = _windows(kinds <= place, LAYOUTS[BY_WIDTH[place]][0])
        if not fits.any():
            break  # narrower integers and longer runs fit nowhere either
        best[fits] = BY_WIDTH[place]
    steps = COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    return starts, best[starts]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and escaped integers (both ``uint64``) of an array of unsigned integers."""
    values = np.asarray(values)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts, selectors = word_starts(values)
    padded = np.zeros(len(values) + 240, np.uint64)
    padded[: len(values)] = values
    words = selectors.astype(np.uint64) << SELECTOR_AT
    for selector in np.unique(selectors).tolist():
        if selector in (ESCAPE, ZEROS):
            continue
        count, bits = LAYOUTS[selector]
        mine = np.flatnonzero(selectors == selector)
        first = starts[mine]
        packed = words[mine]
        for i in range(count):
            packed |= padded[first + i] << np.uint64(bits * i)
        words[mine] = packed
    return words, padded[starts[selectors == ESCAPE]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers (``uint64``) that ``encode`` packed."""
    if not n:
        return np.zeros(0, np.uint64)
    selectors = (words >> SELECTOR_AT).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    starts = ends - counts
    if ends[-1] < n or (n <= starts[-1]):
        raise ValueError(f"words of {int(ends[-1])} integers cannot hold {n}")
    out = np.zeros(int(ends[-1]), np.uint64)
    for selector in np.unique(selectors).tolist():
        mine = selectors == selector
        first = starts[mine]
        if selector == ESCAPE:
            out[first] = escapes
        elif selector != ZEROS:
            count, bits = LAYOUTS[selector]
            mask, own = np.uint64((1 << bits) - 1), words[mine]
            for i in range(count):
                out[first + i] = (own >> np.uint64(bits * i)) & mask
    return out[:n]
