"""Runs of windows with a common anchor: how equal byte windows are brought together.

A window is WIDTH bytes. Its anchor is the least hash of its GRAM-byte strings, so equal windows
have equal anchors. Consecutive windows with the same anchor form a run; the bytes of its windows
are its fragment.
"""

from __future__ import annotations

import numpy as np

from .common import mix

WIDTH, GRAM = 200, 64
GRAMS = WIDTH - GRAM + 1

_B = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_B, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 21)
        known = np.empty(size, np.uint64)
        known[0] = 1
        known[1:] = base
        np.multiply.accumulate(known, out=known)
        _powers[base] = known
    return known[:n]


def window_hashes(data: bytes, seed: int) -> np.ndarray:
    """A 64-bit hash of each WIDTH-byte window of one text; different seeds, independent hashes."""
    x = np.frombuffer(data, np.uint8)
    coded = mix(_TABLE + np.uint64(seed))[x]
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(coded * _power(_INVERSE, len(x)), out=total[1:])
    return mix((total[WIDTH:] - total[:-WIDTH]) * _power(_B, len(x) + 1)[: len(x) - WIDTH + 1])


def slide(x: np.ndarray, w: int, of: np.ufunc) -> np.ndarray:
    """Minimum or maximum (`of`) of each w consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    fill = np.iinfo(np.uint64).max if of is np.minimum else 0
    blocks = np.concatenate([x, np.full(pad, fill, np.uint64)]).reshape(-1, w)
    ahead = of.accumulate(blocks, axis=1).ravel()
    back = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[:n], ahead[w - 1 : w - 1 + n])


class Runs:
    """The runs of several texts: text number, first window, windows, anchor, fragment hash, how
    often the anchor's string stands in the fragment (ties), and where it first does (at)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        empty = np.empty(0, np.int64)
        self.text = self.first = self.count = self.ties = self.at = empty
        self.anchor = self.fragment = empty.astype(np.uint64)
        if len(data) < WIDTH:
            return
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * _power(_INVERSE, len(data)), out=total[1:])
        power = _power(_B, len(data) + 1)
        grams = mix((total[GRAM:] - total[:-GRAM]) * power[: len(data) - GRAM + 1])
        least = slide(grams, GRAMS, np.minimum)
        windows = len(least)
        # windows that lie within one text
        inside = np.zeros(windows + 1, np.int64)
        for a, b in zip(ends - sizes, ends, strict=True):
            if b - a >= WIDTH:
                inside[a] += 1
                inside[b - WIDTH + 1] -= 1
        valid = np.cumsum(inside[:-1]) > 0
        turn = np.empty(windows, bool)
        turn[0] = True
        turn[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
        starts = ends - sizes
        turn[starts[starts < windows]] = True
        first = np.flatnonzero(turn)
        stop = np.append(first[1:], windows)
        good = valid[first]
        first, stop = first[good], stop[good]
        # a run ends where its text's windows end
        owner = np.searchsorted(ends, first, side="right")
        stop = np.minimum(stop, ends[owner] - WIDTH + 1)
        self.text, self.first, self.count = owner, first - (ends - sizes)[owner], stop - first
        self.anchor = least[first]
        length = stop - first + WIDTH - 1
        self.fragment = mix(mix((total[first + length] - total[first]) * power[first]) + length.astype(np.uint64))
        # places of the anchor's string within each fragment
        peak = slide(np.concatenate([np.zeros(GRAMS - 1, np.uint64), least, np.zeros(GRAMS - 1, np.uint64)]), GRAMS, np.maximum)
        spots = np.flatnonzero(grams == peak[: len(grams)])
        low, high = np.searchsorted(spots, first), np.searchsorted(spots, stop - 1 + GRAMS)
        each = np.repeat(np.arange(len(first)), high - low)
        at = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        same = grams[spots[at]] == self.anchor[each]
        self.ties = np.bincount(each, same, len(first)).astype(np.int64)
        hit = np.flatnonzero(same)
        lead = np.full(len(first), -1, np.int64)
        lead[each[hit][::-1]] = spots[at[hit]][::-1]
        self.at = lead - first
