"""Repeated strings of a fixed length by a Burrows-Wheeler transform: interval expansion bounded by the length."""

from __future__ import annotations

import numpy as np

#: Symbols: the end of all pieces, the end of a piece, then the bytes that occur.
_LAST, _END, _FIRST = 0, 1, 2


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``codes`` in the order of their first ``depth`` symbols, by doubling; only tied ones are sorted again."""
    n = len(codes)
    bits = int(codes.max()).bit_length()
    known = 63 // bits
    key = np.zeros(n + known, np.int64)
    wide = np.zeros(n + known, np.int64)
    wide[:n] = codes
    for j in range(known):
        key[:n] = (key[:n] << bits) | wide[j : j + n]
    key = key[:n]
    order = np.argsort(key)
    sorted_ = key[order]
    first = np.r_[True, sorted_[1:] != sorted_[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    while known < depth:
        tied = np.flatnonzero(~first | ~np.r_[first[1:], True])
        if not len(tied):
            break
        step = min(known, depth - known)
        at = order[tied]
        after = at + step
        then = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + then
        by = np.argsort(pair)
        order[tied], pair = at[by], pair[by]
        new = np.r_[True, pair[1:] != pair[:-1]]
        first[tied] = new
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        known += step
    return order


class Transform:
    """The transform of a text with the ranks of its symbols, as a wavelet matrix."""

    def __init__(self, codes: np.ndarray, order: np.ndarray):
        n = len(codes)
        self.codes = codes[order - 1].astype(np.int16)
        symbols = int(codes.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(codes, minlength=symbols))]
        self.back = np.empty(n, np.int32)
        self.back[np.argsort(self.codes, kind="stable")] = np.arange(n, dtype=np.int32)
        self.levels = []
        current = self.codes
        start = np.zeros(symbols, np.int64)
        for level in range(int(symbols - 1).bit_length() - 1, -1, -1):
            bit = (current >> level) & 1
            zeros = np.zeros(n + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.levels.append((zeros, int(zeros[-1])))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
            ones = (np.arange(symbols) >> level) & 1
            start = np.where(ones == 0, zeros[start], zeros[-1] + start - zeros[start])
        self.start = start

    def extend(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all strings with one byte more in front; ends of pieces are left out."""
        one = high - low == 1
        alone = low[one]
        alone = self.back[alone[self.codes[alone] >= _FIRST]]
        l, h = low[~one], high[~one]
        symbol = np.zeros(len(l), np.int64)
        for zeros, total in self.levels:
            zl, zh = zeros[l].astype(np.int64), zeros[h].astype(np.int64)
            l1, h1 = total + l - zl, total + h - zh
            left, right = zh > zl, h1 > l1
            l, h = np.concatenate([zl[left], l1[right]]), np.concatenate([zh[left], h1[right]])
            symbol = np.concatenate([symbol[left] * 2, symbol[right] * 2 + 1])
        keep = symbol >= _FIRST
        symbol = symbol[keep]
        move = self.before[symbol] - self.start[symbol]
        return np.concatenate([alone, l[keep] + move]), np.concatenate([alone + 1, h[keep] + move])


def long_prefixes(codes: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place of ``order`` whether its suffix shares ``depth`` symbols or more with the one before.

    Strings grow by one symbol in front a round, breadth first: the intervals of round ``l`` end where the common prefix is ``l`` long, so
    prefixes become known by increasing length, and what is open after ``depth`` rounds is at least that long. Places whose
    common prefix meets the end of a piece stay open too; the caller leaves those out.
    """
    n = len(codes)
    text = Transform(codes, order)
    open_ = np.ones(n + 1, bool)
    open_[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        low, high = text.extend(low, high)
        new = open_[high]
        low, high = low[new], high[new]
        open_[high] = False
        if not len(low):
            break
    return open_[:n]


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, the starts of its strings of ``length`` bytes that also start elsewhere in the pieces, ascending."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    if not len(sizes) or not (sizes >= length).any():
        return [np.zeros(0, np.int64) for _ in pieces]
    joined = np.frombuffer(b"\x00".join(pieces) + b"\x00\x00", np.uint8)
    ends = np.cumsum(sizes + 1) - 1  # the byte after each piece
    inside = np.ones(len(joined), bool)
    inside[ends] = False
    inside[-1] = False
    used = np.zeros(256, bool)
    used[joined[inside]] = True
    number = np.zeros(256, np.int64)
    number[used] = np.arange(_FIRST, _FIRST + used.sum())
    codes = np.where(inside, number[joined], _END)
    codes[-1] = _LAST
    order = suffix_order(codes, length)
    starts = ends - sizes
    whole = np.zeros(len(codes) + 1, np.int32)  # places with ``length`` bytes left in their piece
    enough = sizes >= length
    np.add.at(whole, starts[enough], 1)
    np.add.at(whole, ends[enough] - length + 1, -1)
    whole = np.cumsum(whole)[:-1] > 0
    same = long_prefixes(codes, order, length)
    same[1:] &= whole[order[1:]] & whole[order[:-1]]
    hit = np.zeros(len(codes), bool)
    hit[order[same]] = True
    hit[order[np.flatnonzero(same) - 1]] = True
    places = np.flatnonzero(hit)
    owner = np.searchsorted(ends, places, side="right")
    cut = np.searchsorted(owner, np.arange(len(pieces) + 1))
    return [places[cut[i] : cut[i + 1]] - starts[i] for i in range(len(pieces))]
