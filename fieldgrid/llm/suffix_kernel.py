"""Byte-level parts of the repeated-substring search: anchors, and the hash-compared suffix sort.

Prefix polynomial hashes (modulo 2**64, odd base) give the hash of any substring
in constant time, and binary search on them the longest common extension of two
suffixes in logarithmic time. ``sorted_suffixes`` is a bottom-up mergesort whose
comparisons are such extensions, done for a whole level at once; the extensions
of neighbours in the result are verified byte by byte.
"""

from __future__ import annotations

import numpy as np

BASES = [0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7]
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class PrefixHash:
    """hash(start, length) of substrings of a byte buffer, vectorised."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data)
        have = self._powers.get(base)
        if have is None or len(have[0]) < n + 1:
            size = 1 << max(n + 1, 1024).bit_length()
            with np.errstate(over="ignore"):
                up = np.full(size, base, dtype=np.uint64)
                down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
                up[0] = down[0] = 1
                have = self._powers[base] = (np.cumprod(up), np.cumprod(down))
        self.up = have[0]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * have[1][:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[start + length] - self.sums[start]) * self.up[start]


def scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, length: int, gram: int, segment: int = 1 << 20) -> list[np.ndarray]:
    """Rows (g, start, size, mark): every window of ``length`` bytes belongs to the leftmost least gram in it.

    A row holds a run of windows with the same gram: bytes [start, start + size), the gram at start + mark. g names
    the gram. Equal windows have equal grams at equal places, whatever surrounds them."""
    out = []
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, segment):
        piece = data[at : at + segment + length - 1]
        n = len(piece) - gram + 1
        first = PrefixHash(piece)
        h = scramble(first(np.arange(n), gram))
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // width) * width, _ALL)
        padded[:n] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        end = np.r_[begin[1:], len(place)]  # window starts begin..end-1
        size = end - begin + length - 1
        mark = place[begin] - begin
        out.append(np.stack([h[place[begin]].view(np.int64), begin + at, size, mark], axis=1))
    return out


def extension(h: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Longest common extension of the suffixes at a and b, at most ``most`` bytes: binary search on hashes."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = h(a, mid) == h(b, mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def sorted_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[start : start + size] by (group, bytes), and each one's common extension with the one before."""
    h = PrefixHash(data, BASES[base])
    padded = np.r_[data, np.uint8(0)]

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Is suffix j before suffix i (strictly)?"""
        most = np.where(group[i] == group[j], np.minimum(size[i], size[j]), 0)
        e = extension(h, start[i], start[j], most)
        ci = np.where(e < size[i], padded[start[i] + np.minimum(e, size[i])].astype(np.int64) + 1, 0)
        cj = np.where(e < size[j], padded[start[j] + np.minimum(e, size[j])].astype(np.int64) + 1, 0)
        return np.where(group[i] == group[j], cj < ci, group[j] < group[i])

    n = len(start)
    order = np.argsort(group, kind="stable")
    run = 1
    while run < n:
        pair = np.arange(n) // (2 * run) * (2 * run)
        left = np.flatnonzero(np.arange(n) - pair < run)
        lo = pair[left] + run  # the right run of the pair: lo .. hi - 1
        hi = np.minimum(pair[left] + 2 * run, n)
        base_, low, high = lo, np.minimum(lo, n), np.maximum(hi, np.minimum(lo, n))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) >> 1
            before = less(order[left[open_]], order[mid])
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        target = np.full(n, -1)
        target[left + np.where(lo < n, low - base_, 0)] = order[left]
        right = np.setdiff1d(np.arange(n), left, assume_unique=True)
        target[target < 0] = order[right]
        order = target
        run *= 2
    i, j = order[1:], order[:-1]
    common = np.r_[0, extension(h, start[i], start[j], np.where(group[i] == group[j], np.minimum(size[i], size[j]), 0))].astype(np.int64)
    raw = data.tobytes()
    for a, b, e in zip(start[i].tolist(), start[j].tolist(), common[1:].tolist(), strict=True):
        if raw[a : a + e] != raw[b : b + e]:
            if base + 1 == len(BASES):
                raise ValueError("hash collisions under all bases")
            return sorted_suffixes(data, start, size, group, base + 1)
    return order, common


def repeated_runs(group: np.ndarray, texts: list[bytes], mark: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) in each text: the union of its windows that another text of its group has at the same place before its mark.

    Suffixes from the marks and reversed prefixes before them are sorted. Two windows that reach a bytes to the left
    are equal if the texts agree for a bytes to the left and length - a to the right, that is, if they lie in one
    class of either order at that depth. All of them hold the mark, so the union is one interval."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.r_[0, np.cumsum(sizes)[:-1]] + mark
    after, before = sizes - mark, mark
    right, rcommon = sorted_suffixes(data, at, after, group)
    left, lcommon = sorted_suffixes(data[::-1].copy(), len(data) - at, before, group)

    def best(order: np.ndarray, common: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[order] = np.maximum(common, np.r_[common[1:], 0])
        return out

    reach_r, reach_l = np.minimum(best(right, rcommon), after), np.minimum(best(left, lcommon), before)
    low, high = np.full(n, -1), np.full(n, -1)
    first, last = np.maximum(length - reach_r, 0), np.minimum(reach_l, length)
    able = np.flatnonzero(first <= last)
    if len(able):
        for a in range(int(first[able].min()), int(last[able].max()) + 1):
            rows = able[(first[able] <= a) & (a <= last[able])]
            if len(rows) < 2:
                continue
            rclass, lclass = np.empty(n, np.int64), np.empty(n, np.int64)
            # at depth 0 all texts of a group agree; groups stay apart through the other order or their own border
            border = np.r_[True, group[right][1:] != group[right][:-1]]
            rclass[right] = np.cumsum((rcommon < length - a) | border)
            border = np.r_[True, group[left][1:] != group[left][:-1]]
            lclass[left] = np.cumsum((lcommon < a) | border)
            _, inverse, count = np.unique(rclass[rows] * (n + 1) + lclass[rows], return_inverse=True, return_counts=True)
            hit = rows[count[inverse] > 1]
            high[hit] = np.maximum(high[hit], a)
            low[hit] = np.where(low[hit] < 0, a, low[hit])
    return np.where(high >= 0, mark - high, -1), np.where(high >= 0, mark - low + length, -1)
