"""An FM-index over integer symbols: suffix order, wavelet matrix, sampled suffix positions. numpy, all searches at once.

Symbol 0 is a separator that is in no pattern. Every separator is its own smallest symbol in the suffix order, so a
suffix is told from the others by the first separator at the latest and sorting takes few rounds.
"""

from __future__ import annotations

import numpy as np

SAMPLE_RATE = 8


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of all suffixes in order. ``text`` holds symbols below ``sigma``; it should end with 0."""
    n = len(text)
    bits = max(1, int(sigma).bit_length())
    sep = text == 0
    n_sep = int(sep.sum())
    # first round: as many symbols as fit one 62-bit key; a separator ends the comparison
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    for k in range(width):
        sym = np.zeros(n, np.int64)
        m = max(0, n - k)
        sym[:m] = text[n - m :]
        sym[~alive] = 0
        key = (key << bits) | sym
        alive &= sym != 0
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = start
    # suffixes whose key met a separator are told by where it stands
    nxt = np.full(n + 1, n, np.int64)
    at = np.flatnonzero(sep)
    if n_sep:
        nxt[:n] = np.append(at, n)[np.searchsorted(at, np.arange(n))]
    done = width
    unsorted = np.flatnonzero(~_single(new))
    while len(unsorted):
        pos = order[unsorted]
        ended = nxt[pos] - pos < done
        follow = np.minimum(pos + done, n - 1)
        second = np.where(ended, nxt[pos], n + 1 + rank[follow])
        sub = np.lexsort((second, rank[pos]))
        pos, second = pos[sub], second[sub]
        order[unsorted] = pos
        first = rank[pos]
        fresh = np.ones(len(pos), bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[pos] = unsorted[np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))]
        single = _single(fresh)
        unsorted = unsorted[~single]
        done *= 2
    return order


def _single(new: np.ndarray) -> np.ndarray:
    """Groups of one: a start that is followed by a start."""
    end = np.ones(len(new), bool)
    end[:-1] = new[1:]
    return new & end


class WaveletMatrix:
    """Ranks of symbols in a sequence, with one bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, bits: int) -> None:
        self.bits, self.levels, self.zeros = bits, [], []
        cur = seq.astype(np.int64)
        n = len(cur)
        for level in range(bits - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.levels.append((words, before))
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])

    @staticmethod
    def _ones(level: tuple[np.ndarray, np.ndarray], pos: np.ndarray) -> np.ndarray:
        words, before = level
        w = pos >> 6
        mask = (np.uint64(1) << (pos & 63).astype(np.uint64)) - np.uint64(1)
        return before[w] + np.bitwise_count(words[w] & mask)

    def rank(self, symbol: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        lo, hi = np.zeros(len(pos), np.int64), pos.astype(np.int64)
        for k, level in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access_rank(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before it."""
        symbol, lo, at = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64), pos.astype(np.int64)
        for k, level in enumerate(self.levels):
            words, _ = level
            one = ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, at)
            symbol = symbol * 2 + one
            lo, at = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, at - b)
        return symbol, at - lo


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE_RATE) -> None:
        if len(text) == 0 or text[-1] != 0:
            text = np.append(text, 0)
        self.n = len(text)
        order = suffix_array(text, sigma)
        bwt = text[order - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        counts = np.bincount(text, minlength=sigma + 1)
        self.start = np.concatenate([[0], np.cumsum(counts)])[: sigma + 1]
        # sampled at every k-th position and after separators: the walk back never has to cross one
        keep = (order % sample == 0) | (bwt == 0)
        self.sampled = np.zeros((self.n // 64 + 1) * 64, bool)
        self.sampled[: self.n] = keep
        self.sample_at = np.cumsum(self.sampled) - 1
        self.positions = order[keep]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of all patterns, one row each, by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k].astype(np.int64)
            lo, hi = self.start[c] + self.wavelet.rank(c, lo), self.start[c] + self.wavelet.rank(c, hi)
            hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the nearest sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, steps, left = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            hit = self.sampled[at]
            out[left[hit]] = self.positions[self.sample_at[at[hit]]] + steps[hit]
            left, at, steps = left[~hit], at[~hit], steps[~hit]
            if len(left):
                c, r = self.wavelet.access_rank(at)
                at, steps = self.start[c] + r, steps + 1
        return out
