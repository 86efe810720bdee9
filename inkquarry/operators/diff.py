"""Word-level comparison of two texts: common ends, a shortest edit script between them, at any length."""

from __future__ import annotations

from collections import defaultdict
from math import isqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a word from which on its bits are kept instead of put together for each row.
_OFTEN = 8


def matching(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words of a shortest edit script.

    A longest common subsequence by bit vectors: a row for each word of ``a``, a bit for each word of ``b``, so time is
    n m over the size of a machine word. Rows are kept at every sqrt(n), those between are computed again on the way back.
    """
    n, m = len(a), len(b)
    places: dict[str, list[int]] = defaultdict(list)
    for j, w in enumerate(b):
        places[w].append(j)
    kept: dict[str, int] = {}

    def row(v: int, w: str) -> int:
        at = places.get(w)
        if at is None:
            return v
        bits = kept.get(w)
        if bits is None:
            bits = sum(1 << j for j in at)
            if len(at) >= _OFTEN:
                kept[w] = bits
        u = v & bits
        return ((v + u) | (v - u)) & full

    full = (1 << m) - 1
    step = isqrt(n) + 1
    marks = []
    v = full
    for i, w in enumerate(a):
        if i % step == 0:
            marks.append(v)
        v = row(v, w)
    pairs = []
    i, j = n, m
    while marks and i and j:
        # rows[k] is what stands after first + k words; a zero bit is a word more in common
        first = (len(marks) - 1) * step
        rows = [marks.pop()]
        for w in a[first:i]:
            rows.append(row(rows[-1], w))
        while i > first and j:
            if rows[i - first] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i - first] >> (j - 1) & 1:
                    j -= 1
                    pairs.append((i, j))
    return pairs[::-1]


def changes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(kind, first and end in a, first and end in b): inserted, deleted or replaced stretches in order."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    same = matching(x, y)
    out = []
    i = j = 0
    for p, q in [*same, (len(x), len(y))]:
        if p > i or q > j:
            out.append(("replaced" if p > i and q > j else "deleted" if p > i else "inserted", lo + i, lo + p, lo + j, lo + q))
        i, j = p + 1, q + 1
    return out


def compare(old: DataFrame, new: DataFrame, key: str = "pair_id") -> DataFrame:
    """``key, seq, kind, old_text, new_text, old_at, new_at`` for pairs of texts ``key, text``.

    One row for each side of a pair meets by key, so no group is larger than one pair of texts. A missing or null text is empty.
    """
    pairs = old.select(key, F.col("text").alias("a")).join(new.select(key, F.col("text").alias("b")), key, "full_outer")

    def run(frames):
        for f in frames:
            rows = []
            for k, s, t in zip(f[key], f["a"], f["b"], strict=True):
                a, b = (s or "").split(), (t or "").split()
                rows += [(k, n, kind, " ".join(a[i:j]), " ".join(b[p:q]), i, p) for n, (kind, i, j, p, q) in enumerate(changes(a, b))]
            yield pd.DataFrame(rows, columns=[key, "seq", "kind", "old_text", "new_text", "old_at", "new_at"])

    return pairs.mapInPandas(run, f"{key} bigint, seq int, kind string, old_text string, new_text string, old_at int, new_at int")


def change_counts(diff: DataFrame, key: str = "pair_id") -> DataFrame:
    return diff.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("replaced", "inserted", "deleted")))


def report(diff: DataFrame, key: str = "pair_id") -> DataFrame:
    line = F.when(F.col("kind") == "inserted", F.concat(F.lit("+ "), "new_text")).when(F.col("kind") == "deleted", F.concat(F.lit("- "), "old_text")).otherwise(F.concat(F.lit("~ "), "old_text", F.lit(" -> "), "new_text"))
    return diff.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def first_changes(diff: DataFrame, most: int = 500, key: str = "pair_id") -> DataFrame:
    """The first changes of each pair, in order."""
    return diff.where(F.col("seq") < most)


#: Pixels of two pages are compared in cells of this side; cells one apart belong together.
CELL = 8


def visual_regions(pairs: DataFrame, tolerance: int = 16, key: str = "pair_id") -> DataFrame:
    """``key, x0, y0, x1, y1``: regions in which two images differ by more than the tolerance in some channel.

    ``pairs``: key, width_a, height_a, a, width_b, height_b, b with four bytes for a pixel. Pages of different size are
    compared where both have pixels, the rest differs. A pair is one row, so an image is the most a task holds.
    """
    import numpy as np

    def grid(a: bytes, wa: int, ha: int, b: bytes, wb: int, hb: int) -> np.ndarray:
        w, h = max(wa, wb), max(ha, hb)
        x, y = np.frombuffer(a, np.uint8).reshape(ha, wa, 4).astype(np.int16), np.frombuffer(b, np.uint8).reshape(hb, wb, 4).astype(np.int16)
        differs = np.ones((h, w), bool)
        hw, hh = min(wa, wb), min(ha, hb)
        differs[:hh, :hw] = (np.abs(x[:hh, :hw] - y[:hh, :hw]) > tolerance).any(axis=2)
        rows, cols = -(-h // CELL), -(-w // CELL)
        padded = np.zeros((rows * CELL, cols * CELL), bool)
        padded[:h, :w] = differs
        return padded.reshape(rows, CELL, cols, CELL).any(axis=(1, 3))

    def components(cells: np.ndarray) -> list[tuple[int, int, int, int]]:
        left = {(int(r), int(c)) for r, c in zip(*np.nonzero(cells), strict=True)}
        found = []
        while left:
            todo = [left.pop()]
            box = [todo[0][0], todo[0][1], todo[0][0], todo[0][1]]
            while todo:
                r, c = todo.pop()
                box = [min(box[0], r), min(box[1], c), max(box[2], r), max(box[3], c)]
                for dr in range(-2, 3):
                    for dc in range(-2, 3):
                        if (r + dr, c + dc) in left:
                            left.remove((r + dr, c + dc))
                            todo.append((r + dr, c + dc))
            found.append((box[1] * CELL, box[0] * CELL, (box[3] + 1) * CELL, (box[2] + 1) * CELL))
        return sorted(found)

    def run(frames):
        for f in frames:
            rows = []
            for k, wa, ha, a, wb, hb, b in zip(*(f[c] for c in (key, "width_a", "height_a", "a", "width_b", "height_b", "b")), strict=True):
                w, h = max(wa, wb), max(ha, hb)
                rows += [(k, x0, y0, min(x1, w), min(y1, h)) for x0, y0, x1, y1 in components(grid(a, wa, ha, b, wb, hb))]
            yield pd.DataFrame(rows, columns=[key, "x0", "y0", "x1", "y1"])

    return pairs.mapInPandas(run, f"{key} bigint, x0 int, y0 int, x1 int, y1 int")
