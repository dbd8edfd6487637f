"""The longest stretch of a series whose medians keep their bounds, for series of any length.

A median of small whole numbers is at most a bound, and that of real ones at least a bound, exactly if enough values are on
the right side of it: the n-th value of the sorted stretch decides, so a count does. With a sign a row (+1 right, -1 wrong),
the sums of both sign series over the stretch decide all cases but a tie in the middle of an even stretch, where the mean of two
values decides. Prefix sums bound the length first (a search over minima that only fall), then each shorter length is one
subtraction of prefix sums, and only stretches that are possible look at values.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def middle(values: list[float]) -> float:
    """Median of a sorted list."""
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2.0


class Window:
    """Sorted values of a sliding stretch, by merging blocks: a step costs a search and a shift."""

    def __init__(self, values: list[float], length: int):
        self.all, self.held, self.at, self.length = values, sorted(values[:length]), 0, length

    def to(self, at: int) -> float:
        """Median once the stretch starts at `at`, at or after where it stands."""
        if at - self.at > self.length // 4:
            self.held, self.at = sorted(self.all[at : at + self.length]), at
        while self.at < at:
            del self.held[bisect_left(self.held, self.all[self.at])]
            insort(self.held, self.all[self.at + self.length])
            self.at += 1
        return middle(self.held)


def possible(sums: list[np.ndarray], length: int) -> np.ndarray:
    """Starts of stretches of this length in which neither sign series has a sum below zero: no other stretch has both medians
    on the right side."""
    ok = np.ones(len(sums[0]) - length, bool)
    for s in sums:
        ok &= s[length:] - s[:-length] >= 0
    return np.flatnonzero(ok)


def longest_possible(sums: list[np.ndarray]) -> int:
    """An upper bound of the length: the longest stretch that each sign series alone allows. The least prefix sum before a
    place only falls and the greatest after it only rises, so two pointers meet every candidate once."""
    out = len(sums[0]) - 1
    for s in sums:
        low = np.minimum.accumulate(s)  # the first place where a sum as low has been reached
        first = np.searchsorted(-low, -s, "left")  # low only falls
        out = min(out, int((np.arange(len(s)) - first).max()))
    return out


def best_stretch(low: list[float], high: list[float], most: float, least: float, shortest: int = 6) -> tuple[int, int, float, float] | None:
    """(start, length, median of low, median of high) of the longest stretch of `shortest` or more rows whose median of `low` is
    at most `most` and of `high` at least `least`; of equally long ones the least median of low, then the greatest of high,
    then the first. None if there is none."""
    signs = [np.where(np.asarray(low) <= most, 1, -1), np.where(np.asarray(high) >= least, 1, -1)]
    sums = [np.concatenate([[0], np.cumsum(s)]) for s in signs]
    length = min(longest_possible(sums), len(low))
    while length >= shortest:
        at = possible(sums, length)
        if len(at):
            a, b = Window(low, length), Window(high, length)
            fits = [(x, -y, k) for k in at.tolist() if (x := a.to(k)) <= most and (y := b.to(k)) >= least]
            if fits:
                x, y, k = min(fits)
                return k, length, x, -y
        length -= 1
    return None
