"""Numpy helpers for first-event-anchored windows over one bounded block of rows.

The only state that crosses from one row to the next is the open window's anchor time, or
``UNSET``. A block of rows is therefore a map from the anchor before it to the anchor after it.
For anchored entry states the map is a step function: which row closes the window depends only
on which of the block's rising time records first reaches ``anchor + width``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

UNSET = np.iinfo(np.int64).min
ANY = np.iinfo(np.int64).max


@dataclass
class AnchorMap:
    """Anchor after a block, and windows opened inside it, for every anchor before it.

    No anchor at or above ``below`` can enter, and steps for such anchors are left out.
    Entry ``UNSET`` gives ``unset_exit``. Entry ``a`` takes the first step with ``a <= upto``;
    above the last step the block closes nothing and ``a`` passes through.
    """

    unset_exit: int
    unset_opened: int
    upto: np.ndarray
    exits: np.ndarray
    opened: np.ndarray
    below: int = ANY

    def __call__(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entry = np.asarray(entry, dtype=np.int64)
        unset = entry == UNSET
        step = np.searchsorted(self.upto, entry, side="left")
        closed = ~unset & (step < len(self.upto))
        step = np.where(closed, step, 0)
        exits, opened = entry.copy(), np.zeros(len(entry), dtype=np.int64)
        if len(self.upto):
            exits = np.where(closed, self.exits[step], exits)
            opened = np.where(closed, self.opened[step], opened)
        exits = np.where(unset, self.unset_exit, exits)
        opened = np.where(unset, self.unset_opened, opened)
        return exits, opened

    def then(self, later: AnchorMap) -> AnchorMap:
        """The map of this block followed by a later one."""
        exits, opened = later(np.append(self.exits, self.unset_exit))
        opened = opened + np.append(self.opened, self.unset_opened)
        passed = later.upto > self.upto[-1] if len(self.upto) else np.ones(len(later.upto), bool)
        return AnchorMap(
            int(exits[-1]),
            int(opened[-1]),
            np.concatenate([self.upto, later.upto[passed]]),
            np.concatenate([exits[:-1], later.exits[passed]]),
            np.concatenate([opened[:-1], later.opened[passed]]),
            self.below,
        ).pruned().merged()

    def pruned(self) -> AnchorMap:
        """Without the steps that no entry can take."""
        keep = self.upto[:-1] < self.below
        if keep.all():
            return self
        keep = np.append(True, keep)
        return AnchorMap(
            self.unset_exit, self.unset_opened, self.upto[keep], self.exits[keep], self.opened[keep], self.below
        )

    def merged(self) -> AnchorMap:
        """Join neighbouring steps with the same outcome."""
        if len(self.upto) < 2:
            return self
        last = np.append(
            (self.exits[1:] != self.exits[:-1]) | (self.opened[1:] != self.opened[:-1]), True
        )
        return AnchorMap(
            self.unset_exit, self.unset_opened, self.upto[last], self.exits[last], self.opened[last],
            self.below,
        )


def _first_reaching(ms: np.ndarray, width: int) -> np.ndarray:
    """For each row the first later row with ``ms >= own ms + width``; ``len(ms)`` if none."""
    n = len(ms)
    target = ms + width
    if np.all(ms[1:] >= ms[:-1]):
        return np.searchsorted(ms, target, side="left")
    # Times in any order: maxima over runs of 1, 2, 4, ... rows, then skip runs below the target.
    maxima = [ms]
    while len(maxima[-1]) > (run := 1 << (len(maxima) - 1)):
        maxima.append(np.maximum(maxima[-1][:-run], maxima[-1][run:]))
    at = np.arange(1, n + 1)
    for level in range(len(maxima) - 1, -1, -1):
        inside = at < len(maxima[level])
        below = np.zeros(n, dtype=bool)
        below[inside] = maxima[level][at[inside]] < target[inside]
        at = np.where(below, at + (1 << level), at)
    return at


def block_map(ms: np.ndarray, width: int, entry_below: int | None = None) -> AnchorMap:
    """Map of one block, given the event times of its rows in arrival order.

    ``entry_below``: no anchor at or above this can enter, so later steps are left out.
    """
    n = len(ms)
    closer = _first_reaching(ms, width)
    rows = np.arange(n + 1)
    ends = np.append(closer == n, True)  # the window stays open, or no row is left
    follow = np.where(ends, rows, np.append(closer, 0) + 1)
    hops = np.where(ends, 0, 1)
    while True:  # double the distance walked until every row knows its last window
        further = follow[follow]
        if np.array_equal(further, follow):
            break
        hops = hops + hops[follow]
        follow = further
    final = np.append(ms, UNSET)[follow]
    opened = hops + (follow < n)

    peaks = np.maximum.accumulate(ms)
    rising = np.append(True, peaks[1:] > peaks[:-1])
    record = np.flatnonzero(rising)
    upto = peaks[record] - width
    below = ANY if entry_below is None else entry_below
    m = AnchorMap(int(final[0]), int(opened[0]), upto, final[record + 1], opened[record + 1], below)
    return m.pruned().merged()


def replay(ms: np.ndarray, width: int, anchor: int, window: int):
    """Window number, closer flag and anchor flag of each row, given the state before the block."""
    n = len(ms)
    number = np.empty(n, dtype=np.int64)
    closes = np.zeros(n, dtype=bool)
    opens = np.zeros(n, dtype=bool)
    ordered = bool(np.all(ms[1:] >= ms[:-1]))

    def reach(start: int, target: int) -> int:
        if ordered:
            return start + int(np.searchsorted(ms[start:], target, side="left"))
        run = 1024
        while start < n:
            hit = ms[start : start + run] >= target
            if hit.any():
                return start + int(hit.argmax())
            start, run = start + run, run * 2
        return n

    at = 0
    while at < n:
        if anchor == UNSET:
            anchor, window = int(ms[at]), window + 1
            opens[at] = True
        end = reach(at, anchor + width)
        number[at:end] = window
        if end < n:
            number[end], closes[end], anchor = window, True, UNSET
        at = end + 1
    return number, closes, opens
